"""Shot and narrative classification, motion guidance, pacing and transitions."""

from ..plans.relation import quote, relation
from .text import WORD_VISUAL, words_in
from .timeline import cell, in_cells

#: Shot rules in their order of precedence.
SHOTS = [
    ("map", ("map", "maps", "atlas", "geography", "geographic", "route", "routes", "border", "borders", "territory", "territories")),
    ("document", ("document", "documents", "letter", "letters", "record", "records", "newspaper", "newspapers", "headline", "headlines", "manuscript", "certificate", "report", "reports", "file", "files", "chart", "charts")),
    ("portrait", ("portrait", "person", "people", "individual", "face", "man", "men", "woman", "women", "leader", "leaders", "president", "king", "queen", "doctor", "nurse", "judge", "officer")),
    ("archive", ("archive", "archival", "vintage", "historic", "historical", "black-and-white", "photograph", "photographs", "footage")),
    ("establishing", ("establishing", "exterior", "skyline", "cityscape", "landscape", "building", "buildings", "hospital", "street", "streets", "location", "overview", "aerial")),
    ("detail", ("close-up", "detail", "evidence", "artifact", "artifacts", "object", "objects", "gavel", "weapon", "hand", "hands")),
    ("wide", ("wide", "panorama", "panoramic", "crowd", "crowds", "room", "interior", "group", "groups")),
]

#: Narrative rules in their order of precedence: phrases and keywords.
NARRATIVES = [
    ("climax", ("turning point", "final confrontation", "decisive moment", "highest point"), ("culmination", "decisive", "peak", "verdict", "breakthrough")),
    ("reveal", ("came to light", "for the first time", "it emerged"), ("discover", "discovered", "discovery", "reveal", "revealed", "uncovered", "exposed", "disclosed")),
    ("escalation", ("grew worse", "became urgent", "rising tension"), ("danger", "conflict", "crisis", "urgent", "urgency", "tension", "threat", "worsened", "violence", "risk")),
    ("explanation", ("this means", "as a result", "the reason", "in other words"), ("because", "explains", "explanation", "process", "therefore", "why", "how")),
    ("reflection", ("looking back", "in retrospect", "years later"), ("remember", "remembered", "reflection", "legacy", "aftermath", "contemplate", "impact")),
    ("conclusion", ("in the end", "to conclude", "in conclusion", "the story ends"), ("finally", "conclusion", "ultimately", "closing", "summary", "ended")),
    ("introduction", ("this is the story", "our story begins", "the story begins"), ("introduce", "introduction", "begins", "beginning", "opens")),
    ("context", ("at the time", "years before", "historical background"), ("background", "history", "before", "previously", "origin", "context", "earlier")),
]

#: Camera presets by shot and by narrative intent.
SHOT_PRESETS = [("establishing", "slow_pull_out"), ("wide", "slow_pull_out"), ("portrait", "subject_push_in"), ("detail", "focus_reveal"), ("document", "documentary_float"), ("map", "focus_reveal"), ("archive", "documentary_float")]
NARRATIVE_PRESETS = [("introduction", "safe_push_in"), ("context", "documentary_float"), ("explanation", "documentary_float"), ("development", "documentary_float"), ("escalation", "subject_push_in"), ("reveal", "focus_reveal"), ("climax", "focus_reveal"), ("reflection", "slow_pull_out"), ("conclusion", "slow_pull_out")]

#: Pacing profiles: hold, ease in, peak, ease out, settle.
PACING = [("context_calm", 0.14, 0.26, 0.18, 0.27, 0.15), ("introduction_smooth", 0.08, 0.22, 0.28, 0.27, 0.15), ("development_dynamic", 0.04, 0.16, 0.38, 0.28, 0.14), ("conclusion_settled", 0.10, 0.25, 0.15, 0.28, 0.22)]
PROFILE = """case when narrative_intent = 'introduction' then 'introduction_smooth' when narrative_intent in ('context', 'explanation') then 'context_calm'
  when narrative_intent in ('reflection', 'conclusion') then 'conclusion_settled' else 'development_dynamic' end"""


@relation(public=False)
def shot_rules(d):
    return d.values("r", ("rule", "priority", "keyword"), [(n, i, w) for i, (n, ws) in enumerate(SHOTS) for w in ws])


@relation(public=False)
def shot_presets(d):
    return d.values("r", ("shot", "shot_preset"), SHOT_PRESETS)


@relation(public=False)
def narrative_presets(d):
    return d.values("r", ("narrative", "narrative_preset"), NARRATIVE_PRESETS)


@relation(public=False)
def pacing_profiles(d):
    return d.values("r", ("profile", "hold", "ease_in", "peak", "ease_out", "settle"), PACING)


@relation("scenes", public=False)
def visual_tokens(d):
    return f"select project_id, scene_index, scene_count, lower(voiceover_text) as low, {d.distinct(d.tokens('lower(voiceover_text)', WORD_VISUAL))} as words from scenes"


@relation("visual_tokens", "shot_rules")
def rule_x_scene(d):
    """Scenes with each shot rule they match and the number of keywords."""
    return f"select project_id, scene_index, rule, priority, cast(count(*) as int) as n from {d.unnest('(select project_id, scene_index, words from visual_tokens) s', 'words', 'word')} join shot_rules on keyword = word group by project_id, scene_index, rule, priority"


@relation("rule_x_scene")
def rank_rules(d):
    """The best rule: most keywords, then precedence."""
    return "select project_id, scene_index, rule, n from (select *, row_number() over (partition by project_id, scene_index order by n desc, priority) as r from rule_x_scene) t where r = 1"


@relation("scenes", "rank_rules")
def shot_intent(d):
    """Shot class and confidence; medium where nothing matches."""
    return "select s.project_id, s.scene_index, coalesce(rule, 'medium') as shot, case when rule is null then 0.5e0 else round(least(0.95e0, 0.68e0 + 0.07e0 * n), 2) end as shot_confidence from scenes s left join rank_rules r on r.project_id = s.project_id and r.scene_index = s.scene_index"


@relation("visual_tokens")
def narrative_intent(d):
    """Narrative function: phrases count 3, keywords 2; else by place."""
    phrase = {n: " + ".join(f"case when contains(low, {quote(p)}) then 1 else 0 end" for p in ps) for n, ps, _ in NARRATIVES}
    keyword = {n: d.size(d.keep("words", f"x in {words_in(ws)}")) for n, _, ws in NARRATIVES}
    cols = ", ".join(f"{phrase[n]} as p_{n}, {keyword[n]} as k_{n}" for n, _, _ in NARRATIVES)
    score = {n: f"(3 * p_{n} + 2 * k_{n})" for n, _, _ in NARRATIVES}
    top = "greatest(" + ", ".join(score.values()) + ")"
    pick = " ".join(f"when {score[n]} = top then {quote(n)}" for n, _, _ in NARRATIVES)
    match = " ".join(f"when {score[n]} = top then p_{n} + k_{n}" for n, _, _ in NARRATIVES)
    return f"""
    select project_id, scene_index, case when top > 0 then case {pick} end when scene_index = 0 then 'introduction'
             when scene_count > 1 and scene_index = scene_count - 1 then 'conclusion' when scene_count >= 4 and scene_index * 1e0 / scene_count <= 0.25e0 then 'context' else 'development' end as narrative_intent,
           case when top > 0 then round(least(0.95e0, 0.68e0 + 0.04e0 * top + 0.01e0 * case {match} end), 2) when scene_index = 0 or (scene_count > 1 and scene_index = scene_count - 1) then 0.6e0
             when scene_count >= 4 and scene_index * 1e0 / scene_count <= 0.25e0 then 0.55e0 else 0.5e0 end as narrative_confidence
    from (select *, {top} as top from (select project_id, scene_index, scene_count, {cols} from visual_tokens))"""


@relation("shot_intent", "narrative_intent")
def visual_plan(d):
    """The visual plan of each scene: both classes with confidence and reason, and neutral
    values for what later stages may fill in."""
    return """
    select s.project_id, s.scene_index, 'neutral' as shot_type, 'neutral' as emotion, 'neutral' as pace, 0e0 as importance, 'identity' as cinematic_intent, shot as visual_intent, shot_confidence as confidence, case when shot = 'medium' then 'Default fallback.' else concat('Keywords of ', shot, '.') end as reason,
      narrative_intent, narrative_confidence, case when narrative_confidence >= 0.68e0 then concat('Phrases or keywords of ', narrative_intent, '.') else concat('Position suggests ', narrative_intent, '.') end as narrative_reason from shot_intent s join narrative_intent n on n.project_id = s.project_id and n.scene_index = s.scene_index"""


@relation("scenes", public=False)
def directed_scenes(d):
    """Scenes as a director hands them back; some changed on the way."""
    return "select project_id, scene_index, scene_start, case when length(project_id) = 4 and scene_index = 2 then scene_end + 1e0 else scene_end end as scene_end, case when length(project_id) % 7 = 5 and scene_index = 1 then upper(voiceover_text) else voiceover_text end as voiceover_text from scenes"


@relation("scenes", "directed_scenes")
def visual_preservation(d):
    """Whether directed scenes are the original ones in number, times and all else; the first that is not."""
    return "select s.project_id, cast(count(*) as bigint) as n, count(*) = count(v.scene_index) as count_kept, min(case when v.scene_index is null or v.scene_start <> s.scene_start or v.scene_end <> s.scene_end or v.voiceover_text <> s.voiceover_text then s.scene_index end) as first_changed from scenes s left join directed_scenes v on v.project_id = s.project_id and v.scene_index = s.scene_index group by s.project_id"


@relation("visual_plan", "shot_presets", "narrative_presets")
def motion_guidance(d):
    """Preset, intensity, hold and reason: strong story moments lead, else the shot."""
    strong = "narrative_intent in ('escalation', 'reveal', 'climax', 'conclusion') or shot_preset is null"
    preset = f"case when {strong} then coalesce(narrative_preset, 'documentary_float') else shot_preset end"
    return f"""
    select project_id, scene_index, {preset} as preferred_preset, round(greatest(0.35e0, least(1e0, 0.35e0 + (confidence + narrative_confidence) * 0.5e0 * 0.65e0)), 3) as intensity,
           greatest(case when narrative_intent in ('reflection', 'conclusion') then 0.12e0 else 0e0 end, case when visual_intent in ('document', 'archive') then 0.08e0 else 0e0 end) as hold_fraction, visual_intent, narrative_intent, concat(case when {strong} then 'Narrative' else 'Visual' end, ' intent selected ', {preset}, '.') as reason
    from visual_plan left join shot_presets on shot = visual_intent left join narrative_presets on narrative = narrative_intent"""


@relation("visual_plan")
def motion_intensity(d):
    """0.35 and 0.65 of the mean confidence of both classes, at most 1."""
    return "select project_id, scene_index, round(greatest(0.35e0, least(1e0, 0.35e0 + (confidence + narrative_confidence) * 0.5e0 * 0.65e0)), 3) as intensity from visual_plan"


@relation("narrative_intent", "pacing_profiles")
def pacing_profile(d):
    """The pacing profile of each scene's narrative intent, with its five fractions."""
    return f"select project_id, scene_index, profile, hold, ease_in, peak, ease_out, settle from (select project_id, scene_index, {PROFILE} as own from narrative_intent) n join pacing_profiles on profile = own"


def paced(x: str) -> str:
    """Distance moved at progress x through a scene with the five fractions: the integral of a smooth speed."""
    y, v, w = f"({x} - hold)", f"(({x} - hold) / ease_in)", f"(({x} - hold - ease_in - peak) / ease_out)"
    area = "(ease_in * 0.5e0 + peak + ease_out * 0.5e0)"
    return f"""case when {x} <= hold then 0e0 when {x} >= hold + ease_in + peak + ease_out then 1e0 when {y} < ease_in then ease_in * ({v} * {v} * {v} - 0.5e0 * {v} * {v} * {v} * {v}) / {area}
      when {y} < ease_in + peak then (ease_in * 0.5e0 + {y} - ease_in) / {area} else (ease_in * 0.5e0 + peak + ease_out * ({w} - {w} * {w} * {w} + 0.5e0 * {w} * {w} * {w} * {w})) / {area} end"""


@relation("spoken", "scenes", "pacing_profile")
def pacing_progress(d):
    """Distance moved at each word's time within its scene."""
    return f"select project_id, word_index, round({paced('x')}, 6) as progress from (select w.project_id, w.word_index, least(1e0, greatest(0e0, (word_start - scene_start) / (scene_end - scene_start))) as x, hold, ease_in, peak, ease_out from (select project_id, word_index, word_start, {cell('word_start')} as cell from spoken) w join {in_cells(d, 'scenes', 'scene_start', 'scene_end').removesuffix('_u')} s on s.project_id = w.project_id and s.cell = w.cell and word_start >= scene_start and word_start < scene_end join pacing_profile p on p.project_id = s.project_id and p.scene_index = s.scene_index) t"


@relation("scenes")
def transition_boundaries(d):
    """Boundary frames at 30 a second (halves to the even frame) and dissolve lengths held to a
    fifth of both scenes."""
    return f"""
    select project_id, scene_index, cast({d.half_even('scene_start * 30e0')} as bigint) as frame, cast(case when dur > 0e0 then greatest(1e0, {d.half_even('dur * 30e0')}) else 0e0 end as int) as duration_frames
    from (select *, least(0.65e0, greatest(0e0, (lag(scene_end - scene_start) over (partition by project_id order by scene_index)) * 0.2e0), greatest(0e0, (scene_end - scene_start) * 0.2e0)) as dur from scenes) t where scene_index > 0"""


@relation("motion_continuity", public=False)
def motion_plans(d):
    """Motion plans as they come back: some late, some without their last scene."""
    return "select project_id, scene_index, scene_start + case when project_id like '%3-2' and scene_index = 1 then 0.1e0 else 0e0 end as scene_start, scene_end from motion_continuity where not (project_id like '%7-1' and scene_index = 2)"


@relation("scenes", "motion_plans")
def transition_contract(d):
    """Whether a project's scenes are gapless, positive, as many as their motion plans, and at
    the same times as those (each within half a frame of 30 a second)."""
    return """
    select s.project_id, count(*) = count(m.scene_index) as counts_agree, bool_and(s.scene_end > s.scene_start) as positive, bool_and(abs(gap) <= 0.5e0 / 30e0) as gapless, coalesce(bool_and(abs(m.scene_start - s.scene_start) <= 0.5e0 / 30e0 and abs(m.scene_end - s.scene_end) <= 0.5e0 / 30e0), false) as plans_agree
    from (select *, coalesce(scene_start - lag(scene_end) over (partition by project_id order by scene_index), 0e0) as gap from scenes) s left join motion_plans m on m.project_id = s.project_id and m.scene_index = s.scene_index group by s.project_id"""


@relation("orders")
def smootherstep(d):
    """x^3 (x (6 x - 15) + 10), the cosine dissolve and the overshoot ease of a share held in 0 to 1."""
    x = "x * x * x * (x * (6e0 * x - 15e0) + 10e0)"
    return f"select o_orderkey, round({x}, 6) as smootherstep, round(0.5e0 - 0.5e0 * cos(pi() * x), 6) as smooth_alpha, round(1e0 + 2.70158e0 * (x - 1e0) * (x - 1e0) * (x - 1e0) + 1.70158e0 * (x - 1e0) * (x - 1e0), 6) as ease_out_back from (select o_orderkey, greatest(0e0, least(1e0, o_totalprice / 400000e0 - 0.05e0)) as x from orders) t"


@relation("analyses")
def composition_label(d):
    """Where the focus lies within the frame: centred within 0.10, else by the axis it is further off on."""
    return """
    select project_id, n, case when abs(dx) < 0.10e0 and abs(dy) < 0.10e0 then 'centered' when abs(dx) > abs(dy) then case when dx < 0e0 then 'left_weighted' else 'right_weighted' end when dy < 0e0 then 'top_weighted' else 'bottom_weighted' end as composition
    from (select project_id, n, focus_x - 0.5e0 as dx, focus_y - 0.5e0 as dy from analyses) t"""


#: Zoom, pan and safe focus of a motion plan, and where continuity turns it round.
ZOOM, SPAN, PAN = "1.015e0", "0.09e0", "0.72e0"
PULL_ABOVE, PUSH_BELOW, SETTLE = "0.72e0", "0.28e0", "0.07e0"


@relation("scene_analyses", "motion_guidance")
def motion_preset(d):
    """Each scene's guided preset with its zoom and pan from start to end, before continuity,
    and the preset it would have without guidance (null where the reference draws one at
    random; for the same reason the float preset goes without its jitter)."""
    ends = {"subject_push_in": (f"{ZOOM}", f"least({ZOOM} + {SPAN}, {ZOOM} + {SPAN} * (0.72e0 + 0.20e0 * strength))", "tx * 0.35e0", "ty * 0.35e0", "tx", "ty"), "portrait_hold": (f"{ZOOM} + {SPAN} * 0.35e0", f"{ZOOM} + {SPAN} * 0.35e0 + {SPAN} * 0.18e0", "tx * 0.75e0", "ty * 0.75e0", "tx", "ty"),
            "focus_reveal": (f"{ZOOM} + {SPAN} * 0.55e0", f"{ZOOM} + {SPAN} * 0.72e0", "-tx * 0.35e0", "-ty * 0.35e0", "tx", "ty"), "slow_pull_out": (f"{ZOOM} + {SPAN} * 0.78e0", f"{ZOOM} + {SPAN} * 0.22e0", "tx", "ty", "tx * 0.45e0", "ty * 0.45e0"),
            "documentary_float": (f"{ZOOM} + {SPAN} * 0.40e0", f"{ZOOM} + {SPAN} * 0.58e0", "tx", "ty", "tx", "ty")}
    other = (ZOOM, f"{ZOOM} + {SPAN} * 0.55e0", "0e0", "0e0", "tx * 0.7e0", "ty * 0.7e0")
    columns = ", ".join("case preset " + " ".join(f"when '{p}' then {e[i]}" for p, e in ends.items()) + f" else {other[i]} end as {n}" for i, n in enumerate(("z0", "z1", "x0", "y0", "x1", "y1")))
    return f"""
    select project_id, scene_index, scene_start, scene_end, preset, unguided, confidence, focus_x, focus_y, tx, ty, strength, guided_hold, {columns} from (select *, (focus_x - 0.5e0) * 2e0 * {PAN} as tx, (focus_y - 0.5e0) * 2e0 * {PAN} as ty from (select a.project_id, a.scene_index, a.scene_start, a.scene_end, g.preferred_preset as preset,
        case when face_count > 0 then case when subject_scale < 0.20e0 then 'subject_push_in' else 'portrait_hold' end when a.confidence < 0.34e0 then 'safe_push_in' when abs((focus_x - 0.5e0) * 2e0 * {PAN}) > 0.24e0 or abs((focus_y - 0.5e0) * 2e0 * {PAN}) > 0.24e0 then 'focus_reveal' end as unguided, a.confidence,
        greatest(0.20e0, least(0.80e0, focus_x)) as focus_x, greatest(0.18e0, least(0.76e0, focus_y)) as focus_y, least(1e0, greatest(0.35e0, greatest(0.1e0, a.scene_end - a.scene_start) / 5e0)) * greatest(0.45e0, a.confidence) * greatest(0.35e0, least(1e0, intensity)) as strength, greatest(0e0, least(0.25e0, hold_fraction)) as guided_hold
      from scene_analyses a join motion_guidance g on g.project_id = a.project_id and g.scene_index = a.scene_index) s) t"""


@relation("motion_preset", public=False)
def motion_walk(d):
    level = f"(s.z1 - {ZOOM}) / {SPAN}"
    pull, push = f"(x.z1 >= x.z0 and {level} >= {PULL_ABOVE})", f"(x.z1 < x.z0 and {level} <= {PUSH_BELOW})"
    step = "(0.42e0 + 0.16e0 * x.strength)"
    pick = lambda a, b, c: f"case when {pull} then {a} when {push} then {b} else {c} end"
    state = {"preset": ("string", "x.preset", pick("'continuity_pull_out'", "'continuity_push_in'", "x.preset")), "z0": ("double", "round(x.z0, 9)", "s.z1"),
             "z1": ("double", "round(x.z1, 9)", "round(" + pick(f"greatest({ZOOM} + {SPAN} * 0.24e0, s.z1 - {SPAN} * {step})", f"least({ZOOM} + {SPAN}, s.z1 + {SPAN} * {step})", "x.z1") + ", 9)"),
             "x0": ("double", "x.x0", "0e0"), "y0": ("double", "x.y0", "0e0"), "x1": ("double", "x.x1", pick("x.tx * 0.45e0", "x.tx * 0.85e0", "x.x1")), "y1": ("double", "x.y1", pick("x.ty * 0.45e0", "x.ty * 0.85e0", "x.y1"))}
    return d.scan("(select *, scene_index + 1 as place from motion_preset)", ["project_id"], "place", ["preset", "z0", "z1", "x0", "y0", "x1", "y1", "tx", "ty", "strength"], state)


@relation("motion_walk", "motion_preset")
def motion_continuity(d):
    """The motion plan: each scene's zoom goes on from the last one's end, turned round where
    that is near a limit; pans begin in the middle after a cut, and plans settle after it."""
    clamp = lambda c: f"round(greatest(-1e0, least(1e0, w.{c})), 6) as {c}"
    return f"""
    select w.project_id, p.scene_index, p.scene_start, p.scene_end, w.preset, round(w.z0, 6) as z0, round(w.z1, 6) as z1, {', '.join(map(clamp, ('x0', 'y0', 'x1', 'y1')))}, p.confidence, greatest(case when p.scene_index > 0 then {SETTLE} else 0e0 end, guided_hold) as hold
    from motion_walk w join motion_preset p on p.project_id = w.project_id and p.scene_index = w.place - 1"""


@relation("captions", "motion_continuity", "pacing_profile")
def motion_state_lookup(d):
    """Zoom and pan at each caption's start: its scene's plan (the last one after the end), as
    far as paced progress has come."""
    u = paced("x")
    lerp = ", ".join(f"round({a} + ({b} - {a}) * u, 6) as {n}" for n, a, b in (("zoom", "z0", "z1"), ("pan_x", "x0", "x1"), ("pan_y", "y0", "y1")))
    # the first scene that ends after the start: all ends after it, from the last one backwards
    ends = "select project_id, caption_start as t, 0 as kind, caption_id, cast(null as int) as scene_index from captions union all select project_id, scene_end, 1, null, scene_index from motion_continuity"
    first = "min(scene_index) over (partition by project_id order by t desc, kind rows between unbounded preceding and current row)"
    return f"""
    select project_id, caption_id, scene_index, {lerp} from (select *, {u} as u from (select c.project_id, c.caption_id, m.scene_index, z0, z1, x0, x1, y0, y1, p.hold, ease_in, peak, ease_out, greatest(0e0, least(1e0, (t - scene_start) / greatest(0.001e0, scene_end - scene_start))) as x
      from (select project_id, t, kind, caption_id, coalesce({first}, max(scene_index) over (partition by project_id)) as own from ({ends}) e) c join motion_continuity m on m.project_id = c.project_id and m.scene_index = c.own join pacing_profile p on p.project_id = m.project_id and p.scene_index = m.scene_index where kind = 0) t) v"""


@relation("motion_continuity")
def lerp(d):
    """Zoom and pan half way between a scene's start and end."""
    return "select project_id, scene_index, round(z0 + (z1 - z0) * 0.5e0, 8) as zoom, round(x0 + (x1 - x0) * 0.5e0, 8) as pan_x, round(y0 + (y1 - y0) * 0.5e0, 8) as pan_y from motion_continuity"


@relation("motion_state_lookup")
def crop_box(d):
    """What a zoom and pan keep of a frame of 1080 by 1920, within its borders; all of it up to
    a zoom of 1.0001."""
    side = lambda size, pan: f"greatest(0e0, least({size} - {size} / zoom, {size} / 2e0 + greatest(-1e0, least(1e0, {pan})) * greatest(0e0, ({size} - {size} / zoom) / 2e0) - {size} / zoom / 2e0))"
    keep = lambda x, whole: f"round(case when zoom <= 1.0001e0 then {whole} else {x} end, 3)"
    return f"select project_id, caption_id, {keep(side('1080e0', 'pan_x'), '0e0')} as x, {keep(side('1920e0', 'pan_y'), '0e0')} as y, {keep('1080e0 / zoom', '1080e0')} as width, {keep('1920e0 / zoom', '1920e0')} as height from motion_state_lookup"


@relation("frames")
def histogram(d):
    """Each frame's histogram as shares of its largest bin: how many bins have any, and the sum of shares."""
    return f"select vec_id, cast({d.size(d.keep('hist', 'x > 0e0'))} as int) as bins, round(total / {d.max_of('hist')}, 6) as mass from frames"
