"""Audio planning: text evidence, intent and tone, energy, music, ambience, ducking, transitions."""

from ..plans.relation import literal, quote, relation, shorter
from .text import WORD_AMBIENCE, WORD_STORY, clamp

#: Words that negate a phrase within the three words after them.
NEGATIONS = ("not", "no", "never", "without", "inte", "ingen", "inget", "inga", "ej", "utan")

#: Text signals by category.
TEXT_SIGNALS = {
    "establish": ("begin", "begins", "began", "introduction", "first", "börjar", "började", "inledning", "först"),
    "build": ("growing", "increasing", "mounting", "toward", "växande", "ökande", "byggdes", "mot"),
    "tension": ("danger", "threat", "crisis", "risk", "urgent", "fara", "hot", "kris", "risk", "akut"),
    "release": ("relief", "released", "revealed", "truth", "lättnad", "släpptes", "avslöjades", "sanningen"),
    "reflection": ("remember", "looking back", "retrospect", "years later", "minns", "i efterhand", "år senare"),
    "transition": ("meanwhile", "elsewhere", "next", "later", "samtidigt", "på annat håll", "därefter", "senare"),
    "resolution": ("resolved", "solved", "ultimately", "in the end", "conclusion", "löstes", "slutligen", "till slut", "slutsats"),
    "calm": ("calm", "quiet", "steady", "gentle", "lugn", "stilla", "stadig", "mjuk"),
    "reflective": ("remember", "reflection", "looking back", "legacy", "minns", "eftertanke", "i efterhand", "arv"),
    "mysterious": ("unknown", "hidden", "secret", "mystery", "unanswered", "okänd", "dold", "hemlig", "mysterium", "obesvarad"),
    "tense": ("danger", "threat", "crisis", "risk", "fear", "fara", "hot", "kris", "risk", "rädsla"),
    "somber": ("death", "loss", "grief", "tragedy", "mourning", "död", "förlust", "sorg", "tragedi", "sörjande"),
    "hopeful": ("hope", "recovery", "possible", "future", "chance", "hopp", "återhämtning", "möjlig", "möjligt", "framtid", "möjlighet"),
    "uplifting": ("joy", "celebrate", "inspired", "renewed", "glädje", "firar", "inspirerad", "förnyad"),
    "triumphant": ("victory", "triumph", "won", "success", "seger", "triumf", "vann", "framgång"),
    "dramatic": ("decisive", "turning point", "confrontation", "avgörande", "vändpunkt", "konfrontation"),
}
#: Intents by story role and by narrative intent, and energy adjustments.
ROLE_INTENT = [("hook", "establish"), ("setup", "establish"), ("context", "support"), ("development", "build"), ("evidence", "support"), ("complication", "build"), ("contrast", "tension"), ("counterargument", "tension"), ("revelation", "release"), ("turning_point", "build"), ("resolution", "resolution"), ("epilogue", "reflection"), ("transition", "transition")]
SEMANTIC_INTENT = [("introduction", "establish"), ("context", "support"), ("explanation", "support"), ("development", "build"), ("escalation", "tension"), ("reveal", "release"), ("reflection", "reflection"), ("conclusion", "resolution")]
INTENT_ENERGY = [("neutral", 0.0), ("support", 0.0), ("establish", -0.04), ("reflection", -0.12), ("release", -0.08), ("transition", -0.02), ("build", 0.12), ("tension", 0.22), ("resolution", 0.02), ("climax", 0.38)]
TONE_ENERGY = [("neutral", 0.0), ("calm", -0.08), ("reflective", -0.07), ("mysterious", 0.04), ("tense", 0.10), ("somber", -0.05), ("hopeful", 0.03), ("uplifting", 0.08), ("triumphant", 0.12), ("dramatic", 0.10)]
#: The order in which tones and styles win ties.
TONE_ORDER = ("neutral", "calm", "reflective", "mysterious", "tense", "somber", "hopeful", "dramatic", "uplifting", "triumphant")
STYLE_ORDER = ("documentary", "ambient", "minimal", "emotional_piano", "cinematic", "suspense", "orchestral", "none")
#: Places that a text may name. "station" stands twice, so it counts twice.
AMBIENCE = {
    "urban": ("city", "street", "traffic", "stad", "gata", "trafik"),
    "crowd": ("crowd", "audience", "protesters", "folkmassa", "publik", "demonstranter"),
    "nature": ("wilderness", "landscape", "wildlife", "vildmark", "landskap", "djurliv"),
    "forest": ("forest", "trees", "woodland", "skog", "träd", "skogsmark"),
    "ocean": ("ocean", "sea", "waves", "coast", "hav", "sjö", "vågor", "kust"),
    "wind": ("wind", "gusts", "windswept", "vind", "vindbyar", "blåsigt"),
    "rain": ("rain", "rainfall", "raindrops", "regn", "regnfall", "regndroppar"),
    "machinery": ("machinery", "factory", "engines", "maskiner", "fabrik", "motorer"),
    "transport": ("train", "station", "vehicle", "airport", "tåg", "station", "fordon", "flygplats"),
    "battlefield": ("battlefield", "combat", "artillery", "front line", "slagfält", "strid", "artilleri", "frontlinje"),
    "archival_noise": ("archive footage", "old recording", "historical recording", "arkivfilm", "gammal inspelning", "historisk inspelning"),
    "room_tone": ("interior room", "indoor interview", "quiet room", "inomhusintervju", "tyst rum"),
}
INTENTS = ("establish", "build", "tension", "release", "reflection", "transition", "resolution")
TONES = ("calm", "reflective", "mysterious", "tense", "somber", "hopeful", "uplifting", "dramatic")


def occurs(p: str) -> str:
    """Words of a phrase in a row, in `line`, the words of a text between single spaces."""
    return f"contains(line, {quote(' ' + p + ' ')})"


def negated(d, p: str) -> str:
    no = "|".join(NEGATIONS)
    return d.matches("line", f" ({no})( [^ ]+)?( [^ ]+)? {p} ")


@relation("scenes", public=False)
def audio_requests(d):
    """What scenes ask for beside their text: a pause, an environment, a hard cut."""
    return "select project_id, scene_index, scene_index % 2 = 1 as pause, case scene_index % 3 when 0 then 'urban' when 1 then 'transport' end as explicit, scene_index % 4 = 2 as hard_cut from scenes"


@relation("scenes", "audio_requests", public=False)
def audio_text(d):
    """Scenes with their words in a row, and what they ask for (nothing where that is not said)."""
    ambient = f"concat(' ', {d.join(d.tokens('lower(voiceover_text)', WORD_AMBIENCE), ' ')}, ' ')"
    return f"""
    select s.project_id, s.scene_index, scene_count, scene_start, scene_end, voiceover_text, concat(' ', {d.join(d.tokens('lower(voiceover_text)', WORD_STORY), ' ')}, ' ') as line, {ambient} as ambient, coalesce(pause, false) as pause, explicit, coalesce(hard_cut, false) as hard_cut
    from scenes s left join audio_requests a on a.project_id = s.project_id and a.scene_index = s.scene_index"""


@relation("audio_text", public=False)
def audio_evidence(d):
    cols = ", ".join(" + ".join(f"case when {occurs(p)} and not {negated(d, p)} then 1 else 0 end" for p in ps) + f" as e_{c}" for c, ps in TEXT_SIGNALS.items())
    return f"select *, {cols} from audio_text"


@relation("audio_text")
def text_evidence(d):
    """Accepted phrases of each category: present, and nowhere negated."""
    own = lambda ps: ", ".join(f"case when {occurs(p)} and not {negated(d, p)} then {quote(p)} end" for p in sorted(ps))
    columns = ", ".join("concat_ws('|', " + own(ps) + f") as {c}" for c, ps in TEXT_SIGNALS.items())
    return f"select project_id, scene_index, {columns} from audio_text"


@relation("audio_text")
def phrase_occurs(d):
    """The phrases of any category that a scene has, as whole words in a row."""
    phrases = sorted({p for ps in TEXT_SIGNALS.values() for p in ps})
    there = d.keep(d.strings(*phrases), "contains(line, concat(' ', x, ' '))")
    if d.spark:  # without a lambda, which would be interpreted for each phrase
        there = f"array_compact(array({', '.join(f'case when {occurs(p)} then {quote(p)} end' for p in phrases)}))"
        # outer: else Catalyst filters by the array first, with the line's expression in it for each phrase
        return f"select project_id, scene_index, phrase from (select project_id, scene_index, {there} as ps from audio_text) s lateral view outer explode(ps) o as phrase where phrase is not null"
    return f"select project_id, scene_index, phrase from {d.unnest(f'(select project_id, scene_index, {there} as ps from audio_text) s', 'ps', 'phrase')}"


@relation("phrase_occurs", "audio_text")
def phrase_negated(d):
    """Phrases that a scene has, and whether one of their occurrences follows a negation by at
    most three words."""
    no = "|".join(NEGATIONS)
    test = "o.phrase, ' ')"
    return f"select o.project_id, o.scene_index, o.phrase, {'regexp_like' if d.spark else 'regexp_matches'}(t.line, concat(' ({no})( [^ ]+)?( [^ ]+)? ', {test}) as negated from phrase_occurs o join audio_text t on t.project_id = o.project_id and t.scene_index = o.scene_index"


@shorter("phrase_negated", "audio_text")
def _(d):
    """Phrases are tried on the line they were found in, where it has a negation at all."""
    phrases = sorted({p for ps in TEXT_SIGNALS.values() for p in ps})
    tried = ", ".join(f"case when {occurs(p)} then {d.struct(phrase=quote(p), negated=f'denied and {negated(d, p)}')} end" for p in phrases)
    lines = f"(select project_id, scene_index, line, {d.matches('line', f' ({'|'.join(NEGATIONS)}) ')} as denied from audio_text where project_id is not null and scene_index is not null) t"
    return f"select project_id, scene_index, o.phrase, o.negated from (select project_id, scene_index, array_compact(array({tried})) as ps from {lines}) s lateral view outer explode(ps) u as o where o is not null"


@relation(public=False)
def role_intents(d):
    return d.values("r", ("story_key", "role_intent"), ROLE_INTENT)


@relation(public=False)
def semantic_intents(d):
    return d.values("r", ("semantic_key", "semantic_audio"), SEMANTIC_INTENT)


#: Schema and version of the story plans that audio planning reads.
STORY_VERSIONS = (("4.6.0", "4.6.0"),)


@relation("structural_roles", public=False)
def story_plans(d):
    """Story plans as they are handed over, one a project: some without a version or of another,
    some whose count is not that of the scenes, some no object or without a list of scenes."""
    user = f"coalesce(cast(nullif({d.extract('project_id', '^([0-9]+)', 1)}, '') as bigint), 0)"
    return f"""
    select project_id, u % 29 <> 5 as is_object, u % 31 <> 6 as has_scenes, n - case when u % 37 = 7 then 1 else 0 end as scene_count, case when u % 41 <> 8 then '4.6.0' end as schema_version, case when u % 43 = 9 then '4.5.0' when u % 47 = 10 then ' ' else '4.6.0' end as story_director_version
    from (select project_id, {user} as u, cast(count(*) as int) as n from structural_roles group by project_id) t where u % 23 <> 4"""


@relation("structural_roles", "scenes", public=False)
def story_plan_scenes(d):
    """Scenes of story plans in their order, with ids, numbers and times: a few wrong."""
    user = f"coalesce(cast(nullif({d.extract('r.project_id', '^([0-9]+)', 1)}, '') as bigint), 0)"
    return f"""
    select r.project_id, r.scene_index as place, true as is_object, case when {user} % 53 = 11 and r.scene_index = 1 then 'scene_999' else concat('scene_', lpad(cast(r.scene_index + 1 as string), 3, '0')) end as scene_id, r.scene_index,
      scene_start + case when {user} % 59 = 12 and r.scene_index = 2 then 0.5e0 else 0e0 end as scene_start, scene_end, cast(null as double) as duration, story_role, story_phase, tension, emotional, revelation
    from structural_roles r join scenes s on s.project_id = r.project_id and s.scene_index = r.scene_index"""


@relation("scenes", "story_plans", "story_plan_scenes")
def story_semantic_match(d):
    """Whether a project's story plan fits its scenes one to one, and the first reason why not:
    no plan, no object, no scenes, their number, no version or another one, then the first
    scene that is no object, has another id or number, or (where it has times) another time.
    A plan that does not fit loses its whole side."""
    known = " or ".join(f"(p.schema_version = {quote(s)} and p.story_director_version = {quote(v)})" for s, v in STORY_VERSIONS)
    own = "concat('scene_', lpad(cast(s.scene_index + 1 as string), 3, '0'))"
    late = " or ".join(f"coalesce(abs(t.{c} - {e}) > 0.001e0, false)" for c, e in (("scene_start", "s.scene_start"), ("scene_end", "s.scene_end"), ("duration", "(s.scene_end - s.scene_start)")))
    blank = lambda c: f"trim(coalesce({c}, '')) = ''"
    return f"""
    select project_id, reason is null as accepted, reason from (select n.project_id, case when p.project_id is null then 'story_director_plan_missing' when not p.is_object then 'story_director_plan_not_object' when not p.has_scenes then 'story_director_scenes_invalid'
        when coalesce(p.scene_count, -1) <> n.n or coalesce(m.n, 0) <> n.n then 'story_director_scene_count_mismatch' when {blank('p.schema_version')} or {blank('p.story_director_version')} then 'story_director_version_missing'
        when not ({known}) then concat('story_director_version_incompatible:', p.schema_version, ':', p.story_director_version) when m.first_bad is not null then concat('story_director_scene_', substring(m.first_bad, 11)) end as reason
      from (select project_id, count(*) as n from scenes group by project_id) n left join story_plans p on p.project_id = n.project_id
      left join (select t.project_id, count(*) as n, min(case when not t.is_object then concat({{0}}, '_invalid') when s.scene_index is null or coalesce(t.scene_id, '') <> {own} or coalesce(t.scene_index, -1) <> s.scene_index then concat({{0}}, '_identity_mismatch') when {late} then concat({{0}}, '_timing_mismatch') end) as first_bad
        from story_plan_scenes t left join scenes s on s.project_id = t.project_id and s.scene_index = t.place group by t.project_id) m on m.project_id = n.project_id) v""".replace("{0}", "lpad(cast(t.place as string), 10, '0'), cast(t.place as string)")


@relation("audio_evidence", "story_semantic_match", "story_plan_scenes", "narrative_intent", "role_intents", "semantic_intents", public=False)
def audio_base(d):
    """Scenes with their text evidence, narrative intent, and what an accepted story plan says."""
    unit = lambda c: f"case when accepted and r.{c} between 0e0 and 1e0 then r.{c} end as {c}"
    return f"""
    select e.*, accepted, reason as refusal, n.narrative_intent, semantic_audio, case when accepted then r.story_role end as story_role, case when accepted then r.story_phase end as story_phase, {unit('tension')}, {unit('emotional')}, {unit('revelation')}, case when accepted then role_intent end as role_intent
    from audio_evidence e join story_semantic_match m on m.project_id = e.project_id join narrative_intent n on n.project_id = e.project_id and n.scene_index = e.scene_index
    left join story_plan_scenes r on r.project_id = e.project_id and r.place = e.scene_index left join role_intents on story_key = r.story_role left join semantic_intents on semantic_key = n.narrative_intent"""


def rank(names, s):
    """The best of named scores, and which it is: most, then by name."""
    first = "greatest(" + ", ".join(f"{s}_{n}" for n in names) + ")"
    pick = " ".join(f"when {s}_{n} = {s}_top then {quote(n)}" for n in sorted(names))
    return first, pick


@relation("audio_base", public=False)
def audio_intents(d):
    names = ("establish", "build", "tension", "release", "reflection", "transition", "resolution", "support", "climax")

    def score(n):
        parts = [f"case when role_intent = '{n}' then 0.85e0 else 0e0 end"]
        parts += {"climax": ["case when story_role = 'climax' and story_phase = 'climax' and tension >= 0.70e0 and (emotional >= 0.60e0 or revelation >= 0.65e0) then 1.25e0 else 0e0 end"],
                  "build": ["case when story_phase in ('rising_action', 'turning_point', 'complication') then 0.32e0 else 0e0 end"],
                  "resolution": ["case when story_phase = 'resolution' then 0.32e0 else 0e0 end"],
                  "reflection": ["case when story_phase = 'closing' and story_role = 'epilogue' then 0.32e0 else 0e0 end"],
                  "tension": ["case when tension >= 0.72e0 and story_role in ('complication', 'contrast', 'counterargument') then 0.38e0 else 0e0 end"]}.get(n, [])
        parts.append(f"case when semantic_audio = '{n}' then 0.52e0 else 0e0 end")
        if n in INTENTS:
            parts.append(f"case when e_{n} > 0 then least(0.34e0, 0.18e0 + 0.06e0 * e_{n}) else 0e0 end")
        if n == "establish":
            parts.append("case when scene_index = 0 and scene_count > 1 and e_establish > 0 then 0.16e0 else 0e0 end")
        return f"{d.round(' + '.join(parts), 4)} as i_{n}"

    top, pick = rank(names, "i")
    second = "greatest(" + ", ".join(f"case when i_winner = '{n}' then -1e0 else i_{n} end" for n in names) + ")"
    next_ = " ".join(f"when i_winner <> '{n}' and i_{n} = i_second then '{n}'" for n in sorted(names))
    return f"""
    select *, case when i_top <= 0e0 then 'support' when i_top - i_second <= 0.08e0 and ((i_winner = 'build' and case {next_} end = 'resolution') or (i_winner = 'resolution' and case {next_} end = 'build')) then 'support'
             when i_winner = 'climax' and i_top < 1.2e0 then 'build' else i_winner end as audio_intent,
           case when i_top > 0e0 and i_top - i_second <= 0.08e0 and ((i_winner = 'build' and case {next_} end = 'resolution') or (i_winner = 'resolution' and case {next_} end = 'build')) or (i_winner = 'climax' and i_top < 1.2e0) then 1 else 0 end as intent_conflicts
    from (select *, {second} as i_second from (select *, case {pick} end as i_winner from (select *, {top} as i_top from (select *, {', '.join(map(score, names))} from audio_base))))"""


@relation("audio_intents", public=False)
def audio_tones(d):
    names = (*TONES, "triumphant")

    def score(n):
        parts = {"reflective": ["case when story_role = 'epilogue' then 0.78e0 else 0e0 end"],
                 "dramatic": ["case when story_role = 'climax' and tension >= 0.70e0 and emotional >= 0.60e0 then 0.82e0 else 0e0 end"],
                 "tense": ["case when story_role in ('complication', 'contrast', 'counterargument') and tension >= 0.65e0 then 0.72e0 else 0e0 end"],
                 "calm": ["case when story_role in ('context', 'setup') and tension <= 0.35e0 and emotional <= 0.35e0 then 0.62e0 else 0e0 end"],
                 "mysterious": ["case when story_role = 'revelation' or revelation >= 0.65e0 then 0.58e0 else 0e0 end"],
                 "triumphant": ["case when story_role in ('resolution', 'climax') and e_triumphant > 0 and (e_uplifting > 0 or e_hopeful > 0) then 0.92e0 else 0e0 end"]}.get(n, [])
        if n in TONES:
            parts.append(f"case when e_{n} > 0 then least(0.62e0, 0.20e0 + 0.13e0 * e_{n}) else 0e0 end")
        return f"{d.round(' + '.join(parts), 4)} as t_{n}"

    top, pick = rank(names, "t")
    pairs = (("hopeful", "somber"), ("calm", "tense"), ("uplifting", "somber"), ("triumphant", "somber"))
    clash = " + ".join(f"case when t_winner = '{a}' and t_{b} > 0e0 and abs(t_top - t_{b}) <= 0.18e0 then 1 else 0 end" for p in pairs for a, b in (p, p[::-1]))
    return f"""
    select *, case when t_top <= 0e0 or clashes > 0 or t_top < 0.55e0 or (t_winner = 'dramatic' and t_top < 0.75e0) then 'neutral' else t_winner end as emotional_tone,
           case when t_top > 0e0 then case when clashes > 0 then clashes when t_top >= 0.55e0 and t_winner = 'dramatic' and t_top < 0.75e0 then 1 else 0 end else 0 end as tone_conflicts
    from (select *, {clash} as clashes from (select *, case {pick} end as t_winner from (select *, {top} as t_top from (select *, {', '.join(map(score, names))} from audio_intents))))"""


@relation("audio_intents")
def audio_intent(d):
    """Additive scores from structure, semantics and text; ties by name; conflicts to support."""
    return "select project_id, scene_index, audio_intent, i_top as score, intent_conflicts from audio_intents"


@relation("audio_tones")
def emotional_tone(d):
    """Additive tone scores; conflicting pairs, weak tops and unsupported drama are neutral."""
    return "select project_id, scene_index, emotional_tone, t_top as score, tone_conflicts from audio_tones"


@relation("audio_tones", public=False)
def audio_scenes(d):
    """Classified scenes with confidence, raw energy and whether a larger step is supported."""
    categories = " + ".join(f"case when e_{c} > 0 then 1 else 0 end" for c in TEXT_SIGNALS)
    structural = "case when accepted then 0.42e0 + 0.10e0 + 0.15e0 else 0e0 end + case when semantic_audio is not null then 0.20e0 else 0e0 end"
    confidence = clamp(d, f"0.24e0 + {structural} + least(0.16e0, ({categories}) * 0.025e0) - case when accepted then 0e0 else 0.08e0 end - least(0.24e0, (intent_conflicts + tone_conflicts) * 0.12e0) + case when audio_intent in ('climax', 'tension') or emotional_tone in ('triumphant', 'dramatic', 'tense') then 0.05e0 else 0e0 end")
    pick = lambda column, pairs: f"case {column} " + " ".join(f"when '{k}' then {literal(v)}" for k, v in pairs) + " end"
    energy = clamp(d, f"0.40e0 + {pick('audio_intent', INTENT_ENERGY)} + {pick('emotional_tone', TONE_ENERGY)} + coalesce((tension - 0.5e0) * 0.18e0, 0e0) + coalesce((emotional - 0.5e0) * 0.12e0, 0e0) + coalesce(revelation * 0.06e0, 0e0)")
    return f"""
    select *, coalesce(audio_intent = 'climax' and story_role = 'climax' and story_phase = 'climax' and tension >= 0.70e0 and confidence >= 0.75e0, false) as supported, not accepted and not has_semantic as fallback_used
    from (select project_id, scene_index, cast(scene_index + 1 as int) as place, scene_start, scene_end, voiceover_text, ambient, pause, explicit, hard_cut, accepted, refusal, semantic_audio is not null as has_semantic, story_role, story_phase, tension, emotional, revelation, audio_intent, emotional_tone, cast(intent_conflicts + tone_conflicts as int) as conflicts,
      cast(case when accepted then 5 else 0 end + case when semantic_audio is not null then 1 else 0 end + {' + '.join('e_' + c for c in TEXT_SIGNALS)} as int) as n_signals, {confidence} as confidence, {energy} as energy from audio_tones) t"""


@relation("audio_scenes")
def audio_classify(d):
    """Intent, tone, confidence, fallback and rationale of each scene."""
    return """
    select project_id, scene_index, audio_intent, emotional_tone, confidence, n_signals, conflicts, fallback_used, case when fallback_used then case when trim(ambient) <> '' then 'No compatible structural metadata; conservative semantic-text fallback used.' else 'No usable structural or text metadata; neutral fallback used.' end end as fallback_reason,
      refusal as warning, concat('Intent ', audio_intent, ' and tone ', emotional_tone, ' selected from ', cast(n_signals as string), ' accepted signal(s); ', cast(conflicts as string), ' conflict(s) resolved.') as rationale from audio_scenes"""


@relation("audio_scenes")
def raw_energy(d):
    """0.40 plus intent, tone and bounded structural values."""
    return "select project_id, scene_index, energy from audio_scenes"


@relation("audio_scenes")
def supported_contrast(d):
    """Whether a climax has the structure that allows a larger step."""
    return "select project_id, scene_index, supported from audio_scenes"


#: What scenes carry through the pass over energies, so that nothing is joined back.
CARRIED = {"scene_index": "int", "scene_start": "double", "scene_end": "double", "voiceover_text": "string", "ambient": "string", "pause": "boolean", "explicit": "string", "hard_cut": "boolean", "accepted": "boolean", "story_role": "string", "story_phase": "string", "tension": "double", "emotional": "double", "revelation": "double",
           "audio_intent": "string", "emotional_tone": "string", "conflicts": "int", "n_signals": "int", "confidence": "double", "energy": "double", "supported": "boolean", "fallback_used": "boolean"}


@relation("audio_scenes", public=False)
def audio_walk(d):
    """Scenes with the smoothed energy, one pass in scene order."""
    final = clamp(d, "least(s.final + case when x.supported and x.energy - s.final > 0.30e0 then 0.45e0 else 0.30e0 end, greatest(s.final - 0.30e0, x.energy))")
    state = {n: (t, f"x.{n}", f"x.{n}") for n, t in CARRIED.items()}
    state["final"] = ("double", "x.energy", final)
    return d.scan("audio_scenes", ["project_id"], "place", list(CARRIED), state)


@relation("audio_walk", public=False)
def audio_final(d):
    """Scenes with what smoothing did to their energy."""
    return "select *, case when final < energy then 'limited_up' when final > energy then 'limited_down' else 'unchanged' end as adjustment, coalesce(supported and energy - before > 0.30e0 and final - before > 0.30e0, false) as preserved from (select *, lag(final) over (partition by project_id order by scene_index) as before from audio_walk) t"


@relation("audio_final")
def energy_smooth(d):
    """Energy bounded to steps of 0.30 (0.45 up for supported climaxes), in scene order, what
    was done to it, and whether a supported contrast was kept."""
    return "select project_id, scene_index, final, adjustment, preserved from audio_final"


@relation("audio_final", public=False)
def audio_sound(d):
    """Scenes with music, ambience, density and silence. A pause that the structure supports
    silences music and ambience."""
    count = {k: " + ".join(f"case when {occurs(p).replace('line', 'ambient', 1)} then 1 else 0 end" for p in ps) for k, ps in AMBIENCE.items()}

    def score(k):
        if k == "battlefield":
            return "case when explicit = 'battlefield' and c_battlefield >= 2 then 0.65e0 + least(0.30e0, c_battlefield * 0.10e0) else 0e0 end as a_battlefield"
        return f"case when explicit is null and c_{k} >= 3 then 0.72e0 else case when explicit = '{k}' then 0.65e0 else 0e0 end + least(0.30e0, c_{k} * 0.10e0) end as a_{k}"

    top, pick = rank(list(AMBIENCE), "a")
    silent = "(pause and story_role in ('epilogue', 'revelation', 'resolution', 'climax') and (story_role = 'epilogue' or coalesce(revelation, 0e0) >= 0.75e0 or coalesce(emotional, 0e0) >= 0.75e0) and confidence >= 0.70e0)"
    style = """case when emotional_tone in ('calm', 'reflective') or audio_intent = 'reflection' then case when final >= 0.25e0 then 'ambient' else 'minimal' end
        when emotional_tone = 'somber' then 'emotional_piano' when audio_intent = 'tension' and story_role in ('complication', 'contrast', 'counterargument', 'climax') and tension >= 0.65e0 then 'suspense'
        when audio_intent = 'climax' and supported then case when emotional_tone = 'triumphant' then 'orchestral' else 'cinematic' end else 'documentary' end"""
    music = clamp(d, "final * 0.72e0 - case when audio_intent in ('support', 'neutral', 'establish') then 0.08e0 else 0e0 end + case when supported then 0.08e0 else 0e0 end")
    level = clamp(d, "least(final, greatest(0e0, least(final * 0.45e0, 0.35e0) - case when narrated then 0.08e0 else 0e0 end))")
    return f"""
    select *, ambience_supported and not intentional as ambience_on, case when ambience_supported and not intentional then best_place else 'none' end as place_kind, case when intentional then 'none' else planned_style end as style, case when intentional then 0e0 else planned_level end as music_level, case when intentional then 0e0 else ambience_raw end as ambience_level
    from (select *, ambience_raw > 0e0 as ambience_supported from (select *, case when a_top >= 0.70e0 then {level} else 0e0 end as ambience_raw from (select *, case {pick} end as best_place from (select *, {top} as a_top from (select *, {', '.join(map(score, AMBIENCE))}
      from (select *, {style} as planned_style, {music} as planned_level, trim(voiceover_text) <> '' as narrated, {clamp(d, "length(voiceover_text) / greatest(1e0, (scene_end - scene_start) * 20e0)")} as density, coalesce({silent}, false) as intentional, {', '.join(f'{c} as c_{k}' for k, c in count.items())} from audio_final) a) b) c) e) f) g"""


@relation("audio_sound")
def music_plan(d):
    """Style by a decision list and intensity from the smoothed energy; off in a pause."""
    four = "concat(cast(cast(floor(final) as int) as string), '.', lpad(cast(cast(round(final * 10000e0) as int) % 10000 as string), 4, '0'))"
    return f"select project_id, scene_index, not intentional as enabled, style, music_level as intensity, case when planned_style = 'documentary' and (audio_intent in ('tension', 'climax') or emotional_tone in ('dramatic', 'triumphant')) then 'aggressive_music_style_downgraded' end as warning, case when intentional then 'Intentional silence suppresses music metadata.' else concat('Style ', planned_style, ' from intent ', audio_intent, ', tone ', emotional_tone, ', energy ', {four}, '.') end as rationale from audio_sound"


@relation("audio_sound")
def ambience(d):
    """The best supported place of a scene, where its score reaches 0.70 and energy leaves room."""
    return f"""
    select project_id, scene_index, ambience_on as enabled, place_kind as place, {d.round('least(1e0, a_top)', 4)} as score, ambience_level as intensity, case when intentional then 'Intentional silence suppresses ambience metadata.' when a_top < 0.70e0 then 'Environment evidence did not reach the conservative threshold.' when ambience_raw = 0e0 then 'Scene energy leaves no usable ambience intensity.' end as reason from audio_sound"""


@relation("audio_sound")
def narration_density(d):
    """Whether a scene is narrated, and its characters against twenty a second."""
    return "select project_id, scene_index, narrated, density from audio_sound"


@relation("audio_sound")
def silence(d):
    """Pauses that were asked for and that the structure supports, with time before and after."""
    return "select project_id, scene_index, intentional, case when intentional then case when story_role in ('revelation', 'climax') then 300 else 200 end else 0 end as pre_ms, case when intentional then case when story_role in ('epilogue', 'resolution') then 400 else 250 end else 0 end as post_ms, intentional as mutes_music, intentional as mutes_ambience, case when intentional then 'Explicit pause has compatible structural support.' else 'No explicit structurally supported pause.' end as reason from audio_sound"


DUCK = "not intentional and narrated as ducked, case when intentional or not narrated then 0e0 when density >= 0.65e0 then -14e0 else -12e0 end as music_db, case when intentional or not narrated or not ambience_on then 0e0 when density >= 0.65e0 then -8e0 else -6e0 end as ambience_db"


@relation("audio_sound")
def ducking(d):
    """Music and ambience lowered under narration, more where it is dense, with attack and release."""
    return f"select project_id, scene_index, ducked as enabled, music_db, ambience_db, case when ducked then 120 else 0 end as attack_ms, case when ducked then 500 else 0 end as release_ms, case when not narrated then 'narration_missing_ducking_disabled' end as warning from (select *, {DUCK} from audio_sound) t"


@relation("audio_sound", public=False)
def audio_bounds(d):
    """Scenes with the way each boundary sounds and what they warn of, from the scene before alone."""
    w = "over (partition by project_id order by scene_index)"
    warnings = [("aggressive_ambience_downgraded", "a_top < 0.70e0 and explicit = 'battlefield'"), ("aggressive_music_style_downgraded", "planned_style = 'documentary' and (audio_intent in ('tension', 'climax') or emotional_tone in ('dramatic', 'triumphant'))"), ("aggressive_transition_downgraded", "transition_in = 'crossfade' and audio_intent in ('climax', 'tension') and story_role is null"), ("ambience_disabled_at_zero_energy", "a_top >= 0.70e0 and ambience_raw = 0e0"),
                ("ambience_evidence_insufficient", "a_top < 0.70e0 and (explicit is not null or a_top > 0e0)"), ("ambience_suppressed_by_intentional_silence", "intentional"), ("ambient_bridge_not_supported", "transition_in = 'crossfade' and (ambience_on or previous_on)"), ("narration_missing_ducking_disabled", "not narrated"), ("normal_energy_delta_limited", "adjustment <> 'unchanged'"), ("story_director_scene_count_mismatch", "not accepted"), ("supported_climax_contrast_preserved", "preserved")]
    return f"""
    select *, {DUCK}, {', '.join(f"coalesce({c}, false) as w_{n}" for n, c in warnings)}, concat_ws(',', {', '.join(f"case when {c} then '{n}' end" for n, c in warnings)}) as warnings
    from (select *, case when scene_index = 0 then 'fade_in' when intentional then 'silence' when audio_intent = 'climax' and preserved then 'impact'
        when (story_role in ('contrast', 'counterargument') and coalesce(tension, 0e0) >= 0.8e0) or (hard_cut and story_role in ('revelation', 'climax') and coalesce(emotional, 0e0) >= 0.75e0 and confidence >= 0.75e0) then 'hard_cut' when audio_intent = 'climax' and story_role = 'climax' and confidence >= 0.75e0 then 'riser'
        when ambience_on and previous_on and place_kind = previous_place then 'ambient_bridge' else 'crossfade' end as transition_in
      from (select *, lag(ambience_on) {w} as previous_on, lag(place_kind) {w} as previous_place, lag(style) {w} as previous_style from audio_sound) a) t"""


#: Lengths and reasons of transitions.
WAYS = "case {0} when 'silence' then 300 when 'impact' then 0 when 'hard_cut' then 0 else 800 end"
WHY = """case {0} when 'fade_in' then 'First scene entry.' when 'fade_out' then 'Final scene exit.' when 'silence' then 'Intentional pause defines the scene boundary.' when 'impact' then 'Structurally supported climax contrast.' when 'hard_cut' then 'Strong structural contrast supports a hard cut.'
  when 'riser' then 'Structurally supported climax build.' when 'ambient_bridge' then 'Compatible ambience bridges both scenes.' else 'Conservative scene boundary.' end"""


@relation("audio_bounds")
def audio_transition(d):
    """How the boundary into each scene sounds, how long, and why."""
    return f"select project_id, scene_index, transition_in, {WAYS.format('transition_in')} as ms, {WHY.format('transition_in')} as reason from audio_bounds"


@relation("audio_bounds", public=False)
def audio_pairs(d):
    return "select *, coalesce(lead(transition_in) over (partition by project_id order by scene_index), 'fade_out') as transition_out from audio_bounds"


@relation("audio_pairs")
def transition_pairs(d):
    """Each boundary as one scene's way out and the next one's way in."""
    return f"select project_id, scene_index, transition_in, {WAYS.format('transition_in')} as in_ms, transition_out, {WAYS.format('transition_out')} as out_ms from audio_pairs"


@relation("audio_scenes")
def dominant_tone(d):
    """The tone of most confidence, then scenes, then the fixed order."""
    order = "case emotional_tone " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(TONE_ORDER)) + " end"
    return f"""
    select project_id, emotional_tone as tone, total from (select project_id, emotional_tone, round(sum(confidence), 4) as total, row_number() over (partition by project_id order by round(sum(confidence), 4) desc, count(*) desc, min({order})) as r
      from audio_scenes group by project_id, emotional_tone) t where r = 1"""


@relation("audio_sound")
def default_music_style(d):
    """The most frequent style, silence included, ties by the fixed order."""
    order = "case style " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(STYLE_ORDER)) + " end"
    return f"select project_id, style from (select project_id, style, row_number() over (partition by project_id order by count(*) desc, min({order})) as r from audio_sound group by project_id, style) t where r = 1"


@relation("audio_final")
def energy_curve(d):
    """A project's energies in scene order."""
    return f"select project_id, {d.agg_text('cast(cast(round(final * 10000e0) as int) as string)', ',', 'scene_index')} as curve from audio_final group by project_id"


@relation("audio_bounds")
def adjacent_delta(d):
    """Changes of style from scene to scene."""
    return "select project_id, cast(count_if(coalesce(style <> previous_style, false)) as bigint) as changes from audio_bounds group by project_id"


DIAGNOSTICS = """cast(count(*) as bigint) as scenes, cast(count_if(fallback_used) as bigint) as fallback_count, count_if(fallback_used) * 2 > count(*) as fallback_dominant, max(final) - min(final) <= 0.05e0 as flat, cast(count_if(final <= 0.10e0 or final >= 0.90e0) as bigint) as extreme_energies,
  cast(count_if(coalesce(style <> previous_style, false)) as bigint) as style_changes, cast(count_if(w_aggressive_transition_downgraded) as bigint) as unsupported_transitions, cast(count_if(ambience_on) as bigint) as ambience_scenes, cast(count_if(n_signals = 0 and not narrated) as bigint) as unusable_scenes, cast(sum(conflicts) as bigint) as conflicts,
  case when bool_or(not accepted) then 'story_director_plan' end as missing_inputs, round(greatest(0e0, least(1e0, avg(confidence) - case when count_if(fallback_used) * 2 > count(*) then 0.10e0 else 0e0 end - case when bool_or(not accepted) then 0.05e0 else 0e0 end)), 6) as confidence"""


@relation("audio_bounds")
def audio_project_diagnostics(d):
    """Fallbacks, flat and extreme energy, style changes, transitions, ambience, scenes without
    input, conflicts, missing inputs and confidence."""
    return f"select project_id, {DIAGNOSTICS} from audio_bounds group by project_id"


#: Warnings of scenes, and those of projects with their condition over scenes.
SCENE_WARNINGS = ("aggressive_ambience_downgraded", "aggressive_music_style_downgraded", "aggressive_transition_downgraded", "ambience_disabled_at_zero_energy", "ambience_evidence_insufficient", "ambience_suppressed_by_intentional_silence", "ambient_bridge_not_supported", "narration_missing_ducking_disabled", "normal_energy_delta_limited", "story_director_scene_count_mismatch", "supported_climax_contrast_preserved")
PROJECT_WARNINGS = [("ambience_not_supported_for_any_scene", "not bool_or(ambience_on)"), ("energy_curve_contains_limited_deltas", "bool_or(adjustment <> 'unchanged')"), ("energy_curve_contains_supported_climax_contrast", "bool_or(preserved)"), ("fallback_dominant_audio_plan", "count_if(fallback_used) * 2 > count(*)"), ("fallback_dominant_energy_planning", "count_if(fallback_used) * 2 > count(*)"), ("narration_missing_for_some_scenes", "bool_or(not narrated)")]


def all_warnings() -> str:
    every = sorted([*PROJECT_WARNINGS, *((w, f"bool_or(w_{w})") for w in SCENE_WARNINGS)])
    return "concat_ws(',', " + ", ".join(f"case when {c} then '{n}' end" for n, c in every) + ")"


@relation("audio_bounds")
def warning_union(d):
    """Distinct warnings of a project and its scenes, sorted."""
    return f"select project_id, {all_warnings()} as warnings from audio_bounds group by project_id"


@relation("audio_pairs")
def sound_layers(d):
    """All sound decisions of a scene in one row."""
    return f"select project_id, scene_index, audio_intent, emotional_tone, final as energy, not intentional as music_on, style, music_level, ambience_on, place_kind as place, ambience_level, ducked, music_db, ambience_db, intentional as silence, transition_in, {WAYS.format('transition_in')} as in_ms, transition_out, {WAYS.format('transition_out')} as out_ms, confidence, fallback_used, warnings from audio_pairs"


@relation("audio_bounds")
def assemble_audio(d):
    """The audio project in one pass: dominant tone and default style (counted within windows
    of the project), energy curve, loudness, status, diagnostics and warnings."""
    place = lambda c, order: f"case {c} " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(order)) + " end"
    best = lambda column, key: f"substring(min(concat({key}, {column})), {{0}})"
    tone = best("emotional_tone", f"lpad(cast(cast(round((100000e0 - tone_total) * 10000e0) as bigint) as string), 12, '0'), lpad(cast(1000000 - tone_n as string), 8, '0'), cast({place('emotional_tone', TONE_ORDER)} as string)").format(22)
    style = best("style", f"lpad(cast(1000000 - style_n as string), 8, '0'), cast({place('style', STYLE_ORDER)} as string)").format(10)
    return f"""
    select project_id, {tone} as dominant_tone, {style} as default_music_style, {d.agg_text('cast(cast(round(final * 10000e0) as int) as string)', ',', 'scene_index')} as energy_curve, -14e0 as target_loudness_lufs, case when count_if(fallback_used) * 2 > count(*) then 'fallback' else 'planned' end as status, {all_warnings()} as warnings, {DIAGNOSTICS}
    from (select *, round(sum(confidence) over (partition by project_id, emotional_tone), 4) as tone_total, count(*) over (partition by project_id, emotional_tone) as tone_n, count(*) over (partition by project_id, style) as style_n from audio_bounds) t group by project_id"""


@relation("audio_pairs")
def validate_consistency(d):
    """Whether a plan holds together: boundaries agree on both sides, silence has no enabled
    layer, intensities and decibels keep their ranges; how many scenes do not."""
    return """
    select project_id, cast(count_if(coalesce(before_out <> transition_in, transition_in <> 'fade_in')) as bigint) as boundary_conflicts, cast(count_if(intentional and (style <> 'none' or ambience_on or ducked)) as bigint) as silence_conflicts, cast(count_if(final not between 0e0 and 1e0 or music_level not between 0e0 and 1e0 or ambience_level not between 0e0 and 1e0 or music_db > 0e0 or ambience_db > 0e0 or confidence not between 0e0 and 1e0) as bigint) as range_conflicts
    from (select *, lag(transition_out) over (partition by project_id order by scene_index) as before_out from audio_pairs) t group by project_id"""
