"""Story analysis of scenes: roles, phases, scores, structure, and one document a project."""

from ..plans.relation import quote, relation
from .text import SIGNALS, WORD_STORY, clamp, has, story_tokens


#: Words that ask as a question mark does.
QUESTION_WORDS = ("question", "fråga")


@relation("match_terms", public=False)
def scene_notes(d):
    """What a scene carries beside its voice-over: narration (none here) and its match terms."""
    return f"select project_id, scene_index, cast(null as string) as narration, {d.agg_text('term', ' ', 'term')} as match_terms from match_terms group by project_id, scene_index"


@relation("caption_scene_interval_join", "captions", public=False)
def scene_captions(d):
    """The texts of the captions whose midpoint a scene covers, in order; blank ones left out."""
    return f"select j.project_id, j.scene_index, {d.agg_text('said', ' ', 'j.caption_id')} as captions from caption_scene_interval_join j join (select project_id, caption_id, {d.strip('caption_text')} as said from captions) c on c.project_id = j.project_id and c.caption_id = j.caption_id where said <> '' group by j.project_id, j.scene_index"


@relation("scenes", "scene_notes", "scene_captions", public=False)
def story_text(d):
    """A scene's whole text: voice-over, narration, match terms and its captions, without
    blank ones."""
    parts = ", ".join(f"nullif({d.strip(c)}, '')" for c in ("s.voiceover_text", "narration", "match_terms"))
    return f"""
    select s.project_id, s.scene_index, s.scene_count, concat_ws(' ', {parts}, captions) as text from scenes s
    left join scene_notes n on n.project_id = s.project_id and n.scene_index = s.scene_index left join scene_captions c on c.project_id = s.project_id and c.scene_index = s.scene_index"""


@relation("story_text", public=False)
def story_flags(d):
    flags = ", ".join(f"case when {has('text', s)} then 1 else 0 end as f_{s}" for s in SIGNALS)
    asks = " or ".join(d.contains_item("words", quote(w)) for w in QUESTION_WORDS)
    return f"""
    select project_id, scene_index, scene_count, text, words, {d.size('words')} as n_words, {d.size('words')} = 0 as fallback_used,
           case when contains(text, '?') or {asks} then 1 else 0 end as f_question, {', '.join('f_' + s for s in SIGNALS)}
    from (select *, {story_tokens(d, 'text')} as words, {flags} from story_text)"""


@relation("story_flags", public=False)
def story_base(d):
    """Role and scores of each scene; one without content words takes the fallback's."""
    relative = "(scene_index / greatest(1e0, scene_count - 1e0))"
    beats = "(f_question + f_contrast + f_challenge + f_evidence + f_reveal + f_escalation + f_conclusion + f_reflection)"
    known = lambda x, otherwise: f"case when fallback_used then {otherwise} else {x} end"
    return f"""
    select *, {known(clamp(d, "0.58e0 + 0.045e0 * beats + case when role in ('development', 'unknown') then 0e0 else 0.08e0 end"), '0.25e0')} as confidence
    from (select *, {relative} as relative, {beats} as beats,
      case when fallback_used then 'development' when scene_count = 1 then case when f_question = 1 then 'hook' else 'development' end
           when scene_index = 0 then case when f_question = 1 or f_reveal = 1 then 'hook' else 'setup' end
           when scene_index = scene_count - 1 then case when f_reflection = 1 then 'epilogue' else 'resolution' end
           when f_reveal = 1 then 'revelation' when f_contrast = 1 and f_challenge = 1 then 'counterargument'
           when f_contrast = 1 then 'contrast' when f_evidence = 1 then 'evidence' when f_escalation = 1 then 'complication' else 'development' end as role,
      {known(clamp(d, f"0.25e0 + 0.5e0 * (1e0 - abs({relative} - 0.72e0)) + 0.13e0 * f_escalation + 0.10e0 * f_reveal + 0.06e0 * f_contrast + 0.05e0 * f_question"), '0.5e0')} as tension,
      {known(clamp(d, "0.08e0 + 0.62e0 * f_reveal + 0.18e0 * f_evidence + 0.10e0 * f_challenge"), '0e0')} as revelation,
      {known(clamp(d, "0.28e0 + 0.36e0 * f_escalation + 0.20e0 * f_reveal + 0.10e0 * f_question + 0.08e0 * f_contrast"), '0.5e0')} as emotional,
      {known(clamp(d, "0.18e0 + least(0.62e0, n_words / 55e0) + 0.12e0 * f_evidence + 0.08e0 * f_cause"), '0.5e0')} as information
      from story_flags)"""


@relation("story_base")
def story_role(d):
    """Role by place and signals."""
    return "select project_id, scene_index, role from story_base"


@relation("story_base")
def story_scores(d):
    """Tension, revelation, emotion, information and confidence of each scene."""
    return "select project_id, scene_index, tension, revelation, emotional, information, confidence from story_base"


#: Phases by role and place. The shares of the story where phases end.
PHASE = """case when fallback_used then case when scene_index = 0 then 'opening' when scene_index = scene_count - 1 and scene_count > 1 then 'closing' else 'middle' end when scene_count <= 1 or scene_index = 0 then 'opening' when scene_index = scene_count - 1 then 'closing'
  when role in ('complication', 'turning_point', 'climax', 'resolution') then role when role = 'epilogue' then 'closing'
  when relative <= 0.22e0 then 'setup' when relative <= 0.48e0 then 'rising_action' when relative <= 0.68e0 then 'middle'
  when relative <= 0.84e0 then 'falling_action' else 'resolution' end"""


@relation("story_base")
def story_phase(d):
    """Phase by role, else by relative place."""
    return f"select project_id, scene_index, {PHASE} as phase from story_base"


@relation("story_base")
def position_relative(d):
    """A scene's place from 0 to 1, and as a share of the count."""
    return "select project_id, scene_index, round(relative, 6) as relative, round(scene_index * 1e0 / scene_count, 6) as share from story_base"


@relation("story_base", public=False)
def story_adjacent(d):
    overlap = f"{d.common('words', 'previous')} / greatest(1e0, {d.union_size('words', 'previous')})"
    return f"select *, case when previous is null then null else {overlap} end as jaccard from (select *, lag(words) over (partition by project_id order by scene_index) as previous, lag(tension) over (partition by project_id order by scene_index) as previous_tension from story_base)"


@relation("story_adjacent")
def continuity_relation(d):
    """How a scene goes on from the one before."""
    return """
    select project_id, scene_index, case when fallback_used then case when scene_index = 0 then 'introduces_topic' else 'continues_previous' end
      when scene_index = 0 then case when contains(text, '?') then 'opens_question' else 'introduces_topic' end
      when f_contrast = 1 and f_challenge = 1 then 'challenges_previous' when f_contrast = 1 then 'contrasts_previous'
      when role = 'revelation' then 'reveals_new_information' when role = 'evidence' then 'adds_evidence'
      when role in ('resolution', 'epilogue') then case when contains(text, '?') then 'opens_question' else 'resolves_previous' end
      when tension >= 0.72e0 then 'escalates_tension' when jaccard >= 0.08e0 then 'continues_previous' else 'deepens_context' end as continuity
    from story_adjacent"""


@relation("story_adjacent")
def self_adjacent(d):
    """Tension of each scene beside the one before."""
    return "select project_id, scene_index, tension, previous_tension, round(abs(tension - previous_tension), 4) as change from story_adjacent"


@relation("story_adjacent")
def token_set_ops(d):
    """Sizes of the common and joint words of neighbouring scenes."""
    return f"select project_id, scene_index, cast({d.common('words', 'previous')} as int) as n_common, cast({d.union_size('words', 'previous')} as int) as n_union from story_adjacent where previous is not null"


@relation("story_adjacent", public=False)
def story_marked(d):
    """Scenes with the interior flag and the project's climax and turning point."""
    inner = "(scene_count = 2 or scene_index between 1 and scene_count - 2)"
    return f"""
    select *, first_value(scene_index) over (partition by project_id order by case when interior and scene_index <> climax then 0 else 1 end, change desc, scene_index) as turning_raw,
           sum(case when interior and scene_index <> climax then 1 else 0 end) over (partition by project_id) as candidates
    from (select *, case when scene_count = 1 then 0 else first_value(scene_index) over (partition by project_id order by case when interior then 0 else 1 end, tension desc, revelation desc, scene_index) end as climax,
                 case when scene_index = 0 then 0e0 else abs(tension - previous_tension) + revelation * 0.35e0 end as change
          from (select *, {inner} as interior from story_adjacent))"""


@relation("story_marked")
def climax_scene(d):
    """The interior scene of most tension, then revelation, then the earliest."""
    return "select distinct project_id, climax from story_marked"


@relation("story_marked")
def turning_point(d):
    """The interior scene of most change that is not the climax, or the climax."""
    return "select distinct project_id, case when candidates = 0 then climax else turning_raw end as turning from story_marked"


@relation("story_marked")
def structural_roles(d):
    """Roles and phases with the turning point and the climax put in."""
    turn = "(scene_count > 1 and candidates > 0 and scene_index = turning_raw)"
    peak = "(scene_count > 1 and scene_index = climax)"
    return f"""
    select project_id, scene_index, scene_count, case when {peak} then 'climax' when {turn} then 'turning_point' else role end as story_role,
           case when {peak} then 'climax' when {turn} then 'turning_point' else {PHASE} end as story_phase, tension, emotional, revelation, confidence
    from story_marked"""


@relation("continuity_relation", "structural_roles")
def story_edges(d):
    """Edges between neighbouring scenes with the relation and strength of the later one."""
    return f"""
    select c.project_id, c.scene_index - 1 as from_scene, c.scene_index as to_scene, continuity as relation, {clamp(d, "0.52e0 + 0.22e0 * confidence + 0.16e0 * tension")} as strength
    from continuity_relation c join structural_roles s on s.project_id = c.project_id and s.scene_index = c.scene_index where c.scene_index > 0"""


@relation("story_flags")
def signal_counts(d):
    """Scenes of each project that show a signal."""
    counts = ", ".join(f"cast(sum(f_{s}) as bigint) as n_{s}" for s in ("reveal", "evidence", "contrast", "challenge", "chronology"))
    return f"select project_id, cast(sum(case when contains(text, '?') then 1 else 0 end) as bigint) as n_question, {counts}, max(f_cause) = 1 as any_cause, max(f_conclusion) = 1 as any_conclusion from story_flags group by project_id"


@relation("signal_counts")
def story_shape(d):
    """First matching shape of a decision list over the counts."""
    return """
    select project_id, case when n_question > 0 and n_challenge > 0 then 'contested_resolution' when n_question > 0 and n_reveal > 0 then 'mystery_reveal'
      when n_evidence >= 2 or n_question > 0 then 'investigation' when n_contrast >= 2 then 'contrast' when any_cause and any_conclusion then 'problem_solution'
      when n_chronology >= 2 then 'chronological_history' else 'linear_explanation' end as story_shape from signal_counts"""


@relation("story_adjacent")
def coherence(d):
    """0.55 plus 0.45 times the mean word overlap of neighbours."""
    return f"select project_id, {clamp(d, '0.55e0 + coalesce(avg(jaccard), 0e0) * 0.45e0')} as coherence from story_adjacent group by project_id"


@relation("story_flags")
def opening_strategy(d):
    """How the first scene opens."""
    return "select project_id, case when contains(text, '?') then 'direct_question' when f_chronology = 1 then 'chronological_setup' when f_reveal = 1 then 'immediate_revelation' else 'contextual_setup' end as opening from story_flags where scene_index = 0"


@relation("story_flags")
def resolution_type(d):
    """How the last scene ends."""
    return "select project_id, case when contains(text, '?') then 'open_question' when f_call = 1 then 'call_to_action' when f_reflection = 1 then 'reflective' when f_challenge = 1 or f_contrast = 1 then 'ambiguous' when f_conclusion = 1 then 'closed' else 'none' end as resolution from story_flags where scene_index = scene_count - 1"


@relation("story_flags", "sentence_regex_split")
def central_question(d):
    """The first sentence with a question mark, else the three most frequent words."""
    return f"""
    select p.project_id, coalesce(q.sentence, case when t.terms is null then 'Unknown.' else concat('What explains ', t.terms, '?') end) as question
    from (select distinct project_id from story_flags) p
    left join (select project_id, sentence from (select *, row_number() over (partition by project_id order by scene_index, place) as r from sentence_regex_split where contains(sentence, '?')) a where r = 1) q on q.project_id = p.project_id
    left join (select project_id, {d.agg_text("word", " ", "r")} as terms from (select project_id, word, row_number() over (partition by project_id order by count(*) desc, word) as r from {d.unnest("(select project_id, words from story_flags) s", "words", "word")} group by project_id, word) b where r <= 3 group by project_id) t on t.project_id = p.project_id"""


@relation("structural_roles")
def tension_curve(d):
    """A project's tensions in scene order."""
    return f"select project_id, {d.agg_text('cast(cast(round(tension * 10000e0) as int) as string)', ',', 'scene_index')} as curve from structural_roles group by project_id"


@relation("story_shape", "opening_strategy", "resolution_type", "coherence", "climax_scene", "turning_point", "signal_counts")
def story_document(d):
    """One row a project: shape, opening, resolution, structure and confidence."""
    return f"""
    select s.project_id, story_shape, opening, resolution, coherence, climax, turning, {clamp(d, "0.56e0 + least(0.32e0, 0.04e0 * (n_question + n_evidence + n_reveal + n_contrast))")} as confidence
    from story_shape s join opening_strategy o on o.project_id = s.project_id join resolution_type r on r.project_id = s.project_id join coherence c on c.project_id = s.project_id
    join climax_scene x on x.project_id = s.project_id join turning_point t on t.project_id = s.project_id join signal_counts n on n.project_id = s.project_id"""


#: What a scene gets that can't be analysed.
FALLBACK_ROW = "concat('scene_', lpad(cast(scene_index + 1 as string), 3, '0')) as scene_id, 'development' as story_role, case when scene_index = 0 then 'opening' when scene_index = scene_count - 1 and scene_count > 1 then 'closing' else 'middle' end as story_phase, 0.5e0 as tension, 0.5e0 as emotional_intensity, 0.5e0 as information_density, 0e0 as revelation_strength, case when scene_index = 0 then 'introduces_topic' else 'continues_previous' end as continuity_relation, 0.25e0 as confidence, true as fallback_used, 'Deterministic fallback due to insufficient story metadata.' as reason"


@relation("story_flags")
def story_fallback(d):
    """The default rows of scenes without content words."""
    return f"select project_id, scene_index, {FALLBACK_ROW} from story_flags where fallback_used"


@relation("scenes")
def story_fallback_plan(d):
    """The plan of a project that could not be analysed: default rows for all its scenes."""
    return f"select project_id, scene_index, {FALLBACK_ROW} from scenes"


@relation("story_flags")
def story_fallback_summary(d):
    """How many scenes of a project have no content words and fall back, the status and the
    warning that gives."""
    n = "count_if(fallback_used)"
    return f"""
    select project_id, cast({n} as bigint) as fallback_count, case when {n} > 0 then 'fallback' else 'planned' end as status, case when {n} > 0 then concat(cast({n} as string), ' scene(s) used deterministic fallback analysis.') end as warnings
    from story_flags group by project_id"""
