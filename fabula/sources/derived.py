"""Timed narrative inputs derived from the event tables (one project a user and four days)."""

from ..plans.relation import relation

#: A second of the story is so many seconds of event time.
PACE = "1800e0"

#: What an event says, by its type and event_id modulo 4.
PHRASES = [
    ("view", 0, "According to records the evidence showed a pattern in the city street."),
    ("view", 1, "Our story begins at the hospital street, an aerial overview."),
    ("view", 2, "The old map of the territory and its borders."),
    ("view", 3, "A portrait of the president and the doctor in a quiet room."),
    ("error", 0, "The crisis brought danger and risk, so we need to take action."),
    ("error", 1, "Experts disputed and denied the claim."),
    ("error", 2, "It grew worse, an urgent threat of violence and death."),
    ("error", 3, "There was no danger, yet fear and grief remained."),
    ("purchase", 0, "The truth was revealed and discovered."),
    ("purchase", 1, "Finally, in the end a conclusion."),
    ("purchase", 2, "Because of hope, a recovery was possible, a chance for the future."),
    ("purchase", 3, "Victory and success, joy for all who celebrate."),
    ("signup", 0, "What happened here?"),
    ("signup", 1, "Looking back, the legacy remained."),
    ("signup", 2, "Years later people remember the photographs and the footage."),
    ("signup", 3, "At the time, before 1999, the background was unknown and hidden."),
    ("click", 0, "However, it went on because of the map route."),
    ("click", 1, "A quiet calm steady room."),
    ("click", 2, "The crowd at the train station, a vehicle near the airport."),
    ("click", 3, "Meanwhile the decisive turning point came to light in 2004."),
]


@relation(public=False)
def phrases(d):
    return d.values("p", ("kind", "variant", "phrase"), PHRASES)


@relation("events", "phrases", public=False)
def said(d):
    """Events with project, story time and phrase."""
    day = "dayofyear(ts)"
    return f"""
    select concat(cast(user_id as string), '-', cast(cast(floor(({day} - 1) / 4) as int) as string)) as project_id,
           cast({day} as int) as day, event_id, user_id, event_type, value, {d.seconds("ts")} as instant, phrase
    from events join phrases on kind = event_type and variant = event_id % 4"""


@relation("said", public=False)
def timed(d):
    return f"""
    select *, {d.round(f'(instant - min(instant) over (partition by project_id)) / {PACE}', 3)} as t,
           cast(row_number() over (partition by project_id order by instant, event_id) as int) as n
    from said"""


@relation("timed")
def scenes(d):
    """scan/derivation of scenes: project_id, scene_index, scene_count, start, end, text."""
    return f"""
    select project_id, cast(row_number() over (partition by project_id order by day) - 1 as int) as scene_index,
           cast(count(*) over (partition by project_id) as int) as scene_count, first_t as scene_start,
           coalesce(lead(first_t) over (partition by project_id order by day), last_t + 5e0) as scene_end, voiceover_text
    from (select project_id, day, min(t) as first_t, max(t) as last_t, {d.agg_text("phrase", " ", "n")} as voiceover_text
          from timed group by project_id, day)"""


@relation("timed", public=False)
def spoken(d):
    """Timed words: each event's phrase spread evenly over a second and a half."""
    return f"""
    select project_id, n, t, word, place, size, cast(row_number() over (partition by project_id order by n, place) as int) as word_index,
           {d.round('t + 1.5e0 * (place - 1) / size', 6)} as word_start, {d.round('t + 1.5e0 * place / size', 6)} as word_end
    from (select project_id, n, t, word, place, {d.size("parts")} as size
          from {d.unnest_at(f"(select project_id, n, t, {d.split('phrase', ' ')} as parts from timed)", "parts", "word", "place")})"""


@relation("timed", public=False)
def captions(d):
    """One caption an event: start, end and text."""
    return """
    select project_id, cast(n as int) as caption_id, t as caption_start, round(t + 1.5e0, 3) as caption_end, phrase as caption_text from timed"""


@relation("timed", public=False)
def analyses(d):
    """Frame analyses: intervals of at most 6 (some scenes' midpoints lie between them) with
    focus, faces, how much of the frame a subject fills, and confidence, from event values."""
    return """
    select project_id, n, t as analysis_start, least(coalesce(lead(t) over (partition by project_id order by n), t + 5e0), t + 6e0) as analysis_end,
           round(value * 0.53e0 - floor(value * 0.53e0), 4) as focus_x, round(value * 0.37e0 - floor(value * 0.37e0), 4) as focus_y, cast(event_id % 3 as int) as face_count,
           round((value / 53e0 - floor(value / 53e0)) * 0.5e0, 4) as subject_scale, round(0.25e0 + (value / 89e0 - floor(value / 89e0)) * 0.7e0, 4) as confidence,
           case when event_id % 3 > 0 then 'face' when event_id % 2 = 0 then 'saliency' else 'center' end as source
    from timed"""


@relation("timed", public=False)
def faces(d):
    """Boxes of faces in frames of 1920 by 1080, one or two at the events that have faces."""
    return """
    select project_id, n, face, 100e0 + value * 7e0 + 400e0 * face as x, 60e0 + value * 3e0 + 90e0 * face as y, 80e0 + value + 40e0 * face as w, 100e0 + value * 1.3e0 as h
    from timed join (select 1 as face union all select 2) f on face <= event_id % 3"""
