"""Story analysis by hand: five scenes with captions and match terms, and scenes without words."""

import pytest

from fabula.plans import registry  # noqa: F401  (registers the relations)
from fabula.plans.relation import RELATIONS, apply

TEXTS = [
    "What happened inside the hospital? This is where the investigation begins.",
    "According to records, the evidence showed a repeated pattern.",
    "However, experts challenged the claim because the data was incomplete.",
    "Years later, the truth was revealed in new documents.",
    "Ultimately, the result remains disputed. Was justice served?",
]


def project(spark, texts, captions=(), notes=()):
    n = len(texts)
    return {
        "scenes": spark.createDataFrame([("p", i, n, i * 5.0, i * 5.0 + 5, t) for i, t in enumerate(texts)], "project_id string, scene_index int, scene_count int, scene_start double, scene_end double, voiceover_text string"),
        "captions": spark.createDataFrame([("p", i, float(s), float(e), t) for i, (s, e, t) in enumerate(captions, 1)], "project_id string, caption_id int, caption_start double, caption_end double, caption_text string"),
        "scene_notes": spark.createDataFrame([("p", *x) for x in notes], "project_id string, scene_index int, narration string, match_terms string"),
    }


def rows(spark, name, *columns, **given):
    return sorted(tuple(r[c] for c in columns) for r in apply(name, spark, **given).collect())


def test_five_scenes(spark):
    given = project(spark, TEXTS, [(i * 5 + 0.1, i * 5 + 4.8, t) for i, t in enumerate(TEXTS)], [(0, None, "hospital evidence"), (1, "", "hospital evidence")])
    text = f"{TEXTS[0]} hospital evidence {TEXTS[0]}"
    assert rows(spark, "story_text", "scene_index", "text", **given)[0] == (0, text)
    # hook by question; records and evidence; contrast (however) with a challenge; revealed; last without reflection
    assert rows(spark, "story_role", "role", "scene_index", **given) == sorted([("hook", 0), ("evidence", 1), ("counterargument", 2), ("revelation", 3), ("resolution", 4)])
    document = apply("story_document", spark, **given).first()
    assert (document.story_shape, document.opening, document.resolution) == ("contested_resolution", "direct_question", "open_question")
    # tension of the inner scenes: 0.25 + 0.5 (1 - |i/4 - 0.72|) + signals; scene 3 (0.735 + 0.10) leads
    assert document.climax == 3
    # changes: scene 1 |0.515 - 0.44| + 0.26 * 0.35, scene 2 |0.70 - 0.515| + 0.36 * 0.35
    assert document.turning == 2
    assert apply("central_question", spark, **given).first().question == "What happened inside the hospital?"
    edges = rows(spark, "story_edges", "from_scene", "to_scene", "relation", **given)
    assert edges == [(0, 1, "adds_evidence"), (1, 2, "challenges_previous"), (2, 3, "contrasts_previous"), (3, 4, "opens_question")]  # "men" is in "documents"


def test_scores_of_a_scene(spark):
    given = project(spark, ["Calm words here", "The crisis was revealed in a report", "end"])
    got = {r.scene_index: r for r in apply("story_scores", spark, **given).collect()}
    # the middle: place 0.5, escalation, reveal and evidence
    assert got[1].tension == pytest.approx(0.25 + 0.5 * (1 - 0.22) + 0.13 + 0.10, abs=1e-4)
    assert got[1].revelation == pytest.approx(0.08 + 0.62 + 0.18, abs=1e-4) and got[1].emotional == pytest.approx(0.28 + 0.36 + 0.20, abs=1e-4)
    # crisis, revealed, report
    assert got[1].information == pytest.approx(0.18 + 3 / 55 + 0.12, abs=1e-4)
    assert got[1].confidence == pytest.approx(0.58 + 3 * 0.045 + 0.08, abs=1e-4)


def test_scenes_without_words_fall_back(spark):
    given = project(spark, ["", "  ", None])
    got = [(r.scene_index, r.role) for r in apply("story_role", spark, **given).orderBy("scene_index").collect()]
    assert got == [(0, "development"), (1, "development"), (2, "development")]
    assert rows(spark, "story_phase", "scene_index", "phase", **given) == [(0, "opening"), (1, "middle"), (2, "closing")]
    assert {tuple(r)[2:] for r in apply("story_scores", spark, **given).collect()} == {(0.5, 0.0, 0.5, 0.5, 0.25)}
    assert rows(spark, "continuity_relation", "scene_index", "continuity", **given) == [(0, "introduces_topic"), (1, "continues_previous"), (2, "continues_previous")]
    assert rows(spark, "story_fallback_summary", "fallback_count", "status", "warnings", **given) == [(3, "fallback", "3 scene(s) used deterministic fallback analysis.")]
    assert len(rows(spark, "story_fallback", "scene_index", **given)) == 3
    # an empty caption, a stop word and a caption of another scene give no words either
    given = project(spark, ["the", "real words"], [(1, 2, " "), (4.9, 5.3, "other caption words")])
    assert rows(spark, "story_fallback", "scene_index", **given) == [(0,)]


@pytest.mark.parametrize("text,role", [("En fråga om detta", "hook"), ("An open question", "hook"), ("Is water wet?", "hook"), ("It was revealed", "hook"), ("Plain beginnings", "setup")])
def test_how_a_first_scene_opens(spark, text, role):
    assert rows(spark, "story_role", "scene_index", "role", **project(spark, [text, "something else"]))[0] == (0, role)


def test_sentences_end_before_any_white_space(spark):
    given = project(spark, ["One.  Two?\nThree! Four... five", ""])
    assert rows(spark, "sentence_regex_split", "place", "sentence", **given)[:5] == [(1, ""), (1, "One."), (2, "Two?"), (3, "Three!"), (4, "Four...")]


def spoken(spark, *words):
    return spark.createDataFrame([("p", i, w, float(s), float(e)) for i, (w, s, e) in enumerate(words, 1)], "project_id string, word_index int, word string, word_start double, word_end double")


def test_sentences_of_words_end_at_closing_quotes(spark):
    given = spoken(spark, *[(w, i, i + 0.5) for i, w in enumerate('He said "stop." Then left.'.split())], (" ", 9, 9.5))
    assert rows(spark, "sentence_split", "sentence", "text", spoken=given) == [(0, 'He said "stop."'), (1, "Then left.")]


def test_turns_begin_beats(spark):
    # a sentence of 5 seconds, then one that begins with a turn word; years after "in" count as well
    for first, beats in (("Because", [1, 2]), ("Therefore", [1, 2]), ("Other", [1, 1])):
        given = spoken(spark, ("Begin", 0, 1), ("here.", 4, 5), (first, 5.5, 6), ("goes.", 6, 7))
        assert [b for _, b in rows(spark, "beat_segmentation", "sentence", "beat", spoken=given)] == beats
    for text, beats in (("In 1999 it", [1, 2]), ("In 19999 it", [1, 1])):
        given = spoken(spark, ("Begin", 0, 1), ("here.", 4, 5), *[(w, 5.5 + i, 6 + i) for i, w in enumerate(text.split())])
        assert [b for _, b in rows(spark, "beat_segmentation", "sentence", "beat", spoken=given)] == beats


def test_beats_reach_from_0_to_the_end_of_the_audio(spark):
    lengths = spark.createDataFrame([("p", 30.0), ("silent", 9.0)], "project_id string, duration double")
    given = spoken(spark, ("Begin", 1, 2), ("here.", 4, 6), ("Finally", 6.5, 7), ("it", 7, 8), ("ends.", 8, 9))
    assert rows(spark, "beat_align", "project_id", "beat", "beat_start", "beat_end", "text", spoken=given, project_lengths=lengths) == [("p", 1, 0.0, 6.5, "Begin here."), ("p", 2, 6.5, 30.0, "Finally it ends."), ("silent", 1, 0.0, 9.0, "documentary")]


def test_words_without_times(spark):
    given = spark.createDataFrame([("p", 1, " a \t b ", None, None), ("p", 2, " ", 1.0, 2.0), ("p", 3, "c", 3.0, None), ("p", 4, "d", 4.0, 4.0)], "project_id string, word_index int, word string, word_start double, word_end double").selectExpr("*", "2.5D as segment_start")
    got = rows(spark, "explode_words", "word_index", "word", "word_start", "word_end", recognised=given)
    assert [(i, w, s, round(e, 3)) for i, w, s, e in got] == [(1, "a b", 2.5, 2.68), (3, "c", 3.0, 3.18), (4, "d", 4.0, 4.12)]


@pytest.mark.parametrize("start,frame", [(0.15, 4), (0.25, 8), (0.05, 2), (0.17, 5)])
def test_boundaries_round_halves_to_even(spark, start, frame):
    scenes = spark.createDataFrame([("p", 0, 2, 0.0, start, ""), ("p", 1, 2, start, 9.0, "")], "project_id string, scene_index int, scene_count int, scene_start double, scene_end double, voiceover_text string")
    assert rows(spark, "transition_boundaries", "frame", scenes=scenes) == [(frame,)]


def test_every_number_of_a_name_counts(spark):
    names = ["a_2_10.jpg", "a_2_9.jpg", "A_10_1.jpg", "a_002_1.jpg", "10.jpg", "9.jpg", "a!.jpg", "a.jpg", "ab_1", "a" + "9" * 30, "a" + "1" + "0" * 30]
    profiles = spark.createDataFrame([(i, 1, f) for i, f in enumerate(names)], "image_id long, user_id long, file string")
    got = [names[r.image_id] for r in apply("natural_sort", spark, profiles=profiles).orderBy("place").collect()]
    import re

    key = lambda n: [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", n)]
    assert got == sorted(sorted(names), key=key)


def test_captions_stay_where_moving_is_off(spark):
    required = spark.createDataFrame([(p, i, q) for p in ("on", "off") for i, q in enumerate([None, "top", None, "bottom"])], "project_id string, scene_index int, position string")
    settings = spark.createDataFrame([("on", "bottom", True), ("off", "top", False)], "project_id string, default_position string, allow_reposition boolean")
    got = rows(spark, "placement_stability", "project_id", "scene_index", "position", "moved", required_position=required, caption_settings=settings)
    assert got == [("off", i, "top", False) for i in range(4)] + [("on", 0, "bottom", False), ("on", 1, "top", True), ("on", 2, "top", False), ("on", 3, "bottom", True)]


FORMATTING = {"srt_timestamp", "required_position", "music_plan", "candidate_reason", "legacy_zoom", "sink_srt"}


def test_public_relations_make_nothing_up():
    """No residue of a key, no length of an id decides anything in a public rule: what is wrong
    with some rows is said by private relations, which apply() replaces."""
    import re

    from fabula.plans.relation import Duck, Spark

    for name, r in RELATIONS.items():
        if r.public and name not in FORMATTING:
            for dialect in (Spark(), Duck()):
                text = r.sql(dialect)
                assert not re.search(r"length\(\w*\.?project_id\)", text), name
                found = [m for m in re.findall(r"(\w+) % \d+", text) if m not in ("n", "x")]
                assert not found, (name, found)
