"""Interval joins in cells against comparisons of all pairs, in one dense project."""

import random

import pytest

from fabula.plans import registry  # noqa: F401  (registers the relations)
from fabula.plans.relation import apply

R = random.Random(6)
STEP = [0.0, 0.5, 16.0, 31.9, 48.0]


def intervals(n, longest=40.0):
    out = []
    for _ in range(n):
        a = R.choice(STEP) if R.random() < 0.3 else round(R.uniform(-20, 400), 1)
        out.append((a, round(a + R.choice([0.0, 0.5, 16.0, R.uniform(0, longest)]), 2)))
    return out


@pytest.fixture(scope="module")
def given(spark):
    scenes = [(p, i, 60, s, e, "") for p in "ab" for i, (s, e) in enumerate(intervals(60))]
    analyses = [(p, i, s, e, 0.5, 0.5, 1, 0.1, 0.5, "face") for p in "ab" for i, (s, e) in enumerate(intervals(50, 8.0))] + [("b", 50, 3.0, 9.0, 0.1, 0.2, 0, 0.0, 0.1, "center"), ("b", 51, 2.0, 10.0, 0.1, 0.2, 0, 0.0, 0.1, "center")]
    captions = [(p, i, s, e, "x") for p in "ab" for i, (s, e) in enumerate(intervals(80, 5.0))]
    spoken = [(p, i, R.choice(STEP) if i % 3 == 0 else round(R.uniform(-30, 420), 1)) for p in "ab" for i in range(120)]
    tables = {
        "scenes": (scenes, "project_id string, scene_index int, scene_count int, scene_start double, scene_end double, voiceover_text string"),
        "analyses": (analyses, "project_id string, n int, analysis_start double, analysis_end double, focus_x double, focus_y double, face_count int, subject_scale double, confidence double, source string"),
        "captions": (captions, "project_id string, caption_id int, caption_start double, caption_end double, caption_text string"),
        "spoken": (spoken, "project_id string, word_index int, word_start double"),
    }
    return {n: spark.createDataFrame(*t) for n, t in tables.items()}, {n: t[0] for n, t in tables.items()}


def rows(spark, name, given, *columns):
    return sorted(tuple(r[c] for c in columns) for r in apply(name, spark, **given).collect())


def test_captions_in_scenes(spark, given):
    frames, raw = given
    want = [(p, c, i) for p, c, s, e, _ in raw["captions"] for q, i, _, a, b, _ in raw["scenes"] if p == q and a <= (s + e) * 0.5 < b]
    assert rows(spark, "caption_scene_interval_join", frames, "project_id", "caption_id", "scene_index") == sorted(want) and want


def test_captions_on_screen(spark, given):
    frames, raw = given
    want = {(p, i): min((c for q, c, s, e, _ in raw["captions"] if p == q and s <= t <= e), default=None) for p, i, t in raw["spoken"]}
    assert rows(spark, "active_caption", frames, "project_id", "word_index", "caption_id") == sorted((*k, c) for k, c in want.items() if c is not None)


def test_analyses_of_scenes(spark, given):
    frames, raw = given
    want, covering = [], []
    for p, i, _, s, e, _ in raw["scenes"]:
        m, own = (s + e) * 0.5, [a for a in raw["analyses"] if a[0] == p]
        cover = [a for a in own if a[2] <= m < a[3]]
        best = min(cover, key=lambda a: a[1]) if cover else min(own, key=lambda a: (abs((a[2] + a[3]) * 0.5 - m), a[1]))
        want.append((p, i, best[2], bool(cover)))
        if cover:
            covering.append((p, i, min(cover, key=lambda a: (a[2], a[3]))[2]))
    assert rows(spark, "semantic_to_analysis", frames, "project_id", "scene_index", "analysis_start", "covers") == sorted(want)
    assert rows(spark, "analysis_for_scene", frames, "project_id", "scene_index", "analysis_start") == sorted(covering)
    assert {w[3] for w in want} == {True, False}


def test_motion_of_captions(spark, given):
    frames, raw = given
    plans = [(p, i, s, e, 0.0 + i, 0.0 + i, 0.0, 0.0, 0.0, 0.0, 0.0) for p, i, _, s, e, _ in raw["scenes"]]
    motion = spark.createDataFrame(plans, "project_id string, scene_index int, scene_start double, scene_end double, z0 double, z1 double, x0 double, y0 double, x1 double, y1 double, hold double")
    pacing = spark.createDataFrame([(p, i, 0.1, 0.3, 0.3, 0.3) for p, i, *_ in raw["scenes"]], "project_id string, scene_index int, hold double, ease_in double, peak double, ease_out double")
    want = []
    for p, c, t, _, _ in raw["captions"]:
        own = [i for q, i, _, _, e, _ in raw["scenes"] if q == p]
        want.append((p, c, min((i for q, i, _, _, e, _ in raw["scenes"] if q == p and t < e), default=max(own))))
    assert rows(spark, "motion_state_lookup", {"captions": frames["captions"], "motion_continuity": motion, "pacing_profile": pacing}, "project_id", "caption_id", "scene_index") == sorted(want)
