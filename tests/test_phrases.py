"""Phrases of scenes: the line of a scene is worked out once, not for each phrase."""

import re

from fabula.plans.registry import QUERIES
from fabula.plans.relation import apply

SF = "/root/testdata/sf0.001"


def test_line_is_computed_once(spark):
    plan = QUERIES["phrase_occurs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(?i)lambdafunction\(contains\(concat", plan)


def test_phrases_of_lines(spark):
    text = spark.createDataFrame([("p", 0, " no danger in the end "), ("p", 1, " the end "), ("p", 2, " risk danger risk "), ("p", 3, None)], "project_id string, scene_index int, line string")
    assert sorted(map(tuple, apply("phrase_occurs", spark, audio_text=text).collect())) == [("p", 0, "danger"), ("p", 0, "in the end"), ("p", 2, "danger"), ("p", 2, "risk")]
    assert sorted((r.scene_index, r.phrase) for r in apply("phrase_negated", spark, audio_text=text).collect() if r.negated) == [(0, "danger"), (0, "in the end")]


def test_phrases_are_tried_where_they_were_found(spark):
    plan = QUERIES["phrase_negated"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") <= 2  # 4 with a join
    assert plan.count("regexp_extract_all") <= 4  # not for each phrase


def test_negations_of_phrases(spark):
    lines = [" no danger ", " danger no ", " not a single risk ", " not one more big risk ", " nothing risk ", " no danger danger ", " danger without fear ", None]
    given = "project_id string, scene_index int, line string"
    text = spark.createDataFrame([("p", i, line) for i, line in enumerate(lines)] + [(None, 0, " no danger ")], given)
    found = [(r.scene_index, r.phrase, r.negated) for r in apply("phrase_negated", spark, audio_text=text).collect()]
    assert sorted(found) == [(0, "danger", True), (1, "danger", False), (2, "risk", True), (3, "risk", False), (4, "risk", False), (5, "danger", True), (6, "danger", False), (6, "fear", True)]
    occurs = spark.createDataFrame([("p", 2, "risk")], "project_id string, scene_index int, phrase string")
    assert [tuple(r) for r in apply("phrase_negated", spark, audio_text=text, phrase_occurs=occurs).collect()] == [("p", 2, "risk", True)]
