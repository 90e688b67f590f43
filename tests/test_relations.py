"""Every relation against the same definition run by DuckDB, and hand-computed cases."""

import math

import duckdb
import pytest

from fabula.plans.registry import ORACLE_SQL, QUERIES
from fabula.plans.relation import RELATIONS, TABLES, apply, needed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(f"{v:.9g}") + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_relation(name, spark, duck):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(tuple(norm(r[c]) for c in columns) for r in frame.collect())
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert found == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_shape_of_five_scenes(spark):
    texts = ["What happened at the hospital?", "Records and evidence were found.", "But the claim was disputed.", "The truth was revealed.", "Why did nobody act?"]
    scenes = spark.createDataFrame([("p", i, 5, i * 5.0, i * 5.0 + 5.0, t) for i, t in enumerate(texts)], "project_id string, scene_index int, scene_count int, scene_start double, scene_end double, voiceover_text string")
    captions = spark.createDataFrame([], "project_id string, caption_id int, caption_start double, caption_end double, caption_text string")
    assert apply("story_shape", spark, scenes=scenes, captions=captions).first().story_shape == "contested_resolution"
    assert apply("opening_strategy", spark, scenes=scenes, captions=captions).first().opening == "direct_question"
    assert apply("resolution_type", spark, scenes=scenes, captions=captions).first().resolution == "open_question"
    assert apply("story_edges", spark, scenes=scenes, captions=captions).count() == 4
    assert [r.role for r in apply("story_role", spark, scenes=scenes, captions=captions).orderBy("scene_index").collect()] == ["hook", "evidence", "counterargument", "revelation", "resolution"]


def test_boundaries_of_three_scenes(spark):
    rows = [("p", 0, 3, 0.0, 2.0, ""), ("p", 1, 3, 2.0, 5.0, ""), ("p", 2, 3, 5.0, 5.5, "")]
    scenes = spark.createDataFrame(rows, "project_id string, scene_index int, scene_count int, scene_start double, scene_end double, voiceover_text string")
    found = apply("transition_boundaries", spark, scenes=scenes).orderBy("scene_index").collect()
    assert [(r.frame, r.duration_frames) for r in found] == [(60, 12), (150, 3)]


def test_partitioning_does_not_matter(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = lambda n: sorted(map(tuple, apply("structural_roles", spark, events=events.repartition(n)).collect()))
    assert rows(1) == rows(7)


def test_only_what_is_needed_is_rendered():
    assert needed("signal_has") == ["phrases", "said", "timed", "scenes", "signal_has"]
    assert all(i in RELATIONS or i in TABLES for r in RELATIONS.values() for i in r.inputs)


def test_columns_are_pruned(spark):
    plan = QUERIES["digest_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
