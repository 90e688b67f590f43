"""Decisions about cache entries are worked out along one row of an entry, dealt out once by its key."""

import duckdb
import pytest

from fabula.plans.registry import ORACLE_SQL, QUERIES
from fabula.plans.relation import SHORTER, apply

SF = "/root/testdata/sf0.001"
RUNS = ("cas_upsert", "execution_status_map", "recon_diagnostic_code", "work_budget_wrappers", "reconcile_run", "recon_progress", "checkpoint_codec")


@pytest.mark.parametrize("name", RUNS)
def test_tables_are_dealt_out_once(name, spark):
    found = QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 40  # over two hundred where each relation below is worked out again for each that reads it
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for table in ("orders", "lineitem"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.sql(ORACLE_SQL[name]).fetchall()))


def test_relations_that_are_given_are_read(spark):
    """A relation that the shorter way passes by stands in for what is derived."""
    assert "cas_upsert" in SHORTER
    compare = spark.createDataFrame([(1, "upsert_final", 3), (2, "upsert_final", 2), (3, "noop", 1)], "entry long, action string, expected_revision long")
    read = spark.createDataFrame([(1, "record_found", None, 3, "f", "r"), (2, "record_found", None, 3, "f", "r")], "entry long, status string, tombstone_revision long, record_revision long, last_final string, last_recovery string")
    told = spark.createDataFrame([(1, "new", None), (2, "new", None)], "entry long, final_summary string, recovery_summary string")
    found = apply("cas_upsert", spark, recon_compare=compare, catalog_lookup=read, catalog_vs_authority=told)
    assert sorted((r.entry, r.revision, r.outcome, r.last_final, r.last_recovery) for r in found.collect()) == [(1, 4, "catalog_write_applied", "new", "r"), (2, None, "catalog_write_conflict", None, None)]
