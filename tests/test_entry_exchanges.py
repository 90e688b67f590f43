"""What several sources say of an entry meets where the tables were dealt out, without another exchange."""

import duckdb
import pytest

from fabula.plans.registry import ORACLE_SQL, QUERIES
from fabula.plans.relation import apply

SF = "/root/testdata/sf0.001"
RUNS = ("checkpoint_codec", "recon_progress", "work_budget_wrappers")


@pytest.mark.parametrize("name", RUNS)
def test_only_lookups_are_dealt_out_again(name, spark):
    found = QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entry#") <= 2  # lookups, where they are read and where recoveries read them
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for table in ("orders", "lineitem"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.sql(ORACLE_SQL[name]).fetchall()))


def test_recoveries_come_to_the_same_either_way(spark):
    """The way past the findings gives what the relation over given findings gives."""
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem")}
    short = apply("recovery_compose", spark, **tables)
    plain = apply("recovery_compose", spark, recovery_findings=apply("recovery_findings", spark, **tables))
    assert sorted(map(tuple, short.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
