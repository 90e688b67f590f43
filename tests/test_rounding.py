"""Values next to halves are rounded as the SQL rounds them."""

import duckdb
import pytest

from fabula.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401  (registers all relations)
from fabula.plans.relation import Duck, apply, render

FINAL = """select concat('p', cast(i as string)) as project_id, 0 as scene_index, 1 as place, 0e0 as scene_start, 5e0 as scene_end, 'city street' as voiceover_text, ' city street ' as ambient, false as pause, 'urban' as explicit, false as hard_cut, true as accepted,
  'support' as story_role, 'setup' as story_phase, 0.5e0 as tension, 0.5e0 as emotional, 0.5e0 as revelation, 'support' as audio_intent, 'neutral' as emotional_tone, 0 as conflicts, 1 as n_signals, 1e0 as confidence, i / 1e3 as energy, false as supported, false as fallback_used, i / 1e3 as final, cast(null as double) as before,
  'unchanged' as adjustment, false as preserved from {0}"""


@pytest.mark.parametrize("name", ["ambience", "sound_layers"])
def test_levels_of_each_energy(name, spark):
    found = sorted(map(tuple, apply(name, spark, audio_final=spark.sql(FINAL.format("(select id as i from range(1001)) t"))).collect()))
    want = duckdb.connect().sql(render(name, Duck(), {"audio_final": FINAL.format("(select unnest(range(1001)) as i) t")})).fetchall()
    assert found == sorted(want)


def test_fractions_of_each_price(spark):
    con = duckdb.connect()
    con.execute("create table orders as select i as o_orderkey, i * 25 / 1e0 as o_totalprice from (select unnest(range(24000)) as i) t")
    orders = spark.sql("select id as o_orderkey, id * 25 / 1e0 as o_totalprice from range(24000)")
    found = sorted(map(tuple, apply("fraction_in_range", spark, orders=orders).collect()))
    assert found == sorted(con.sql(ORACLE_SQL["fraction_in_range"]).fetchall())
