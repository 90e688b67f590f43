"""Words of scenes and images meet by user and word, not pair by pair."""

import re

import pytest

from fabula.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["top_terms", "semantic_reference_score"])
def test_pairs_do_not_meet_all_words(name, spark):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [re.sub(r"#\d+L?", "", line) for line in plan.splitlines() if re.search(r"\bJoin ", line)]
    assert not [j for j in joins if re.search(r"\(image_id = image_id\) AND \(word = word\)|\(word = word\) AND \(image_id = image_id\)", j)]
    assert [j for j in joins if "owner" in j or re.search(r"user_id = .*word = word", j)]
