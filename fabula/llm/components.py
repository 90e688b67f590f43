"""Connected components of a graph that is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), nulls ignored -> (node, component), the least node that
    can be reached; a written table.

    Each round takes the least label among a node and its neighbours and then follows
    labels twice as far (pointer jumping), so that rounds grow with the logarithm of a
    component's diameter. Labels and links are written tables in every round: a join
    on a hub's label is broadcast where it is small and split by AQE where it is not.
    """
    both = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(both.select(F.col("a").alias("u"), F.col("b").alias("v")).union(both.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        far = labels.select(F.col("u").alias("v"), F.col("l").alias("m"))
        near = edges.join(small(far), "v").groupBy("u").agg(F.min("m").alias("m"))
        near = written(labels.join(near, "u", "left").select("u", F.least("l", F.coalesce("m", "l")).alias("n"), "l"), "near")
        jump = near.select(F.col("u").alias("n"), F.col("n").alias("j"))
        jumped = written(near.join(small(jump), "n", "left").select("u", F.least("n", F.coalesce("j", "n")).alias("l"), (F.col("l") != F.least("n", F.coalesce("j", "n"))).alias("moved")), "labels")
        labels = jumped.select("u", "l")
        if jumped.where("moved").limit(1).count() == 0:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
