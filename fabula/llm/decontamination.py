"""Benchmark decontamination by size-partitioned MinHash containment search.

Only DataFrame functions are used. Texts become sets of 5-word shingle hashes. A
document of n shingles belongs to size class b = ceil(log2 n) + 1 and is sketched by
one-permutation MinHash with 2**b bins (the smallest hash of each bin), so that the
load of a bin, and with it the chance that a shared shingle survives as a minimum,
is the same for short and very long documents (at least 0.79). A test item is
sketched once for each size class that can hold it. Documents and items that share a
minimum are candidates: an item with m shingles in a document is missed with
probability below 0.21**m. Items of at most SHORT shingles, for which that is not
small, ask with all their shingles, and a document answers with all of its own.
Candidates are verified by exact containment of shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

WORDS = 5
CONTAINMENT = 0.8
#: The largest size class: a document of over 2**25 shingles belongs there too, with
#: more shingles to a bin.
CLASSES = 26
#: Items of so few shingles are not sketched (beyond, 0.21**m is below 1e-6).
SHORT = 8


def words(text) -> Column:
    """Runs of letters and digits, lower case: punctuation glued to words is no disguise."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashes(df: DataFrame, text: str) -> DataFrame:
    """df with `_s`, the sorted distinct shingle hashes of its text; empty below five words."""
    df = df.withColumn("_w", F.transform(words(text), lambda w: F.xxhash64(w)))
    last = F.size("_w") - WORDS
    own = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(WORDS))))
    none = F.expr("cast(array() as array<bigint>)")
    return df.withColumn("_s", F.when(last >= 0, F.sort_array(own)).otherwise(none)).drop("_w")


def _minima(b) -> Column:
    """The smallest hash of each of 2**b bins (by leading bits) of the sorted `_s`."""
    return F.filter("_s", lambda x, i: (i == 0) | (_bin(x, b) != _bin(F.get("_s", i - 1), b)))


def _bin(x, b) -> Column:
    return F.call_function("shiftright", x, F.lit(64) - b)


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (content, item_id) that share a minimum, or any shingle of a short item;
    content is xxhash64(text), so copies count once."""
    # no predicate on computed arrays, outer generators and a size class that is never
    # null: else Catalyst pushes filters, and with them the whole computation once more,
    # below the projections
    size_class = F.coalesce(F.least(F.lit(CLASSES), (F.ceil(F.log2(F.greatest(F.size("_s"), F.lit(1)).cast("double"))) + 1).cast("int")), F.lit(0))
    sized = _hashes(docs.select(F.xxhash64("text").alias("content"), "text"), "text").select("content", "_s", size_class.alias("b"))
    asked = _hashes(items.select("item_id", "text"), "text").select("item_id", F.array_distinct("_s").alias("_s"))
    short = F.size("_s") <= SHORT
    least = F.ceil(F.log2(F.greatest(F.size("_s"), F.lit(1)) * CONTAINMENT)).cast("int")  # smaller documents cannot hold it
    asked = asked.withColumn("b", F.explode(F.sequence(F.greatest(least, F.lit(1)), F.lit(CLASSES))))
    queries = asked.select("item_id", "b", short.alias("all"), F.explode_outer(F.when(short, F.col("_s")).otherwise(_minima(F.col("b")))).alias("h"))
    queries = written(queries.distinct().where(F.col("h").isNotNull()), "items")
    minimum = F.transform("_s", lambda x, i: F.struct(x.alias("h"), ((i == 0) | (_bin(x, F.col("b")) != _bin(F.get("_s", i - 1), F.col("b")))).alias("minimum")))
    kept = sized.select("content", "b", F.explode_outer(minimum).alias("own")).select("content", "b", "own.h", "own.minimum")
    return kept.join(small(queries), ["b", "h"]).where(F.col("minimum") | F.col("all")).select("content", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """Rows of docs (doc_id) with the items they contain: doc_id, content, item_id,
    containment double, n_shared and n_item (shingles). Items under five words, and
    null or empty texts, match nothing. Repeated documents each get their rows;
    repeated item rows count once."""
    items = items.select("item_id", "text").distinct()
    found = written(candidates(docs, items), "candidates")
    item = items.withColumn("_q", words("text")).select("item_id", _shingles("_q").alias("_q"))
    pairs = written(found.join(item, "item_id"), "pairs")
    hit = docs.select("doc_id", F.xxhash64("text").alias("content"), "text").join(small(pairs), "content")
    hit = hit.withColumn("_w", words("text")).select("doc_id", "content", "item_id", "_q", _shingles("_w").alias("_d"))
    out = hit.select("doc_id", "content", "item_id", F.size(F.array_intersect("_q", "_d")).alias("n_shared"), F.size("_q").alias("n_item"))
    out = out.groupBy("doc_id", "content", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)


def _shingles(w: str) -> Column:
    """The distinct shingles themselves; empty below five words."""
    last = F.size(w) - WORDS + 1
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, WORDS), " ")))
    return F.when(last >= 1, own).otherwise(F.expr("cast(array() as array<string>)"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """docs without the rows that contain an item; all columns, nulls included."""
    bad = written(contained(docs, items, threshold).select("content").distinct(), "contaminated")
    keyed = docs.withColumn("_content", F.xxhash64("text"))
    bad = small(bad.withColumnRenamed("content", "_content"))
    return keyed.join(bad, "_content", "left_anti").select(*docs.columns)
