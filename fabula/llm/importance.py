"""Quality by importance resampling.

Two bags of hashed word n-grams (n = 1, 2) are counted: one over labelled good
texts (the target), one over the whole corpus (raw). A document's log-weight is the
log-ratio of the two generative models, each without the document's own counts
(leave-one-out), so that labelled and other documents are judged alike; adding Gumbel noise and taking the top k
samples documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extended, mix64, slices, written
from .sharding import edges

BUCKETS = 1 << 14
#: Labelled good documents that the target model may be fitted on (by a hash of doc_id).
TARGET_DOCS = 20_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
TOKENS = 400_000  # bound of a task's cache of token hashes


class Hasher:
    """Bucket numbers of a text's 1- and 2-grams."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text.lower()) if text else []
        known = self.known
        if len(known) > TOKENS:
            known.clear()
        out = []
        for t in tokens:
            h = known.get(t)
            if h is None:
                h = known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
            out.append(h)
        one = np.array(out, np.uint64)
        two = mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each bucket over all of docs: summed within each task first, so
    a task sends at most one row a bucket; the driver gets BUCKETS numbers."""

    def run(batches):
        hasher, total = Hasher(), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                np.add.at(total, hasher(text), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], names=["bucket", "n"])

    summed = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in summed.collect():
        out[r.bucket] = r.n
    return out


def log_weight(own: np.ndarray, member: bool, target: np.ndarray, raw: np.ndarray) -> float:
    """Log-ratio of the models for a document's buckets. Half a count is added to each
    bucket of both, as E[log(N + 1/2)] is close to log E[N]: neither model then loses
    merely by being counted over fewer texts."""
    if not len(own):
        return 0.0
    at, c = np.unique(own, return_counts=True)
    half = len(raw) / 2
    p = (np.maximum(raw[at] - c, 0) + 0.5) / (max(raw.sum() - len(own), 0) + half)
    q = (np.maximum(target[at] - (c if member else 0), 0) + 0.5) / (max(target.sum() - (len(own) if member else 0), 0) + half)
    return float((c * (np.log(q) - np.log(p))).sum())


def weigh(docs: DataFrame, target: np.ndarray, raw: np.ndarray, seed: int = 0) -> DataFrame:
    """Replaces `text` and `_member` (whether the target counts hold it) by log_weight, gumbel_key (with noise from a hash of doc_id and
    seed, so that reruns agree) and `_order`, gumbel_key's bits in unsigned order."""
    docs = docs.drop("log_weight", "gumbel_key", "_order").withColumn("_u", F.xxhash64("doc_id", F.lit(seed)))
    schema = extended(docs, "log_weight double, gumbel_key double, _order bigint", ("text", "_u", "_member"))
    names = schema.names[:-3]

    def make():
        hasher = Hasher()

        def handle(batch):
            texts, members = batch.column("text").to_pylist(), batch.column("_member").to_pylist()
            w = np.array([log_weight(hasher(t), m, target, raw) for t, m in zip(texts, members)], float)
            u = (batch.column("_u").to_numpy(zero_copy_only=False).view(np.uint64).astype(float) + 0.5) / 2.0**64
            key = w - np.log(-np.log(np.clip(u, 1e-18, 1 - 1e-15)))
            bits = key.view(np.int64)
            order = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(w), pa.array(key), pa.array(order)], names=schema.names)

        return handle

    return arrow_map(docs, make, schema)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """The sampled rows, `text` replaced by log_weight and gumbel_key.

    k defaults to the expected size of the target within the corpus, the sum of
    min(1, weight). Texts that are null or empty have weight 1 (no evidence). The cut
    is found by counting; rows of equal key and doc_id (repeated rows of a document) are
    kept or left together, so up to their number more or fewer than k rows come out.
    Columns called log_weight, gumbel_key, _order, _member or _u are replaced or
    dropped. Without good labels, all weights are 1; an empty table gives no rows.
    """
    docs = docs.drop("_member", "_u", "_in")
    good = written(labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id", F.lit("target")).alias("_t")).dropDuplicates(["doc_id"]), "good")
    n = good.count()
    if n > 2 * TARGET_DOCS:  # of so many, the first ones lie far below this bound: few rows reach one task
        good = good.where(F.col("_t") <= int((2 * TARGET_DOCS / n - 0.5) * 2.0**64))
    good = good.orderBy("_t", "doc_id").limit(TARGET_DOCS).select("doc_id")
    # at most TARGET_DOCS numbers are broadcast
    target = counts(docs.join(F.broadcast(good), "doc_id", "left_semi"))
    raw = counts(docs) if target.any() else target
    marked = docs.join(F.broadcast(good.withColumn("_in", F.lit(True))), "doc_id", "left").withColumn("_member", F.coalesce("_in", F.lit(False))).drop("_in")
    weighed = written(weigh(marked.select(*docs.columns, "_member"), target, raw, seed), "weights")
    one = F.least(F.lit(1.0), F.exp(F.least(F.lit(0.0), F.col("log_weight"))))
    total = weighed.agg(F.sum(one).alias("k"), F.count("*").alias("n")).first()
    k = min(total.n, round(total.k or 0) if k is None else k)
    if not k:
        return weighed.drop("_order").limit(0)
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).bitwiseXOR(F.lit(-(2**63)).cast("long"))
    keys = weighed.select(F.col("_order").alias("high"), low.alias("low"), F.lit(1).cast("long").alias("w"))
    cut = edges(keys, [float(total.n - k)], [0.0])[0]
    signed = lambda x: F.lit((x ^ 2**63) - 2**63).cast("long")  # noqa: E731  unsigned order as signed longs
    flip = F.lit(-(2**63)).cast("long")
    high, low = F.col("_order").bitwiseXOR(flip), low.bitwiseXOR(flip)
    h, d = signed(cut.high ^ 2**63), signed(cut.low ^ 2**63)
    return weighed.where((high > h) | ((high == h) & (low >= d))).drop("_order")
