"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its words and their beginnings; the document's is their noisy-or with a leak,
p = 1 - (1 - leak) * prod(1 - p_sentence). Only document labels are used to
train; the fitted sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map, extended

#: Labelled documents that fit() may look at, and bytes of their texts in all.
TRAIN_DOCS, TRAIN_BYTES = 6_000, 64 << 20
#: Features that fit() may weigh, those of the clearest excess among toxic documents first.
VOCABULARY = 20_000
#: Logit of a sentence without any weighed word: long clean texts must stay clean.
BASE_LOGIT = -12.0
#: Documents that score so much or more count as toxic.
THRESHOLD = 0.3

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that are weighed beside whole words (inflected forms).
STEMS = (4, 5, 6, 7)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of words and of beginnings (marked ^), and the leak (the chance of a
    label without any cause seen)."""

    weights: dict[str, float]
    leak: float

    def openings(self) -> frozenset[str]:
        """What a word that any weight applies to must begin with."""
        return frozenset(f.removeprefix("^")[: STEMS[0]] for f in self.weights)


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def sentence_features(words: list[str], weights: dict[str, float], openings: frozenset[str]) -> set[str]:
    return {f for w in words if w[: STEMS[0]] in openings for f in features(w) if f in weights}


def score_text(text: str | None, model: ToxicityModel, openings: frozenset[str]) -> tuple[float, list[tuple[int, int, float]]]:
    """Document score and (start, end, score) of the sentences that weights apply to,
    in code points, end exclusive."""
    clean, found = 1.0 - model.leak, []
    text = text or ""
    if not openings.isdisjoint({w[: STEMS[0]] for w in WORD.findall(text.lower())}):
        for m in SENTENCE.finditer(text):
            if own := sentence_features(WORD.findall(m.group().lower()), model.weights, openings):
                p = 1.0 / (1.0 + math.exp(-(BASE_LOGIT + math.fsum(map(model.weights.__getitem__, own)))))
                clean *= 1.0 - p
                found.append((m.start(), m.end(), p))
    return min(1.0, max(0.0, 1.0 - clean)), found


def fit(rows: list[tuple[str | None, int]], steps: int = 400, rate: float = 0.3, l1: float = 0.004, min_docs: int = 8) -> ToxicityModel:
    """Maximum likelihood by gradient steps on the noisy-or, with soft thresholding.

    Features are weighed if they occur in min_docs documents and oftener in positive
    ones than chance would have it; weights are kept non-negative, so that every
    cause only adds. With no positive rows the model gives the leak alone.
    """
    rows = [(t or "", int(y)) for t, y in rows if y is not None]
    positives = sum(y for _, y in rows)
    if not rows or not positives:
        return ToxicityModel({}, 0.01)
    seen, bad = Counter(), Counter()
    for text, y in rows:
        own = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
        seen.update(own)
        if y:
            bad.update(own)
    prior = positives / len(rows)
    lift = {w: (bad[w] - n * prior) / np.sqrt(n * prior * (1 - prior) + 1) for w, n in seen.items() if n >= min_docs}
    words = sorted((w for w, z in lift.items() if z > 4.0), key=lambda w: (-lift[w], w))[:VOCABULARY]
    index = {w: i for i, w in enumerate(words)}
    openings = frozenset(w.removeprefix("^")[: STEMS[0]] for w in words)
    docs, bags = [], []  # one entry a sentence: its document and its words
    for d, (text, _) in enumerate(rows):
        for m in SENTENCE.finditer(text):
            own = sorted(index[f] for f in sentence_features(WORD.findall(m.group().lower()), index, openings))
            if own:
                docs.append(d)
                bags.append(own)
    if not bags:
        return ToxicityModel({}, prior)
    doc = np.array(docs)
    sent = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    col = np.concatenate([np.array(b) for b in bags])
    y = np.array([v for _, v in rows], dtype=float)
    w, leak = np.full(len(words), -BASE_LOGIT - 2.0), 0.03
    speed, moment = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(BASE_LOGIT + np.bincount(sent, w[col], len(bags)))))
        clean = (1 - leak) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(rows)))
        pd = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        # d(log-likelihood)/d(logit of a sentence): p for a positive bag weighs by the odds
        push = np.where(y[doc] > 0, clean[doc] / pd[doc], -1.0) * p
        grad = np.bincount(col, push[sent], len(words)) / len(rows)
        moment = 0.9 * moment + 0.1 * grad
        speed = 0.99 * speed + 0.01 * grad * grad
        w = w + rate * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
        w = np.maximum(0.0, w - rate * l1)
        quiet = clean / (1 - leak)
        leak = float(np.clip(np.mean((y * leak * quiet / pd)), 1e-4, 0.2))
    keep = w > 2.5
    return ToxicityModel({words[i]: float(w[i]) for i in np.flatnonzero(keep)}, leak)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_DOCS, size: int = TRAIN_BYTES) -> list[tuple[str | None, int]]:
    """A bounded sample (by a hash of doc_id) of labelled texts outside the held-out
    quarter: at most `limit` documents, and of these, in that order, each that still fits
    into `size` bytes. Sizes of at most `limit` texts are told first, then only the chosen
    texts are read. Rows without a label or doc_id are not used; a document with several
    labels has the highest, one with several texts is left out."""
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id")
        .limit(limit)
    )
    # at most `limit` rows of two numbers are broadcast; repeated rows become one in each task
    texts = docs.select("doc_id", "text")
    body = F.xxhash64("text")
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(body).alias("body"), F.max(body).alias("other"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    found = found.where("body = other").select("doc_id", "y", "bytes", F.xxhash64("doc_id", F.lit("fit")).alias("place"))
    chosen, total = {}, 0
    for r in sorted(found.collect(), key=lambda r: (r.place, r.doc_id)):
        if total + r.bytes <= size:
            chosen[r.doc_id] = r.y
            total += r.bytes
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], StructType([docs.schema["doc_id"]]))
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r.text, chosen[r.doc_id]) for r in sorted(rows, key=lambda r: r.doc_id)]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: ToxicityModel, column: str = "toxicity", spans: str = "offending") -> DataFrame:
    """Adds `column` double and `spans` array<struct<start,end,score>>.

    Null and empty texts score the leak; other columns pass through, but columns that
    have these two names are replaced. One pass without a shuffle; sentences are scored
    one at a time, whatever a text's length. Repeated rows score alike; an empty table
    gives no rows.
    """
    docs = docs.drop(column, spans)
    schema = extended(docs, f"{column} double, {spans} array<struct<start:int,end:int,score:double>>")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    openings = model.openings()

    def make():
        def handle(batch):
            scored = [score_text(t, model, openings) for t in batch.column("text").to_pylist()]
            columns = [*batch.columns, pa.array([s for s, _ in scored], pa.float64())]
            columns.append(pa.array([[{"start": a, "end": b, "score": p} for a, b, p in f] for _, f in scored], span))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return handle

    return arrow_map(docs, make, schema)
