"""Secret scan with corpus-wide ownership frequency.

Base kinds (assign, access, hex) always stay. A further kind, `generic` (long
mixed-class tokens), is only a candidate: it is kept where the corpus shows it to
belong to few owners, while strings that many owners share are copied examples.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extended, small, written

KINDS = ("assign", "access", "hex", "generic")
#: A candidate seen under at most so many owners and in so many repositories is live-looking.
MAX_OWNERS = 2
MAX_REPOSITORIES = 20

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
LONG = re.compile(r"\S{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GENERIC = re.compile(r"[A-Za-z0-9+/_-]{20,}")

SPAN = "struct<kind:string,start:int,end:int,digest:string>"


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; code points, end exclusive."""
    text, found = text or "", []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if max(map(len, text.split()), default=0) >= 20:
        base = []
        for run in LONG.finditer(text):  # no kind below has white space
            at = run.span()
            if "AKIA" in run[0]:
                base += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text, *at) if len(m[0]) >= 20]
            base += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text, *at) if len(m[0]) >= 24]
            for m in GENERIC.finditer(text, *at):
                v = m[0]
                if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and entropy(v) >= 3.5:
                    if not any(s < m.end() and m.start() < e for _, s, e, _ in found + base):
                        found.append(("generic", *m.span(), v))
        found += base
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """Replaces `text` by `content` (its xxhash64) and `candidates` array<struct<kind,
    start,end,digest>>; digest is the value's SHA-256, so that values go no further.
    One pass, no shuffle."""
    docs = docs.drop("content", "candidates").withColumn("content", F.xxhash64("text"))
    schema = extended(docs, f"candidates array<{SPAN}>", ("text",))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string())]))
    names = schema.names[:-1]

    def make():
        def handle(batch):
            found = [
                [{"kind": k, "start": a, "end": b, "digest": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for k, a, b, v in candidates(t)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, kind)], names=[*names, "candidates"])

        return handle

    return arrow_map(docs, make, schema)


def ownership(scanned: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """digest, n_owners, n_repositories, live: distinct counts over the whole corpus,
    pre-aggregated before each shuffle, so that a secret copied everywhere is one row
    a task. Null owners count as one owner."""
    spans = scanned.select(F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("o"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("r"), F.explode("candidates.digest").alias("digest"))
    owners = spans.groupBy("digest", "o").agg(F.lit(1)).groupBy("digest").agg(F.count("*").alias("n_owners"))
    repositories = spans.groupBy("digest", "r").agg(F.lit(1)).groupBy("digest").agg(F.count("*").alias("n_repositories"))
    both = owners.join(repositories, "digest")
    return both.withColumn("live", (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES))


def report(scanned: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row for each distinct (doc_id, content) of `scanned` (a written table) with
    candidates: `secrets` array<struct<start,rank,kind,end,digest,n_owners,
    n_repositories,live>> in order. Generic candidates stay only where live."""
    status = small(written(ownership(scanned, owner, repository), "ownership"))
    spans = scanned.where(F.size("candidates") > 0).select("doc_id", "content", F.explode("candidates").alias("c"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("c.kind")).cast("int")
    judged = spans.select("doc_id", "content", "c", F.col("c.digest").alias("digest"), rank.alias("rank")).join(status, "digest")
    judged = judged.where((F.col("c.kind") != "generic") | F.col("live"))
    one = F.struct("c.start", "rank", "c.kind", "c.end", "digest", "n_owners", "n_repositories", "live")
    # repeated rows of a document meet here as one; a document's spans are bounded by its text
    return judged.groupBy("doc_id", "content").agg(F.array_sort(F.collect_set(one)).alias("secrets"))


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """docs with every secret in `text` replaced: `<SECRET>` where live-looking,
    `<EXAMPLE>` where widely copied. Overlapping spans are one, live if any is.
    n_chars, where present, follows the text. No row is dropped."""
    found = written(report(written(scan(docs), "candidates"), owner, repository), "secrets")
    cols = docs.columns
    keyed = docs.withColumn("_c", F.xxhash64("text")).alias("d")
    hits = small(found).select(F.col("doc_id").alias("_doc"), F.col("content").alias("_content"), F.col("secrets").alias("_secrets"))
    joined = keyed.join(hits, F.col("d.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_c") == F.col("_content")), "left")
    merged = F.aggregate(
        "_secrets",
        F.expr("cast(array() as array<struct<start:int,end:int,live:boolean>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).getField("end") > s.start),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1)).getField("start").alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1)).getField("end"), s.end).alias("end"), (F.try_element_at(acc, F.lit(-1)).getField("live") | s.live).alias("live"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s.start.alias("start"), s.end.alias("end"), s.live.alias("live"))))),
    )
    # from the last span to the first, so that earlier offsets stay true
    clean = F.aggregate(
        F.reverse(merged),
        F.col("d.text"),
        lambda t, s: F.concat(F.substring(t, F.lit(1), s.start), F.when(s.live, F.lit("<SECRET>")).otherwise(F.lit("<EXAMPLE>")), F.substring(t, s.end + 1, F.length(t))),
    )
    out = joined.select(*(F.col(f"d.`{c}`") for c in cols if c != "text"), F.when(F.col("_secrets").isNull(), F.col("d.text")).otherwise(clean).alias("text"))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)
