"""Histogram sort: exact splitters by counting, then a single exchange.

Keys are 128 bits, (hash of the text, doc_id), both unsigned. Candidate key
boundaries are the bins of a radix histogram; each round counts exact weights and
rows below the bins of those boundaries that are still too far from their targets,
and looks a few bits deeper there only. What reaches the driver is at most
2**bits bins in the first round and targets * 2**bits later, whatever the input; targets
are the shards' edges alone. Within shards, rows are dealt out in ranges of bounded size
that are counted, split and numbered as tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

BITS = 12
#: A shard's edge may be this share of a shard away from its target; equal texts then
#: stay together. Where one row or group is larger than that, the closest row edge holds.
TOLERANCE = 0.002
#: Weight that a range of keys is split beyond, and of the ranges that a task gets.
RANGE_BYTES, TASK_BYTES = 16 << 20, 64 << 20
#: Times that ranges are split again; each brings a span of keys down by the weight in it.
DEPTH = 12


@dataclass(frozen=True)
class Edge:
    """Rows with (high, low) below this key: their total weight and number."""

    high: int
    low: int
    weight: int
    rows: int


def unsigned(column):
    """A long as the unsigned order's bit pattern (signed order kept)."""
    return F.col(column).bitwiseXOR(F.lit(-(2**63)).cast("long"))


def edges(keys: DataFrame, targets: list[float], tolerance: list[float], bits: int = BITS) -> list[Edge]:
    """For each target weight, the closest key boundary found within its tolerance.

    keys: (high long, low long, w long), a written table; high and low in unsigned
    order. Runs one small aggregation a round, at most 2 * ceil(64 / bits).
    """
    # a bracket: (depth in bits, high prefix, low prefix) -> weight and rows below it
    state = {i: (0, 0, 0, 0, 0) for i in range(len(targets))}
    found: dict[int, Edge] = {}
    while state:
        depth = min(s[0] for s in state.values())
        step = min(bits, 64 - depth % 64)
        now = {i: s for i, s in state.items() if s[0] == depth}
        rows = _histogram(keys, depth, step, {s[1:3] for s in now.values()})
        for i, (_, hi, lo, weight, count) in now.items():
            bins = rows.get((hi, lo), [])
            best, inside = (abs(weight - targets[i]), weight, count, hi, lo, 0), None
            for b, w, n in bins:
                if weight + w >= targets[i] and inside is None:
                    inside = (b, weight, count, n)
                weight, count = weight + w, count + n
                best = min(best, (abs(weight - targets[i]), weight, count, hi, lo, b + 1))
                if inside:
                    break
            done = depth + step
            if best[0] <= tolerance[i] or done == 128 or inside is None or inside[3] == 1:
                key = ((hi << 64 | lo) if depth >= 64 else hi << (64 + 64 - depth)) + (best[5] << (128 - done))
                key = min(key, (1 << 128) - 1)
                found[i] = Edge(key >> 64, key & (2**64 - 1), best[1], best[2])
                del state[i]
            else:
                b, weight, count, _ = inside
                if done <= 64:
                    state[i] = (done, hi << step | b, 0, weight, count)
                else:
                    below = lo | b << (128 - done)
                    state[i] = (done, hi, below, weight, count)
    return [found[i] for i in range(len(targets))]


def _histogram(keys: DataFrame, depth: int, step: int, prefixes: set[tuple[int, int]]) -> dict:
    """(high, low prefix) -> sorted (bin, weight, rows) at bits depth .. depth+step."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    mask = F.lit(2**step - 1).cast("long")
    if depth < 64:
        place = F.shiftrightunsigned("high", 64 - depth) if depth else F.lit(0).cast("long")
        digit = F.shiftrightunsigned("high", 64 - depth - step)
        own = keys.select(place.alias("p"), F.lit(0).cast("long").alias("q"), digit.bitwiseAND(mask).alias("b"), "w")
        wanted = [(signed(h), 0) for h, _ in prefixes]
    else:
        used = depth - 64
        q = F.shiftleft(F.shiftrightunsigned("low", 64 - used), 64 - used) if used else F.lit(0).cast("long")
        own = keys.select(F.col("high").alias("p"), q.alias("q"), F.shiftrightunsigned("low", 64 - used - step).bitwiseAND(mask).alias("b"), "w")
        wanted = [(signed(h), signed(low)) for h, low in prefixes]
    if depth:  # at most one row a target
        active = keys.sparkSession.createDataFrame(wanted, "p long, q long")
        own = own.join(F.broadcast(active), ["p", "q"], "left_semi")
    out: dict = {}
    for r in own.groupBy("p", "q", "b").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect():
        out.setdefault((r.p % 2**64, r.q % 2**64), []).append((r.b, r.w, r.n))
    return {k: sorted(v) for k, v in out.items()}


def shard_of(cuts: list[Edge]) -> Column:
    """How many cuts lie at or below a row's key (_h, _k)."""
    signed = lambda x: F.lit(x - 2**63).cast("long")  # noqa: E731  unsigned order as signed longs
    above = [(F.col("_h") > signed(c.high)) | ((F.col("_h") == signed(c.high)) & (F.col("_k") >= signed(c.low))) for c in cuts]
    return sum((a.cast("int") for a in above), F.lit(0))


def ranged(keyed: DataFrame, bits: int, levels: list[DataFrame]) -> DataFrame:
    """keyed (_h, _k, shard) with _r, its range: the leading bits of the hash within the
    shard, and for ranges that are split, in levels, an equal share of the span of _k."""
    out = keyed.withColumn("_r", F.xxhash64("shard", F.shiftrightunsigned(unsigned("_h"), 64 - bits)))
    for level in levels:
        step = F.floor((F.col("_k").cast("double") - F.col("_low").cast("double")) / F.col("_span"))
        out = out.join(small(level), "_r", "left").withColumn("_r", F.when(F.col("_span").isNull(), F.col("_r")).otherwise(F.xxhash64("_r", step))).drop("_low", "_span")
    return out


def shard(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with `size` (UTF-8 bytes plus 1), `shard` and `slot` (gapless from 0).

    Shards are near equal in size and ordered by (hash of text, key), so that equal
    texts lie side by side; a group of copies is cut only where a shard's edge falls
    inside it. Null texts have size 1 and sort together; null keys come first, and rows
    with equal text and key stay in one range. Texts cross the network once, in ranges
    that are sorted by themselves: a range beyond RANGE_BYTES with several keys is split
    by key, again and again; slots come from the exact counts before each range.
    Columns called size, shard or slot are replaced. Empty tables give no rows.
    """
    docs = docs.drop("size", "shard", "slot", "_h", "_k", "_r", "_before", "_low", "_span")
    docs = docs.withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    docs = docs.withColumn("_h", F.xxhash64(text)).withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")))
    keys = written(docs.select("_h", "_k", F.col("size").alias("w")), "keys")
    total = keys.agg(F.sum("w")).first()[0] or 0
    found = edges(keys.select(unsigned("_h").alias("high"), unsigned("_k").alias("low"), "w"), [total * i / shards for i in range(1, shards)], [TOLERANCE * total / shards] * (shards - 1))
    cuts = sorted(found, key=lambda c: (c.high, c.low))  # neighbours may pick edges in the same bin
    bits = min(40, max(8, (4 * total // RANGE_BYTES).bit_length()))
    levels: list[DataFrame] = []
    while True:
        sized = ranged(keys.withColumn("shard", shard_of(cuts)), bits, levels).groupBy("_r", "shard")
        sized = sized.agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min(F.struct("_h", "_k")).alias("first"), F.min("_k").alias("_low"), F.max("_k").alias("high"))
        sized = written(sized, "ranges")
        large = sized.where((F.col("w") > RANGE_BYTES) & (F.col("_low") < F.col("high")))
        share = F.ceil(4 * F.col("w") / RANGE_BYTES)
        large = written(large.select("_r", "_low", ((F.col("high").cast("double") - F.col("_low").cast("double") + 1) / share).alias("_span")), "large")
        if len(levels) == DEPTH or large.limit(1).count() == 0:
            break
        levels.append(large)
    before = Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sized.select("_r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "bases")
    placed = ranged(docs.withColumn("shard", shard_of(cuts)), bits, levels).join(small(bases), "_r").repartition(max(1, -(-total // TASK_BYTES)), "_r")
    slot = F.row_number().over(Window.partitionBy("_r").orderBy("_h", "_k")) - 1 + F.col("_before")
    return placed.withColumn("slot", slot).select(*docs.drop("_h", "_k").columns, "shard", "slot")
