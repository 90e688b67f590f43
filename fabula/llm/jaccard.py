"""Exact n-gram Jaccard join as a blocked sparse product.

Rows of the incidence matrix are distinct shingle sets (classes of documents), columns
are shingles. Only the blocks that can matter are multiplied:

* a pair at or above the threshold must share a shingle among the rarest
  (1 - t) * size + 1 of each set (the prefix), so only those incidences are dealt
  out by column. Rarity comes from counts over the whole corpus, hashed to a fixed
  number of cells; any order that all sets share is exact, and rare-first keeps
  common lines and passages out of the prefixes;
* in each column, members meet the member that looks most central, not each other:
  as many pairs as incidences, however large a group of copies is;
* pairs are dropped by bounds from their sizes, from the shingle's place in both
  sets and from 256-cell histograms of both sets before any set is moved;
* overlaps of what is left are counted in full. Links join classes to components;
  then columns that still hold different components are multiplied in full, between
  components only, so that no link between components is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, mix64, slices, small, utf8, written
from .components import components

CELLS_BITS, BLOCK, HISTOGRAM = 22, 1 << 16, 256
#: Tasks that first sum a block of the cells.
SALTS = 64
#: Column numbers (8 bytes each) that may be broadcast.
COLUMNS = 3_000_000
#: Members of a column's block in the second product.
TILE = 2048


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence where
    it is shorter, nothing without words. bytes.lower and .split do exactly A-Z and
    the white space \\x20 \\x09-\\x0D."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)] + np.uint64(k))
    return np.unique(out)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def survey(docs: DataFrame, k: int) -> DataFrame:
    """One pass over the texts: rows of kind 0 are documents (doc_id, content,
    cid, n, histogram),
    rows of kind 1 are blocks of the task's shingle counts."""

    def run(batches):
        cells = np.zeros(1 << CELLS_BITS, np.uint32)
        for batch in slices(batches):
            ids, sizes, classes, hist = batch.column("doc_id"), [], [], []
            for text in utf8(batch.column("text")):
                s = shingles(text, k)
                np.add.at(cells, (s >> np.uint64(64 - CELLS_BITS)).astype(np.int64), 1)
                sizes.append(len(s))
                classes.append(set_id(s))
                cell = np.bincount((s & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM)
                hist.append(cell.astype("u1" if cell.max() < 256 else "<u4").tobytes())
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, "i4")), ids.cast(pa.int64()), batch.column("content"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hist, pa.binary()), none], names=names)
        for b in range(len(cells) // BLOCK):
            part = cells[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)]), pa.array([b], pa.int32())], names=names)

    names = ["kind", "doc_id", "content", "cid", "n", "data", "block"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("content")).mapInArrow(run, "kind int, doc_id long, content long, cid long, n int, data binary, block int")


def rarity(survey_rows: DataFrame) -> np.ndarray:
    """Counts of all cells, on a log scale in a byte: the driver gets 2**CELLS_BITS bytes,
    whatever the corpus. A block's rows (one a task of the survey) are summed in SALTS tasks
    first, so that none of them meets the rows of all."""

    def add(kind, last):
        def run(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in slices(batches):
                for b, salt, data in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "data"))):
                    own = np.frombuffer(zlib.decompress(data), kind)
                    key = (b, 0 if last else salt)
                    sums[key] = sums[key] + own if key in sums else own.astype(np.uint64)
            for (b, salt), total in sums.items():
                out = np.minimum(255, np.round(16 * np.log2(1.0 + total)) if total.max() >= 2**15 else np.round(17 * np.log2(1.0 + total))).astype(np.uint8) if last else total
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(out.tobytes(), 1)])], names=["block", "salt", "data"])

        return run

    schema = "block int, salt int, data binary"
    rows = survey_rows.where("kind = 1").select("block", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "data")
    part = rows.repartition("block", "salt").mapInArrow(add(np.uint32, False), schema)
    blocks = part.repartition("block").mapInArrow(add(np.uint64, True), schema)
    cells = np.zeros(1 << CELLS_BITS, np.uint8)
    for r in blocks.collect():
        cells[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return cells


def need(n1, n2, percent: int):
    """Least overlap of sets of such sizes at the threshold: 100 i >= percent * union."""
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100.0 + percent) - 1e-9)


def prefixes(docs: DataFrame, cells: np.ndarray, k: int, percent: int) -> DataFrame:
    """Incidences of the prefixes: h, cid, n, at (place in rare-first order) and hub (lower:
    made of more common shingles, so likelier the centre of a group)."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(cells.tobytes(), 1))

    def run(batches):
        levels = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in slices(batches):
            hs, cs, ns, ats, hubs = [], [], [], [], []
            for text in utf8(batch.column("text")):
                s = shingles(text, k)
                if not len(s):
                    continue
                n, level = len(s), levels[(s >> np.uint64(64 - CELLS_BITS)).astype(np.int64)]
                keep = n - -(-percent * n // 100) + 1
                order = np.argsort(level, kind="stable")[:keep]  # ties by hash, as s is sorted
                hs.append(s[order])
                cs.append(np.full(keep, set_id(s), np.int64))
                ns.append(np.full(keep, n, np.int32))
                ats.append(np.arange(keep, dtype=np.int32))
                hubs.append(np.full(keep, 65535 - int(level.mean() * 256), np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([h.view(np.int64) for h in hs], cs, ns, ats, hubs)], names=["h", "cid", "n", "at", "hub"])

    return docs.select("text").mapInArrow(run, "h long, cid long, n int, at int, hub int")


def bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, ia, b, nb, ib) that share a shingle at places ia and ib and can still
    reach the threshold by their sizes and places."""
    size = F.col("na") * 100 >= F.col("nb") * percent
    size = size & (F.col("nb") * 100 >= F.col("na") * percent)
    most = F.least("ia", "ib") + 1 + F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1)
    return pairs.where(size & (most >= need(F.col("na"), F.col("nb"), percent)))


def histograms(data: pa.Array) -> np.ndarray:
    """Counts of HISTOGRAM cells each, stored in a byte or four."""
    rows = data.to_pylist()
    if all(len(x) == HISTOGRAM for x in rows):
        return np.frombuffer(b"".join(rows), "u1").reshape(-1, HISTOGRAM)
    return np.array([np.frombuffer(x, "u1" if len(x) == HISTOGRAM else "<u4") for x in rows], np.int64).reshape(-1, HISTOGRAM)


def close_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that the histograms of both sets let through."""

    def run(batches):
        for batch in slices(batches):
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = np.minimum(histograms(batch.column("da")), histograms(batch.column("db"))).sum(1, dtype=np.int64)
            ok = pa.array(most * (100 + percent) >= percent * (na.astype(np.int64) + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    hist = classes.select("cid", "n", "data")
    met = pairs.join(hist.toDF("a", "na", "da"), "a").join(hist.toDF("b", "nb", "db"), "b")
    return met.mapInArrow(run, "a long, b long")


def block_pairs(rest: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of members of one column but different components that sizes,
    places and histograms let through.

    A column of m members is cut into ceil(m / TILE) blocks, and each two blocks meet in
    a group of their own: at most 2 * TILE members are held at once, m * m / TILE rows
    are dealt out in place of m * m pairs, and only surviving pairs become rows.
    """
    blocks = F.ceil(F.col("m") / TILE).cast("int")
    cut = rest.withColumn("blocks", blocks).withColumn("own_block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("ti", F.least("own_block", "other")).withColumn("tj", F.greatest("own_block", "other"))
    cut = cut.join(classes.select("cid", "data"), "cid").select("h", "ti", "tj", "own_block", "cid", "n", "at", "own", "data")

    def run(batches):
        for g in groups(batches, ["h", "ti", "tj"]):
            block, cid, n, at, own = (g.column(c).to_numpy() for c in ("own_block", "cid", "n", "at", "own"))
            hist = histograms(g.column("data"))
            same = g.column("ti")[0].as_py() == g.column("tj")[0].as_py()
            left, right, n = [], [], n.astype(np.int64)
            for i in range(len(cid)):
                j = np.flatnonzero((own != own[i]) & ((cid > cid[i]) if same else (block != block[i]) & (block[i] == g.column("ti")[0].as_py())))
                least = -(-percent * (n[i] + n[j]) // (100 + percent))
                most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
                j = j[(np.minimum(n[i], n[j]) >= least) & (most >= least)]
                least = -(-percent * (n[i] + n[j]) // (100 + percent))
                j = j[np.minimum(hist[i], hist[j]).sum(1, dtype=np.int64) >= least]
                left.append(np.minimum(cid[i], cid[j]))
                right.append(np.maximum(cid[i], cid[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return cut.repartition("h", "ti", "tj").sortWithinPartitions("h", "ti", "tj").mapInArrow(run, "a long, b long")


def verified(close: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b), a written table, those whose sets reach the threshold: a, b."""
    wanted = close.select(F.col("a").alias("cid")).union(close.select("b")).distinct().join(classes.select("cid", "doc", "content"), "cid")
    wanted = written(wanted.select(F.col("doc").alias("doc_id"), "content", F.col("cid").alias("want")), "wanted")
    ids = small(wanted.where("doc_id is not null").drop("content"))
    nameless = small(wanted.where("doc_id is null").drop("doc_id"))

    def sets(batches):
        done = set()  # of this task's share of repeated rows
        for batch in slices(batches):
            found = []
            for c, t in zip(batch.column("want").to_pylist(), utf8(batch.column("text"))):
                if c not in done and set_id(s := shingles(t, k)) == c:
                    found.append((c, s))
                    done.add(c)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["cid", "s"])

    own = docs.select("doc_id", "text").join(ids, "doc_id").mapInArrow(sets, "cid long, s binary")
    # classes of rows without a doc_id are found by one of their texts, which may come often
    bare = docs.where("doc_id is null").select("text", F.xxhash64("text").alias("content")).join(nameless, "content").mapInArrow(sets, "cid long, s binary")
    own = written(own.union(bare.dropDuplicates(["cid"])), "sets")
    both = close.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")

    def count(batches):
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                i = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * i >= percent * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(count, "a long, b long")


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, content (xxhash64 of the text), n_shingles, cid, component_id (least doc_id
    linked to), one row per row.

    Sets hold 64-bit hashes of shingles. Null and empty texts have no shingles and are
    linked with nothing, so their component is their own doc_id; equal sets are linked.
    Rows with a null doc_id are members of components but never name one. Empty tables
    give no rows.
    """
    docs = docs.select("doc_id", "text")
    rows = written(survey(docs, k), "survey")
    classes = rows.where("kind = 0 and n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("data").alias("data"), F.min("content").alias("content"))
    classes = written(classes, "classes")
    cells = rarity(rows)
    incidence = written(prefixes(docs, cells, k, percent), "prefixes")
    # columns with more than one class: partial minima and maxima first
    columns = incidence.groupBy("h").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo != hi").select("h")
    columns = small(written(columns, "columns"), COLUMNS)
    met = written(incidence.join(columns, "h", "left_semi").dropDuplicates(["h", "cid"]), "met")
    v = F.shiftleft(F.col("hub").cast("long"), 40) + F.col("cid").bitwiseAND(F.lit(2**40 - 1))
    centres = written(met.groupBy("h").agg(*(F.min_by(c, v).alias(f"r{c}") for c in ("cid", "n", "at"))), "centres")
    star = met.join(centres, "h").where("cid != rcid")
    low = F.col("cid") < F.col("rcid")
    star = star.select(
        *(F.when(low, F.col(x)).otherwise(F.col(f"r{x}")).alias(y) for x, y in (("cid", "a"), ("n", "na"), ("at", "ia"))),
        *(F.when(low, F.col(f"r{x}")).otherwise(F.col(x)).alias(y) for x, y in (("cid", "b"), ("n", "nb"), ("at", "ib"))),
    )
    tried = written(bounded(star, percent).select("a", "b").distinct(), "tried")
    close = written(close_pairs(tried, classes, percent), "close")
    links = written(verified(close, classes, docs, k, percent), "links")
    parts = components(links)

    # what the centres did not settle: columns with members of different components
    label = parts.select(F.col("node").alias("cid"), F.col("component").alias("own"))
    marked = written(met.join(small(label), "cid", "left").withColumn("own", F.coalesce("own", "cid")).select("h", "cid", "n", "at", "own"), "marked")
    mixed = marked.groupBy("h").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("h", "m")
    rest = written(marked.join(written(mixed, "mixed"), "h"), "rest")
    # in order of size, a member that neither neighbour is close to in size has no partner
    # there; sizes are counted first, so that a column of many members is a row a size
    by_size = Window.partitionBy("h").orderBy("n")
    near = (F.col("c") > 1) | (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.lead("n").over(by_size) * percent)
    sizes = rest.groupBy("h", "n").agg(F.count("*").alias("c")).withColumn("near", near).where("near").select("h", "n")
    rest = written(rest.join(small(written(sizes, "sizes")), ["h", "n"], "left_semi"), "near")
    other = written(block_pairs(rest, classes, percent).distinct(), "other").join(tried, ["a", "b"], "left_anti")
    more = verified(written(other, "untried"), classes, docs, k, percent)
    links = written(links.union(more), "all_links")
    parts = components(links)

    # components by their least doc_id; parts has one row a class that is linked
    named = classes.select("cid", "doc").join(parts.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    final = written(named.join(least, "component").select("cid", "component_id"), "named")
    out = rows.where("kind = 0").select("doc_id", "content", F.col("n").cast("long").alias("n_shingles"), "cid")
    out = out.join(final, "cid", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "content", "n_shingles", "cid", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with the smallest doc_id of each component, whole rows. Texts without words,
    and components without any doc_id, are kept; repeated rows of a kept document
    become one, the first by its columns as JSON where those differ. An empty table gives
    no rows."""
    rows = written(join(docs, k, percent), "joined")
    gone = rows.where((F.col("n_shingles") > 0) & (F.col("doc_id").isNull() & F.col("component_id").isNotNull() | (F.col("doc_id") != F.col("component_id"))))
    gone = small(written(gone.select(F.col("doc_id").alias("_d"), F.col("content").alias("_c")).distinct(), "gone"))
    keyed = docs.withColumn("_c0", F.xxhash64("text"))
    out = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_c0") == F.col("_c")), "left_anti")
    again = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id", "content").count().where("count > 1")
    again = small(written(again.select("doc_id", F.col("content").alias("_c0")), "again"))
    once = out.join(again, ["doc_id", "_c0"], "left_anti").select(*docs.columns)
    whole = F.struct(*docs.columns)
    many = out.join(again, ["doc_id", "_c0"], "left_semi").groupBy("doc_id", "_c0").agg(F.min_by(whole, F.to_json(whole)).alias("_row"))
    return once.union(many.select("_row.*"))
