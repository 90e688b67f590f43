"""Substring dedup by collinear chaining.

Seeds are minimizers of word k-mers, every place of each: a window of WINDOW k-mers
has one, so two texts with WINDOW + K - 1 words in common share a seed there. A seed
is matched with its first place in the smallest and in the largest document that has
it, which makes at most two matches a seed, however many documents share a passage.
Seeds that no passage found so covers are then matched with all documents that have
them, places whose words are the same far around as one. Matches of two documents are chained in order with linear gap costs, the best
predecessor coming from a Fenwick tree of prefix maxima; a match alone is a chain
too. Chains that words around a match speak for are aligned word by word, cut into their longest
parts that are similar enough, and extended at both ends. Parts that go on from each other
in both documents are one; only what is long enough for one partner alone is a passage,
and overlapping passages of a document, whichever documents they match, are one row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, mix64, slices, small, whole, written

K, WINDOW = 5, 7
#: Characters whose words are hashed together.
CHARACTERS = 1 << 16
#: Words of texts whose seeds are found together (a longer text goes alone).
WORDS = 1 << 15
#: Words that a passage needs, and that an aligned chain needs to count towards one.
LEAST, CHAIN = 50, 16
SIMILAR = 0.8
#: What a matched seed adds to a chain, and what each word between two seeds costs.
GAIN, COST = 12.0, 0.1
#: Words beside a chain that the alignment may look at.
MARGIN = 64
#: Words on either side of a seed of which two bits each go with it, and how many of
#: them all must agree at one match of a chain at least: as many as a side has, since a
#: passage lies on one side of its first and last seeds (a quarter agrees by chance).
BESIDE, AGREE = 8, 8
#: Words on either side of a seed, the first AWAY ones passed over, of which four bits each
#: are compared first where all documents with a seed meet, and how many of them all must
#: agree: as many as a side has, which an exact passage of LEAST words reaches at any seed.
AWAY, SIDE, MET = 5, 16, 16
#: Places of a seed that meet at once: those not covered, and all.
OPEN_TILE, TILE = 1 << 11, 1 << 14
#: Pairs of places compared by one step of an array.
STEP = 1 << 15


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Of each text, 64-bit hashes of its words in lower case: runs of letters and digits.
    A word's hash is the mixed sum of those of its characters at their places, so that
    arrays over many texts give all of them at once."""
    letters = np.array([chr(i).isalnum() for i in range(1 << 16)])
    held, size = [], 0
    for text in texts:
        held.append((text or "").lower())
        size += len(held[-1]) + 1
        if size >= CHARACTERS:
            yield from _hashed(held, letters)
            held, size = [], 0
    yield from _hashed(held, letters)


def _hashed(texts: list[str], letters: np.ndarray) -> Iterator[np.ndarray]:
    if not texts:
        return
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters[np.minimum(chars, len(letters) - 1)]
    rare = np.flatnonzero(chars >= len(letters))
    inside[rare] = [chr(c).isalnum() for c in chars[rare].tolist()]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edge[::2], np.diff(edge)[::2]
    at = np.flatnonzero(inside)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    own = mix64(chars[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = mix64(np.add.reduceat(own, first) + sizes.astype(np.uint64)) if len(first) else np.empty(0, np.uint64)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    begin = 0
    for end in ends.tolist():
        yield h[begin:end]
        begin = end


def seeds_of(hs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, the minimizers: which text, k-mer hash, place, whether the hash comes there first
    in the text, and two bits of each of the BESIDE words before and after it, zero beyond the
    text. Where a few words come again and again, one place in CHAIN of each hash: alignments
    from there cover the others."""
    pad = max(WINDOW, BESIDE)
    sizes = np.array([len(h) for h in hs])
    starts = pad + np.cumsum(sizes + pad) - sizes - pad
    words = np.zeros(int(pad + sizes.sum() + pad * len(hs)) + K, np.uint64)
    for h, start in zip(hs, starts.tolist()):
        words[start : start + len(h)] = h
    n = len(words) - K + 1
    kmers = words[:n].copy()
    for i in range(1, K):
        kmers *= np.uint64(0x9E3779B97F4A7C15)
        kmers += words[i : i + n]
    kmers = mix64(kmers)
    # the leftmost smallest k-mer of each window: places ride in the low bits of the hashes
    low, here = np.uint64(0xFFFFFF), np.arange(n)
    own = np.maximum(sizes - K + 1, 0)
    edges = np.zeros((2, n + 1), np.int32)
    np.add.at(edges, (0, starts), 1)
    np.add.at(edges, (0, starts + own), -1)
    least = np.where(np.cumsum(edges[0, :n]) > 0, kmers & ~low | here.astype(np.uint64) & low, np.uint64(0xFFFFFFFFFFFFFFFF))
    done = 1
    while done < WINDOW:
        step = min(done, WINDOW - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    windows = np.where(own > 0, np.maximum(own - WINDOW + 1, 1), 0)
    np.add.at(edges, (1, starts), 1)
    np.add.at(edges, (1, starts + windows), -1)
    window = np.flatnonzero(np.cumsum(edges[1, : len(least)]) > 0)
    places = window + ((least[window] & low).astype(np.int64) - window & 0xFFFFFF)
    places = places[np.diff(places, prepend=-1) > 0]
    values, text = kmers[places], np.searchsorted(starts, places, "right") - 1
    order = np.argsort(values, kind="stable")
    again = np.flatnonzero((np.diff(values[order]) == 0) & (np.diff(text[order]) == 0)) + 1
    first, keep = np.ones(len(places), bool), np.ones(len(places), bool)
    if len(again):
        first[order[again]] = False
        twice = ~first
        twice[order[again - 1]] = True
        last: dict[tuple[int, int], int] = {}
        for i, t, v, p in zip(np.flatnonzero(twice).tolist(), text[twice].tolist(), values[twice].tolist(), places[twice].tolist()):
            if p - last.get((t, v), -CHAIN) < CHAIN:
                keep[i] = False
            else:
                last[t, v] = p
        text, values, places, first = text[keep], values[keep], places[keep], first[keep]
    bits = (words >> np.uint64(20)).astype(np.int64) & 3
    beside = np.zeros(len(places), np.int64)
    for i in [*range(-BESIDE, 0), *range(K, K + BESIDE)]:
        beside = beside << 2 | bits[places + i]
    return text, values, places - starts[text], first, beside


def seeds(docs: DataFrame) -> DataFrame:
    """h, doc and spot: the place above the bits beside it, and ~ of that where the hash
    was in the document before."""

    def run(batches):
        for batch in slices(batches):
            ids, held, size, out = [], [], 0, []
            for d, words in zip(batch.column("doc_id").to_pylist(), word_hashes(batch.column("text").to_pylist())):
                if d is None:
                    continue
                if held and size + len(words) > WORDS:
                    out.append(spots(ids, held))
                    ids, held, size = [], [], 0
                ids.append(d)
                held.append(words)
                size += len(words)
            if held:
                out.append(spots(ids, held))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["h", "doc", "spot"])

    def spots(ids, held):
        text, h, p, first, beside = seeds_of(held)
        spot = p.astype(np.int64) << 32 | beside
        return h.view(np.int64), np.array(ids, np.int64)[text], np.where(first, spot, ~spot)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h long, doc long, spot long")


def shared_seeds(own: DataFrame) -> DataFrame:
    """Seeds of several documents with the smallest (first) and the largest (last) of these."""
    shared = own.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last")
    return written(own.join(written(shared, "shared"), "h"), "shared_seeds")


def matched(own: DataFrame) -> DataFrame:
    """Matches of shared seeds with the smallest and the largest document that has them: doc,
    at, ref, rat and the number of words beside them that agree. What no passage covers
    after these is left to matched_with_all()."""
    ends = own.where("spot >= 0 and (doc = first or doc = last)").groupBy("h").agg(F.min_by("spot", "doc").alias("fspot"), F.max_by("spot", "doc").alias("lspot"))
    both = own.join(small(written(ends, "ends"), 1_000_000), "h")
    # the first places of the two ends have met when the last one's seed met the first's
    low = both.where("doc != first").select("doc", "spot", F.col("first").alias("ref"), F.col("fspot").alias("rspot"))
    high = both.where("doc != last and (doc != first or spot < 0)").select("doc", "spot", F.col("last").alias("ref"), F.col("lspot").alias("rspot"))
    met = low.union(high).withColumn("spot", F.expr("if(spot < 0, ~spot, spot)")).withColumn("same", F.expr("~(spot ^ rspot)"))
    agree = f"bit_count(same & shiftright(same, 1) & {0x55555555}L)"
    return met.selectExpr("doc", "cast(shiftright(spot, 32) as int) as at", "ref", "cast(shiftright(rspot, 32) as int) as rat", f"cast({agree} as int) as agree")


def uncovered(own: DataFrame, found: DataFrame) -> DataFrame:
    """Places of shared seeds in documents that are neither the first nor the last with them,
    where two such documents or more have one and no row of `found` (of merged()) covers
    it in one of them: h, doc, at, open (not covered)."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")).withColumnRenamed("doc_id", "doc")
    middle = own.where("doc != first and doc != last").selectExpr("h", "doc", "cast(shiftright(if(spot < 0, ~spot, spot), 32) as int) as at")
    covered = F.expr(f"coalesce(exists(spans, s -> s.start_word <= at and at + {K} <= s.end_word), false)")
    middle = written(middle.join(small(written(spans, "covered")), "doc", "left").select("h", "doc", "at", (~covered).alias("open")), "middle")
    asked = middle.groupBy("h").agg(F.bool_or("open").alias("any"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("any and a != b").select("h")
    return middle.join(small(written(asked, "asked")), "h")


def sketched(places: DataFrame, docs: DataFrame) -> DataFrame:
    """Places of uncovered() with the words around them: ctx, a hash of MARGIN words on either
    side, one and two, two bits each of the SIDE words on either side beyond AWAY, and near, half
    a byte (zero beyond the text) of each of the MARGIN words before and behind the seed."""
    listed = places.groupBy("doc").agg(F.collect_list(F.struct("h", F.expr("if(open, ~at, at)").alias("at"))).alias("p"))
    listed = small(written(listed.selectExpr("doc", "transform(p, x -> x.h) as hs", "transform(p, x -> x.at) as ats"), "listed"))
    around = MARGIN + np.arange(-MARGIN, K + MARGIN)
    weights = mix64(np.arange(1, len(around) + 1, dtype=np.uint64)) | np.uint64(1)
    aside = MARGIN + np.r_[-AWAY - SIDE : -AWAY, K + AWAY : K + AWAY + SIDE]
    shifts = 2 * np.arange(2 * SIDE, dtype=np.uint64)
    beside_ = MARGIN + np.r_[-1 : -MARGIN - 1 : -1, K : K + MARGIN]

    def run(batches):
        for batch in slices(batches):
            out, near = [[] for _ in range(7)], []
            for d, hs, ats, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "hs", "ats")), word_hashes(batch.column("text").to_pylist())):
                at, hs = np.array(ats, np.int64), np.array(hs, np.int64)
                at, open_ = np.where(at < 0, ~at, at), at < 0
                inside = at + K <= len(words)  # rows of one doc_id may have several texts
                at, hs, open_ = at[inside], hs[inside], open_[inside]
                padded = np.zeros(len(words) + 2 * MARGIN, np.uint64)
                padded[MARGIN : MARGIN + len(words)] = words
                ctx = mix64((padded[at[:, None] + around] * weights).sum(axis=1, dtype=np.uint64))
                side = padded[at[:, None] + aside]
                codes = np.zeros(len(padded), np.uint8)
                codes[MARGIN : MARGIN + len(words)] = (words >> np.uint64(32)) % np.uint64(15) + np.uint64(1)
                codes = codes[at[:, None] + beside_]
                near += [x.tobytes() for x in codes[:, ::2] | codes[:, 1::2] << 4]
                bits = [((side >> np.uint64(n) & np.uint64(3)) << shifts).sum(axis=1, dtype=np.uint64) for n in (20, 22)]
                for column, value in zip(out, (hs, np.full(len(at), d, np.int64), at.astype(np.int32), open_, *(x.view(np.int64) for x in (ctx, *bits)))):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out), pa.array(near, pa.binary())], names=["h", "doc", "at", "open", "ctx", "one", "two", "near"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(listed, "doc")
    return texts.mapInArrow(run, "h long, doc long, at int, open boolean, ctx long, one long, two long, near binary")


def planes(near: np.ndarray) -> np.ndarray:
    """The codes of the words beside places (near) by side, bit and place: a bit of each of the
    MARGIN words of a side in one number, the fifth of which says whether there is a word."""
    codes = np.empty((len(near), 2, MARGIN), np.uint8)
    flat = codes.reshape(len(near), 2 * MARGIN)
    flat[:, ::2], flat[:, 1::2] = near & 15, near >> 4
    bits = [codes >> n & 1 for n in range(4)] + [codes > 0]
    return np.stack([np.packbits(x, axis=2, bitorder="little").view("<u8")[:, :, 0].T for x in bits], axis=1)


def equal_codes(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether the words beside pairs of places have the same code, a bit each, from the planes
    of one side of both."""
    differ = a[0] ^ b[0]
    for n in (1, 2, 3):
        differ |= a[n] ^ b[n]
    return ~differ & a[4]


def _walks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each 16 bits: what they add (a mismatch costs 2), the most on the way, and where that is."""
    bits = np.arange(1 << 16)[:, None] >> np.arange(16) & 1
    total = np.cumsum(3 * bits - 2, axis=1)
    return tuple(x.astype(np.int8) for x in (total[:, -1], total.max(axis=1), total.argmax(axis=1) + 1))


ADDED, HIGHEST, WHERE = _walks()


def begun(same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the nearest 16 bits of a side: how far they go together, the most and the last total
    on the way, and which sides may go farther than that."""
    near = (same & np.uint64(0xFFFF)).astype(np.uint16)
    most, total = HIGHEST[near], ADDED[near]
    far = np.where(most > 0, WHERE[near], np.int8(0))
    most = np.maximum(most, np.int8(0))
    return far, most, total, np.flatnonzero(total + np.bitwise_count(same >> np.uint64(16)).astype(np.int8) > most)


def bounded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As followed(), or more, from the nearest 16 words of a side and the number of equal codes
    among the others."""
    reached = np.full(len(a), K)
    for x, y in zip(planes(a), planes(b)):
        far, _, _, on = begun(equal_codes(x, y))
        far[on] = MARGIN
        reached += far
    return reached


def farthest(same: np.ndarray) -> np.ndarray:
    """How many words the bits of one side (equal_codes()) go together: the first most of their total."""
    far, most, total, on = begun(same)
    most, total, rest, best = most[on], total[on].astype(np.int16), same[on], far[on]
    for k in (1, 2, 3):
        bits = (rest >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.uint16)
        top = total + HIGHEST[bits]
        best = np.where(top > most, 16 * k + WHERE[bits], best)
        most, total = np.maximum(most, top), total + ADDED[bits]
    far[on] = best
    return far


def followed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words pairs of places can come to at most, as hopeless() counts them, from
    the codes of the words beside them (near): equal codes make it more, never less."""
    return sum((farthest(equal_codes(x, y)) for x, y in zip(planes(a), planes(b))), np.full(len(a), K))


def met(g: pa.RecordBatch) -> list[np.ndarray]:
    """doc, at, ref, rat of the pairs of whole tiles that can come to LEAST words: each row of side 0
    with each of side 1 of its tile that is of another document, those open on both sides once."""
    side, h, p, q = (g.column(c).to_numpy() for c in ("side", "h", "i", "j"))
    doc, at, other, oat, ctx, one, two = (g.column(c).to_numpy() for c in ("doc", "at", "other", "oat", "ctx", "one", "two"))
    open_ = g.column("open").to_numpy(zero_copy_only=False)
    one, two, low = one.view(np.uint64), two.view(np.uint64), np.uint64(0x5555555555555555)
    tile = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))])
    codes, found = None, [(tile[:0], tile[:0])]

    def followed_from(i, j, differ):
        nonlocal codes
        differ |= differ >> np.uint64(1)
        differ &= low
        asked = np.flatnonzero(np.bitwise_count(differ).ravel() <= 2 * SIDE - MET)
        i, j = i(asked), j(asked)
        once = ~open_[j] | (ctx[i] < ctx[j])
        i, j = i[once], j[once]
        if len(i):
            if codes is None:
                codes = planes(np.frombuffer(b"".join(g.column("near").to_pylist()), np.uint8).reshape(len(side), MARGIN))
            left, right = (farthest(equal_codes([x[i] for x in c], [x[j] for x in c])) for c in codes)
            enough = left.astype(np.int16) + right >= LEAST - K
            found.append((i[enough], j[enough]))

    # open places by ctx: those before a step's first have met its places already
    here = np.flatnonzero(side == 0)
    here = here[np.lexsort((ctx[here], tile[here]))]
    there = np.flatnonzero(side == 1)
    there = there[np.lexsort((~ctx[there], open_[there], tile[there]))]
    n_here, n_there = (np.bincount(tile[x], minlength=tile[-1] + 1) for x in (here, there))
    first, begin = np.cumsum(n_here) - n_here, np.cumsum(n_there) - n_there
    large = n_here * n_there > STEP // 4
    for t in np.flatnonzero(large).tolist():
        own, others = here[first[t] : first[t] + n_here[t]], there[begin[t] : begin[t] + n_there[t]]
        late = ctx[others[open_[others]][::-1]]
        after = len(others) - np.searchsorted(late, ctx[own], "right")
        ones, twos, start = one[others], two[others], 0
        while start < len(own):
            n = int(after[start])
            part = own[start : start + max(1, STEP // max(1, n))]
            start += len(part)
            if n:
                differ = one[part, None] ^ ones[:n]
                differ |= two[part, None] ^ twos[:n]
                followed_from(lambda k: part[k // n], lambda k: others[k % n], differ)  # noqa: B023
    # small tiles together, a list of pairs
    own = here[~large[tile[here]]]
    times = n_there[tile[own]]
    cuts = np.searchsorted(np.cumsum(times), np.arange(STEP, int(times.sum()) + STEP, STEP), "right")
    for part, n in zip(np.split(own, cuts), np.split(times, cuts)):
        if n.sum():
            i = np.repeat(part, n)
            j = there[np.repeat(begin[tile[part]] - np.cumsum(n) + n, n) + np.arange(len(i))]
            followed_from(i.__getitem__, j.__getitem__, one[i] ^ one[j] | two[i] ^ two[j])
    i, j = (np.concatenate(x) for x in zip(*found))
    # where the smallest documents of two places are one, the largest of either stands for it
    a, x, b, y = doc[i], at[i], doc[j], at[j]
    same = a == b
    second = same & (other[j] != a)
    b, y = np.where(second, other[j], b), np.where(second, oat[j], y)
    first = same & ~second
    a, x = np.where(first, other[i], a), np.where(first, oat[i], x)
    keep = a != b
    swap = a < b
    return [c[keep] for c in (np.where(swap, b, a), np.where(swap, y, x), np.where(swap, a, b), np.where(swap, x, y))]


def matched_with_all(places: DataFrame, docs: DataFrame) -> DataFrame:
    """Matches as of matched() of the open places of uncovered() with all places of the same
    seed: those with the same words far around are one, with a match of each open one and its
    smallest document; of these, the open ones meet all others in tiles of bounded size."""
    rows = written(sketched(places, docs), "sketches")
    smallest, largest = F.min(F.struct("doc", "at")), F.max(F.struct("doc", "at"))
    kinds = rows.groupBy("h", "ctx").agg(smallest.alias("s"), largest.alias("l"), F.bool_or("open").alias("open"), F.first("one").alias("one"), F.first("two").alias("two"), F.first("near").alias("near"))
    kinds = written(kinds.selectExpr("h", "ctx", "s.doc", "s.at", "l.doc as other", "l.at as oat", "open", "one", "two", "near"), "kinds")
    agree = f"{AGREE} as agree"
    copies = kinds.where("doc != other and open")
    alike = copies.selectExpr("other as doc", "oat as at", "doc as ref", "at as rat", agree)
    inner = rows.where("open").alias("r").join(copies.alias("k"), ["h", "ctx"]).where("r.doc != k.doc and r.doc != k.other")
    alike = alike.union(inner.selectExpr("r.doc", "r.at", "k.doc as ref", "k.at as rat", agree))

    counts = kinds.groupBy("h").agg(F.count_if("open").alias("n_open"), F.count("*").alias("n")).where("n_open > 0 and n > 1")
    cut = kinds.join(counts, "h").selectExpr("*", f"cast(ceil(n_open / {OPEN_TILE}) as int) as p", f"cast(ceil(n / {TILE}) as int) as q")
    columns = ["h", "ctx", "doc", "at", "other", "oat", "open", "one", "two", "near"]
    here = cut.where("open").selectExpr(*columns, "0 as side", "cast(pmod(xxhash64(ctx), p) as int) as i", "explode(sequence(0, q - 1)) as j")
    there = cut.selectExpr(*columns, "1 as side", "explode(sequence(0, p - 1)) as i", "cast(pmod(xxhash64(ctx), q) as int) as j")

    def run(batches):
        for g in whole_pairs(batches, 4000, ("h", "i", "j")):
            found = [*met(g)]
            found.append(np.full(len(found[0]), AGREE))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "at", "ref", "rat", "agree"])

    dealt = here.union(there).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return alike.union(dealt.mapInArrow(run, "doc long, at int, ref long, rat int, agree int"))


def chains_of(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of matches (x, y), best first, each match in one chain at most. Matches are
    taken by x, then y; a match follows one with smaller x and y."""
    order = np.lexsort((y, x))
    ranks = sorted(set(y.tolist()))
    size = len(ranks)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, back = {}, {}
    i = 0
    order = order.tolist()
    while i < len(order):
        j = i
        while j < len(order) and x[order[j]] == x[order[i]]:
            j += 1
        now = []
        for m in order[i:j]:  # predecessors have smaller x: ask before any of this x is put in
            r = bisect_left(ranks, y[m])
            best = (-np.inf, -1)
            while r > 0:
                best = max(best, tree[r])
                r &= r - 1
            linked = best[0] - COST * float(x[m] + y[m]) if best[1] >= 0 else -np.inf
            score[m], back[m] = (GAIN + linked, best[1]) if linked > 0 else (GAIN, -1)
            now.append(m)
        for m in now:
            value = (score[m] + COST * float(x[m] + y[m]), m)
            r = bisect_left(ranks, y[m]) + 1
            while r <= size:
                tree[r] = max(tree[r], value)
                r += r & -r
        i = j
    used, out = set(), []
    for m in sorted(score, key=lambda m: (-score[m], m)):
        chain = []
        while m >= 0 and m not in used:
            chain.append(m)
            used.add(m)
            m = back[m]
        if chain:
            out.append(chain[::-1])
    return out


def chains(matches: DataFrame) -> DataFrame:
    """Chains, of one match or more, that AGREE words beside a match speak for: doc, ref,
    xs, ys (places of the matches)."""

    def run(batches):
        for batch in whole_pairs(batches, 10_000):
            d, r, x, y, agree = (batch.column(c).to_numpy() for c in ("doc", "ref", "at", "rat", "agree"))
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(starts, append=len(d))
            dx, dy = np.diff(x), np.diff(y)
            apart = np.zeros(len(d), bool)
            apart[1:] = ~new[1:] & ~((dx > 0) & (dy > 0) & (np.abs(dx - dy) + dx + dy <= GAIN / COST))
            spoken = np.maximum.reduceat(agree, starts) >= AGREE
            one = ~np.logical_or.reduceat(apart, starts)  # already one chain
            rows = np.repeat(spoken & one, sizes)
            ends = np.concatenate([[0], np.cumsum(sizes[spoken & one])])
            found = [], [], [], []
            for start, n in zip(starts[spoken & ~one].tolist(), sizes[spoken & ~one].tolist()):
                xs, ys, a = (c[start : start + n] for c in (x, y, agree))
                for chain in chains_of(xs.astype(np.int64), ys.astype(np.int64)):
                    if a[chain].max() >= AGREE:
                        for column, value in zip(found, (d[start], r[start], xs[chain], ys[chain])):
                            column.append(value)
            yield out(d[starts[spoken & one]], r[starts[spoken & one]], *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[rows], pa.int32())) for c in (x, y)))
            if found[0]:
                yield out(*found)

    def out(*columns):
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.ListArray) else pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "ref", "xs", "ys"])

    dealt = matches.repartition("doc", "ref").sortWithinPartitions("doc", "ref", "at", "rat")
    return dealt.mapInArrow(run, "doc long, ref long, xs array<int>, ys array<int>")


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence of two pieces, a bit for each word of one: those
    where it grows are cleared."""
    if a == b:
        return len(a)
    at: dict[int, int] = {}
    for i, v in enumerate(b):
        at[v] = at.get(v, 0) | 1 << i
    every = left = (1 << len(b)) - 1
    for v in a:
        grown = left & at.get(v, 0)
        left = (left + grown | left - grown) & every
    return len(b) - left.bit_count()


def reach(a: np.ndarray, b: np.ndarray, miss: int = 2) -> tuple[int, int]:
    """How far two pieces go together from their beginnings (a mismatch costs `miss`),
    and the words that match on the way."""
    n = min(len(a), len(b))
    return together(a[:n] == b[:n], miss)


def together(same: np.ndarray, miss: int) -> tuple[int, int]:
    """reach() from whether the words match."""
    n = len(same)
    matched = np.count_nonzero(same)
    if matched in (0, n):
        return matched, matched
    total = np.cumsum(np.where(same, 1, -miss))
    end = int(total.argmax()) + 1
    return (end, np.count_nonzero(same[:end])) if total[end - 1] > 0 else (0, 0)


def blocks(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The seeds of a chain without what overlaps the one before, a row each: where it
    starts in both pieces, words matched up to there, where it ends, words matched."""
    rows, n, x, y = [], 0, int(xs[0]), int(ys[0])
    x0, y0 = x, y
    a, b = a[x : xs[-1] + K].tolist(), b[y : ys[-1] + K].tolist()
    for p, q in zip(xs.tolist(), ys.tolist()):
        if p < x or q < y:  # overlaps the seed before
            step = max(x - p, y - q)
            grown = K - step
            if grown > 0:
                more = min(grown, common(a[x - x0 : p + K - x0], b[y - y0 : q + K - y0])) if p - x != q - y else grown
                rows.append((x, y, n, p + K, q + K, n + more))
                n, x, y = n + more, p + K, q + K
        else:
            n += common(a[x - x0 : p - x0], b[y - y0 : q - y0])
            rows.append((p, q, n, p + K, q + K, n + K))
            n, x, y = n + K, p + K, q + K
    return np.array(rows)


def similar(n: int, la: int, lb: int) -> bool:
    return 2 * n >= SIMILAR * (la + lb)


def extended(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end, start, end, matched words) of some blocks and what goes on beside
    them, as far as they stay similar enough."""
    (x, y, before), (u, v, n) = part[0, :3].tolist(), part[-1, 3:].tolist()
    n -= before
    left, right = min(x, y), min(len(a) - u, len(b) - v)
    same = (a[x - left : x] == b[y - left : y])[::-1], a[u : u + right] == b[v : v + right]
    best, sides = None, [tuple(together(s, 2) for s in same)]
    for far in (0, 1, 2):  # the widest most often fits: the others are looked at where it does not
        if far == 1:
            sides += [tuple(together(s, 4) for s in same), ((0, 0), (0, 0))]
        pairs = [(0, 0)] if far == 0 else [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2)] if far == 1 else [(2, 0), (2, 1), (2, 2)]
        for i, j in pairs:
            (left, less), (right, more) = sides[i][0], sides[j][1]
            fits = similar(n + less + more, u - x + left + right, v - y + left + right)
            if best is None or (fits, left + right) > best[0]:
                best = (fits, left + right), (x - left, u + right, y - left, v + right, n + less + more)
            if fits and left == sides[0][0][0] and right == sides[0][1][0]:
                return best[1]
    return best[1]


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end, start, end, matched words) in two pieces with a chain of matches."""
    return extended(a, b, blocks(a, b, xs, ys))


def similar_parts(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """As align, for the longest part of the chain that is similar enough, and again for
    what is left at both sides of it."""
    found, open_ = [], [blocks(a, b, xs, ys)]
    while open_:
        part = open_.pop()
        if len(part) == 1:
            found.append(extended(a, b, part))
            continue
        starts = 2 * part[:, 2] - SIMILAR * (part[:, 0] + part[:, 1])
        ends = 2 * part[:, 5] - SIMILAR * (part[:, 3] + part[:, 4])
        # the first start from which each end is similar enough: where the running least falls to it
        at = np.searchsorted(-np.minimum.accumulate(starts), -ends - 1e-9)
        at = np.minimum(at, np.arange(len(part)))
        j = int((part[:, 3] - part[at, 0]).argmax())
        i = int(at[j])
        found.append(extended(a, b, part[i : j + 1]))
        open_ += [p for p in (part[:i], part[j + 1 :]) if len(p)]
    return found


def pieces(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Both sides of each chain as rows: doc, ref, x0 and y0 (where the chain begins), side,
    places, start and the words from MARGIN before the chain to MARGIN behind it, as 32
    bits of their hashes. Each document that chains are about is hashed and dealt out once."""
    first = [F.col("xs")[0].alias("x0"), F.col("ys")[0].alias("y0")]
    sides = [F.struct(F.col(d).alias("at"), F.lit(n).alias("side"), F.col(x).alias("places")) for n, (d, x) in enumerate((("doc", "xs"), ("ref", "ys")))]
    asked = found.select("doc", "ref", *first, F.explode(F.array(*sides)).alias("s")).select("doc", "ref", "x0", "y0", "s.*")
    ids = small(written(asked.select("at").distinct(), "ids"))

    def shorten(batches):
        for batch in slices(batches):
            words = [(h >> np.uint64(32)).astype("<u4").tobytes() for h in word_hashes(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(words, pa.binary())], names=["at", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("at"), "text").join(ids, "at", "left_semi").mapInArrow(shorten, "at long, words binary")
    start = asked.withColumn("start", F.greatest(F.lit(0), F.col("places")[0] - MARGIN))
    piece = F.expr(f"substring(words, 4 * start + 1, 4 * (element_at(places, -1) + {K + MARGIN} - start))").alias("piece")
    return start.join(texts, "at").select("doc", "ref", "x0", "y0", "side", "places", "start", piece)


def whole_pairs(batches: Iterator[pa.RecordBatch], rows: int = 4000, keys: tuple[str, ...] = ("doc", "ref")) -> Iterator[pa.RecordBatch]:
    """Batches of whole pairs (doc, ref), or of other keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in slices(batches, rows):
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        others = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
        start = int(others[-1]) + 1 if len(others) else 0
        if held and (start or any(h != c[0] for h, c in zip(last, columns))):
            new = np.flatnonzero(np.logical_or.reduce([c != h for h, c in zip(last, columns)]))
            cut = int(new[0]) if len(new) else batch.num_rows
            yield whole([*held, batch.slice(0, cut)]) if cut else whole(held)
            held = []
            if cut < start:
                yield batch.slice(cut, start - cut)
            held = [batch.slice(max(cut, start))] if max(cut, start) < batch.num_rows else []
        else:
            if start:
                yield batch.slice(0, start)
            held.append(batch.slice(start))
        last = [c[-1] for c in columns]
    if held:
        yield whole(held)


def hopeless(g: pa.RecordBatch) -> np.ndarray:
    """Of rows of pieces() of whole pairs, sorted, those of chains that cannot come to a part
    that counts: one match that does not reach LEAST words where it is its pair's only
    chain, or CHAIN words else. Both reaches of extended(), for all of them at once."""
    d, r, x, y, side = (g.column(c).to_numpy() for c in ("doc", "ref", "x0", "y0", "side"))
    n = len(d)
    new = np.ones(n + 1, bool)
    new[1:n] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    pair = np.ones(n + 1, bool)
    pair[1:n] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
    sizes = np.diff(offsets(g.column("places")))
    at = np.flatnonzero(new[:-2] & ~new[1:-1] & new[2:]) if n > 1 else np.empty(0, np.int64)
    at = at[(side[at] == 0) & (side[at + 1] == 1) & (sizes[at] == 1) & (sizes[at + 1] == 1)]
    out = np.zeros(n, bool)
    if not len(at):
        return out
    alone = pair[at] & pair[at + 2]
    places = g.column("places").flatten().to_numpy()[offsets(g.column("places"))[:-1] - offsets(g.column("places"))[0]]
    here = places - g.column("start").to_numpy()
    piece = g.column("piece")
    ends = offsets(piece)
    words = np.frombuffer(piece.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u4")
    ends = (ends - ends[0]) // 4
    reached = np.full(len(at), K)
    span = np.arange(MARGIN)
    for sign in (-1, 1):
        first = [ends[i] + here[i] + (K if sign > 0 else -1) for i in (at, at + 1)]
        room = np.minimum(*((ends[i + 1] - f if sign > 0 else f - ends[i] + 1) for i, f in zip((at, at + 1), first)))
        inside = span < room[:, None]
        index = [np.clip(f[:, None] + sign * span, 0, len(words) - 1) for f in first]
        same = words[index[0]] == words[index[1]]
        far = np.zeros(len(at), np.int64)
        for miss in (2, 4):
            total = np.cumsum(np.where(inside, np.where(same, 1, -miss), -1000), axis=1)
            best = total.argmax(axis=1)
            far = np.maximum(far, np.where(total[np.arange(len(at)), best] > 0, best + 1, 0))
        reached += far
    lost = at[reached < np.where(alone, LEAST, CHAIN)]
    out[lost] = out[lost + 1] = True
    return out


def offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a list or binary column begin and end in its buffer."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def parts_of(g: pa.RecordBatch) -> list[tuple[int, int, int, int]]:
    """Similar parts (start, end, start, end) of the chains of one pair of documents, given
    as rows of pieces(), by where they start. A side has several pieces where rows of a
    doc_id have several texts."""
    chains_: dict[tuple[int, int], tuple[list, list]] = {}
    x0s, y0s, sides, starts = (g.column(c).to_numpy().tolist() for c in ("x0", "y0", "side", "start"))
    listed, piece = g.column("places"), g.column("piece")
    places, ends = listed.flatten().to_numpy(), offsets(listed)
    ends = (ends - ends[0]).tolist()
    cuts = offsets(piece).tolist()
    words = np.frombuffer(piece.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]].view("<u4")
    cuts = [(c - cuts[0]) // 4 for c in cuts]
    for n, (x0, y0, side, start) in enumerate(zip(x0s, y0s, sides, starts)):
        chains_.setdefault((x0, y0), ([], []))[side].append((places[ends[n] : ends[n + 1]] - start, start, words[cuts[n] : cuts[n + 1]]))
    found = set()
    for left, right in chains_.values():
        for xs, a0, a in left:
            for ys, b0, b in right:
                if len(a) >= xs[-1] + K and len(b) >= ys[-1] + K:
                    for s, e, rs, re_, n in similar_parts(a, b, xs, ys):
                        if e - s >= CHAIN and similar(n, e - s, re_ - rs):
                            found.add((s + a0, e + a0, rs + b0, re_ + b0))
    return sorted(found)


def passages(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Passages of chains: doc, start, end, ref, rstart, rend. Similar parts of one pair of
    documents that touch or overlap in both of them are one, where LEAST words long in either."""

    def run(batches):
        for batch in whole_pairs(batches):
            left = batch.filter(pa.array(~hopeless(batch)))
            rows = []
            for g in groups([left], ["doc", "ref"]):
                doc, ref = g.column("doc")[0].as_py(), g.column("ref")[0].as_py()
                open_: list[list[int]] = []
                for s, e, rs, re_ in parts_of(g):
                    for o in open_:
                        if s <= o[1] and o[2] <= rs <= o[3]:
                            o[1], o[3] = max(o[1], e), max(o[3], re_)
                            break
                    else:
                        rows += [(doc, *o[:2], ref, *o[2:]) for o in open_ if o[1] < s]
                        open_ = [*(o for o in open_ if o[1] >= s), [s, e, rs, re_]]
                rows += [(doc, *o[:2], ref, *o[2:]) for o in open_]
            rows = [r for r in rows if max(r[2] - r[1], r[5] - r[4]) >= LEAST]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc", "start", "end", "ref", "rstart", "rend"])

    dealt = pieces(found, docs).repartition("doc", "ref").sortWithinPartitions("doc", "ref", "x0", "y0", "side")
    return dealt.mapInArrow(run, "doc long, start int, end int, ref long, rstart int, rend int")


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one."""

    def run(batches):
        now, rows = None, []
        for batch in slices(batches):
            for d, s, e, o, n in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "end", "other", "n"))):
                if now and now[0] == d and s <= now[2]:
                    now = (d, now[1], max(now[2], e), min(now[3], o), now[4] + n)
                else:
                    if now:
                        rows.append(now)
                    now = (d, s, e, o, n)
            if len(rows) > 5000:
                yield out(rows)
                rows = []
        if now:
            yield out([*rows, now])

    def out(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start_word", "end_word", "ref_doc_id", "n_links"])

    # equal spans are one row before they meet: a passage that thousands share is one row a task
    compact = spans.groupBy("doc", "start", "end").agg(F.min("other").alias("other"), F.sum("n").alias("n"))
    dealt = compact.repartition("doc").sortWithinPartitions("doc", "start", "end")
    return dealt.mapInArrow(run, "doc_id long, start_word int, end_word int, ref_doc_id long, n_links long")


def repeated(docs: DataFrame) -> DataFrame:
    """Passages of LEAST words or more that come again in another document, copies with
    small changes included: doc_id, start_word, end_word (of the text's runs of letters
    and digits, end exclusive), ref_doc_id (the smallest document it was matched with),
    n_links. Both sides of each match have rows. A passage is LEAST words long with one
    partner; where passages with several partners overlap or touch, they are one row.

    Null and empty texts, texts shorter than a seed and rows without a doc_id have none;
    rows of one doc_id count as one document, so repeated rows match nothing by
    themselves. Ties between partners go to the smallest doc_id. Other columns are not
    read. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    own = shared_seeds(written(seeds(docs), "seeds"))
    found = written(chains(matched(own)), "chains")
    spans = written(passages(found, docs), "passages")
    rest = matched_with_all(uncovered(own, merged(both_sides(spans))), docs)
    found = written(chains(rest), "more_chains")
    return merged(both_sides(spans.union(written(passages(found, docs), "more_passages"))))


def both_sides(spans: DataFrame) -> DataFrame:
    """Rows of passages() for either document: doc, start, end, other, n."""
    one = F.lit(1).cast("long").alias("n")
    sides = spans.select("doc", "start", "end", F.col("ref").alias("other"), one)
    return sides.union(spans.select(F.col("ref").alias("doc"), F.col("rstart").alias("start"), F.col("rend").alias("end"), F.col("doc").alias("other"), one))
