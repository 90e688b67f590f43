"""Media columns: content-defined chunks, deduplicated by digest, rebuilt and verified.

A payload is stored as a binary grey-scale image (PGM, 192 samples of 8 bits a row).
A rolling gear hash over the stored bytes sets the cuts, so that equal passages give
equal chunks. Each digest has a home, the smallest medium that lists it, and its chunk is
stored there alone; a medium is an ordered list of digests. Media whose chunks are all at
home are rebuilt where they are stored; others fetch what they lack by digest. All are
checked against their SHA-256 and read back.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, slices, small, utf8, written

ROW = 192
LEAST, MOST, MASK_BITS = 1 << 10, 1 << 14, 12
#: Holders of a digest beyond which its chunk is dealt out by salt.
HOLDERS = 256
#: Texts that the compression dictionary is made from (by a hash), and its bytes.
DICTIONARY_TEXTS, DICTIONARY_BYTES = 1_000, 112 << 10
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 bytes padded by spaces to a positive multiple of ROW."""
    text = text or b""
    return text + b" " * (-len(text) % ROW if text else ROW)


def encode(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def parse(media: bytes) -> bytes:
    """The samples of a stored image; raises ValueError if it is not one of ours."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width != ROW or len(samples) != width * height:
        raise ValueError("not a stored payload")
    return samples


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash h = (h << 1) + gear[byte] modulo 2**32 depends on
    the last 32 bytes; five doubling steps give it at every place at once."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if n > step else h[step:]
    places = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, start = [], 0
    while n - start > LEAST:
        i = np.searchsorted(places, start + LEAST)
        end = int(min(places[i] if i < len(places) else n, start + MOST, n))
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(samples: bytes) -> str:
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    total, square = int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    p = counts[counts > 0] / len(a)
    edges = int(np.abs(np.diff(a.reshape(-1, ROW).astype(np.int16), axis=1)).sum(dtype=np.int64))
    mean = total / len(a)
    return f"rows={len(a) // ROW};mean={mean:.4f};var={max(0.0, square / len(a) - mean * mean):.4f};min={a.min()};max={a.max()};entropy={-(p * np.log2(p)).sum():.4f};gradient={edges / len(a):.4f}"


def content():
    """What stands for a text in joins: its hash and length."""
    return [F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")]


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_bytes, media_key (SHA-256 of the stored form), digests in order."""

    def run(batches):
        for batch in slices(batches):
            sizes, keys, lists = [], [], []
            for text in utf8(batch.column("text")):
                media = encode(payload_of(text))
                ends = cuts(media)
                sizes.append(len(text or b""))
                keys.append(hashlib.sha256(media).digest())
                lists.append([digest(media[a:b]) for a, b in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "h", "n_bytes", "media_key", "digests"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", content()[0], "text").mapInArrow(run, f"doc_id {kind}, h long, n_bytes long, media_key binary, digests array<binary>")


def dictionary(docs: DataFrame, rows: int) -> bytes:
    """A zstd dictionary from some DICTIONARY_TEXTS of `rows` texts, picked by their hash,
    equal ones once; only compression depends on it."""
    share = min(1.0, 2 * DICTIONARY_TEXTS / max(1, rows))
    picked = docs.where((F.octet_length("text") > 64) & (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= int(share * (1 << 30))))
    picked = picked.select(F.xxhash64("text").alias("h"), F.substring("text", 1, MOST).alias("text")).groupBy("h").agg(F.min("text").alias("text"))
    texts = [r.text.encode("utf-8", "replace")[:MOST] for r in picked.limit(DICTIONARY_TEXTS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) >= 100 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def chunks(docs: DataFrame, away: DataFrame, words: bytes) -> DataFrame:
    """media_key, n_places, and places, digests and packed of the chunks stored with it.
    away: (h, size, home, doc) for texts that several rows have or whose chunks are in part
    at home elsewhere: the places of the latter, and the doc_id that stores the medium."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_content_size=True, write_dict_id=False)
        seen: set = set()  # repeated rows, and rows without a doc_id, once a task as far as this tells
        for batch in slices(batches):
            rows = [[], [], [], [], []]
            for text, elsewhere in zip(utf8(batch.column("text")), batch.column("elsewhere").to_pylist()):
                media = encode(payload_of(text))
                key = hashlib.sha256(media).digest()
                if key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                ends, elsewhere = cuts(media), set(elsewhere or ())
                own = [(i, media[a:b]) for i, (a, b) in enumerate(zip([0, *ends], ends)) if i not in elsewhere]
                for column, value in zip(rows, (key, len(ends), [i for i, _ in own], [digest(c) for _, c in own], [packer.compress(c) for _, c in own])):
                    column.append(value)
            kinds = (pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["media_key", "n_places", "places", "digests", "packed"])

    keyed = docs.select("doc_id", "text", *content()).join(small(away), ["h", "size"], "left")
    stores = F.col("doc").isNull() | F.col("doc_id").eqNullSafe(F.col("doc.doc_id"))
    return keyed.where(stores).select("text", "elsewhere").mapInArrow(run, "media_key binary, n_places int, places array<int>, digests array<binary>, packed array<binary>")


def rebuilt(rows: DataFrame, words: bytes) -> DataFrame:
    """From media_key, n_places, places and packed, in any number of rows that stand together
    (a place that comes again is skipped): media_key, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature. Raises if the SHA-256 of a medium is not
    its key."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).decompress
        key, parts = None, {}

        def done():
            media = b"".join(parts[i] for i in sorted(parts))
            found = hashlib.sha256(media)
            if found.digest() != key:
                raise ValueError(f"medium {key.hex()} could not be rebuilt")
            samples = parse(media)
            return key, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), found.hexdigest(), features(samples)

        def out(rows):
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["media_key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        for batch in slices(batches):
            rows = []
            for k, places, packed in zip(*(batch.column(c).to_pylist() for c in ("media_key", "places", "packed"))):
                if k != key:
                    if key is not None:
                        rows.append(done())
                    key, parts = k, {}
                for i, p in zip(places, packed):
                    if i not in parts:
                        parts[i] = unpack(p)
            if rows:
                yield out(rows)
        if key is not None:
            yield out([done()])

    return rows.select("media_key", "places", "packed").mapInArrow(run, "media_key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


@dataclass(frozen=True)
class Store:
    """Stored media: lists (doc_id, n_bytes, media_key, digests in order), chunks (each digest
    once, in the row of its home medium) and the dictionary that chunks are packed with."""

    lists: DataFrame
    chunks: DataFrame
    words: bytes

    def save(self, path: str) -> None:
        self.lists.write.parquet(f"{path}/lists")
        self.chunks.write.parquet(f"{path}/chunks")
        self.lists.sparkSession.createDataFrame([(bytearray(self.words),)], "words binary").write.parquet(f"{path}/dictionary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Store:
        lists, chunks_, words = (spark.read.parquet(f"{path}/{n}") for n in ("lists", "chunks", "dictionary"))
        return cls(lists, chunks_, bytes(words.first().words))

    def media(self) -> DataFrame:
        """Every stored medium once: what rebuilt() returns, from these tables alone."""
        whole = F.size("places") == F.col("n_places")
        partial = self.chunks.where(~whole)
        listed = self.lists.select("media_key", "digests").join(small(written(partial.select("media_key").distinct(), "partial")), "media_key", "left_semi").dropDuplicates(["media_key"])
        named = listed.select("media_key", F.posexplode("digests").alias("place", "digest"))
        own = partial.select("media_key", F.explode("places").alias("place"))
        lacking = written(named.join(own, ["media_key", "place"], "left_anti"), "lacking")
        # a digest that very many lack is dealt out by salt
        asked = written(lacking.groupBy("digest").agg(F.ceil(F.count("*") / HOLDERS).cast("int").alias("salts")), "asked")
        held = self.chunks.select(F.explode(F.arrays_zip("digests", "packed")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.packed").alias("packed"))
        held = held.join(small(asked), "digest").dropDuplicates(["digest"]).select("digest", "packed", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        salted = lacking.join(small(asked), "digest").withColumn("salt", F.pmod(F.xxhash64("media_key"), F.col("salts")).cast("int"))
        fetched = salted.join(held, ["digest", "salt"]).select("media_key", F.array("place").alias("places"), F.array("packed").alias("packed"))
        mixed = partial.select("media_key", "places", "packed").union(fetched).repartition("media_key").sortWithinPartitions("media_key")
        return rebuilt(self.chunks.where(whole), self.words).union(rebuilt(mixed, self.words)).dropDuplicates(["media_key"])


def store(docs: DataFrame) -> Store:
    """Stores the texts of docs (doc_id, text). Null texts are empty; equal texts share one
    medium. Texts stay in their task but for media with chunks in common; an empty table
    gives an empty store."""
    docs = docs.select("doc_id", "text")
    listed = written(recipes(docs), "recipes")
    media_ = listed.groupBy("media_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("n_bytes").alias("n_bytes"), F.first("digests").alias("digests"))
    media_ = written(media_, "distinct_media")
    refs = media_.select("media_key", F.posexplode("digests").alias("place", "digest"))
    shared = written(refs.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("media_key", "place")).alias("home")).where("n > 1").select("digest", "home"), "shared")
    guests = refs.join(small(shared), "digest").where((F.col("media_key") != F.col("home.media_key")) | (F.col("place") != F.col("home.place")))
    guests = written(guests.groupBy("media_key").agg(F.sort_array(F.collect_list("place")).alias("elsewhere")), "guests")
    away = media_.select("media_key", "n", "doc_id", "h", F.col("n_bytes").cast("int").alias("size")).join(small(guests), "media_key", "left").where("n > 1 or elsewhere is not null")
    away = written(away.select("h", "size", F.struct("doc_id").alias("doc"), "elsewhere"), "away")
    words = dictionary(docs, listed.count())
    return Store(listed.drop("h"), written(chunks(docs, away, words), "chunks"), words)


def media(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes and what rebuilt() returns, read back from a
    store of docs. Nulls in doc_id pass through, repeated rows are listed each, other columns
    are not read; an empty table gives no rows."""
    stored = store(docs)
    built = written(stored.media(), "media")
    return stored.lists.select("doc_id", "n_bytes", "media_key").join(small(built), "media_key").drop("media_key")
