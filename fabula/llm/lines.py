"""Line dedup: lines that several documents hold stay in the first of them only.

Normalised lines are exploded with their places and hashed (96 bits), distinct
documents are counted per hash, and what is over the threshold comes back to each
document as the places of its lines to drop, from which the text is put together again
in order. Built-in expressions throughout; texts are shuffled once at most, hashes
otherwise.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

BLANKS = " \t\n\x0b\x0c\r"
ADDED = ("n_lines", "n_dropped", "kept")


def lines_of(text: Column) -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normalised(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case; other letters stay."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def occurrences(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(id, body, place, h1, h2) of every line whose key has `min_chars` code points or
    more. `body` tells rows of one id apart by their text."""
    exploded = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("body"), F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    keys = exploded.select("id", "body", "place", normalised(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("id", "body", "place", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def repeated(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """(h1, h2, first, n_docs) of every key in at least `min_docs` documents; `first` is
    the smallest id. Rows without an id are one document, after all others."""
    once = lines.select("h1", "h2", "id").distinct()
    counted = once.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_docs"))
    return counted.where(F.col("n_docs") >= min_docs)


def without(lines: Column, places: Column) -> Column:
    """The lines joined again, but for those at the given places (in order, from 0). The
    slices between them are put together, so the work is linear in the lines. Both
    arrays are bound once: inside a lambda an expression would run for each slice."""

    def kept(bound):
        def between(i):
            start = F.coalesce(F.get(bound["places"], i - 1) + 1, F.lit(0))
            end = F.coalesce(F.get(bound["places"], i), F.size(bound["lines"]))
            return F.slice(bound["lines"], start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(bound["places"])), between)), "\n")

    return F.transform(F.array(F.struct(lines.alias("lines"), places.alias("places"))), kept)[0]


def dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """docs with n_lines, n_dropped (long) and kept (string), which replace columns of
    these names. Keys of `min_chars` code points or more that are in `min_docs` documents
    or more lose all their lines but those of the smallest doc_id.

    Null and empty texts have one empty line, which stays, and give an empty `kept`.
    Repeated rows count as one document and get equal values; rows of one doc_id with
    different texts are one document; so are all rows without a doc_id, after the
    others. Empty tables give no rows; other columns pass through. A hot line is one row
    of `repeated`; its occurrences are split by AQE where the join is shuffled.
    """
    lines = written(occurrences(docs, min_chars), "lines")
    often = small(written(repeated(lines, min_docs), "repeated"))
    elsewhere = lines.join(often, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    dropped = elsewhere.groupBy("id", "body").agg(F.array_sort(F.collect_set("place")).alias("places"))
    dropped = small(written(dropped.select(F.col("id").alias("id"), "body", "places"), "dropped"))
    own = [c for c in docs.columns if c.lower() not in ADDED]
    of, drop = docs.alias("of"), dropped.alias("drop")
    met = of.join(drop, F.col("of.doc_id").eqNullSafe(F.col("drop.id")) & (F.xxhash64("of.text") == F.col("drop.body")), "left")
    n_dropped, text = F.coalesce(F.size("drop.places"), F.lit(0)), F.coalesce("of.text", F.lit(""))
    return met.select(
        *(F.col(f"of.`{c}`") for c in own),
        F.size(lines_of(F.col("of.text"))).cast("long").alias("n_lines"),
        F.when(F.col("drop.places").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped"),
        F.when(F.col("drop.places").isNull(), text).otherwise(without(lines_of(F.col("of.text")), F.col("drop.places"))).alias("kept"),
    )
