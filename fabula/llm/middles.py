"""Fill-in-middle transformation by escaped markers.

A delimiter is escaped in the text, appended after each unit by regexp_replace and
counted; substring_index then takes ranked runs of units, which are unescaped and put
together. One projection, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units: lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")
MARK, ESCAPE = "\x01", "\x02"
ADDED = ("n_units", "form", "prefix", "middle", "suffix", "output")


def marked(text: Column, units: str = LINES) -> Column:
    """The escaped text with the delimiter after each unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "m"))
    return F.regexp_replace(escaped, units, "$0" + MARK)


def plain_text(part: Column) -> Column:
    """A run of marked units as it was in the text."""
    bare = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "m"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def draws(key: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of a key's digest, as unsigned numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, units: str = LINES, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs with n_units long, form (plain, psm or spm), prefix, middle, suffix (null if
    plain) and output, which replace columns of these names.

    The cuts, whether a text is transformed (`rate` of 100) and into which form (`spm`
    of 100) follow from the digest of seed and doc_id. A text that holds a marker, and
    an empty one, stays plain. `units` must match every character of an escaped text
    once; the control characters U+0001 and U+0002 in texts are escaped and come back.
    Null texts count as empty, a null doc_id as an empty number; repeated rows get equal
    values; empty tables give no rows; other columns pass through.
    """
    p, s, m = (F.lit(x) for x in markers)
    own = [c for c in docs.columns if c.lower() not in ADDED]
    step = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"),
        F.coalesce("text", F.lit("")).alias("whole"),
        marked(F.coalesce("text", F.lit("")), units).alias("marked"),
        F.array(*draws(F.col("doc_id"), seed)).alias("h"),
    )
    step = step.withColumn("n", (F.octet_length("marked") - F.octet_length(F.replace("marked", F.lit(MARK), F.lit("")))).cast("long"))
    a, b = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    stays = (F.col("whole") == "") | (F.col("h")[2] % 100 >= rate)
    for marker in (p, s, m):
        stays = stays | F.contains("whole", marker)
    step = step.withColumns({
        "low": F.least(a, b).cast("int"),
        "high": F.greatest(a, b).cast("int"),
        "form": F.when(stays, "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm"),
    })
    # with the last unit's delimiter a marked text has n + 1 fields, the last one empty
    ranked = {
        "prefix": "substring_index(marked, char(1), low)",
        "middle": "substring_index(substring_index(marked, char(1), high), char(1), low - high)",
        "suffix": "substring_index(marked, char(1), cast(high - n - 1 as int))",
    }
    step = step.withColumns({name: F.when(F.col("form") != "plain", plain_text(F.expr(e))) for name, e in ranked.items()})
    output = (
        F.when(F.col("form") == "plain", F.col("whole"))
        .when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    )
    return step.select("own.*", F.col("n").alias("n_units"), "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of transform() was made of; each marker is in it once."""
    p, s, m = markers
    middle = F.substring_index(output, m, -1)
    head = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
