"""The registered queries of this subpackage: thin uses of its operators.

Each takes (spark, sf_dir), runs over its whole table and returns the full result.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, importance, jaccard, licenses, lines, media, middles, passages, pieces, secrets, sharding, toxicity
from .common import read, written

#: Folder of the public tokenizer files; they are never copied here.
TOKENIZERS = os.environ.get("FABULA_TOKENIZERS", "/opt/tokenizers")


@lru_cache(maxsize=2)
def piece_model(path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def byte_bpe(path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, read(spark, sf_dir, "labels")).select("doc_id", "log_weight", "gumbel_key")


def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


def op4_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(read(spark, sf_dir, "documents"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = written(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source")), "candidates").alias("d")
    found = written(secrets.report(scanned), "secrets").alias("s")
    joined = scanned.join(secrets.small(found), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.content") == F.col("s.content")), "left")
    spans = F.coalesce("secrets", F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,digest:string,n_owners:bigint,n_repositories:bigint,live:boolean>>)"))

    def count(kind):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")

    def joined_text(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    return joined.select(
        "d.doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined_text(F.filter(spans, lambda s: s.kind != "generic")).cast("binary"), 256).alias("base_sha256"),
        joined_text(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s.live)).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s.live)).cast("long").alias("n_widely_copied"),
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_toxicity_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, read(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",").alias("offending"),
    )


def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.inline("licenses"))


def op10_streaming_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.tokenize(docs, piece_model())


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middles.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(middles.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe(), piece_model())
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    found = alignment.scored(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")


QUERIES = {f.__name__: f for f in (op1_histogram_shards, op2_importance_resampling, op3_benchmark_containment, op4_chained_passages, op5_secret_ownership, op6_ngram_jaccard, op7_media_chunks, op8_toxicity_instances, op9_license_dice, op10_streaming_pieces, op11_line_dedup, op12_fill_in_middle, op13_token_alignment)}

#: What SQL can express: the exact containment that MinHash candidates are verified by.
ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_containment": r"""
    with grams as (
      select 'd' as side, doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents
      union all select 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') from benchmark),
    shingles as (select distinct side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as s from grams where len(w) >= 5),
    sizes as (select id, count(*) as n from shingles where side = 'i' group by id)
    select d.id as doc_id, i.id as item_id, cast(count(*) as int) as n_shared, cast(min(n) as int) as n_item, round(count(*) / min(n), 6) as containment
    from shingles i join shingles d on d.s = i.s and d.side = 'd' join sizes z on z.id = i.id where i.side = 'i'
    group by d.id, i.id having count(*) >= 0.8 * min(n)""",
    "op11_line_dedup": r"""
    with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from split),
    keys as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
    often as (select key, min(doc_id) as first from keys where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
    told as (select k.*, o.key is not null and k.doc_id <> o.first as dropped from keys k left join often o on o.key = k.key)
    select doc_id, count(*) as n_lines, cast(sum(dropped::int) as bigint) as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256
    from told group by doc_id""",
    "op12_fill_in_middle": r"""
    with texts as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as d from documents),
    units as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u,
      ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from texts),
    cuts as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from units),
    parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cuts)
    select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
      sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
      sha256(p || m || s) as restored_sha256
    from parts""",
}
