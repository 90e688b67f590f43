"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import verdict
from ..functions.models import decode
from ..functions.models import integer as whole
from ..functions.models import text as said
from ..operators import audio, cache, contracts, evidence, forms, images, inventory, layout, storage, story, text, timeline, visual  # noqa: F401  (modules register their relations)
from ..sources import derived  # noqa: F401
from .relation import RELATIONS, oracle, query

QUERIES = {n: query(n) for n, r in RELATIONS.items() if r.public}
ORACLE_SQL = {n: oracle(n) for n in QUERIES}


def parse_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and why each is no canonical JSON in the three dialects."""
    texts = query("json_texts")(spark, sf_dir)
    return texts.select("event_id", *(verdict(F.col("document"), d).alias(d) for d in ("contract", "storage", "key")))


def json_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the catalog read by their models, strictly: fields that don't fit, by path."""
    records = query("catalog_record_codec")(spark, sf_dir)
    return records.select("entry", decode(F.col("json"), RECORD, "storage", extra=RECORD_EXTRA).alias("misfits"))


#: Fields that every record of a catalog has, and those of live ones.
RECORD = said("entry_digest", "record_kind") + whole("record_revision", 1, 2**63 - 1) + whole("record_version", 1, 1)
RECORD_EXTRA = ("last_recovery_observation", "last_validated_final")

#: Queries that run Arrow functions, which no oracle has; tests compare them with plain Python.
QUERIES |= {"parse_canonical": parse_canonical, "json_codecs": json_codecs}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["story_document"](spark, sf_dir)
