"""Documents to training ids: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import decontamination, jaccard, pieces, secrets, toxicity
from fabula.llm.common import read, written
from fabula.llm.queries import piece_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learnt from labels outside the held-out
    quarter. Null and empty texts score the leak and stay; repeated rows score alike; all
    columns stay as they are."""
    model = toxicity.fit(toxicity.training_rows(docs, read(spark, sf_dir, "labels")))
    score, spans = "_toxicity_score", "_toxicity_spans"
    return toxicity.score(docs, model, score, spans).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by a Jaccard similarity of
    0.8 over five words. Texts without words stay; repeated rows of a document become one."""
    return jaccard.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item.
    Null and short texts, and rows without a doc_id, are judged by their text alone;
    benchmark items under five words, and an empty benchmark, drop nothing."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in `text` replaced (n_chars follows). Null texts stay null; other
    columns pass through."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, `text` replaced by its ids, their number and digests, and whether decoding
    gave the text back. Null and empty texts have no ids."""
    return pieces.tokenize(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode),
]

#: Fitting, links and merging can't be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
