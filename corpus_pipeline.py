"""Documents made ready for training: quality, near copies, benchmark passages, personal data, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import documents
from ebbtide.llm.decontaminate import decontaminate
from ebbtide.llm.jaccard import one_of_each_group
from ebbtide.llm.jobs import PIECES
from ebbtide.llm.personal import mask_personal
from ebbtide.llm.pieces import encode_decode
from ebbtide.llm.quality import quality_rules
from ebbtide.session import scratch_path
from ebbtide.sources.tables import read_table

#: Near copies: runs of five words, four in five shared.
WORDS, PERCENT = 5, 80


def _recounted(changed: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines, and without the documents that the rules reject."""
    return _recounted(quality_rules(docs).where("kept"), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return one_of_each_group(docs, width=WORDS, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked."""
    return _recounted(mask_personal(docs), docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and digests of the ids and of what they decode to."""
    return encode_decode(
        docs.select("doc_id", "text"), PIECES, fields=("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    ).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", encoding),
]

#: Groups of linked documents and the piece codec cannot be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written down and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
STATEMENTS: dict[str, str] = {}
