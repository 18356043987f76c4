"""Registered queries of the corpus operators and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import documents
from ebbtide.llm.decontaminate import contaminated_windows
from ebbtide.llm.jaccard import document_components
from ebbtide.llm.langid import learn_languages, predict_languages
from ebbtide.llm.manifest import dataset_manifest
from ebbtide.llm.mixing import label_weights, mix_sources
from ebbtide.llm.personal import find_personal, joined_spans
from ebbtide.llm.pieces import encode_decode
from ebbtide.llm.quality import quality_rules
from ebbtide.llm.search import search
from ebbtide.llm.secrets import scan_secrets
from ebbtide.llm.shards import shuffle_into_shards
from ebbtide.llm.statements import STATEMENTS as STATEMENTS
from ebbtide.llm.suffix_tree import score_texts
from ebbtide.llm.warc import archive_and_read_back
from ebbtide.sources.tables import read_table

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Vocabulary of the piece codec.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(folds: int) -> Column:
    """Documents whose id, hashed as text, leaves 1; those without an id are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 1, F.lit(False))


def job(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    JOBS[function.__name__] = function
    return function


@job
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder, "doc_id", "text", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_removed_words",
    )


@job
def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder, "doc_id", "text")
    return encode_decode(rows, PIECES, fields=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


@job
def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return document_components(documents(spark, folder, "doc_id", "text")).drop("group", "body")


@job
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated_windows(documents(spark, folder, "doc_id", "text"), read_table(spark, folder, "benchmark"))


@job
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(documents(spark, folder, "doc_id", "text", "source")).where("is_secret")


@job
def op6_shard(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    rows = documents(spark, folder, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return shuffle_into_shards(rows, 40)


@job
def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal(documents(spark, folder, "doc_id", "text")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(joined_spans(F.col("base_spans")), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
        "n_id",
    )


@job
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_and_read_back(read_table(spark, folder, "pages", ["page_id", "url", "html"]))


@job
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder, "doc_id", "text", "lang")
    trees = learn_languages(rows.where(~held_out(3)))
    return predict_languages(rows.select("doc_id", held_out(3).alias("held_out"), "text"), trees).drop("text")


@job
def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder, "doc_id", "text")
    return score_texts(rows, "coalesce(crc32(cast(doc_id AS string)) % 5 != 1, true)").withColumn("held_out", held_out(5))


@job
def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(documents(spark, folder, "doc_id", "text"), read_table(spark, folder, "benchmark", ["item_id", "text"]))


@job
def op12_mix(spark: SparkSession, folder: str) -> DataFrame:
    weights = label_weights(read_table(spark, folder, "labels", ["doc_id", "quality", "toxic"]))
    return mix_sources(documents(spark, folder, "doc_id", "text", "source"), quality=weights)


@job
def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    struck = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return dataset_manifest(
        documents(spark, folder, "doc_id", "source", "lang", "n_chars", "text"),
        ["doc_id", "source", "lang", "n_chars", "text"],
        altered={"n_chars": F.when(struck, F.col("n_chars") + 1).otherwise(F.col("n_chars"))},
    )
