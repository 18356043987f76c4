"""Fixtures and plain readings of the text rules."""

import os
import re

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def table(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet'").fetchall()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


AWKWARD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \t\n\r\x0b\x0c ", "en", None),
    (4, "one", "en", "b"),
    (5, "one two", "en", "b"),
    (6, "x " * 3000 + "long" * 5000, "en", "a"),
    (7, "ÄÖ ß \U0001f600 ñandú é\x00z   　", "de", "a"),
    (8, "same same same\nsame same same\n\nsame same same", "en", "a"),
    (8, "same same same\nsame same same\n\nsame same same", "en", "a"),
    (None, "no id here", "en", "a"),
]


def awkward(spark, rows=AWKWARD):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with added ones."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns(
        {"n_chars": F.length("text").cast("long"), "SHARD": F.lit("s"), "kept": F.lit("k"), "row": F.lit(1), "key": F.lit(2)}
    )
