"""Texts as flat arrays of symbols: a small alphabet of frequent bytes and one symbol for all others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of text that a Python worker handles at a time.
CHUNK = 1_500_000


def chunks(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Parts of the batches with their texts as UTF-8, A-Z lowered (NULL as empty), of bounded size but for one long text."""
    for batch in batches:
        if not len(batch):
            continue
        texts = [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in batch[column]]
        bins = np.cumsum([len(t) for t in texts]) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.iloc[low:high], texts[low:high]


def byte_counts(frame: DataFrame) -> np.ndarray:
    """How often each byte occurs in the column ``text``, A-Z lowered (256 sums)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for _, texts in chunks(batches):
            total += np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
        yield pd.DataFrame({"byte": np.arange(256), "n": total})

    from pyspark.sql import functions as F

    counted = frame.select("text").mapInPandas(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    out = np.zeros(256, np.int64)
    for r in counted.collect():
        out[r["byte"]] = r["n"]
    return out


def alphabet(counts: np.ndarray, size: int) -> np.ndarray:
    """Symbol of each byte: the ``size - 1`` most frequent ones have their own (from 1), all others share 0."""
    order = np.lexsort((np.arange(256), -counts))[: size - 1]
    symbols = np.zeros(256, np.int64)
    symbols[order] = np.arange(1, len(order) + 1)
    return symbols


def tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several (keys, counts)."""
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
