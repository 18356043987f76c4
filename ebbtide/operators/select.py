"""Correlation screening."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation_matrix(frame: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations over pairwise complete rows.

    One pass finds means and deviations; one more builds the Gram matrix of the standardised values,
    their squares and the present-value markers, from which every pair's own moments follow.  What
    reaches the driver is bounded by the number of columns, not rows.
    """
    size = len(columns)
    values = frame.selectExpr(*[f"double(`{c}`) AS c{i}" for i, c in enumerate(columns)]).persist()
    moments = values.agg(
        *[F.expr(f"avg(c{i})").alias(f"m{i}") for i in range(size)],
        *[F.expr(f"stddev_pop(c{i})").alias(f"s{i}") for i in range(size)],
    ).first()
    scaled = []
    for i in range(size):
        z = f"coalesce((c{i} - {moments[f'm{i}'] or 0.0!r}D) / {moments[f's{i}'] or 1.0!r}D, 0D)"
        scaled += [f"{z} AS z{i}", f"{z} * {z} AS q{i}", f"double(c{i} IS NOT NULL) AS k{i}"]
    inputs = [f"{part}{i}" for part in "zqk" for i in range(size)]
    vectors = VectorAssembler(inputCols=inputs, outputCol="v").transform(values.selectExpr(*scaled)).select("v")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    values.unpersist()
    z, q, k = slice(0, size), slice(size, 2 * size), slice(2 * size, 3 * size)
    n, products, sums, squares = gram[k, k], gram[z, z], gram[z, k], gram[q, k]
    spread = n * squares - sums**2
    with np.errstate(divide="ignore", invalid="ignore"):
        return (n * products - sums * sums.T) / np.sqrt(spread * spread.T)


def correlated_pairs(
    frame: DataFrame, columns: Sequence[str], cutoff: float = 0.8, first_of_equal: bool = False
) -> DataFrame:
    """Pairs whose Pearson correlation exceeds the cutoff, highest first, identical columns left out.

    A correlation of 1 is recognised to twelve decimals, since summation order moves the last digits.
    ``first_of_equal`` also keeps only the first pair among pairs with the very same correlation.
    """
    matrix = correlation_matrix(frame, columns)
    found, seen = [], set()
    for i, first in enumerate(columns):
        for j in range(i + 1, len(columns)):
            value = float(matrix[i, j])
            if value > cutoff and round(value, 12) != 1 and not (first_of_equal and round(value, 12) in seen):
                seen.add(round(value, 12))
                found.append((first, columns[j], value))
    found.sort(key=lambda row: -row[2])
    return frame.sparkSession.createDataFrame(found, "VARIABLE_1 string, VARIABLE_2 string, CORRELATION double")


def drop_correlated(ranked: Sequence[str], pairs: DataFrame, n: int = 15, forced: Sequence[str] = ()) -> list[str]:
    """Best ``n`` names that are nobody's correlated second, then the forced ones, each once."""
    dropped = {row[0] for row in pairs.select("VARIABLE_2").distinct().collect()}  # at most len(ranked) names
    return list(dict.fromkeys([name for name in ranked if name not in dropped][:n] + list(forced)))
