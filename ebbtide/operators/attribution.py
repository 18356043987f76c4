"""Why a boosted model scores a row as it does: path-dependent Shapley values of its trees.

The trees are read from the model as Spark saves it.  A leaf is a product of conditions on the features along its
path; a feature that is left out lets a row through with the share of training rows that went that way.  The
Shapley value of such a product is a sum over the features of one path alone, so a row costs a fixed number of
steps per leaf, whatever the number of features, and rows are explained where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.model import FEATURES, ROW_ORDER, feature_stages
from ebbtide.session import scratch_path, ship_package

#: Rows that a report explains.
EXPLAINED = 1000


class Step(NamedTuple):
    """All conditions of a path on one feature, and the share of training rows that meet them on their way down."""

    position: int
    share: float
    tests: list[tuple[bool, bool, tuple[float, ...]]]  # to the left?, by category?, threshold or categories


class Leaf(NamedTuple):
    value: float
    steps: list[Step]


def saved_nodes(spark: SparkSession, trees) -> pd.DataFrame:
    """Nodes of all trees of a fitted tree model (their number is bounded by its settings)."""
    path = scratch_path(spark, "trees")
    trees.write().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()


def leaves_of(nodes: pd.DataFrame, weights: Sequence[float]) -> list[Leaf]:
    """Every leaf with its weighted value and the features on its path."""
    out: list[Leaf] = []
    for tree, rows in nodes.groupby("treeID"):
        at = {r.id: r for r in rows.itertuples()}
        waiting = [(at[0], {})]
        while waiting:
            node, path = waiting.pop()
            if node.leftChild < 0:
                steps = [Step(p, share, tests) for p, (share, tests) in path.items()]
                out.append(Leaf(float(weights[tree] * node.prediction), steps))
                continue
            split = node.split
            for left, child in ((True, at[node.leftChild]), (False, at[node.rightChild])):
                share, tests = path.get(split["featureIndex"], (1.0, []))
                test = (left, split["numCategories"] >= 0, tuple(split["leftCategoriesOrThreshold"]))
                waiting.append((child, path | {split["featureIndex"]: (share * child.rawCount / node.rawCount, [*tests, test])}))
    return out


def _meets(values: np.ndarray, tests: list[tuple[bool, bool, tuple[float, ...]]]) -> np.ndarray:
    met = np.ones(len(values), bool)
    for left, by_category, cut in tests:
        goes_left = np.isin(values, cut) if by_category else values <= cut[0]
        met &= goes_left == left
    return met.astype(float)


def attributions(rows: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Shapley value of every position of ``rows`` (rows x positions)."""
    out = np.zeros(rows.shape)
    for leaf in leaves:
        met = [_meets(rows[:, s.position], s.tests) for s in leaf.steps]
        n = len(leaf.steps)
        for i, step in enumerate(leaf.steps):
            # Coefficient k: the value of this leaf over all sets of k other features of the path.
            sets = np.zeros((n, len(rows)))
            sets[0] = leaf.value
            for k, other in enumerate(leaf.steps):
                if k != i:
                    sets[1:] = sets[1:] * other.share + sets[:-1] * met[k]
                    sets[0] *= other.share
            weighted = sum(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * sets[k] for k in range(n))
            out[:, step.position] += weighted * (met[i] - step.share)
    return out


def tree_attribution(
    model: PipelineModel, frame: DataFrame, features: Sequence[str], first: int | None = EXPLAINED
) -> DataFrame:
    """One row per row of ``frame`` and feature: ``FEATURE``, ``ATTRIBUTION``, with ``BASE`` and ``MARGIN`` of the row.

    ``BASE`` and a row's attributions add up to its margin (half the log odds of a boosted classifier).  A number's
    value and its missing marker are added up.  ``first`` rows by scenario and key are explained, all if None.
    """
    spark = frame.sparkSession
    ship_package(spark)
    trees = model.stages[-1]
    leaves = leaves_of(saved_nodes(spark, trees), trees.treeWeights)
    base = sum(leaf.value * math.prod(s.share for s in leaf.steps) for leaf in leaves)
    _, names = feature_stages(frame, features)
    member = np.array([[float(name == c) for c in features] for name in names])
    chosen = frame.orderBy(*ROW_ORDER).limit(first) if first is not None else frame
    prepared = model.transform(chosen).select(
        *ROW_ORDER, F.col("rawPrediction"), vector_to_array(FEATURES).alias("_positions")
    )
    rows = prepared.select(*ROW_ORDER, vector_to_array("rawPrediction")[1].alias("MARGIN"), "_positions")

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = attributions(np.stack(batch["_positions"].to_numpy()).astype(float), leaves) @ member
                yield batch.drop(columns="_positions").assign(_found=list(found))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_positions").schema)
    found = rows.mapInPandas(explain, f"{kinds}, _found array<double>")
    cells = [F.struct(F.lit(c).alias("FEATURE"), F.col("_found")[k].alias("ATTRIBUTION")) for k, c in enumerate(features)]
    return found.select(*ROW_ORDER, F.lit(base).alias("BASE"), "MARGIN", F.inline(F.array(*cells)))
