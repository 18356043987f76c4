"""ROC, AUC, confusion cells and the metrics read from them.

Curves are built from counts per distinct score, so tied scores collapse before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.prefix import running_totals

PLOT_THRESHOLDS = (0.25, 0.5, 0.7)


def score_counts(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at each distinct score, with running counts from the highest score down."""
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(*by, F.col(score).alias("THRESHOLD")).agg(
        F.count_if(F.col(label)).alias("_pos"), F.count_if(~F.col(label)).alias("_neg")
    )
    measures = {"TP": F.col("_pos"), "FP": F.col("_neg"), "_nth": F.lit(1)}
    totals = {"_all_pos": "TP", "_all_neg": "FP", "_last": "_nth"}
    return running_totals(counts, [F.col("THRESHOLD").desc()], measures, by, totals)


def roc_curve(scored: DataFrame, score: str = "PROBA", label: str = "TARGET", thin: bool = True) -> DataFrame:
    """False and true positive rates per threshold, plus the origin (NULL threshold).

    ``thin`` leaves out points that continue the line through their neighbours.
    """
    counts = score_counts(scored, score, label)
    points = counts
    if thin:
        following = counts.select(
            (F.col("_nth") - 1).alias("_nth"), F.col("_pos").alias("_pos2"), F.col("_neg").alias("_neg2")
        )
        bends = (F.col("_pos") != F.col("_pos2")) | (F.col("_neg") != F.col("_neg2"))
        points = counts.join(following, "_nth", "left").where((F.col("_nth") == F.col("_last")) | bends)
    curve = points.select(
        "THRESHOLD",
        (F.col("FP") / F.nullif("_all_neg", F.lit(0))).alias("FPR"),
        (F.col("TP") / F.nullif("_all_pos", F.lit(0))).alias("TPR"),
    )
    origin = scored.sparkSession.sql("SELECT CAST(NULL AS DOUBLE) THRESHOLD, 0.0D FPR, 0.0D TPR")
    return curve.unionByName(origin)


def roc_auc(scored: DataFrame, score: str = "PROBA", label: str = "TARGET", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (trapezoids, so ties count half), one row per group."""
    counts = score_counts(scored, score, label, by)
    wins = F.sum(F.col("_neg") * (F.col("TP") - F.col("_pos") / 2))
    pairs = F.sum("_pos") * F.sum("_neg")
    return counts.groupBy(*by).agg((wins / F.nullif(pairs, F.lit(0))).alias("ROC_AUC"))


def roc_points(curve: DataFrame, thresholds: Sequence[float] = PLOT_THRESHOLDS) -> DataFrame:
    """Curve point whose threshold is nearest to each requested one (the higher of two equally near)."""
    known = curve.where(F.col("THRESHOLD").isNotNull())
    asked = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("REQUESTED")
    nearness = F.struct(F.abs(F.col("THRESHOLD") - F.col("REQUESTED")), -F.col("THRESHOLD"))
    best = known.select("*", asked).groupBy("REQUESTED").agg(
        F.min_by(F.struct("THRESHOLD", "FPR", "TPR"), nearness).alias("_p")
    )
    return best.select("REQUESTED", "_p.*")


def confusion_matrix(
    scored: DataFrame, score: str = "PROBA", label: str = "TARGET", threshold: float = 0.5
) -> DataFrame:
    """The four cells at a threshold, in one row."""
    called = F.col(score) >= threshold
    actual = F.col(label)
    return scored.agg(
        F.count_if(~actual & ~called).alias("TN"),
        F.count_if(~actual & called).alias("FP"),
        F.count_if(actual & ~called).alias("FN"),
        F.count_if(actual & called).alias("TP"),
    )


def classification_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy overall, among rows called positive and among rows called negative."""

    def share(right: list[str], of: list[str]):
        return sum((F.col(c) for c in right), F.lit(0)) / F.nullif(sum((F.col(c) for c in of), F.lit(0)), F.lit(0))

    return cells.select(
        share(["TN", "TP"], ["TN", "TP", "FN", "FP"]).alias("ACCURACY"),
        share(["TP"], ["TP", "FP"]).alias("POSITIVE_ACCURACY"),
        share(["TN"], ["TN", "FN"]).alias("NEGATIVE_ACCURACY"),
    )


def high_risk_hits(scored: DataFrame, score: str = "PROBA", label: str = "TARGET", least: float = 0.75) -> DataFrame:
    """Churned rows that had been given a high score."""
    return scored.where((F.col(score) >= least) & F.col(label))
