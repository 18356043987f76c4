"""Publishing of predictions: one wide row per key with four scores, flags, features and a rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.prefix import rank_by
from ebbtide.operators.slots import KEY, SCENARIO
from ebbtide.plans.spec import unique

MARGIN = "FF_ONE_OM_SUM_L13S"


def publish_wide(
    today: DataFrame, scores: Mapping[int, DataFrame], features: Sequence[str] = (), cp: int = 4
) -> DataFrame:
    """Join one score frame (``PK``, ``SCENARIO_DATE``, ``PROBA``) per horizon and rank keys by margin."""
    wide = today
    for ph, scored in scores.items():
        proba = scored.select(KEY, SCENARIO, F.col("PROBA").alias(f"PROBA_{ph}S"))
        wide = wide.join(proba, [KEY, SCENARIO])
    return publish_scored(wide, list(scores), features, cp)


def publish_scored(wide: DataFrame, horizons: Sequence[int], features: Sequence[str] = (), cp: int = 4) -> DataFrame:
    """The published columns of a frame that already holds ``PROBA_<ph>S``, with the rank by margin."""
    kept = unique([KEY, SCENARIO, MARGIN, *features])
    selected = wide.select(
        *kept,
        *[F.col(f"CHURN_PH_{ph}_CP_{cp}S").alias(f"CHURN_{ph}S") for ph in horizons],
        *[f"PROBA_{ph}S" for ph in horizons],
    )
    return rank_by(selected, MARGIN, "RANK", method="max")


def upload_sample(scored: DataFrame, n: int = 10000) -> DataFrame:
    """The upload list: the first rows by key, with the scenario date as text."""
    return (
        scored.select(KEY, F.col(SCENARIO).cast("string").alias(SCENARIO), "CHURN", "PROBA")
        .orderBy(KEY, SCENARIO)
        .limit(n)
    )
