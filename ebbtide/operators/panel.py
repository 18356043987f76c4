"""Monthly panel: roll-up, volume filter, rolling mean, lags, leakage drop, splits and cleaning."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.functions.scalars import guarded_ratio, safe_ratio

LEVEL, BRANCH, MONTH = "CUSTOMER_REPORTING_LEVEL", "ID_CUSTOMER_BRANCH", "DATE_MONTH"
ENTITY = (LEVEL, BRANCH)


def monthly_panel(
    activity: DataFrame,
    sums: Sequence[str],
    means: Mapping[str, str],
    ratios: Mapping[str, tuple[str, str]],
    peaks: Sequence[str] = (),
    payment: str | None = None,
    day: str = "DATE",
    keys: Sequence[str] = ENTITY,
) -> DataFrame:
    """Roll daily activity up to entity and month: sums, means, ratios of sums, maxima, payment flags."""
    columns = [F.sum(name).alias(name) for name in sums]
    columns += [F.avg(source).alias(name) for name, source in means.items()]
    columns += [safe_ratio(F.sum(a), F.sum(b)).alias(name) for name, (a, b) in ratios.items()]
    columns += [F.max(name).alias(name) for name in peaks]
    if payment:
        held = F.max(F.coalesce(F.col(payment), F.lit("")))
        columns.append(held.isin("C", "C & P").alias("PAYMENT_CREDIT"))
        columns.append(held.isin("P", "C & P").alias("PAYMENT_PREPAYMENT"))
    panel = activity.groupBy(*keys, F.trunc(day, "month").alias(MONTH)).agg(*columns)
    return panel.withColumns({"MONTH_NUMBER": F.month(MONTH), "IS_CHURNED": F.col("RN") == 0})


def volume_filter(activity: DataFrame, minimum: Mapping[str, float], measure: str = "RN") -> DataFrame:
    """Keep rows whose level and branch both reach their minimum total (each counted over what the ones before kept).

    The rows are summed once to all the keys; the filters work on these totals, and meet the rows in one semi join.
    """
    keys = list(minimum)
    totals = activity.groupBy(*keys).agg(F.sum(measure).alias("_total"))
    for key, least in minimum.items():
        large = totals.groupBy(key).agg(F.sum("_total").alias("_sum")).where(F.col("_sum") >= least)
        totals = totals.join(large.select(key), key, "left_semi")
    return activity.join(totals.select(*keys), keys, "left_semi")


def add_rolling_mean(
    panel: DataFrame, value: str = "RN", months: int = 12, name: str = "AVG_MONTHLY_RN_12M",
    keys: Sequence[str] = ENTITY, order: Sequence[str] = (MONTH,),
) -> DataFrame:
    """Mean of the preceding months, without the current one."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-months, -1)
    return panel.withColumn(name, F.avg(value).over(frame))


def add_lags(
    panel: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 2, 3),
    keys: Sequence[str] = ENTITY, order: Sequence[str] = (MONTH,),
) -> DataFrame:
    """``<column>_LAG_<k>`` for every column and lag, over one ordering.

    Lags stay inside an entity; pass ``keys=[level]`` and ``order=[branch, month]`` to let them run on
    from branch to branch of a level.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    added = [F.lag(c, k).over(window).alias(f"{c}_LAG_{k}") for c in columns for k in lags]
    return panel.select("*", *added)


def drop_leakage(panel: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("IS_CHURNED",)) -> DataFrame:
    """Drop values of the predicted month itself."""
    return panel.drop(*[c for c in columns if c not in keep])


def split_by_date(panel: DataFrame, start: dt.date, cut: dt.date, column: str = MONTH) -> DataFrame:
    """Rows from ``start`` on, marked ``train`` before ``cut`` and ``test`` after."""
    side = F.when(F.col(column) < F.lit(cut), "train").otherwise("test")
    return panel.where(F.col(column) >= F.lit(start)).withColumn("SPLIT", side)


def complete_cases(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in the given columns."""
    return panel.na.drop(subset=list(columns) if columns else None)


def add_ratios(frame: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """``P_<numerator>``: numerator over its denominator, which counts as at least 1."""
    ratios = [guarded_ratio(F.col(a), F.col(b)).alias(f"P_{a}") for a, b in pairs.items()]
    return frame.select("*", *ratios)


def newly_churned(panel: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Months in which an entity is inactive and was not in the month before."""
    before = F.lag("IS_CHURNED").over(Window.partitionBy(*keys).orderBy(MONTH))
    marked = panel.withColumn("IS_CHURNED_PRIOR", before)
    return marked.where(F.col("IS_CHURNED") & (F.col("IS_CHURNED_PRIOR") == F.lit(False)))


def retail_population(frame: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is true; an unknown flag counts as true."""
    return frame.where(F.coalesce(F.col(flag), F.lit(True)))
