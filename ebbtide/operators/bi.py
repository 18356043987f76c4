"""Calculations behind the dashboard: joins at matching grain, ranks, bins, flags and trend lines."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.scalars import rebin, single_value
from ebbtide.operators.prefix import rank_by

LEVEL, NAME, DAY = "CUSTOMER_REPORTING_LEVEL", "CUSTOMER_RL_NAME", "DATE"

# Commercial areas and the bins they are shown in.
AREA_BINS = {
    "Core": ("APAC Core", "Americas Core", "Med & MEAI Core", "North Europe Core"),
    "LT": ("APAC LT", "Americas LT", "Iberia, UK & Dach LT", "MEAI & ROE LT"),
}
FLAGS = ("CDF_RN_12W_NBINOM_FLAG", "CDF_RN_WEEKDAY12W_NBINOM_FLAG", "AVG_COUNTRY_DAY_PROB_FLAG")


def member_filter(frame: DataFrame, column: str, include: Iterable = (), exclude: Iterable = ()) -> DataFrame:
    """Explicit member lists; a NULL member survives an exclusion and never matches an inclusion."""
    include, exclude = list(include), list(exclude)
    if include:
        frame = frame.where(F.col(column).isin(*include))
    if exclude:
        frame = frame.where(~F.coalesce(F.col(column).isin(*exclude), F.lit(False)))
    return frame


def profile_daily(profile: DataFrame, daily: DataFrame) -> DataFrame:
    """Profile measures beside daily totals: each side is at customer grain before they meet."""
    totals = daily.groupBy(LEVEL).agg(
        F.sum("RN").alias("DAILY_RN"), F.count(F.lit(1)).alias("N_DAYS"), F.max("RN").alias("PEAK_RN")
    )
    return profile.join(totals, LEVEL)


def daily_measures(daily: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """Sums per level, name and date; ``measures`` maps output names to source columns."""
    return daily.groupBy(LEVEL, NAME, DAY).agg(*[F.sum(src).alias(name) for name, src in measures.items()])


def measures_long(frame: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Measure names as rows, so several measures share one axis."""
    return frame.select(LEVEL, NAME, DAY, *[F.col(m).cast("double") for m in measures]).unpivot(
        [LEVEL, NAME, DAY], list(measures), "MEASURE", "VALUE"
    )


def attribute(frame: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The single value of each column in a group, or ``*``."""
    return frame.groupBy(*by).agg(*[single_value(F.col(c).cast("string")).alias(c) for c in columns])


def customer_rank(daily: DataFrame) -> DataFrame:
    """Customers by total volume, largest first; the rank is shown as text."""
    totals = daily.groupBy(LEVEL).agg(F.sum("RN").alias("SUM_RN"))
    ranked = rank_by(totals, "SUM_RN", "RN_RANK", method="min")
    return ranked.withColumn("RN_RANK", F.col("RN_RANK").cast("string"))


def area_bins(profile: DataFrame, column: str) -> DataFrame:
    """Commercial area as Core, LT or Others, and the large-LT marker."""
    binned = profile.withColumn("AREA_GROUP", rebin(F.col(column), AREA_BINS, "Others"))
    return binned.withColumn("LT_ACTIVE", (F.col("AREA_GROUP") == "LT") & (F.col("AVG_RN") >= 2))


def flag_combinations(frame: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """Row count of every combination of the flags that occurs."""
    return frame.groupBy(*flags).agg(F.count(F.lit(1)).alias("N_ROWS"))


def power_trend(profile: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares fit of ``y = a * x^b`` on the points where both are positive."""
    points = profile.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log(x).alias("lx"), F.log(y).alias("ly"))
    return points.agg(
        F.exp(F.regr_intercept("ly", "lx")).alias("A"),
        F.regr_slope("ly", "lx").alias("B"),
        F.count(F.lit(1)).alias("N_POINTS"),
    )


def reference_average(frame: DataFrame, measure: str) -> DataFrame:
    """Average line of a plotted measure."""
    return frame.agg(F.avg(measure).alias("REFERENCE"))
