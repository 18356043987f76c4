"""Detection of abnormal drops in daily trading.

Every window is partitioned by one customer (bounded by the number of days).  Country-wide statistics are
group aggregates joined back, never windows over all customers of a country.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window, WindowSpec

from ebbtide.functions.distributions import nbinom_cdf, nbinom_pmf
from ebbtide.functions.scalars import is_true
from ebbtide.operators.prefix import exact_quantiles

LEVEL, COUNTRY, DAY = "CUSTOMER_REPORTING_LEVEL", "CUSTOMER_RL_COUNTRY_NAME", "DATE"
SEGMENT = (COUNTRY, "CUSTOMER_RL_BL_RETAIL", "CUSTOMER_RL_WHOLESALE", DAY)
RARE = 0.01
LEAST_VOLUME = 5
#: A sketched quantile is off in rank by one in so many rows of its group at most.
SKETCH_ACCURACY = 200


def _customer() -> WindowSpec:
    return Window.partitionBy(LEVEL)


def _days() -> WindowSpec:
    return _customer().orderBy(DAY)


def gate_active(
    daily: DataFrame, period: tuple[dt.date, dt.date], gate: tuple[dt.date, dt.date], least: float | None = None
) -> DataFrame:
    """Days in the period of customers that traded in the gate interval (more than ``least``, if given)."""
    inside = F.col(DAY).between(F.lit(gate[0]), F.lit(gate[1]))
    volume = F.sum(F.when(inside, F.col("RN")).otherwise(0)).over(_customer())
    rows = daily.where(F.col(DAY).between(F.lit(period[0]), F.lit(period[1]))).withColumn("RN_GATE", volume)
    rows = rows.where(F.col("RN_GATE") != 0)
    return rows if least is None else rows.where(F.col("RN_GATE") > least)


def zero_trading_runs(daily: DataFrame) -> DataFrame:
    """Length of the current run of days without trade; 0 on trading days and before the first trade."""
    traded = F.col("RN") > 0
    numbered = daily.select("*", F.row_number().over(_days()).alias("_day"), F.sum("RN").over(_days()).alias("_so_far"))
    last_trade = F.max(F.when(F.col("RN") != 0, F.col("_day"))).over(_days())
    run = F.col("_day") - F.coalesce(last_trade, F.lit(0))
    silent = (F.col("RN") == 0) & (F.col("_so_far") > 0)
    return numbered.withColumns(
        {
            "GRP": F.when(traded, 0).otherwise(F.sum(F.when(F.col("RN") == 0, 0).otherwise(1)).over(_days())),
            "CONSECUTIVE_ZERO_TRADING_DAYS": F.when(silent, run).otherwise(0),
        }
    ).drop("_day", "_so_far")


def moving_stats(rows: DataFrame, value: str, keys: Sequence[str], size: int, mean: str, deviation: str) -> DataFrame:
    """Mean and sample deviation of the ``size`` rows before each, from running sums of a whole number.

    Count, sum and sum of squares run from the first day of the key; a window is the difference of two of them, so
    a row costs the same at any window length.  The sums are whole numbers, so nothing is lost in the difference.
    """
    days = Window.partitionBy(*keys).orderBy(DAY)
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col(value).cast("decimal(19,0)")
    running = {"_n": F.count(value), "_s": F.sum(whole), "_q": F.sum(whole * whole)}
    kept = rows.columns
    rows = rows.withColumns({c: F.coalesce(e.over(before).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) for c, e in running.items()})
    rows = rows.withColumns({c: F.col(c) - F.coalesce(F.lag(c, size).over(days), F.lit(0).cast("decimal(38,0)")) for c in running})
    n, s, q = (F.col(c).cast("decimal(38,0)") for c in running)
    spread = (n * q - s * s).cast("double")
    return rows.select(
        *kept,
        F.when(n > 0, s.cast("double") / n.cast("double")).alias(mean),
        F.when(n > 1, F.sqrt(spread / (n * (n - 1)).cast("double"))).alias(deviation),
    )


def rolling_stats(daily: DataFrame, require_history: bool = True) -> DataFrame:
    """Mean and deviation of the last 84 days and of the last 12 same weekdays, current day excluded.

    ``RN`` must be a whole number, else the frames are summed row by row, as differences would round.
    """
    names = ["AVG_RN_12W", "STD_RN_12W", "AVG_RN_WEEKDAY12W", "STD_RN_WEEKDAY12W"]
    if isinstance(daily.schema["RN"].dataType, IntegralType):
        rows = moving_stats(daily, "RN", [LEVEL], 84, *names[:2]).withColumn("_weekday", F.dayofweek(DAY))
        rows = moving_stats(rows, "RN", [LEVEL, "_weekday"], 12, *names[2:]).drop("_weekday")
    else:
        recent = _days().rowsBetween(-84, -1)
        weekday = Window.partitionBy(LEVEL, F.dayofweek(DAY)).orderBy(DAY).rowsBetween(-12, -1)
        frames = [(f, w) for w in (recent, weekday) for f in (F.avg, F.stddev_samp)]
        rows = daily.select("*", *[f("RN").over(w).alias(name) for (f, w), name in zip(frames, names, strict=True)])
    return rows.na.drop(subset=names) if require_history else rows


def country_p80(
    daily: DataFrame, by: Sequence[str] = SEGMENT, approximate: bool = False, accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """80th percentile of RN per country, retail, wholesale and day, one row per group.

    ``approximate`` takes it from a mergeable sketch: one aggregate with partial sketches, without ranking value
    counts across groups.  Its rank is off by a share of ``1 / accuracy`` of the group's rows at most, and it is a
    value of the group instead of one between two.
    """
    if approximate:
        return daily.groupBy(*by).agg(F.percentile_approx("RN", 0.8, accuracy).cast("double").alias("P80_RN_COUNTRY"))
    return exact_quantiles(daily, "RN", {"P80_RN_COUNTRY": 0.8}, by)


def rank_error(daily: DataFrame, found: DataFrame, by: Sequence[str], share: float = 0.8) -> DataFrame:
    """``N_ROWS`` and ``RANK_ERROR`` of each group: how far, as a share of its rows, a value lies from its rank."""
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    value = F.col("P80_RN_COUNTRY")
    counts = daily.where(F.col("RN").isNotNull()).groupBy(*by, "RN").agg(F.count(F.lit(1)).alias("_n"))
    met = counts.alias("d").join(found.alias("f"), same).groupBy(*[F.col(f"d.{c}").alias(c) for c in by]).agg(
        F.sum("_n").alias("N_ROWS"),
        F.sum(F.when(F.col("RN") < value, F.col("_n")).otherwise(0)).alias("_below"),
        F.sum(F.when(F.col("RN") <= value, F.col("_n")).otherwise(0)).alias("_upto"),
    )
    wanted = F.ceil(share * F.col("N_ROWS"))
    off = F.greatest(F.lit(0), F.col("_below") + 1 - wanted, wanted - F.col("_upto"))
    return met.select(*by, "N_ROWS", (off / F.col("N_ROWS")).alias("RANK_ERROR"))


def nbinom_scores(rows: DataFrame) -> DataFrame:
    """Probability of a day this low under both rolling windows, and its floored variant.

    The sample deviation plays the dispersion parameter, as in the method this follows.
    """
    scored = rows.select(
        "*",
        nbinom_cdf(F.col("RN"), F.col("AVG_RN_12W"), F.col("STD_RN_12W")).alias("CDF_RN_12W_NBINOM"),
        nbinom_cdf(F.col("RN"), F.col("AVG_RN_WEEKDAY12W"), F.col("STD_RN_WEEKDAY12W")).alias(
            "CDF_RN_WEEKDAY12W_NBINOM"
        ),
    )
    return scored.withColumn(
        "CDF_RN_WEEKDAY12W_NBINOM_FLOOR",
        F.when(F.col("AVG_RN_12W") >= LEAST_VOLUME, F.col("CDF_RN_WEEKDAY12W_NBINOM")),
    )


def nbinom_density(rows: DataFrame) -> DataFrame:
    """Probability of exactly this count under the 84-day window."""
    density = nbinom_pmf(F.col("RN"), F.col("AVG_RN_12W"), F.col("STD_RN_12W"))
    return rows.withColumn("PMF_RN_12W_NBINOM", density)


def country_day_probability(scored: DataFrame) -> DataFrame:
    """Median floored probability of a country on a day, on every row of that country and day.

    Exact median of a mergeable kind would not exist, so it comes from ranked value counts, joined back.
    """
    medians = exact_quantiles(
        scored, "CDF_RN_WEEKDAY12W_NBINOM_FLOOR", {"AVG_COUNTRY_DAY_PROB": 0.5}, (COUNTRY, DAY)
    )
    return scored.join(medians, [COUNTRY, DAY], "left")


def anomaly_flags(scored: DataFrame) -> DataFrame:
    """The three rarity flags, their conjunction and the flagged volume; missing counts as not flagged."""
    flags = {
        "CDF_RN_12W_NBINOM_FLAG": is_true(F.col("CDF_RN_12W_NBINOM") <= RARE),
        "CDF_RN_WEEKDAY12W_NBINOM_FLAG": is_true(F.col("CDF_RN_WEEKDAY12W_NBINOM") <= RARE),
        "AVG_COUNTRY_DAY_PROB_FLAG": is_true(F.col("AVG_COUNTRY_DAY_PROB") >= RARE),
    }
    flagged = scored.withColumns(flags)
    every = F.lit(True)
    for name in flags:
        every = every & F.col(name)
    return flagged.withColumn("RN_FLAG_ALL", every).withColumn("RN_WITH_FLAG", F.when(every, F.col("RN")))


def daily_typed(rows: DataFrame) -> DataFrame:
    """Column types of the exported report, sorted by customer and day."""
    types = {LEVEL: "string", "CUSTOMER_RL_NAME": "string", COUNTRY: "string", DAY: "date", "RN": "int"}
    types |= {
        name: "float"
        for name in ("AVG_RN_12W", "STD_RN_12W", "AVG_RN_WEEKDAY12W", "STD_RN_WEEKDAY12W", "P80_RN_COUNTRY")
    }
    typed = rows.withColumns({name: F.col(name).cast(t) for name, t in types.items() if name in rows.columns})
    return typed.orderBy(LEVEL, DAY)


def entity_extract(rows: DataFrame, level: str) -> DataFrame:
    """All rows of one customer."""
    return rows.where(F.col(LEVEL) == level)


def customer_profile(runs: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Average and total volume and longest run without trade, per customer."""
    return runs.groupBy(LEVEL, *attributes).agg(
        F.avg("RN").alias("AVG_RN"),
        F.sum("RN").alias("SUM_RN"),
        F.max("CONSECUTIVE_ZERO_TRADING_DAYS").alias("MAX_CONSECUTIVE_ZERO_TRADING_DAYS"),
    )
