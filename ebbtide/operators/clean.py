"""Outlier trimming, cleaning reports, class balance, column profile and time splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType
from pyspark.sql.window import Window

from ebbtide.functions.scalars import is_true
from ebbtide.operators.prefix import exact_quantiles, ranked_quantiles, running_totals
from ebbtide.operators.slots import SCENARIO


def outlier_trim(frame: DataFrame, value: str, low: float = 0.55, high: float = 0.998) -> DataFrame:
    """Rows strictly between two quantiles of the untrimmed frame."""
    bounds = _bounds(frame, value, low, high)
    return frame.where((F.col(value) < bounds["hi"]) & (F.col(value) > bounds["lo"]))


def _bounds(frame: DataFrame, value: str, low: float, high: float) -> Column:
    """Both quantiles from one subquery, which all conditions share."""
    found = exact_quantiles(frame, value, {"lo": low, "hi": high})
    return found.select(F.struct("lo", "hi")).scalar()


def trim_stages(frame: DataFrame, value: str, low: float = 0.55, high: float = 0.998) -> dict[str, Column]:
    """Conditions of the cleaning steps, for :func:`dataset_status` and :func:`removal_effect`."""
    bounds = _bounds(frame, value, low, high)
    top = is_true(F.col(value) >= bounds["hi"])
    bottom = ~top & is_true(F.col(value) <= bounds["lo"])
    measured = F.col(value).isNotNull()
    return {
        "loaded": F.lit(True),
        "upper_removed": measured & ~top,
        "lower_removed": measured & ~top & ~bottom,
        "upper_end": top,
        "lower_end": bottom,
    }


def dataset_status(frame: DataFrame, stages: Mapping[str, Column], key: str = "PK") -> DataFrame:
    """Rows and distinct entities that satisfy each stage, in one pass.

    Rows are first counted per entity, so no distinct set is built per stage.
    """
    per_key = frame.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in stages.items()])
    totals = per_key.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(f"{name}_rows") for name in stages],
        *[F.count_if((F.col(name) > 0) & F.col(key).isNotNull()).alias(f"{name}_keys") for name in stages],
    )
    rows = [
        F.struct(
            F.lit(name).alias("STAGE"),
            F.col(f"{name}_rows").alias("N_ROWS"),
            F.col(f"{name}_keys").alias("N_KEYS"),
        )
        for name in stages
    ]
    return totals.select(F.inline(F.array(*rows)))


def removal_effect(frame: DataFrame, stages: Mapping[str, Column], churn: str = "CHURN") -> DataFrame:
    """Churn probability, to two decimals, of the rows that satisfy each stage."""
    flag = F.col(churn).cast("double")
    totals = frame.agg(*[F.avg(F.when(c, flag)).alias(name) for name, c in stages.items()])
    rows = [F.struct(F.lit(n).alias("STAGE"), F.round(F.col(n), 2).alias("CHURN_PROBABILITY")) for n in stages]
    return totals.select(F.inline(F.array(*rows)))


def split_newest(frame: DataFrame, n: int = 2, newest_is_smallest: bool = True) -> DataFrame:
    """Mark the ``n`` newest scenarios ``test`` and the rest ``dev`` in a ``SPLIT`` column."""
    order = F.col(SCENARIO).asc() if newest_is_smallest else F.col(SCENARIO).desc()
    test = frame.select(SCENARIO).where(F.col(SCENARIO).isNotNull()).distinct().orderBy(order).limit(n)
    marked = frame.join(F.broadcast(test.withColumn("_test", F.lit(True))), SCENARIO, "left")  # n rows
    side = F.when(F.col("_test"), "test").otherwise("dev")
    return marked.select(*frame.columns, side.alias("SPLIT"))


def balance_classes(frame: DataFrame, variation: str, order: Sequence[Column]) -> DataFrame:
    """All rows of the two changing classes and an equal share of each stable class.

    Each stable class gives up to half as many rows as the changing classes hold together.  ``order``
    decides which rows stay; pass a seeded hash of the key for a random draw.
    """
    changing = F.col(variation).isin("C_L2M__NOT_C", "NOT_C_L2M__C")
    stable = F.col(variation).isin("C_L2M__C", "NOT_C_L2M__NOT_C")
    quota = frame.agg(F.floor(F.count_if(changing) / 2)).scalar()
    ranked = running_totals(frame.where(stable), order, {"_nth": F.lit(1)}, [variation])
    drawn = ranked.where(F.col("_nth") <= quota).drop("_nth")
    return frame.where(changing).unionByName(drawn)


def class_weights(frame: DataFrame, label: str, name: str = "WEIGHT") -> DataFrame:
    """Inverse class frequency, ``n / (classes * n_class)``, on every row."""
    sizes = frame.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = sizes.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
    sizes = F.broadcast(sizes)  # one row per class; the rows stay where they are
    return frame.join(sizes, label, "left").select(*frame.columns, (whole / F.col("_n")).alias(name))


def stratified_folds(frame: DataFrame, label: str, order: Sequence[Column], folds: int = 6) -> DataFrame:
    """Fold number that deals the rows of each label out in turn."""
    dealt = running_totals(frame, order, {"_nth": F.lit(1)}, [label])
    return dealt.withColumn("FOLD", ((F.col("_nth") - 1) % folds).cast("int")).drop("_nth")


def column_profile(frame: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Count, missing, distinct, range, moments, quartiles and histogram of numeric columns.

    Columns are stacked and reduced to value counts first; every statistic follows from those.
    """
    numeric = frame.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = numeric.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("COLUMN"), F.col(c).alias("_value")) for c in columns]))
    )
    present = F.col("_value").isNotNull()
    counts = running_totals(
        long.groupBy("COLUMN", "_value").agg(F.count(F.lit(1)).alias("_n")),
        [F.col("_value")],
        {"_upto": F.when(present, F.col("_n")).otherwise(0)},
        ["COLUMN"],
        {"_size": "_upto"},
    )
    weighted = F.when(present, F.col("_n"))
    basics = counts.groupBy("COLUMN").agg(
        F.coalesce(F.sum(weighted), F.lit(0)).alias("N"),
        F.coalesce(F.sum(F.when(~present, F.col("_n"))), F.lit(0)).alias("N_MISSING"),
        F.count("_value").alias("N_DISTINCT"),
        F.min("_value").alias("MIN"),
        F.max("_value").alias("MAX"),
        (F.sum(F.col("_value") * weighted) / F.sum(weighted)).alias("MEAN"),
    )
    # spread around the mean, so large values do not cancel
    spread = counts.join(F.broadcast(basics), "COLUMN").groupBy("COLUMN").agg(  # one row per column
        F.sqrt(
            F.sum(F.pow(F.col("_value") - F.col("MEAN"), 2) * weighted)
            / F.nullif(F.sum(weighted) - 1, F.lit(0))
        ).alias("STD"),
        *[
            F.coalesce(F.sum(F.when(_bin(bins) == b, weighted)), F.lit(0)).alias(f"_bin{b}")
            for b in range(bins)
        ],
    )
    quartiles = ranked_quantiles(counts, "_value", {"Q25": 0.25, "MEDIAN": 0.5, "Q75": 0.75}, ["COLUMN"])
    histogram = F.array(*[F.col(f"_bin{b}") for b in range(bins)]).alias("HISTOGRAM")
    return (
        basics.join(spread, "COLUMN")
        .join(quartiles, "COLUMN", "left")
        .select(*basics.columns, "STD", "Q25", "MEDIAN", "Q75", histogram)
    )


def _kind(kind: DataType) -> str:
    if isinstance(kind, BooleanType):
        return "boolean"
    if isinstance(kind, DateType):
        return "date"
    return "number" if isinstance(kind, NumericType) else "text"


def mixed_profile(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, distinct, extremes and most frequent value of columns of any type, one row per column.

    Texts also have their mean length, booleans the share that is true, dates the longest gap in days between two
    that follow each other.  Extremes of numbers are left to :func:`column_profile`; ties for the most frequent
    value go to the first text.  Values are counted first, with partial counts per task, and all statistics are
    mergeable over those counts; only the distinct days of a date column are ordered, as many as a calendar has.
    """
    kinds = {c: _kind(frame.schema[c].dataType) for c in columns}
    cells = [
        F.struct(F.lit(c).alias("COLUMN"), F.lit(kinds[c]).alias("KIND"), F.col(c).cast("string").alias("_value")) for c in columns
    ]
    counts = frame.select(F.inline(F.array(*cells))).groupBy("COLUMN", "KIND", "_value").agg(F.count(F.lit(1)).alias("_n"))
    present = F.col("_value").isNotNull()
    held, ordered = F.when(present, F.col("_n")), F.when(present & (F.col("KIND") != "number"), F.col("_value"))

    def only(kind: str, value: Column) -> Column:
        return F.when(F.first("KIND") == kind, value)

    basics = counts.groupBy("COLUMN").agg(
        F.first("KIND").alias("KIND"),
        F.coalesce(F.sum(held), F.lit(0)).alias("N"),
        F.coalesce(F.sum(F.when(~present, F.col("_n"))), F.lit(0)).alias("N_MISSING"),
        F.count("_value").alias("N_DISTINCT"),
        F.min(ordered).alias("LEAST"),
        F.max(ordered).alias("MOST"),
        F.min(F.when(present, F.struct((-F.col("_n")).alias("less"), F.col("_value")))).alias("_top"),
        only("text", F.sum(held * F.length("_value")) / F.sum(held)).alias("MEAN_LENGTH"),
        only("boolean", F.coalesce(F.sum(F.when(F.col("_value") == "true", F.col("_n"))), F.lit(0)) / F.sum(held)).alias("TRUE_SHARE"),
    )
    days = counts.where(present & (F.col("KIND") == "date")).select("COLUMN", F.col("_value").cast("date").alias("_day"))
    after = Window.partitionBy("COLUMN").orderBy("_day")
    gaps = days.select("COLUMN", F.datediff("_day", F.lag("_day").over(after)).alias("_gap"))
    longest = gaps.groupBy("COLUMN").agg(F.max("_gap").alias("LONGEST_GAP"))
    return basics.join(longest, "COLUMN", "left").select(
        "COLUMN", "KIND", "N", "N_MISSING", "N_DISTINCT", "LEAST", "MOST", F.col("_top._value").alias("TOP_VALUE"),
        (-F.col("_top.less")).alias("TOP_COUNT"), "MEAN_LENGTH", "TRUE_SHARE", "LONGEST_GAP",
    )


def _bin(bins: int) -> Column:
    """Equal-width bin of a value in its column's range; the last bin is closed."""
    width = F.nullif(F.col("MAX") - F.col("MIN"), F.lit(0.0))
    place = F.floor((F.col("_value") - F.col("MIN")) / width * bins)
    return F.when(F.col("_value").isNotNull(), F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))
