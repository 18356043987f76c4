"""Running totals, ranks and exact quantiles over a global order, without a one-task window.

Rows are dealt to buckets of neighbouring places in the order.  The bucket is a function of the row alone:
its place among boundaries that one pass of approximate quantiles has set, and for a value so frequent that
it fills whole buckets, its place by the next order column.  Rows are shuffled once, on group and bucket; the
totals of the buckets are summed from that same shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, FractionalType, StringType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

BUCKET = "_bucket"
#: Most boundaries of the first order column (a row is compared with all of them), and of the second per frequent value.
MOST_BUCKETS, INNER_BUCKETS = 1024, 64


def _sorted_value(frame: DataFrame, order: Column) -> tuple[Column, Column, bool, bool]:
    """What a column of an order sorts by, as a number that never falls as it ascends; whether equal numbers mean equal
    values; whether it descends; whether NULLs are first."""
    text = re.fullmatch(r"Column<'(.*) (ASC|DESC) NULLS (FIRST|LAST)'>", str(order), re.DOTALL)
    value = order if text is None else F.col(text[1]) if text[1] in frame.columns else F.expr(text[1])
    kind = frame.select(value).schema[0].dataType
    if isinstance(kind, StringType):  # the first seven bytes
        value = F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0"), 16, 10)
    elif isinstance(kind, DateType):
        value = F.unix_date(value)
    elif isinstance(kind, TimestampType | TimestampNTZType):
        value = F.unix_micros(value.cast("timestamp"))
    number = value.cast("double")
    exact = F.lit(not isinstance(kind, StringType | DecimalType)) & ((F.abs(number) < 2.0**53) | F.lit(isinstance(kind, FractionalType)))
    return number, exact, text is not None and text[2] == "DESC", text is None or text[3] == "FIRST"


def _place(value: Column, bounds: Sequence[float], descending: bool, nulls_first: bool) -> Column:
    """Place among the boundaries, ascending in the order; a value that is a boundary has a place of its own."""
    last = 2 * len(bounds)
    cuts = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    place = F.size(F.filter(cuts, lambda b: b < value)) + F.size(F.filter(cuts, lambda b: b <= value))
    return F.when(value.isNull(), -1 if nulls_first else last + 1).otherwise(last - place if descending else place)


def bucket_of(frame: DataFrame, order: Sequence[Column]) -> Column:
    """Bucket of a row: a whole number that never falls along ``order``."""
    buckets = min(MOST_BUCKETS, max(8, 2 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def quantiles(value: Column, n: int) -> Column:
        return F.percentile_approx(value, [k / n for k in range(1, n)], 50 * n)

    value, exact, *way = _sorted_value(frame, order[0])
    found = frame.agg(quantiles(value, buckets)).first()[0] or []
    outer = _place(value, sorted(set(found)), *way)
    frequent = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    if not frequent or len(order) < 2:
        return outer.cast("long")
    second, _, *inner_way = _sorted_value(frame, order[1])
    cuts = frame.where(exact & value.isin(frequent)).groupBy(value.alias("v")).agg(quantiles(second, INNER_BUCKETS).alias("cuts")).collect()
    inner = F.lit(0)
    for r in cuts:
        inner = F.when(exact & (value == r["v"]), _place(second, sorted(set(r["cuts"] or [])), *inner_way)).otherwise(inner)
    return outer.cast("long") * (4 * INNER_BUCKETS) + inner


def running_totals(
    frame: DataFrame, order: Sequence[Column], measures: Mapping[str, Column], by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add one inclusive running sum per measure, in ``order``, restarting for each ``by`` group.

    ``order`` must tell rows apart within a group, or ties get an arbitrary order.  A group of any size is spread
    over the buckets that its rows fill.  ``totals`` names further columns: the sum of a measure over the group.
    """
    totals = totals or {}
    inputs = {name: f"_in_{name}" for name in measures}
    dealt = frame.withColumns(
        {BUCKET: bucket_of(frame, order)} | {inputs[name]: expr for name, expr in measures.items()}
    ).repartition(*by, BUCKET)
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        dealt.groupBy(*by, BUCKET)
        # The digest needs every column, so that this branch reads the very exchange of the rows instead of one of
        # its own with fewer columns, for which the input would be computed again.
        .agg(*[F.sum(col).alias(col) for col in inputs.values()], F.max(F.hash(*dealt.columns)).alias("_digest"))
        .where(F.col("_digest").isNotNull())
        .select(
            *by,
            BUCKET,
            *[F.sum(col).over(before).alias(f"_before{col}") for col in inputs.values()],
            *[F.sum(inputs[measure]).over(whole).alias(name) for name, measure in totals.items()],
        )
    ).alias("c")
    joined = dealt.withColumns({col: F.sum(col).over(inside) for col in inputs.values()}).alias("r").join(
        carried,
        [F.col(f"r.{BUCKET}") == F.col(f"c.{BUCKET}"), *[F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]],
    )
    return joined.select(
        *[F.col(f"r.{c}") for c in frame.columns],
        *[
            (F.col(col) + F.coalesce(F.col(f"_before{col}"), F.lit(0))).alias(name)
            for name, col in inputs.items()
        ],
        *totals,
    )


def value_counts(frame: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values with how many rows hold each (``_n``)."""
    return frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))


def exact_quantiles(
    frame: DataFrame, value: str, quantiles: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group.

    Works on value counts, so a value that fills most of a group costs one row.
    """
    counts = value_counts(frame, value, by)
    ranked = running_totals(counts, [F.col(value)], {"_upto": F.col("_n")}, by, {"_size": "_upto"})
    return ranked_quantiles(ranked, value, quantiles, by)


def ranked_quantiles(
    ranked: DataFrame, value: str, quantiles: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles from running counts ``_upto`` of the values and the count ``_size`` of their group."""
    picks = []
    for name, q in quantiles.items():
        position = (F.col("_size") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(f"_{name}_{side}"))
    found = ranked.groupBy(*by).agg(F.max("_size").alias("_size"), *picks)

    def between(name: str, q: float) -> Column:
        position = (F.col("_size") - 1) * F.lit(float(q))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return found.select(*by, *[between(name, q) for name, q in quantiles.items()])


def rank_by(frame: DataFrame, value: str, name: str, method: str = "max") -> DataFrame:
    """Descending rank: ``max`` gives ties their last position, ``min`` their first; NULL stays NULL."""
    counts = value_counts(frame, value)
    ranked = running_totals(counts, [F.col(value).desc()], {"_upto": F.col("_n")})
    position = F.col("_upto") if method == "max" else F.col("_upto") - F.col("_n") + 1
    return frame.join(ranked.select(value, position.alias(name)), value, "left").select(*frame.columns, name)


def top_share(frame: DataFrame, value: str, key: str, floor: float = 0.005) -> DataFrame:
    """Cumulative amount and share of the total, largest first (ties by key): the contribution curve."""
    kept = frame.where(F.col(value) > floor).select(key, value)
    measures = {"POSITION": F.lit(1), "CUMULATIVE": F.col(value)}
    ranked = running_totals(kept, [F.col(value).desc(), F.col(key)], measures, totals={"_total": "CUMULATIVE"})
    return ranked.select(key, value, "POSITION", "CUMULATIVE", (F.col("CUMULATIVE") / F.col("_total")).alias("SHARE"))
