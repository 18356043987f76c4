"""Places and running sums in a sorted order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.common import saved, unclash

_AT, _PART, _FIRST = "_at", "_part", "_first"


def in_order(
    frame: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Sequence[str] = (),
    facts: DataFrame | None = None,
) -> DataFrame:
    """Rows with ``nth`` (from 0) and ``group_rows`` of their group, ``before_<c>`` for each of ``sums``, and ``facts``.

    ``by`` must hold no NULL.  Rows are range-partitioned on group and order and written once, so a large group
    lies in many parts and every reader sees the same parts; each part then gets the totals of the earlier parts
    of its group.  The table of parts has a row per part and one per group.  ``facts`` (one row per group) is
    joined to that table and not to the rows, so no join is dealt by the group alone.
    """
    keys = [F.col(c).asc() for c in by]
    ranged = saved(
        unclash(frame, [_AT, _PART, _FIRST, "nth", "group_rows", *[f"before_{c}" for c in sums]])
        .repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(_AT, F.monotonically_increasing_id())
    ).withColumn(_PART, F.shiftright(_AT, 33))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.groupBy(_PART, *by).agg(
        F.min(_AT).alias(_FIRST), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums]
    )
    parts = counted.select(
        _PART,
        *by,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col(_FIRST)).alias(_FIRST),
        F.sum("_n").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums],
    )
    if facts is not None:
        parts = parts.join(facts, list(by))
    rows = ranged
    if sums:
        inside = Window.partitionBy(_PART, *by).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    rows = rows.join(parts, [_PART, *by]).withColumn("nth", F.col(_AT) + F.col(_FIRST))
    for c in sums:
        rows = rows.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"_{c}"))
    return rows.drop(_AT, _PART, _FIRST, *[f"_{c}" for c in sums])
