"""Calendar-month feature engine, run on the sliding-window engine.

Every window of a scenario is bounded by month steps from its break date, so daily rows are first
reduced to one row per key and month step; scenarios that share a day of the month share those steps
and are answered together.  Days 29-31 clip to month ends, so such scenarios have steps of their own and
share one scan of the facts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.slots import KEY, SCENARIO, SLOT, SLOT_DATE, LabelWindow, sliding_rows
from ebbtide.plans.spec import Line

DAY = "DATE"


def shift_months(day: dt.date, months: int) -> dt.date:
    """Month arithmetic that clips to the last day of the month."""
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    following = dt.date(year + month // 11, (month + 1) % 12 + 1, 1)
    return dt.date(year, month + 1, min(day.day, (following - dt.timedelta(days=1)).day))


def month_starts(first: dt.date, last: dt.date) -> list[dt.date]:
    """First days of the months in the range, newest first."""
    start = first if first.day == 1 else shift_months(first.replace(day=1), 1)
    steps = (last.year - start.year) * 12 + last.month - start.month
    return [shift_months(start, k) for k in range(steps, -1, -1)]


def month_features(
    facts: DataFrame,
    lines: Sequence[Line],
    scenarios: Sequence[dt.date],
    months_break: int = 1,
    metric: str = "GROSS_SALES",
) -> DataFrame:
    """One row per key and scenario date: ``L<n>M`` features before the break, label after it."""
    ends = [day for day in scenarios if day.day > 28]
    groups: dict[int, list[dt.date]] = {}
    for day in scenarios:
        if day.day <= 28:
            groups.setdefault(day.day, []).append(day)
    parts = [_month_group(facts, lines, days, months_break, metric) for days in groups.values()]
    if ends:
        parts.append(_month_ends(facts, lines, ends, months_break, metric))
    return reduce(DataFrame.unionByName, parts)


def _reach(day: dt.date, months_break: int, longest: int) -> dt.date:
    return shift_months(shift_months(day, -months_break), -longest)


def _month_group(
    facts: DataFrame, lines: Sequence[Line], days: list[dt.date], months_break: int, metric: str
) -> DataFrame:
    """Scenarios on one day of the month up to the 28th: slots of whole months, shared by all of them."""
    newest = max(days)
    longest = max(length for item in lines for length in item.lengths)
    # slot 0 ends at the newest scenario date, slot s ends s months earlier
    ends = (F.year(DAY) * 12 + F.month(DAY)) + (F.dayofmonth(DAY) > newest.day).cast("int")
    slot_of = {(newest.year - d.year) * 12 + newest.month - d.month + months_break: d for d in days}
    dated = (
        facts.where((F.col(DAY) > F.lit(_reach(min(days), months_break, longest))) & (F.col(DAY) <= F.lit(newest)))
        .withColumn(SLOT, F.lit(newest.year * 12 + newest.month) - ends)
        .withColumn(SLOT_DATE, F.add_months(F.lit(newest), -F.col(SLOT)))
    )
    label = LabelWindow(f"{metric}_TARGET", "CHURN", -months_break, -1)
    rows = sliding_rows(dated, lines, [label], metric, list(slot_of), unit="M", prefix="")
    as_date = F.create_map(*[F.lit(x) for pair in slot_of.items() for x in pair])
    return rows.withColumn(SCENARIO, as_date[F.col(SCENARIO)])


def _month_ends(
    facts: DataFrame, lines: Sequence[Line], days: list[dt.date], months_break: int, metric: str
) -> DataFrame:
    """Scenarios on the 29th to 31st, where short months make every scenario's slots its own.

    One scan of the facts: a fact goes to each scenario that reaches it, with the slot it has there, and is combined
    per key, scenario and slot before it is shuffled.
    """
    longest = max(length for item in lines for length in item.lengths)
    cases = []
    for day in days:
        cuts = [shift_months(day, -k) for k in range(months_break)]
        cuts += [shift_months(shift_months(day, -months_break), -n) for n in range(longest + 1)]
        cases.append(F.struct(F.lit(day).alias("day"), F.array(*map(F.lit, cuts)).alias("cuts")))
    bottom = min(_reach(day, months_break, longest) for day in days)
    place = F.size(F.filter("_case.cuts", lambda cut: F.col(DAY) <= cut))
    dated = (
        facts.where(F.col(KEY).isNotNull() & (F.col(DAY) > F.lit(bottom)) & (F.col(DAY) <= F.lit(max(days))))
        .withColumn("_case", F.explode(F.array(*cases)))
        .where((F.col(DAY) > F.element_at("_case.cuts", -1)) & (F.col(DAY) <= F.col("_case.day")))
        .withColumns({SLOT: place - 1, SLOT_DATE: F.get("_case.cuts", place - 1)})
        .withColumn(KEY, F.struct(F.col(KEY).alias("key"), F.col("_case.day").alias("day")))
    )
    label = LabelWindow(f"{metric}_TARGET", "CHURN", -months_break, -1)
    rows = sliding_rows(dated, lines, [label], metric, [months_break], unit="M", prefix="", series=f"{KEY}.day")
    return rows.withColumn(SCENARIO, F.col(f"{KEY}.day")).withColumn(KEY, F.col(f"{KEY}.key"))
