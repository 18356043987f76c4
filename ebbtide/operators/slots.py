"""Slot-window feature engine: features, labels and time-shifted scenarios in one pass.

A scenario that pretends "today" is slot ``m`` sees the same facts with every slot number moved by a
constant, so the window of length ``n`` for that scenario is the range ``m .. m+n-1`` of the unshifted
slots, and the label window of a horizon is the range ``m-ph .. m-ph+cp-1``.  Facts are shuffled once on
the key and packed into one row per key: an array per metric, indexed by slot.  A scenario's windows are
slices of those arrays, so only the scenario slots are ever expanded to rows, and no fact is copied per
scenario, window or label on its way to the key.

The windows overlap, so the slot axis is cut at every window edge into disjoint bands; each band is
aggregated once and a window is put together from its bands.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType, NumericType

from ebbtide.plans.catalog import INACTIVE_BELOW, TARGET_METRIC
from ebbtide.plans.spec import DATE_DIFFS, Fn, Horizon, Line, column_name, expand

KEY, SLOT, SLOT_DATE, SCENARIO = "PK", "TIME_SLOT", "DATE_TIME_SLOT", "SCENARIO_DATE"
ARRAYS, PLACE = "_arrays", "_place"
TODAY = 4  # slot that plays "today": slots 0..3 are only known to the labels


@dataclass(frozen=True)
class LabelWindow:
    """Label columns and the range of slots, relative to the break slot, whose amount they sum."""

    amount: str
    flag: str
    low: int
    high: int


def label_windows(horizons: Iterable[Horizon], metric: str) -> list[LabelWindow]:
    """Label windows of prediction-horizon and churn-period pairs.

    With a churn period longer than the horizon the window reaches past the break into known slots.
    """
    return [
        LabelWindow(
            f"{metric}_TARGET_PH_{h.ph}_CP_{h.cp}",
            f"CHURN_PH_{h.ph}_CP_{h.cp}S",
            h.last_slot - TODAY,
            h.first_slot - TODAY,
        )
        for h in horizons
    ]


def merge_slot_rows(facts: DataFrame, lines: Iterable[Line], metric: str | None) -> DataFrame:
    """Collapse several rows of one (key, slot) into one, keeping sums, counts, minima and maxima.

    Runs as a partial plus final aggregate, so a key that owns a large share of the rows is reduced to
    one row per slot in every map task before anything is shuffled.
    """
    wanted: dict[str, Column] = {}
    for item in lines:
        for fn in item.functions:
            if fn is not Fn.ISNULL:
                wanted.update(_carriers(item.metric, fn))
    if metric:
        wanted.update(_carriers(metric, Fn.SUM))
    return facts.groupBy(KEY, SLOT).agg(
        F.min(SLOT_DATE).alias(SLOT_DATE), *[expr.alias(name) for name, expr in wanted.items()]
    )


def _carriers(metric: str, fn: Fn) -> dict[str, Column]:
    if fn is Fn.SUM:
        return {f"{metric}__sum": F.sum(metric)}
    if fn is Fn.AVG:
        return {f"{metric}__sum": F.sum(metric), f"{metric}__cnt": F.count(metric)}
    if fn in (Fn.MIN, Fn.DIFF_DATE_MIN):
        return {f"{metric}__min": F.min(metric)}
    return {f"{metric}__max": F.max(metric)}


def cut_bands(windows: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint slot ranges such that every window is a union of some of them."""
    windows = set(windows)
    starts = sorted({low for low, _ in windows} | {high + 1 for _, high in windows})
    bands = [(low, after - 1) for low, after in zip(starts, starts[1:], strict=False)]
    return [b for b in bands if any(low <= b[0] and b[1] <= high for low, high in windows)]


def innermost(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that hold no other one: a row inside such a span is in all spans around it.

    The condition on presence must stay short: Java does not compile a method of over 8,000 bytes of code.
    """
    spans = list(dict.fromkeys(spans))
    return [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]


class _Bands:
    """Hands out one named column per (aggregate, band) and combines them into windows.

    Columns are SQL text: a wide spec has thousands of them, and text costs one call each to build.
    """

    def __init__(self, windows: Iterable[tuple[int, int]], packed: dict[str, str]):
        self.bands = cut_bands(windows)
        self.packed = packed  # arrays by slot and the type their sums have
        self.columns: dict[str, str] = {}

    def _cells(self, kind: str, metric: str, low: int, high: int) -> list[str]:
        cells = []
        for band in self.bands:
            if low <= band[0] and band[1] <= high:
                name = f"`{metric}__{kind}__{band[0]}__{band[1]}`"
                if name not in self.columns:
                    self.columns[name] = f"{self._aggregate(kind, metric, band)} AS {name}"
                cells.append(name)
        return cells

    def _aggregate(self, kind: str, metric: str, band: tuple[int, int]) -> str:
        merged = f"{metric}__{kind}" in self.packed
        name = SLOT if kind == "rows" else f"{metric}__{kind}" if merged else metric
        source, first, length = f"{ARRAYS}.`{name}`", f"{PLACE} + {band[0]}", band[1] - band[0] + 1
        counted = kind == "rows" or (kind == "cnt" and not merged)
        if length == 1:
            value = f"get({source}, {first})"
            return f"int({value} IS NOT NULL)" if counted else value
        part = f"slice({source}, {first} + 1, {length})"
        if counted:
            return f"size(filter({part}, x -> x IS NOT NULL))"
        if kind in ("min", "max"):
            return f"array_{kind}({part})"
        return f"aggregate({part}, CAST(NULL AS {self.packed[name]}), (a, x) -> coalesce(a + x, a, x))"

    def rows(self, low: int, high: int) -> str:
        return _added(self._cells("rows", "", low, high))

    def total(self, metric: str, low: int, high: int, keep_missing: bool = False) -> str:
        cells = self._cells("sum", metric, low, high)
        total = f"double({_added(cells)})"
        return f"if(coalesce({', '.join(cells)}) IS NULL, NULL, {total})" if keep_missing else total

    def mean(self, metric: str, low: int, high: int) -> str:
        count = _added(self._cells("cnt", metric, low, high))
        return f"{self.total(metric, low, high)} / nullif({count}, 0)"

    def extreme(self, kind: str, metric: str, low: int, high: int) -> str:
        cells = self._cells(kind, metric, low, high)
        pick = "least" if kind == "min" else "greatest"
        return f"{pick}({', '.join(cells)})" if len(cells) > 1 else cells[0]


def _bound(offset: int) -> str:
    if offset == 0:
        return "CURRENT ROW"
    return f"{abs(offset)} {'FOLLOWING' if offset > 0 else 'PRECEDING'}"


def _added(cells: Sequence[str]) -> str:
    """Sum of cells with missing as 0."""
    return "(" + " + ".join(f"coalesce({c}, 0)" for c in cells) + ")"


def _feature(bands: _Bands, item: Line, fn: Fn, low: int, high: int) -> str:
    if fn is Fn.SUM:
        return bands.total(item.metric, low, high, item.nulls_as_missing)
    if fn is Fn.AVG:
        return bands.mean(item.metric, low, high)
    value = bands.extreme("min" if fn in (Fn.MIN, Fn.DIFF_DATE_MIN) else "max", item.metric, low, high)
    return f"datediff({SLOT_DATE}, {value})" if fn in DATE_DIFFS else value


def slot_features(
    facts: DataFrame,
    lines: Sequence[Line],
    horizons: Sequence[Horizon] = (),
    model: str = "CLIENT",
    scenarios: Sequence[int] = (TODAY,),
    one_row_per_slot: bool = False,
    presence: bool = True,
) -> DataFrame:
    """One row per key and scenario with every feature column and, per horizon, amount and flag.

    ``presence`` asks for a row of the key in every window and every label window; without it a key needs
    a row at the scenario's own slot.  Set ``one_row_per_slot`` when (key, slot) is already unique;
    otherwise rows are merged first.
    """
    metric = TARGET_METRIC[model]
    labels = label_windows(horizons, metric)
    return sliding_rows(facts, lines, labels, metric, scenarios, one_row_per_slot, presence)


def sliding_rows(
    facts: DataFrame,
    lines: Sequence[Line],
    labels: Sequence[LabelWindow],
    metric: str,
    scenarios: Sequence[int],
    one_row_per_slot: bool = False,
    presence: bool = True,
    unit: str = "S",
    prefix: str = "FF_",
    series: str | None = None,
) -> DataFrame:
    """Evaluate feature lines and label windows at every scenario slot (see :func:`slot_features`).

    ``series`` is SQL text over the key, for keys whose slots have dates of their own.
    """
    lines = list(lines)
    names = {item.metric for item in lines} | ({metric} if labels else set())
    windows = expand(lines)
    oldest = max([length - 1 for length, _ in windows] + [label.high for label in labels] + [0])
    newest = min([label.low for label in labels] + [0])

    first_slot, last_slot = min(scenarios) + newest, max(scenarios) + oldest
    rows = facts.where(F.col(KEY).isNotNull() & F.col(SLOT).between(first_slot, last_slot)).select(
        KEY, SLOT, SLOT_DATE, *sorted(names)
    )
    if not one_row_per_slot:
        rows = merge_slot_rows(rows, lines, metric if labels else None)

    spans = {key: (0 if key[1] == "agg" else key[0] - 1, key[0] - 1) for key in windows}
    label_spans = [(label.low, label.high) for label in labels]
    asked = [*spans.values(), *label_spans]
    # Windows are read at the scenario's own slot.  If no window asks for a row there, a key may lack it and
    # still be present in all windows.
    filled = presence and (0, 0) not in asked
    packed = {c: _sum_type(rows.schema[c].dataType) for c in rows.columns if c != KEY}
    bands = _Bands([*asked, (0, 0)], packed)

    columns: list[str] = []
    for key, items in windows.items():
        for item in items:
            for fn in item.functions:
                if fn is not Fn.ISNULL:
                    name = column_name(item.metric, fn, *key, unit, prefix)
                    columns.append(f"{_feature(bands, item, fn, *spans[key])} AS `{name}`")
    for label in labels:
        amount = bands.total(metric, label.low, label.high)
        columns += [f"{amount} AS `{label.amount}`", f"{amount} < {INACTIVE_BELOW} AS `{label.flag}`"]
    # with a row at the scenario's own slot, a cumulative window is never empty
    tested = asked if filled else [(0, 0), *(spans[key] for key in windows if key[1] == "only"), *label_spans]
    keep = [f"{bands.rows(*span)} > 0" for span in innermost(tested if presence else [(0, 0)])]
    placed = _by_key(rows, first_slot, last_slot, scenarios)
    if filled:  # the date of a slot where the key has no row is that of other keys
        of = F.expr(series or "0").alias("_series")
        dates = rows.groupBy(F.col(SLOT).alias(SCENARIO), of).agg(F.min(SLOT_DATE).alias(SLOT_DATE))  # one row per slot
        placed = placed.drop(SLOT_DATE).withColumn("_series", of).join(F.broadcast(dates), [SCENARIO, "_series"], "left")
    present = placed.where(" AND ".join(_inlined(bands, c) for c in keep))
    return present.selectExpr(KEY, SCENARIO, SLOT_DATE, *bands.columns.values()).selectExpr(KEY, SCENARIO, *columns)


def _inlined(bands: _Bands, condition: str) -> str:
    """A condition on band columns as one on the packed arrays, so that rows leave before their bands are computed."""
    for name, text in bands.columns.items():
        if name in condition:
            condition = condition.replace(name, text.removesuffix(f" AS {name}"))
    return condition


def _sum_type(kind: DataType) -> str:
    if isinstance(kind, DecimalType):
        return f"decimal(38, {kind.scale})"
    return "bigint" if isinstance(kind, IntegralType) else "double"


def _by_key(rows: DataFrame, first_slot: int, last_slot: int, scenarios: Sequence[int]) -> DataFrame:
    """One row per key and scenario: ``ARRAYS`` holds an array per column, by slot from ``first_slot``, NULL where the
    key has no row; ``PLACE`` is the scenario's own slot in it.

    A key has at most one row per slot here, so a packed row is bounded by the slots in reach.
    """
    columns = [c for c in rows.columns if c != KEY]
    by_key = rows.groupBy(KEY).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    at = f"transform(sequence({first_slot}, {last_slot}), s -> get(filter(_rows, r -> r.{SLOT} = s), 0))"
    aligned = by_key.selectExpr(KEY, f"{at} AS _at")
    summed = ", ".join(f"'{c}', " + (f"transform(_at.`{c}`, x -> CAST(x AS {_sum_type(rows.schema[c].dataType)}))" if _summed(rows.schema[c].dataType) else f"_at.`{c}`") for c in columns)
    spread = aligned.selectExpr(KEY, f"named_struct({summed}) AS {ARRAYS}").withColumn(
        SCENARIO, F.explode(F.array(*[F.lit(s) for s in scenarios]))
    )
    return spread.selectExpr(
        KEY, ARRAYS, f"CAST({SCENARIO} AS {rows.schema[SLOT].dataType.simpleString()}) AS {SCENARIO}",
        f"{SCENARIO} - {first_slot} AS {PLACE}", f"get({ARRAYS}.{SLOT_DATE}, {SCENARIO} - {first_slot}) AS {SLOT_DATE}",
    )


def _summed(kind: DataType) -> bool:
    """Numbers narrower than their sums."""
    return isinstance(kind, NumericType) and _sum_type(kind) != kind.simpleString()


def labels_long(labels: DataFrame, horizons: Sequence[Horizon], metric: str) -> DataFrame:
    """One row per key, scenario and horizon instead of one pair of columns per horizon."""
    cells = [
        F.struct(
            F.lit(h.ph).alias("PH"),
            F.lit(h.cp).alias("CP"),
            F.col(f"{metric}_TARGET_PH_{h.ph}_CP_{h.cp}").alias("TARGET"),
            F.col(f"CHURN_PH_{h.ph}_CP_{h.cp}S").alias("CHURN"),
        )
        for h in horizons
    ]
    return labels.select(KEY, SCENARIO, F.inline(F.array(*cells)))


def scenario_totals(training: DataFrame, metric: str) -> DataFrame:
    """Control totals per scenario: rows, target amount and last-slot amount."""
    return training.groupBy(SCENARIO).agg(
        F.count(F.lit(1)).alias("N_ROWS"),
        F.sum(f"{metric}_TARGET_PH_1_CP_1").alias("TARGET_TOTAL"),
        F.sum(f"FF_{metric}_SUM_L1S").alias("LAST_SLOT_TOTAL"),
    )


def active_population(training: DataFrame, metric: str, length: int, prefix: str = "FF_") -> DataFrame:
    """Rows that still traded in the last ``length`` slots; a missing amount counts as active."""
    amount = F.col(f"{prefix}{metric}_SUM_L{length}S")
    return training.where(~F.coalesce(amount <= INACTIVE_BELOW, F.lit(False)))
