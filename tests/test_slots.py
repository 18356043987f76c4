import datetime as dt
import random

import pytest

from ebbtide.operators import slots
from ebbtide.plans.spec import Fn, column_name, horizons, line

DAY0 = dt.date(2001, 8, 1)
SCHEMA = (
    "PK string, TIME_SLOT int, DATE_TIME_SLOT date, GROSS_SALES double, GROSS_COMMERCIAL_COST double, RN long, "
    "MARKUP double, FIRST date, LAST date, REGION string"
)
LINES = [
    line("GROSS_SALES", Fn.SUM, [1, 2, 3, 4, 13]),
    line("RN", [Fn.SUM, Fn.MIN, Fn.MAX], [1, 4, 13]),
    line("RN", Fn.SUM, [1, 3, 13], "only"),
    line("MARKUP", Fn.AVG, [1, 2, 13]),
    line("MARKUP", Fn.AVG, [2], "only"),
    line("MARKUP", [Fn.ISNULL, Fn.SUM], [2]),
    line("FIRST", [Fn.ISNULL, Fn.DIFF_DATE_MIN], [1, 13]),
    line("LAST", Fn.DIFF_DATE_MAX, [1, 13]),
    line("REGION", Fn.MAX, [1, 4]),
]


def slot_date(slot):
    return DAY0 - dt.timedelta(days=91 * slot)


def fact(pk, slot, sales=0.0, rn=0, markup=None, first=None, last=None, region="R"):
    return (pk, slot, slot_date(slot), sales, sales * 2 if sales is not None else None, rn, markup, first, last, region)


def random_facts(seed, per_slot):
    rng = random.Random(seed)
    rows = []
    for k in range(12):
        for slot in range(0, 24):
            for _ in range(per_slot if k else 1):
                if rng.random() < (0.95 if k < 9 else 0.6):
                    day = slot_date(slot) - dt.timedelta(days=rng.randrange(90))
                    some = rng.random() < 0.6
                    rows.append(
                        fact(
                            f"k{k}", slot, rng.choice([None, 0.0, 12.5, 100.25]), rng.choice([None, 0, 3, 8]),
                            rng.choice([None, 0.1, 0.25]), day if some else None, day if some else None,
                            rng.choice([None, "A", "B"]),
                        )
                    )
    return rows


def brute_force(rows, lines, pairs, metric, scenarios):
    """Definition applied row by row: filter the window, then aggregate."""
    position = {n: i for i, n in enumerate(["PK", "TIME_SLOT", "DATE_TIME_SLOT", "GROSS_SALES", "GROSS_COMMERCIAL_COST",
                                            "RN", "MARKUP", "FIRST", "LAST", "REGION"])}
    out = {}
    for m in scenarios:
        for pk in {r[0] for r in rows}:
            mine = [(r[1] - m + 4, r) for r in rows if r[0] == pk and r[1] >= m - 4]

            def values(metric, low, high, mine=mine):
                inside = [r for s, r in mine if low <= s <= high]
                return inside, [r[position[metric]] for r in inside if r[position[metric]] is not None]

            row, present = {}, True
            for item in lines:
                for n in item.lengths:
                    low = 4 if item.mode == "agg" else 4 + n - 1
                    inside, known = values(item.metric, low, 4 + n - 1)
                    present &= bool(inside)
                    for fn in item.functions:
                        if fn is Fn.ISNULL:
                            continue
                        name = column_name(item.metric, fn, n, item.mode)
                        if fn is Fn.SUM:
                            row[name] = float(sum(known)) if known or Fn.ISNULL not in item.functions else None
                        elif fn is Fn.AVG:
                            row[name] = sum(known) / len(known) if known else None
                        elif fn in (Fn.MIN, Fn.MAX):
                            row[name] = (min if fn is Fn.MIN else max)(known) if known else None
                        else:
                            pick = min if fn is Fn.DIFF_DATE_MIN else max
                            row[name] = (slot_date(m) - pick(known)).days if known else None
            for h in pairs:
                inside, known = values(metric, h.last_slot, h.first_slot)
                present &= bool(inside)
                row[f"{metric}_TARGET_PH_{h.ph}_CP_{h.cp}"] = float(sum(known))
                row[f"CHURN_PH_{h.ph}_CP_{h.cp}S"] = sum(known) < 0.005
            present &= any(s == 4 for s, _ in mine)
            if present:
                out[(pk, m)] = row
    return out


@pytest.mark.parametrize("per_slot,unique", [(1, True), (1, False), (3, False)])
@pytest.mark.parametrize("model,metric", [("CLIENT", "GROSS_SALES"), ("HOTEL", "GROSS_COMMERCIAL_COST")])
def test_engine_matches_the_definition(spark, per_slot, unique, model, metric):
    rows = random_facts(per_slot, per_slot)
    if unique:
        rows = list({(r[0], r[1]): r for r in rows}.values())
    frame = spark.createDataFrame(rows, SCHEMA)
    got = slots.slot_features(frame, LINES, horizons(), model, (4, 5, 6), one_row_per_slot=unique)
    expected = brute_force(rows, LINES, horizons(), metric, (4, 5, 6))
    found = {(r["PK"], r["SCENARIO_DATE"]): r.asDict() for r in got.collect()}
    assert found.keys() == expected.keys() and len(found) > 5
    for key, row in expected.items():
        for name, value in row.items():
            assert found[key][name] == (pytest.approx(value) if isinstance(value, float) else value), (key, name)


def test_all_null_sales_count_as_zero_and_churned(spark):
    frame = spark.createDataFrame([fact("a", s, None) for s in range(8)], SCHEMA)
    row = slots.slot_features(frame, [line("GROSS_SALES", Fn.SUM, [1])], horizons()).first()
    assert row["FF_GROSS_SALES_SUM_L1S"] == 0.0
    assert row["GROSS_SALES_TARGET_PH_4_CP_4"] == 0.0 and row["CHURN_PH_4_CP_4S"] is True


def test_null_keys_are_dropped_and_missing_slots_drop_the_key(spark):
    rows = [fact(None, s, 1.0) for s in range(8)] + [fact("a", s, 1.0) for s in range(8) if s != 2]
    rows += [fact("b", s, 1.0) for s in range(8)]
    frame = spark.createDataFrame(rows, SCHEMA)
    lines = [line("GROSS_SALES", Fn.SUM, [1])]
    assert [r["PK"] for r in slots.slot_features(frame, lines, horizons()).collect()] == ["b"]
    assert {r["PK"] for r in slots.slot_features(frame, lines, horizons(), presence=False).collect()} == {"a", "b"}


def test_churn_limit_is_strict_but_population_limit_is_not(spark):
    frame = spark.createDataFrame([fact("a", s, 0.005) for s in range(8)], SCHEMA)
    out = slots.slot_features(frame, [line("GROSS_SALES", Fn.SUM, [1])], horizons())
    assert out.first()["CHURN_PH_1_CP_1S"] is False
    assert slots.active_population(out, "GROSS_SALES", 1).count() == 0


def test_missing_amount_counts_as_active(spark):
    frame = spark.createDataFrame([("a", None), ("b", 0.0), ("c", 3.0)], "PK string, FF_RN_SUM_L1S double")
    assert {r.PK for r in slots.active_population(frame, "RN", 1).collect()} == {"a", "c"}


def test_labels_long_and_totals(spark):
    frame = spark.createDataFrame([fact("a", s, float(s)) for s in range(20)], SCHEMA)
    lines = [line("GROSS_SALES", Fn.SUM, [1])]
    wide = slots.slot_features(frame, lines, horizons(), scenarios=(4, 5))
    long = slots.labels_long(wide, horizons(), "GROSS_SALES")
    assert long.count() == 32
    assert long.where("SCENARIO_DATE = 4 AND PH = 1 AND CP = 4").first()["TARGET"] == 3 + 4 + 5 + 6
    totals = {r.SCENARIO_DATE: r for r in slots.scenario_totals(wide, "GROSS_SALES").collect()}
    assert (totals[5].TARGET_TOTAL, totals[5].LAST_SLOT_TOTAL) == (4.0, 5.0)


def test_labels_only_grow_more_active_with_a_longer_churn_period(spark):
    frame = spark.createDataFrame(random_facts(7, 1), SCHEMA)
    rows = slots.slot_features(frame, [line("RN", Fn.SUM, [1, 2, 3])], horizons(), scenarios=(4, 5, 6)).collect()
    for row in rows:
        assert row["FF_RN_SUM_L1S"] <= row["FF_RN_SUM_L2S"] <= row["FF_RN_SUM_L3S"]
        for ph in range(1, 5):
            for cp in range(1, 4):
                assert not row[f"CHURN_PH_{ph}_CP_{cp + 1}S"] or row[f"CHURN_PH_{ph}_CP_{cp}S"]


def test_bands_cover_every_window_once():
    bands = slots.cut_bands([(0, 0), (0, 1), (0, 12), (12, 12), (-4, -1), (-1, 2)])
    assert bands == [(-4, -2), (-1, -1), (0, 0), (1, 1), (2, 2), (3, 11), (12, 12)]


def test_one_shuffle_of_the_facts(spark):
    frame = spark.createDataFrame(random_facts(1, 1), SCHEMA)
    out = slots.slot_features(frame, LINES, horizons(), scenarios=(4, 5, 6, 7, 8), one_row_per_slot=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    before = plan[plan.index("Exchange hashpartitioning") :]  # facts on their way to the key are not copied per scenario
    assert "Generate" not in before and "Window" not in plan


def test_presence_is_asked_of_the_innermost_spans_only(spark):
    assert slots.innermost([(0, 0), (0, 12), (-1, -1), (-2, -1), (-4, 0), (0, 0)]) == [(0, 0), (-1, -1)]
    assert slots.innermost([(0, 1), (1, 2)]) == [(0, 1), (1, 2)]
    frame = spark.createDataFrame(random_facts(1, 1), SCHEMA)
    out = slots.slot_features(frame, LINES[:2], horizons(), scenarios=(4, 5), one_row_per_slot=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    condition = next(x for x in plan if "Filter" in x and "_arrays" in x)
    assert condition.count("isnotnull") == 5  # the own slot and the four that the labels see
