import datetime as dt

import pytest

from ebbtide.operators.months import month_features, month_starts, shift_months
from ebbtide.plans.spec import Fn, line

SCHEMA = "PK string, DATE date, GROSS_SALES double, RN long, SEEN date"
LINES = [
    line("RN", Fn.SUM, [1, 12]),
    line("GROSS_SALES", Fn.AVG, [1, 12]),
    line("SEEN", [Fn.ISNULL, Fn.DIFF_DATE_MAX], [12]),
]


def daily(first, last):
    days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
    return [("a", d, float(d.day), d.month, d if d.day == 5 else None) for d in days]


def expected(rows, mx, months_break=1):
    brk = shift_months(mx, -months_break)
    one, year = shift_months(brk, -1), shift_months(brk, -12)
    inside = lambda lo, hi: [r for r in rows if lo < r[1] <= hi]
    mean = lambda rs: sum(r[2] for r in rs) / len(rs)
    return {
        "RN_SUM_L1M": float(sum(r[3] for r in inside(one, brk))),
        "RN_SUM_L12M": float(sum(r[3] for r in inside(year, brk))),
        "GROSS_SALES_MEAN_L1M": mean(inside(one, brk)),
        "GROSS_SALES_MEAN_L12M": mean(inside(year, brk)),
        "SEEN_DIFF_DATE_MAX_L12M": (brk - max(r[4] for r in inside(year, brk) if r[4])).days,
        "GROSS_SALES_TARGET": sum(r[2] for r in inside(brk, mx)),
    }


@pytest.mark.parametrize("months_break", [1, 2])
def test_windows_follow_month_arithmetic(spark, months_break):
    rows = daily(dt.date(2019, 1, 1), dt.date(2021, 6, 30))
    scenarios = [dt.date(2021, 3, 1), dt.date(2021, 1, 1), dt.date(2020, 12, 15), dt.date(2021, 3, 31), dt.date(2020, 5, 30)]
    out = month_features(spark.createDataFrame(rows, SCHEMA), LINES, scenarios, months_break)
    found = {r["SCENARIO_DATE"]: r for r in out.collect()}
    assert found.keys() == set(scenarios)
    for day in scenarios:
        for name, value in expected(rows, day, months_break).items():
            assert found[day][name] == pytest.approx(value), (day, name)
        assert found[day]["CHURN"] is False


def test_month_shift_clips():
    assert shift_months(dt.date(2022, 3, 31), -1) == dt.date(2022, 2, 28)
    assert shift_months(dt.date(2022, 1, 31), 1) == dt.date(2022, 2, 28)
    assert shift_months(dt.date(2022, 1, 15), -13) == dt.date(2020, 12, 15)


def test_month_starts_newest_first():
    got = month_starts(dt.date(2021, 11, 1), dt.date(2022, 2, 20))
    assert got == [dt.date(2022, 2, 1), dt.date(2022, 1, 1), dt.date(2021, 12, 1), dt.date(2021, 11, 1)]
    assert month_starts(dt.date(2021, 11, 2), dt.date(2021, 12, 1)) == [dt.date(2021, 12, 1)]


def test_key_needs_rows_in_every_window(spark):
    rows = daily(dt.date(2020, 1, 1), dt.date(2021, 2, 10))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert month_features(frame, LINES, [dt.date(2021, 3, 1)]).count() == 1
    assert month_features(frame, LINES, [dt.date(2021, 4, 1)]).count() == 0
