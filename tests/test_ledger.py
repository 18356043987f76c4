import datetime as dt

import pytest

from ebbtide.operators import ledger

M = dt.date(2001, 7, 1)
BREAK = dt.date(2001, 5, 1)
PERIOD = ledger.Period((M,))
LEDGER = "ID_CUSTOMER_BRANCH string, CUSTOMER_REPORTING_LEVEL string, BOOKING_DATE date, RN long, GROSS_SALES double"
DISPUTES = (
    "ID_CUSTOMER_BRANCH string, CUSTOMER_REPORTING_LEVEL string, DATE date, BOOKINGS_WITH_CASES_OPS long, "
    "BOOKINGS_WITH_CASES_SALES long, BOOKINGS_WITH_CASES_FINANCE long, DISPUTED_AMOUNT_EUR_CASES_FINANCE double"
)
MARKUPS = (
    "ID_CUSTOMER_BRANCH string, CUSTOMER_REPORTING_LEVEL string, BOOKING_DATE date, MARKUP double, CHANNEL_MARKUP double"
)


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def book(spark):
    rows = [
        ("1", "A", d("2000-01-10"), 4, 40.0),
        ("1", "A", d("2000-01-10"), 1, 10.0),
        ("1", "A", d("2000-07-01"), 3, 30.0),
        ("1", "A", d("2001-04-30"), 1, 10.0),
        ("1", "A", d("2001-05-01"), 9, 90.0),
        ("1", "A", d("1999-07-01"), 99, 99.0),  # first day outside the 24 months
        ("2", "A", d("2001-01-05"), 2, 20.0),  # one booking date: slope of a single point
        ("3", "A", d("2001-06-15"), 5, 50.0),  # nothing before the break
        ("4", None, d("2001-01-05"), 5, 50.0),  # NULL key
        ("5", "B", d("2000-03-01"), 5, 50.0),  # nothing in the last twelve months
    ]
    return spark.createDataFrame(rows, LEDGER)


def test_base_windows(book):
    base = {(r.PK, r.BOOKING_DATE): r for r in ledger.base_ledger(book, PERIOD).collect()}
    assert {pk for pk, _ in base} == {"1 | A", "2 | A", "3 | A", "5 | B"}
    first, second = base[("1 | A", d("2000-01-10"))], base[("1 | A", d("2000-07-01"))]
    assert (first.RN_, first.R, first.DIFF_DAYS, first.DAY_LAG) == (5, 1, 0, d("2000-01-10"))
    assert (second.R, second.DIFF_DAYS) == (2, (d("2000-07-01") - d("2000-01-10")).days)
    age = (BREAK - d("2000-01-10")).days
    assert first.TIME_FROM_FIRST_BOOKING == age and first.SPLIT_TIME == int(age / 4 + 0.5)
    assert (first.TIME, second.TIME, base[("1 | A", d("2001-05-01"))].TIME) == ("T1", "T2", "T4")


def test_features_label_and_having(book):
    base = ledger.base_ledger(book, PERIOD)
    rows = {r.PK: r for r in ledger.ledger_features(base).collect()}
    assert set(rows) == {"1 | A", "2 | A"}
    one = rows["1 | A"]
    assert (one.DATES, one.DATES_L2M, one.DATES_L12M) == (3, 1, 2)
    assert (one.RN, one.RN_L2M, one.RN_L12M, one.RN_LXM_TODAY) == (9, 1, 4, 9)
    assert one.TIME_FROM_LAST_BOOKING == 1 and one.RN_BY_BOOKING_DATES == 3.0
    assert one.SLOPE_RN == pytest.approx(-2.0)
    assert rows["2 | A"].SLOPE_RN == 0.0 and rows["2 | A"].RN_LXM_TODAY == 0
    label = {r.PK: r.RN_LXM_TODAY for r in ledger.ledger_label(base).collect()}
    assert label == {"1 | A": 9, "2 | A": 0, "3 | A": 5, "5 | B": 0}


def test_case_counters_are_not_swapped_and_stop_at_the_break(spark):
    rows = [
        ("1", "A", d("2001-04-10"), 7, 1, 0, 2.5),
        ("1", "A", d("2001-04-10"), 1, 0, 0, 1.5),
        ("1", "A", d("2000-02-10"), 1, 1, 1, None),
        ("1", "A", d("2001-05-02"), 50, 50, 50, 50.0),
    ]
    row = ledger.dispute_features(spark.createDataFrame(rows, DISPUTES), PERIOD).first()
    assert (row.BOOKINGS_WITH_CASES_OPS, row.BOOKINGS_WITH_CASES_OPS_L2M) == (9, 8)
    assert (row.BOOKINGS_WITH_CASES_SALES, row.BOOKINGS_WITH_CASES_SALES_L12M) == (2, 1)
    assert (row.DISPUTED_AMOUNT_EUR_CASES_FINANCE, row.BOOKINGS_WITH_CASES_FINANCE_L2M) == (4.0, 0)


def test_markup_averages_rows_not_days(spark):
    rows = [
        ("1", "A", d("2001-04-10"), 0.1, None), ("1", "A", d("2001-04-10"), 0.4, None), ("1", "A", d("2000-02-10"), 1.0, None)
    ]
    row = ledger.markup_features(spark.createDataFrame(rows, MARKUPS), PERIOD).first()
    assert row.MARKUP == pytest.approx(0.5) and row.MARKUP_L2M == pytest.approx(0.25) and row.CHANNEL_MARKUP == 0.0


def test_months_are_independent(spark, book):
    none = spark.createDataFrame([], DISPUTES), spark.createDataFrame([], MARKUPS)
    months = (d("2001-06-01"), M)
    both = ledger.ledger_table(book, *none, ledger.Period(months))
    for month in months:
        alone = ledger.ledger_table(book, *none, ledger.Period((month,)))
        assert sorted(alone.collect()) == sorted(both.where(both.ETL == month).collect())
    row = both.where((both.ETL == M) & (both.PK == "1 | A")).first()
    assert (row.CHURN_L2M, row.CHURN, row.CHURN_VARIATION) == (False, False, "NOT_C_L2M__NOT_C")
    assert row.MARKUP is None


def test_reference_months():
    assert ledger.reference_months(d("2001-01-15"), d("2001-03-14")) == [d("2001-01-15"), d("2001-02-15")]
