import datetime as dt

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import bi, panel


def month(k):
    return dt.date(2021 + (k - 1) // 12, (k - 1) % 12 + 1, 1)


@pytest.fixture(scope="module")
def activity(spark):
    rows = [
        ("L", "b1", dt.date(2021, 1, 5), 4, 2, 1, "C", 0.2), ("L", "b1", dt.date(2021, 1, 20), 0, 2, 0, None, 0.4),
        ("L", "b1", dt.date(2021, 2, 1), 0, 0, 0, None, None), ("L", "b2", dt.date(2021, 1, 3), 9, 1, 1, "P", None),
        ("K", "b3", dt.date(2021, 1, 3), 1, 1, 1, "C & P", None),
    ]
    return spark.createDataFrame(
        rows,
        "CUSTOMER_REPORTING_LEVEL string, ID_CUSTOMER_BRANCH string, DATE date, RN long, SEARCHES long, FAILED long, PAY string, MARKUP double",
    )


def test_monthly_roll_up(activity):
    out = panel.monthly_panel(activity, ["RN"], {"AVG_MARKUP": "MARKUP"}, {"PCT": ("FAILED", "SEARCHES")}, payment="PAY")
    rows = {(r.ID_CUSTOMER_BRANCH, r.DATE_MONTH.month): r for r in out.collect()}
    one, quiet = rows[("b1", 1)], rows[("b1", 2)]
    assert (one.RN, one.PCT, one.IS_CHURNED, one.PAYMENT_CREDIT, one.PAYMENT_PREPAYMENT) == (4, 0.25, False, True, False)
    assert one.AVG_MARKUP == pytest.approx(0.3) and one.MONTH_NUMBER == 1
    assert (quiet.PCT, quiet.IS_CHURNED, quiet.PAYMENT_CREDIT) == (None, True, False)
    assert rows[("b3", 1)].PAYMENT_CREDIT and rows[("b3", 1)].PAYMENT_PREPAYMENT


def test_volume_filter_needs_both_totals(activity):
    kept = panel.volume_filter(activity, {"CUSTOMER_REPORTING_LEVEL": 5, "ID_CUSTOMER_BRANCH": 5})
    assert {r.ID_CUSTOMER_BRANCH for r in kept.collect()} == {"b2"}


@pytest.fixture(scope="module")
def months(spark):
    rows = [("L", b, month(k), k + (100 if b == "y" else 0), k % 3 == 0) for b in "xy" for k in range(1, 15)]
    return spark.createDataFrame(
        rows, "CUSTOMER_REPORTING_LEVEL string, ID_CUSTOMER_BRANCH string, DATE_MONTH date, RN long, IS_CHURNED boolean"
    )


def test_lags_stay_in_the_branch_unless_asked(months):
    own = panel.add_lags(months, ["RN"], [1, 2]).where("ID_CUSTOMER_BRANCH = 'y'").orderBy("DATE_MONTH").collect()
    assert (own[0].RN_LAG_1, own[2].RN_LAG_2) == (None, 101)
    across = panel.add_lags(months, ["RN"], [1], keys=["CUSTOMER_REPORTING_LEVEL"], order=["ID_CUSTOMER_BRANCH", "DATE_MONTH"])
    assert across.where("ID_CUSTOMER_BRANCH = 'y'").orderBy("DATE_MONTH").first().RN_LAG_1 == 14


def test_rolling_mean_leaves_the_month_out(months):
    rows = panel.add_rolling_mean(months).where("ID_CUSTOMER_BRANCH = 'x'").orderBy("DATE_MONTH").collect()
    assert rows[0].AVG_MONTHLY_RN_12M is None and rows[13].AVG_MONTHLY_RN_12M == pytest.approx(sum(range(2, 14)) / 12)


def test_leakage_split_cases_and_churn(months):
    lagged = panel.add_lags(months, ["RN"])
    assert panel.drop_leakage(lagged, ["RN", "IS_CHURNED"]).columns[3:] == ["IS_CHURNED", "RN_LAG_1", "RN_LAG_2", "RN_LAG_3"]
    assert panel.complete_cases(lagged).count() == 2 * 11
    sides = panel.split_by_date(months, month(3), month(13)).groupBy("SPLIT").count().collect()
    assert {r.SPLIT: r["count"] for r in sides} == {"train": 20, "test": 4}
    new = panel.newly_churned(months).where("ID_CUSTOMER_BRANCH = 'x'").collect()
    assert {r.DATE_MONTH for r in new} == {month(k) for k in (3, 6, 9, 12)}


def test_ratios_and_unknown_flags(spark):
    frame = spark.createDataFrame([(4.0, 0.5, True), (4.0, None, None), (6.0, 3.0, False)], "A double, B double, F boolean")
    assert [r.P_A for r in panel.add_ratios(frame, {"A": "B"}).collect()] == [4.0, 4.0, 2.0]
    assert panel.retail_population(frame, "F").count() == 2


DAILY = "CUSTOMER_REPORTING_LEVEL string, CUSTOMER_RL_NAME string, DATE date, RN long, AREA string"


@pytest.fixture(scope="module")
def daily(spark):
    rows = [
        ("a", "n1", dt.date(2021, 1, 1), 5, "APAC LT"), ("a", "n1", dt.date(2021, 1, 2), 1, "APAC LT"),
        ("b", "n2", dt.date(2021, 1, 1), 6, None), ("c", "n3", dt.date(2021, 1, 1), 2, "Global"),
        ("c", "n4", dt.date(2021, 1, 1), 1, "Americas Core"),
    ]
    return spark.createDataFrame(rows, DAILY)


def test_members_and_attributes(daily):
    assert bi.member_filter(daily, "AREA", exclude=["Global"]).count() == 4
    assert bi.member_filter(daily, "AREA", include=["Global", "APAC LT"]).count() == 3
    got = {r.CUSTOMER_REPORTING_LEVEL: (r.CUSTOMER_RL_NAME, r.AREA) for r in bi.attribute(
        daily, ["CUSTOMER_REPORTING_LEVEL"], ["CUSTOMER_RL_NAME", "AREA"]).collect()}
    assert got == {"a": ("n1", "APAC LT"), "b": ("n2", None), "c": ("*", "*")}


def test_rank_shares_the_first_place(daily):
    ranks = {r.CUSTOMER_REPORTING_LEVEL: r.RN_RANK for r in bi.customer_rank(daily).collect()}
    assert ranks == {"a": "1", "b": "1", "c": "3"}


def test_profile_is_not_fanned_out(spark, daily):
    profile = spark.createDataFrame([("a", 6), ("b", 6)], "CUSTOMER_REPORTING_LEVEL string, SUM_RN long")
    rows = {r.CUSTOMER_REPORTING_LEVEL: r for r in bi.profile_daily(profile, daily).collect()}
    assert (rows["a"].SUM_RN, rows["a"].DAILY_RN, rows["a"].N_DAYS, rows["a"].PEAK_RN) == (6, 6, 2, 5)


def test_bins_measures_and_averages(spark, daily):
    profile = daily.withColumn("AVG_RN", F.col("RN").cast("double"))
    rows = [(r.AREA_GROUP, r.LT_ACTIVE) for r in bi.area_bins(profile, "AREA").collect()]
    assert rows == [("LT", True), ("LT", False), ("Others", False), ("Others", False), ("Core", False)]
    long = bi.measures_long(bi.daily_measures(daily, {"A": "RN", "B": "RN"}), ["A", "B"])
    assert long.count() == 10 and {r.MEASURE for r in long.collect()} == {"A", "B"}
    assert bi.reference_average(daily, "RN").first().REFERENCE == 3.0


def test_power_trend_recovers_the_curve(spark):
    rows = [(float(x), 3.0 * x**-0.5) for x in range(1, 9)] + [(0.0, 5.0)]
    fit = bi.power_trend(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert (fit.A, fit.B, fit.N_POINTS) == (pytest.approx(3.0), pytest.approx(-0.5), 8)
