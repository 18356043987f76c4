import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import anomaly, bi

SCHEMA = "CUSTOMER_REPORTING_LEVEL string, DATE date, RN long, CUSTOMER_RL_COUNTRY_NAME string"
START = dt.date(2021, 1, 1)


def series(level, values, country="X"):
    return [(level, START + dt.timedelta(days=i), v, country) for i, v in enumerate(values)]


def test_zero_runs_start_after_the_first_trade(spark):
    frame = spark.createDataFrame(series("a", [0, 0, 3, 0, 0, 1, 0]), SCHEMA)
    rows = anomaly.zero_trading_runs(frame).orderBy("DATE").collect()
    assert [r.CONSECUTIVE_ZERO_TRADING_DAYS for r in rows] == [0, 0, 0, 1, 2, 0, 1]
    assert [r.GRP for r in rows] == [0, 0, 0, 1, 1, 0, 2]


def test_gate(spark):
    frame = spark.createDataFrame(series("a", [0, 5, 9]) + series("b", [7, 0, 0]) + series("c", [1, 20, 0]), SCHEMA)
    day = [START + dt.timedelta(days=i) for i in range(3)]
    traded = anomaly.gate_active(frame, (day[0], day[2]), (day[1], day[2]))
    assert {(r.CUSTOMER_REPORTING_LEVEL, r.RN_GATE) for r in traded.collect()} == {("a", 14), ("c", 20)}
    assert {r.CUSTOMER_REPORTING_LEVEL for r in anomaly.gate_active(frame, (day[0], day[2]), (day[1], day[2]), 14).collect()} == {"c"}


def test_rolling_windows_leave_the_day_out(spark):
    values = [(k * 7) % 11 for k in range(120)]
    rows = anomaly.rolling_stats(spark.createDataFrame(series("a", values), SCHEMA), False).orderBy("DATE").collect()
    assert rows[0].AVG_RN_12W is None and rows[1].STD_RN_12W is None
    past = values[100 - 84 : 100]
    assert rows[100].AVG_RN_12W == pytest.approx(statistics.mean(past))
    assert rows[100].STD_RN_12W == pytest.approx(statistics.stdev(past))
    same_day = [values[100 - 7 * k] for k in range(1, 13)]
    assert rows[100].AVG_RN_WEEKDAY12W == pytest.approx(statistics.mean(same_day))
    kept = anomaly.rolling_stats(spark.createDataFrame(series("a", values), SCHEMA))
    assert kept.count() == 120 - 14


def test_flat_history_is_never_flagged(spark):
    rows = spark.createDataFrame(series("a", [6] * 40), SCHEMA)
    scored = anomaly.country_day_probability(anomaly.nbinom_scores(anomaly.rolling_stats(rows)))
    flagged = anomaly.anomaly_flags(scored).collect()
    assert all(r.CDF_RN_12W_NBINOM is None and r.RN_FLAG_ALL is False and r.RN_WITH_FLAG is None for r in flagged)


def test_country_median_and_flags(spark):
    columns = (
        "CUSTOMER_REPORTING_LEVEL string, DATE date, RN long, CUSTOMER_RL_COUNTRY_NAME string, CDF_RN_12W_NBINOM double, "
        "CDF_RN_WEEKDAY12W_NBINOM double, CDF_RN_WEEKDAY12W_NBINOM_FLOOR double"
    )
    rows = [
        ("a", START, 1, "X", 0.001, 0.001, 0.001), ("b", START, 2, "X", 0.01, 0.5, 0.5), ("c", START, 3, "X", 0.9, 0.9, 0.9),
        ("d", START, 4, "X", 0.005, 0.004, None), ("e", START, 5, "Y", 0.001, 0.001, 0.002),
    ]
    out = {r.CUSTOMER_REPORTING_LEVEL: r for r in anomaly.anomaly_flags(
        anomaly.country_day_probability(spark.createDataFrame(rows, columns))).collect()}
    assert out["a"].AVG_COUNTRY_DAY_PROB == 0.5 and out["d"].AVG_COUNTRY_DAY_PROB == 0.5
    assert [out[k].RN_FLAG_ALL for k in "abcde"] == [True, False, False, True, False]
    assert out["a"].RN_WITH_FLAG == 1 and out["b"].CDF_RN_12W_NBINOM_FLAG is True
    assert bi.flag_combinations(spark.createDataFrame(list(out.values()))).count() == 4


def test_p80_exact_and_approximate(spark):
    rows = [("a", True, False, START, v) for v in (1, 2, 3, 4, 10)]
    frame = spark.createDataFrame(
        rows, "CUSTOMER_RL_COUNTRY_NAME string, CUSTOMER_RL_BL_RETAIL boolean, CUSTOMER_RL_WHOLESALE boolean, DATE date, RN long"
    )
    assert anomaly.country_p80(frame).first().P80_RN_COUNTRY == pytest.approx(5.2)
    assert anomaly.country_p80(frame, approximate=True).first().P80_RN_COUNTRY in (4.0, 10.0)


def test_profile_types_and_extract(spark):
    frame = spark.createDataFrame(series("a", [0, 4, 0]) + series("b", [1, 1, 1], "Y"), SCHEMA)
    profile = anomaly.customer_profile(anomaly.zero_trading_runs(frame), ["CUSTOMER_RL_COUNTRY_NAME"])
    row = profile.where(F.col("CUSTOMER_REPORTING_LEVEL") == "a").first()
    assert (row.SUM_RN, row.MAX_CONSECUTIVE_ZERO_TRADING_DAYS) == (4, 1) and row.AVG_RN == pytest.approx(4 / 3)
    assert dict(anomaly.daily_typed(frame).dtypes)["RN"] == "int"
    assert anomaly.entity_extract(frame, "b").count() == 3


def test_moving_sums_equal_frames_over_many_days(spark):
    """10,000 days of a key with gaps in the values: the same as frames of 84 rows, summed row by row."""
    days = spark.range(20_000).select(
        (F.col("id") % 2).alias(anomaly.LEVEL),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("DATE"),
        F.when(F.col("id") % 37 != 0, (F.rand(2) * 1_000_000).cast("long")).alias("RN"),
    )
    days = spark.createDataFrame(days.collect(), days.schema)
    got = anomaly.rolling_stats(days, require_history=False)
    plain = anomaly.rolling_stats(days.withColumn("RN", F.col("RN").cast("double")), require_history=False)
    assert got.columns == plain.columns
    key = lambda r: (r[anomaly.LEVEL], r.DATE)
    for a, b in zip(sorted(got.collect(), key=key), sorted(plain.collect(), key=key), strict=True):
        for c in got.columns[3:]:
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or a[c] == pytest.approx(b[c], rel=1e-9))


@pytest.mark.parametrize("accuracy", [10, 200, 10_000])
def test_sketched_percentile_keeps_its_rank_error(spark, accuracy):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("C"),
        F.floor(F.pow(F.rand(7), 3) * 5_000).cast("long").alias("RN"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    found = anomaly.country_p80(rows, ["C"], approximate=True, accuracy=accuracy)
    errors = anomaly.rank_error(rows, found, ["C"]).collect()
    assert len(errors) == 8 and sum(r.N_ROWS for r in errors) == 30_000
    assert all(r.RANK_ERROR <= 1 / accuracy for r in errors)
    exact = {r.C: r.P80_RN_COUNTRY for r in anomaly.country_p80(rows, ["C"]).collect()}
    if accuracy == 10_000:
        assert all(abs(r.P80_RN_COUNTRY - exact[r.C]) < 20 for r in found.collect())
