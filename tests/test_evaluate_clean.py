import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import clean, evaluate, publish
from ebbtide.operators.select import correlated_pairs, drop_correlated


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        score = round(rng.random(), 1)
        rows.append((k, rng.random() < score, score))
    return spark.createDataFrame(rows, "PK long, TARGET boolean, PROBA double")


def pairwise_auc(rows):
    pos = [r.PROBA for r in rows if r.TARGET]
    neg = [r.PROBA for r in rows if not r.TARGET]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_counts_ties_as_half(scored):
    assert evaluate.roc_auc(scored).first().ROC_AUC == pytest.approx(pairwise_auc(scored.collect()))
    by = evaluate.roc_auc(scored.withColumn("g", F.col("PK") % 2), by=["g"])
    for row in by.collect():
        assert row.ROC_AUC == pytest.approx(pairwise_auc([r for r in scored.collect() if r.PK % 2 == row.g]))


def test_auc_extremes(spark):
    schema = "TARGET boolean, PROBA double"
    assert evaluate.roc_auc(spark.createDataFrame([(True, 0.9), (False, 0.1)], schema)).first().ROC_AUC == 1.0
    assert evaluate.roc_auc(spark.createDataFrame([(True, 0.5), (False, 0.5)], schema)).first().ROC_AUC == 0.5
    assert evaluate.roc_auc(spark.createDataFrame([(True, 0.5)], schema)).first().ROC_AUC is None


def test_thinned_curve_keeps_the_shape(spark, scored):
    full = evaluate.roc_curve(scored, thin=False).collect()
    assert len(full) == scored.select("PROBA").distinct().count() + 1
    schema = "TARGET boolean, PROBA double"
    line = [(t, s) for s in (0.9, 0.8, 0.7) for t in (True, False)] + [(True, 0.6)]
    thin = evaluate.roc_curve(spark.createDataFrame(line, schema)).where("THRESHOLD IS NOT NULL").collect()
    assert sorted(r.THRESHOLD for r in thin) == [0.6, 0.7]
    points = {r.REQUESTED: r.THRESHOLD for r in evaluate.roc_points(evaluate.roc_curve(scored, thin=False), [0.55, 0.0]).collect()}
    assert points == {0.55: 0.6, 0.0: 0.0}


def test_cells_and_metrics(scored):
    rows = scored.collect()
    cells = evaluate.confusion_matrix(scored, threshold=0.6)
    got = cells.first()
    assert got.TP == sum(r.TARGET and r.PROBA >= 0.6 for r in rows) and got.TN + got.FP + got.FN + got.TP == 400
    metrics = evaluate.classification_metrics(cells).first()
    assert metrics.ACCURACY == (got.TP + got.TN) / 400 and metrics.POSITIVE_ACCURACY == got.TP / (got.TP + got.FP)
    none = evaluate.classification_metrics(evaluate.confusion_matrix(scored, threshold=2.0)).first()
    assert none.POSITIVE_ACCURACY is None
    assert evaluate.high_risk_hits(scored).count() == sum(r.TARGET and r.PROBA >= 0.75 for r in rows)


def test_outlier_trim_and_reports(spark):
    rows = [(f"k{i % 50}", float(i), i % 4 == 0) for i in range(200)] + [("z", None, True)]
    frame = spark.createDataFrame(rows, "PK string, V double, CHURN boolean")
    lo, hi = np.quantile(range(200), [0.55, 0.998])
    assert {r.V for r in clean.outlier_trim(frame, "V").collect()} == {float(i) for i in range(200) if lo < i < hi}
    stages = clean.trim_stages(frame, "V")
    status = {r.STAGE: (r.N_ROWS, r.N_KEYS) for r in clean.dataset_status(frame, stages).collect()}
    assert status["loaded"] == (201, 51) and status["upper_end"] == (1, 1) and status["lower_end"] == (110, 50)
    assert status["lower_removed"][0] == 89
    effect = {r.STAGE: r.CHURN_PROBABILITY for r in clean.removal_effect(frame, stages).collect()}
    assert effect["upper_end"] == 0.0 and effect["lower_end"] == round(28 / 110, 2)


def test_time_split(spark):
    frame = spark.createDataFrame([(k, s) for k in range(3) for s in (5, 6, 7, 8)], "PK long, SCENARIO_DATE int")
    newest = clean.split_newest(frame).where("SPLIT = 'test'").select("SCENARIO_DATE").distinct().collect()
    assert {r[0] for r in newest} == {5, 6}
    latest = clean.split_newest(frame, newest_is_smallest=False).where("SPLIT = 'test'").select("SCENARIO_DATE").distinct()
    assert {r[0] for r in latest.collect()} == {7, 8}


def test_balance_weights_and_folds(spark):
    kinds = ["C_L2M__C"] * 20 + ["NOT_C_L2M__NOT_C"] * 3 + ["C_L2M__NOT_C"] * 5 + ["NOT_C_L2M__C"] * 6
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "PK long, V string")
    got = {r.V: r["count"] for r in clean.balance_classes(frame, "V", [F.col("PK")]).groupBy("V").count().collect()}
    assert got == {"C_L2M__C": 5, "NOT_C_L2M__NOT_C": 3, "C_L2M__NOT_C": 5, "NOT_C_L2M__C": 6}
    labels = spark.createDataFrame([(i, i < 10) for i in range(40)], "PK long, T boolean")
    weights = {r.T: r.WEIGHT for r in clean.class_weights(labels, "T").collect()}
    assert weights == {True: 2.0, False: pytest.approx(40 / 60)}
    folds = clean.stratified_folds(labels, "T", [F.col("PK")], 5).groupBy("FOLD", "T").count().collect()
    assert {(r.FOLD, r.T): r["count"] for r in folds} == {(f, t): (2 if t else 6) for f in range(5) for t in (True, False)}


def test_column_profile(spark):
    values = [1.0, 2.0, 2.0, 4.0, 11.0, None]
    frame = spark.createDataFrame([(v, 7) for v in values], "A double, B int")
    rows = {r.COLUMN: r for r in clean.column_profile(frame, ["A", "B"], bins=5).collect()}
    a, b = rows["A"], rows["B"]
    assert (a.N, a.N_MISSING, a.N_DISTINCT, a.MIN, a.MAX, a.MEAN, a.MEDIAN) == (5, 1, 4, 1.0, 11.0, 4.0, 2.0)
    assert a.STD == pytest.approx(np.std([1, 2, 2, 4, 11], ddof=1)) and list(a.HISTOGRAM) == [3, 1, 0, 0, 1]
    assert (b.N, b.N_DISTINCT, b.STD) == (6, 1, 0.0) and list(b.HISTOGRAM) == [6, 0, 0, 0, 0]


def test_correlated_pairs_use_pairwise_complete_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 10, 300)
    data = {"a": x, "b": x + rng.normal(0, 2, 300), "c": -x, "d": x * 2, "e": rng.normal(0, 1, 300)}
    rows = [tuple(None if (i + j) % 7 == 0 and j < 2 else float(col[i]) for j, col in enumerate(data.values())) for i in range(300)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    import pandas as pd

    expected = pd.DataFrame(rows, columns=list(data)).corr()
    got = {(r.VARIABLE_1, r.VARIABLE_2): r.CORRELATION for r in correlated_pairs(frame, list(data)).collect()}
    assert set(got) == {("a", "b"), ("b", "d")}
    assert got[("a", "b")] == pytest.approx(expected.loc["a", "b"], rel=1e-9)
    kept = drop_correlated(["a", "b", "c", "d", "e"], correlated_pairs(frame, list(data)), 2, ["e", "a"])
    assert kept == ["a", "c", "e"]


def test_publish_joins_on_keys_and_ranks(spark):
    flags = {f"CHURN_PH_{p}_CP_4S": p == 1 for p in (1, 2, 3, 4)}
    rows = [{"PK": k, "SCENARIO_DATE": 4, "FF_ONE_OM_SUM_L13S": m, **flags} for k, m in (("a", 5.0), ("b", 5.0), ("c", 1.0))]
    today = spark.createDataFrame(rows)
    scores = {p: today.select("PK", "SCENARIO_DATE", F.lit(p / 10).alias("PROBA")) for p in (4, 3, 2, 1)}
    out = {r.PK: r for r in publish.publish_wide(today, scores, ["FF_ONE_OM_SUM_L13S"]).collect()}
    assert (out["a"].RANK, out["b"].RANK, out["c"].RANK) == (2, 2, 3)
    assert (out["a"].PROBA_4S, out["a"].CHURN_1S, out["a"].CHURN_4S) == (0.4, True, False)
    sample = publish.upload_sample(today.selectExpr("*", "true AS CHURN", "0.5D AS PROBA"), 2)
    assert [r.PK for r in sample.collect()] == ["a", "b"] and dict(sample.dtypes)["SCENARIO_DATE"] == "string"


def test_profile_of_all_types(spark):
    day = dt.date
    rows = [
        ("b", day(2024, 1, 1), True, 1.5), ("a", day(2024, 1, 2), False, 2.5), ("a", day(2024, 3, 1), None, None),
        ("b", None, True, 2.5), (None, day(2024, 1, 2), True, 0.5), ("", day(2024, 1, 1), None, 0.5),
    ]
    frame = spark.createDataFrame(rows, "t string, d date, f boolean, x double")
    got = {r.COLUMN: r for r in clean.mixed_profile(frame, ["t", "d", "f", "x"]).collect()}
    text, date, flag, number = (got[c] for c in "tdfx")
    assert (text.N, text.N_MISSING, text.N_DISTINCT, text.LEAST, text.MOST) == (5, 1, 3, "", "b")
    assert (text.TOP_VALUE, text.TOP_COUNT, text.MEAN_LENGTH) == ("a", 2, 0.8) and text.TRUE_SHARE is None
    assert (date.LEAST, date.MOST, date.LONGEST_GAP, date.TOP_VALUE) == ("2024-01-01", "2024-03-01", 59, "2024-01-01")
    assert (flag.N, flag.TRUE_SHARE, flag.LONGEST_GAP) == (4, 0.75, None)
    assert (number.N, number.N_DISTINCT, number.LEAST, number.KIND) == (5, 3, None, "number")
    assert clean.mixed_profile(frame.where("false"), ["t"]).count() == 0
    nothing = clean.mixed_profile(frame.where("t IS NULL"), ["t"]).first()
    assert (nothing.N, nothing.N_MISSING, nothing.TOP_VALUE, nothing.MEAN_LENGTH) == (0, 1, None, None)
