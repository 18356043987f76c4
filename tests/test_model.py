import inspect
import math
import random
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import evaluate, model
from ebbtide.plans import registry

FEATURES = ["FF_SIGNAL", "FF_NOISE", "FF_REGION"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for k in range(600):
        signal = rng.random()
        data.append(
            (
                k, 4 + k % 4, signal if rng.random() < 0.9 else None, rng.random(), rng.choice(["EU", "US"]),
                rng.random() < (0.9 if signal > 0.5 else 0.1),
            )
        )
    return spark.createDataFrame(
        data, "PK long, SCENARIO_DATE int, FF_SIGNAL double, FF_NOISE double, FF_REGION string, CHURN boolean"
    ).persist()


@pytest.fixture(scope="module")
def fitted(rows):
    return model.fit(rows, "CHURN", FEATURES, model.classifier({"maxIter": 4, "maxDepth": 3}))


def test_scores_find_the_planted_signal(rows, fitted):
    scored = model.score(fitted, rows, "CHURN")
    assert scored.columns == ["PK", "SCENARIO_DATE", "TARGET", "PROBA", "PRED_TARGET"] and scored.count() == 600
    assert evaluate.roc_auc(scored).first().ROC_AUC > 0.8
    again = model.score(model.fit(rows, "CHURN", FEATURES, model.classifier({"maxIter": 4, "maxDepth": 3})), rows, "CHURN")
    assert sorted(again.collect()) == sorted(scored.collect())


def test_ranking_selection_and_batch(rows, fitted, tmp_path):
    ranking = model.importance_ranking(fitted, rows, FEATURES)
    assert ranking[0][0] == "FF_SIGNAL" and sum(v for _, v in ranking) == pytest.approx(1.0)
    chosen, _ = model.select_features(rows, "CHURN", FEATURES, ["FF_REGION"], model.classifier({"maxIter": 2}), keep=1)
    assert chosen == ["FF_SIGNAL", "FF_REGION"]
    model.save_model(fitted, str(tmp_path / "m"))
    assert sorted(model.score_batch(rows, str(tmp_path / "m")).collect()) == sorted(model.score(fitted, rows).collect())


def test_permutation_hurts_only_the_signal(rows, fitted):
    drops = {r.FEATURE: r.AUC_DROP for r in model.permutation_importance(fitted, rows, "CHURN", FEATURES).collect()}
    assert drops["FF_SIGNAL"] > 0.2 and abs(drops["FF_NOISE"]) < 0.1


def test_shadow_selection(rows):
    found = model.shadow_selection(rows, "CHURN", ["FF_SIGNAL", "FF_NOISE"], rounds=6, trees=10, depth=4)
    assert {r.FEATURE: r.SELECTED for r in found.collect()} == {"FF_SIGNAL": True, "FF_NOISE": False}
    assert model.at_least(6, 6) == 1 / 64


def test_shadow_rounds_share_a_shuffle(rows, monkeypatch):
    """Forests read cached rows: no round joins or shuffles its rows again for each pass of its forest."""
    plans, fit = [], model.RandomForestClassifier.fit

    def record(self, frame, *args):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString().partition("InMemoryRelation"))
        return fit(self, frame, *args)

    monkeypatch.setattr(model.RandomForestClassifier, "fit", record)
    model.shadow_selection(rows, "CHURN", ["FF_SIGNAL", "FF_NOISE"], rounds=2, trees=2, depth=2)
    assert len(plans) == 2 and all(cached and "Join" not in above and "Repartition" not in above for above, cached, _ in plans)


@pytest.mark.parametrize("few", [10, 10_000])
def test_lenders_stand_their_shift_before(spark, monkeypatch, few):
    monkeypatch.setattr(model, "LEAST_ROWS", few)
    found = [f"W{i}" for i in range(10)]
    rows = spark.createDataFrame([(k, k % 2 * 1.0, *[(7 * k + i) % 256 for i in range(10)]) for k in range(50)], ["_row", "label", *found])
    words = [w.alias(f"_w{i}") for i, w in enumerate(model._words(found))]
    paired = model.with_lenders(rows.select("_row", "label", *words), 50, [1, 49, 20], ["_w0", "_w1"])
    bins = [model._bin_at([f"_w{i}_{k}" for i in range(2)], at) for k in range(4) for at in range(10)]
    expected = [
        (k % 2 * 1.0, *[float((7 * ((k - shift) % 50) + i) % 256) for shift in (0, 1, 49, 20) for i in range(10)])
        for k in range(50)
    ]
    assert sorted(tuple(r) for r in paired.select("label", *bins).collect()) == sorted(expected)


def test_rounds_stand_alone_until_one_could_decide():
    bar = 0.05 / 11
    assert model._undecided_for(0, 0, False, bar, 20) == 8 and model._undecided_for(7, 8, False, bar, 20) == 4
    for hits, played, accepted in [(0, 0, False), (7, 8, False), (1, 9, False), (8, 8, True), (5, 10, False)]:
        m = model._undecided_for(hits, played, accepted, bar, 20)
        for more in range(m):
            for won in range(more + 1):
                lost = played + more - hits - won
                assert model.at_least(lost, played + more) > bar
                assert accepted or model.at_least(hits + won, played + more) > bar


@pytest.mark.parametrize("n", [0, 1, 2, 9, 62, 200])
def test_bounds_below_a_value(spark, n):
    bounds = [k / 4 for k in range(n)]
    nan = [math.nan] if n == 9 else []
    values = [-1.0, 0.0, 0.1, 0.25, 1.0, n / 4, n / 4 - 0.25, 1e9, math.nan]
    found = spark.createDataFrame([(v,) for v in values], "v double").select(model.count_below(F.col("v"), nan + bounds)).collect()
    assert [r[0] for r in found] == [sum(math.isnan(v) or b < v for b in bounds) for v in values]


def test_cross_validation_and_search(rows):
    row = model.cv_auc(rows, "CHURN", ["FF_SIGNAL"], 3, model.classifier({"maxIter": 2, "maxDepth": 2})).first()
    assert row.N_FOLDS == 3 and row.MEAN_AUC > 0.8 and 0 <= row.STD_AUC < 0.2
    space = {**model.SEARCH_SPACE, "maxIter": [2], "maxDepth": [2]}
    results, best = model.random_search(rows, "CHURN", ["FF_SIGNAL"], 2, 2, space)
    assert results.count() == 2 and best in model.draw_params(2, space)
    assert model.draw_params(5) == model.draw_params(5) and len(model.draw_params(5)) == 5


def test_regression_on_the_label(rows):
    scored = model.score_regression(model.fit_regression(rows, "CHURN", FEATURES, maxIter=3, maxDepth=3), rows, "CHURN")
    assert 0.2 < model.r2(scored) <= 1 and evaluate.roc_auc(scored).first().ROC_AUC > 0.8


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run in ("a", "b"):
        model.log_run(spark, path, {"RUN": run, "PH": 1, "CP": 2}, {"roc_auc": 0.5})
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize(
    "job, operator",
    [
        ("cv_results", "random_search"), ("cv_auc", "cv_auc"), ("shadow_selection", "shadow_selection"),
        ("feature_ranking", "select_features"), ("churn_regression", "fit_regression"), ("churn_model_scores", "fit"),
        ("publish_predictions", "fit"), ("score_batch", "fit"), ("permutation_importance", "fit"),
    ],
)
def test_registered_jobs_keep_the_defaults_of_the_operators(spark, monkeypatch, job, operator):
    """The job is ended where it calls its operator; arguments with a default (but the forced features) must not be given."""
    given = {}
    signature = inspect.signature(getattr(model, operator))

    class Called(Exception):
        pass

    def record(*args, **named):
        given.update(signature.bind(*args, **named).arguments)
        raise Called

    for name in ("saved_training", "model_rows"):
        monkeypatch.setattr(registry, name, MagicMock())
    monkeypatch.setattr(registry.clean, "split_newest", MagicMock())
    monkeypatch.setattr(model, operator, record)
    with pytest.raises(Called):
        getattr(registry, job)(spark, "unused")
    optional = {k for k, p in signature.parameters.items() if p.default is not p.empty or p.kind is p.VAR_KEYWORD}
    assert not (optional - {"forced"}) & set(given)
