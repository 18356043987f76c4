import os

import pytest

from ebbtide.plans import registry, runs
from ebbtide.sources import views

FOLDER = "/root/testdata/sf0.001"
SMALL = {"maxIter": 2, "maxDepth": 2}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("runs") / "training")
    totals = runs.prepare(views.slot_facts(spark, FOLDER), "CLIENT", folder, registry.MODEL_LINES, one_row_per_slot=True)
    assert {r.SCENARIO_DATE: r.N_ROWS for r in totals.collect()} == dict.fromkeys(range(4, 9), 150)
    return folder


def test_client_run(spark, saved, tmp_path):
    result = runs.client_run(
        spark, saved, ph=9, cp=2, params=SMALL, model_path=str(tmp_path / "m"), runs_path=str(tmp_path / "r"), folds=2
    )
    assert list(result.models) == [1]
    assert result.metrics["roc_auc_dev"] > 0.6 and 0 <= result.metrics["accuracy"] <= 1
    assert spark.read.parquet(str(tmp_path / "r")).where("METRIC = 'm_score' AND CP = '2'").count() == 1
    assert result.frames["roc_points"].count() == 3
    shares = [r.SHARE for r in result.frames["contribution"].orderBy("POSITION").collect()]
    assert shares == sorted(shares) and shares[-1] == pytest.approx(1.0)


def test_hotel_run_publishes_four_horizons(spark, tmp_path):
    folder = str(tmp_path / "training")
    runs.prepare(views.slot_facts(spark, FOLDER), "HOTEL", folder, [
        *registry.MODEL_LINES, registry.line("GROSS_COMMERCIAL_COST", registry.Fn.SUM, [1, 2, 3, 4])
    ], one_row_per_slot=True)
    result = runs.hotel_run(spark, folder, SMALL, "hotel_prediction", str(tmp_path / "published"), folds=2)
    published = spark.table("hotel_prediction")
    assert {"PROBA_4S", "PROBA_1S", "CHURN_4S", "RANK", "FF_REGION_MAX_L1S"} <= set(published.columns)
    assert published.count() > 50 and published.where("PROBA_1S NOT BETWEEN 0 AND 1").count() == 0
    assert all("FF_HOTEL_CATEGORY_GROUP_MAX_L1S" in chosen for chosen in result.features.values())
    assert "roc_auc_today_2S" in result.metrics
    spark.sql("DROP TABLE hotel_prediction")
