"""Whole runs: build and save the training tables, fit, evaluate, log and publish."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import clean, evaluate, model, prefix, publish, slots
from ebbtide.operators.select import correlated_pairs
from ebbtide.plans import catalog
from ebbtide.plans.spec import Line, clamp_horizon, feature_columns, horizons, unique
from ebbtide.session import ensure_checkpoint_dir
from ebbtide.sources import tables

HORIZONS = (4, 3, 2, 1)
CALL_AT = 0.6
CV_FOLDS = 6


@dataclass
class RunResult:
    """What a run leaves behind: fitted models, their features, metrics and the frames behind each plot."""

    models: dict[int, PipelineModel]
    features: dict[int, list[str]]
    metrics: dict[str, float]
    frames: dict[str, DataFrame] = field(default_factory=dict)


def prepare(
    facts: DataFrame, model_name: str, folder: str, lines: Sequence[Line] | None = None,
    today: int = slots.TODAY, replays: int = 4, one_row_per_slot: bool = False,
) -> DataFrame:
    """Save the training table, one folder per scenario ("today" is its own scenario); return control totals."""
    default = catalog.hotel_lines if model_name == "HOTEL" else catalog.client_lines
    scenarios = range(today, today + replays + 1)
    rows = slots.slot_features(facts, lines or default(), horizons(), model_name, scenarios, one_row_per_slot)
    tables.write_snapshot(rows, folder, [slots.SCENARIO])
    saved = tables.read_snapshot(facts.sparkSession, folder)
    return slots.scenario_totals(saved, catalog.TARGET_METRIC[model_name])


def _load(spark: SparkSession, folder: str, today: int) -> tuple[DataFrame, DataFrame]:
    saved = tables.read_snapshot(spark, folder)
    return saved.where(F.col(slots.SCENARIO) > today), saved.where(F.col(slots.SCENARIO) == today)


def _areas(fitted: PipelineModel, parts: dict[str, DataFrame], target: str) -> dict[str, float]:
    found = {name: evaluate.roc_auc(model.score(fitted, rows, target)).first() for name, rows in parts.items()}
    return {f"roc_auc_{name}": row["ROC_AUC"] for name, row in found.items()}


def _call_metrics(scored: DataFrame) -> dict[str, float]:
    row = evaluate.classification_metrics(evaluate.confusion_matrix(scored, threshold=CALL_AT)).first()
    return {name.lower(): value for name, value in row.asDict().items()}


def client_run(
    spark: SparkSession, folder: str, ph: int = 1, cp: int = 1, params: dict | None = None,
    features: Sequence[str] = tuple(catalog.CLIENT_MODEL_FEATURES), model_path: str | None = None,
    runs_path: str | None = None, folds: int = CV_FOLDS, today: int = slots.TODAY,
) -> RunResult:
    """Client model: fixed variables, requested horizon, evaluated on dev, test, all and today.

    Today's population is filtered over ``cp`` slots like the training rows; with a longer filter in one
    place than in the other, a label could be decided by the filter alone.
    """
    horizon = clamp_horizon(ph, cp)
    ph, cp = horizon.ph, horizon.cp
    target, features = f"CHURN_PH_{ph}_CP_{cp}S", list(features)
    scenarios, now = _load(spark, folder, today)
    metric = catalog.TARGET_METRIC["CLIENT"]
    rows = clean.split_newest(slots.active_population(scenarios, metric, cp))
    dev, test = rows.where(F.col("SPLIT") == "dev"), rows.where(F.col("SPLIT") == "test")
    fitted = model.fit(dev, target, features, model.classifier(params))
    current = slots.active_population(now, metric, cp)
    scored = model.score(fitted, current, target)
    metrics = _areas(fitted, {"dev": dev, "test": test, "all": rows, "today": current}, target)
    metrics |= _call_metrics(scored)
    cv = model.cv_auc(current, target, features, folds, model.classifier(params)).first()
    metrics |= {"m_score": cv["MEAN_AUC"], "std_scores": cv["STD_AUC"]}
    if model_path:
        model.save_model(fitted, model_path)
    if runs_path:
        known = {name: value for name, value in metrics.items() if value is not None}
        model.log_run(spark, runs_path, {"RUN": folder, "PH": ph, "CP": cp}, known)
    curve = evaluate.roc_curve(scored)
    frames = {
        "scored_today": scored,
        "roc_today": curve,
        "roc_points": evaluate.roc_points(curve),
        "importance": model.ranking_frame(spark, model.importance_ranking(fitted, dev, features)),
        "correlated": correlated_pairs(rows, features),
        "contribution": prefix.top_share(now, publish.MARGIN, slots.KEY),
    }
    return RunResult({ph: fitted}, {ph: features}, metrics, frames)


def hotel_run(
    spark: SparkSession, folder: str, params: dict | None = None, table: str | None = None,
    table_path: str | None = None, cp: int = 4, folds: int = CV_FOLDS, today: int = slots.TODAY,
    forced: Sequence[str] = tuple(catalog.HOTEL_FORCED_FEATURES),
) -> RunResult:
    """Hotel models for four horizons, each on its own selected variables; optionally published as one table."""
    scenarios, now = (part.where(F.col("FF_HAS_SOME_GND_MAX_L1S") == 0) for part in _load(spark, folder, today))
    metric = catalog.TARGET_METRIC["HOTEL"]
    rows = clean.split_newest(slots.active_population(scenarios, metric, cp))
    dev, test = rows.where(F.col("SPLIT") == "dev"), rows.where(F.col("SPLIT") == "test")
    current = slots.active_population(now, metric, 4)
    result = RunResult({}, {}, {}, {"contribution": prefix.top_share(now, publish.MARGIN, slots.KEY)})
    for ph in HORIZONS:
        target = f"CHURN_PH_{ph}_CP_{cp}S"
        chosen, ranking = model.select_features(
            dev, target, feature_columns(dev.columns), forced, model.classifier(params)
        )
        fitted = model.fit(dev, target, chosen, model.classifier(params))
        result.models[ph], result.features[ph] = fitted, chosen
        areas = _areas(fitted, {"dev": dev, "test": test, "today": current}, target)
        cv = model.cv_auc(current, target, chosen, folds, model.classifier(params)).first()
        areas |= {"m_score": cv["MEAN_AUC"], "std_scores": cv["STD_AUC"]}
        result.metrics |= {f"{name}_{ph}S": value for name, value in areas.items()}
        result.frames[f"importance_{ph}S"] = model.ranking_frame(spark, ranking)
    result.metrics |= _call_metrics(model.score(result.models[1], current, f"CHURN_PH_1_CP_{cp}S"))
    ensure_checkpoint_dir(spark)
    wide = model.score_horizons(result.models, current).checkpoint()
    names = unique([name for ph in HORIZONS for name in result.features[ph]])
    result.frames["published"] = publish.publish_scored(wide, HORIZONS, names, cp)
    if table:
        tables.publish_table(result.frames["published"], table, table_path)
    return result
