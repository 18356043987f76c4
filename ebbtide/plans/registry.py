"""Named jobs: every operator applied to whole input tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.operators import anomaly, attribution, bi, clean, evaluate, ledger, model, months, panel, prefix, publish, slots
from ebbtide.operators.select import correlated_pairs
from ebbtide.plans import catalog
from ebbtide.plans.spec import Fn, horizons, line
from ebbtide.session import ensure_checkpoint_dir, scratch_path
from ebbtide.sources import tables, views

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}

SCENARIOS = (5, 6, 7, 8)
SUM_METRICS = (
    "RN GROSS_SALES ONE_OM AMOUNT_OVERRIDE_EUR BOOKING_DATES SEARCHES_TOTAL VALUATIONS_TOTAL "
    "BOOKINGCANCELLATION SEARCHES_FAILED"
).split()
AVG_METRICS = "MARKUP CHANNEL_MARKUP CALLS_AVG_CASE_AGING".split()
ATTRIBUTE_METRICS = "REGION SEGMENTATION HOTEL_CATEGORY_GROUP HAS_SOME_GND".split()
RECENCY_LINES = [
    line("MIN_BOOKING_DATE", [Fn.ISNULL, Fn.DIFF_DATE_MIN], catalog.SLOT_LENGTHS),
    line("MAX_BOOKING_DATE", [Fn.ISNULL, Fn.DIFF_DATE_MAX], catalog.SLOT_LENGTHS),
]
AGG_LINES = [
    *[line(m, Fn.SUM, catalog.SLOT_LENGTHS) for m in SUM_METRICS],
    *[line(m, Fn.AVG, catalog.SLOT_LENGTHS) for m in AVG_METRICS],
    *[line(m, Fn.MAX, [1]) for m in ATTRIBUTE_METRICS],
]
ONLY_LINES = [
    *[line(m, Fn.SUM, catalog.SLOT_LENGTHS, "only") for m in ("RN", "SEARCHES_TOTAL")],
    line("MARKUP", Fn.AVG, catalog.SLOT_LENGTHS, "only"),
]
MONTHS_FEATURED = [
    *[line(m, Fn.SUM, catalog.MONTH_LENGTHS) for m in views.ACTIVITY_SUMS],
    line("MIN_BOOKING_DATE", [Fn.ISNULL, Fn.DIFF_DATE_MIN], catalog.MONTH_LENGTHS),
    line("MAX_BOOKING_DATE", [Fn.ISNULL, Fn.DIFF_DATE_MAX], catalog.MONTH_LENGTHS),
    line("MARKUP", Fn.AVG, catalog.MONTH_LENGTHS),
]
#: Rows of the contribution curve and of the upload list: reports of the largest and the first.
TOP_ENTITIES, UPLOADED = 50_000, 10_000
MONTH_TODAY = dt.date(2001, 7, 1)
MONTH_FIRST, MONTH_LAST = dt.date(2000, 4, 1), dt.date(2001, 6, 1)
LEDGER_TODAY = ledger.Period((dt.date(2001, 7, 1),))
LEDGER_MONTHS = ledger.Period(tuple(ledger.reference_months(dt.date(2001, 1, 1), dt.date(2001, 7, 1))))
WATCH = (dt.date(1999, 8, 1), dt.date(2001, 8, 1))
GATE = (dt.date(2000, 6, 1), dt.date(2000, 11, 30))
TRAIN_START, TRAIN_CUT = dt.date(2000, 1, 1), dt.date(2001, 1, 1)
PROFILE_ATTRIBUTES = [
    "CUSTOMER_RL_NAME", "CUSTOMER_RL_COUNTRY_NAME", "CUSTOMER_RL_BL_RETAIL", "CUSTOMER_RL_WHOLESALE",
    "COMMERCIAL_AREA",
]
LEDGER_NUMBERS = [
    "TIME_FROM_LAST_BOOKING", "DATES", "RN", "GROSS_SALES", "RN_L12M", "GROSS_SALES_L12M", "MARKUP",
    "DISPUTED_AMOUNT_EUR_CASES_FINANCE",
]


def job(function: Job) -> Job:
    JOBS[function.__name__] = function
    return function


def tidy(frame: DataFrame, digits: int = 4) -> DataFrame:
    """Comparable output: rounded doubles (averages and ratios finer), dates as text."""
    columns = []
    for field in frame.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            places = next((n for tag, n in FINE_DIGITS.items() if tag in field.name), digits)
            columns.append(f"{half_up(f'double({name})', places)} AS {name}")
        else:
            columns.append(f"string({name}) AS {name}" if isinstance(field.dataType, T.DateType) else name)
    return frame.selectExpr(*columns)


def half_up(value: str, places: int) -> str:
    """Rounding in plain floating point (the built-in one goes through decimals for every value).

    ``floor`` gives a whole 64-bit number; a double so large that it would not fit has no such digits to round.
    """
    scale = f"{10**places}D"
    small = f"floor(abs({value}) * {scale} + 0.5D) / {scale}"
    return f"if({value} < 0, -1, 1) * if(abs({value}) * {scale} < 4.5e15D, {small}, abs({value}))"


FINE_DIGITS = {"_BY_": 7} | dict.fromkeys(
    ("_MEAN_", "MARKUP", "_PCT", "RATIO", "PROBA", "SHARE", "FPR", "TPR", "AUC", "THRESHOLD"), 9
)


# ---- slot engine -----------------------------------------------------------------------------------


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return views.slot_facts(spark, folder)


def traded_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Only slots with sales: a sparse input on which the presence rule matters."""
    return facts(spark, folder).where(F.col("GROSS_SALES") > 0)


def training(spark: SparkSession, folder: str, scenarios=(4, *SCENARIOS), lines=None, pairs=None) -> DataFrame:
    return slots.slot_features(
        facts(spark, folder),
        AGG_LINES if lines is None else lines,
        horizons() if pairs is None else pairs,
        "CLIENT",
        scenarios,
        one_row_per_slot=True,
    )


@job
def churn_slots(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(facts(spark, folder))


@job
def slot_features_agg(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(training(spark, folder, (slots.TODAY,), AGG_LINES, []))


@job
def slot_source(spark: SparkSession, folder: str) -> DataFrame:
    """Slot facts of a model by its name, as a job that starts from stored facts reads them."""
    stored = scratch_path(spark, "slots")
    tables.write_snapshot(facts(spark, folder), f"{stored}/{tables.SLOT_TABLES['CLIENT']}")
    return tidy(tables.read_slots(spark, "CLIENT", stored))


@job
def slot_minimum(spark: SparkSession, folder: str) -> DataFrame:
    lines = [line(m, Fn.MIN, catalog.SLOT_LENGTHS) for m in ("MARKUP", "CALLS_AVG_CASE_AGING", "RN")]
    return tidy(training(spark, folder, (4, *SCENARIOS), lines, []), digits=6)


@job
def slot_features_only(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(training(spark, folder, (slots.TODAY,), ONLY_LINES, []))


@job
def slot_recency(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(training(spark, folder, (4, *SCENARIOS), RECENCY_LINES, []))


@job
def slot_presence(spark: SparkSession, folder: str) -> DataFrame:
    kept = slots.slot_features(
        traded_facts(spark, folder), [line("RN", Fn.SUM, [1, 4])], horizons(), "CLIENT", (4, *SCENARIOS)
    )
    return kept.select("PK", "SCENARIO_DATE")


def catalogue_run(spark: SparkSession, folder: str, model_name: str, lines) -> DataFrame:
    rows = views.with_metrics(facts(spark, folder), [item.metric for item in lines])
    return slots.slot_features(rows, lines, horizons(), model_name, (slots.TODAY, *SCENARIOS), True)


@job
def client_training_set(spark: SparkSession, folder: str) -> DataFrame:
    """The client catalogue at full width: every feature, sixteen label pairs, today and four replays."""
    return tidy(catalogue_run(spark, folder, "CLIENT", catalog.client_lines()))


@job
def hotel_training_set(spark: SparkSession, folder: str) -> DataFrame:
    """The hotel catalogue at full width, with its own target, single-slot and settlement windows."""
    return tidy(catalogue_run(spark, folder, "HOTEL", catalog.hotel_lines()))


@job
def slot_presence_long_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse facts and no window of length 1: a key quiet at the scenario's own slot stays."""
    lines = [line("RN", Fn.SUM, [2, 4])]
    return tidy(slots.slot_features(traded_facts(spark, folder), lines, (), "CLIENT", (4, *SCENARIOS)))


@job
def churn_labels_16(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(training(spark, folder, (slots.TODAY,), []))


@job
def churn_labels_long(spark: SparkSession, folder: str) -> DataFrame:
    labels = training(spark, folder, (slots.TODAY,), [])
    return tidy(slots.labels_long(labels, horizons(), "GROSS_SALES"))


@job
def churn_training_set(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(training(spark, folder, (5,), [*AGG_LINES, *ONLY_LINES, *RECENCY_LINES]))


@job
def churn_today(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(training(spark, folder, (slots.TODAY,), [*AGG_LINES, *RECENCY_LINES]))


@job
def churn_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(training(spark, folder, SCENARIOS, [*AGG_LINES, *RECENCY_LINES]))


@job
def scenario_control_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = training(spark, folder, (4, *SCENARIOS), [line("GROSS_SALES", Fn.SUM, [1])])
    return tidy(slots.scenario_totals(rows, "GROSS_SALES"), digits=2)


SALES_LINES = [line(m, Fn.SUM, catalog.SLOT_LENGTHS) for m in ("GROSS_SALES", "ONE_OM", "RN")]


def sales_rows(spark: SparkSession, folder: str, scenarios=(4, *SCENARIOS)) -> DataFrame:
    extra = [line("HAS_SOME_GND", Fn.MAX, [1]), line("REGION", Fn.MAX, [1])]
    return training(spark, folder, scenarios, [*SALES_LINES, *extra])


@job
def active_population(spark: SparkSession, folder: str) -> DataFrame:
    rows = slots.active_population(sales_rows(spark, folder), "GROSS_SALES", 4)
    return tidy(rows.select("PK", "SCENARIO_DATE", "FF_GROSS_SALES_SUM_L4S", "CHURN_PH_1_CP_1S"))


@job
def exclude_guaranteed(spark: SparkSession, folder: str) -> DataFrame:
    rows = sales_rows(spark, folder).where(F.col("FF_HAS_SOME_GND_MAX_L1S") == 0)
    return tidy(rows.select("PK", "SCENARIO_DATE", "FF_GROSS_SALES_SUM_L1S"))


@job
def split_dev_test(spark: SparkSession, folder: str) -> DataFrame:
    marked = clean.split_newest(sales_rows(spark, folder, SCENARIOS))
    return tidy(marked.select("PK", "SCENARIO_DATE", "SPLIT", "FF_GROSS_SALES_SUM_L1S"))


# ---- evaluation and publishing over a deterministic score -------------------------------------------


def scored(spark: SparkSession, folder: str, ph: int = 1, cp: int = 1) -> DataFrame:
    rows = slots.active_population(sales_rows(spark, folder, (slots.TODAY,)), "GROSS_SALES", 4)
    return rows.select(
        "PK",
        "SCENARIO_DATE",
        F.col(f"CHURN_PH_{ph}_CP_{cp}S").alias("TARGET"),
        proxy_score(F.col(f"FF_GROSS_SALES_SUM_L{ph}S")).alias("PROBA"),
        "FF_ONE_OM_SUM_L13S",
        "FF_GROSS_SALES_SUM_L13S",
    )


def proxy_score(amount):
    """Stand-in probability: high for low sales; coarse, so that ties occur."""
    return F.round(1 / (1 + amount / 100000.0), 3)


@job
def project_scored(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(scored(spark, folder).select("PK", "SCENARIO_DATE", "TARGET", "PROBA"))


@job
def high_risk_true_churn(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(evaluate.high_risk_hits(scored(spark, folder)).select("PK", "SCENARIO_DATE", "PROBA"))


@job
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(evaluate.roc_curve(scored(spark, folder)))


@job
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(evaluate.roc_auc(scored(spark, folder)))


@job
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(evaluate.roc_points(evaluate.roc_curve(scored(spark, folder))))


@job
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_matrix(scored(spark, folder), threshold=0.6)


@job
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    cells = evaluate.confusion_matrix(scored(spark, folder), threshold=0.6)
    return tidy(evaluate.classification_metrics(cells), digits=9)


@job
def contribution_curve(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(prefix.top_share(scored(spark, folder), "FF_ONE_OM_SUM_L13S", "PK"))


@job
def contribution_topn(spark: SparkSession, folder: str, n: int = TOP_ENTITIES) -> DataFrame:
    curve = prefix.top_share(scored(spark, folder), "FF_ONE_OM_SUM_L13S", "PK")
    return tidy(curve.orderBy("POSITION").limit(n).select("PK", "POSITION", "SHARE"))


@job
def rank_max_margin(spark: SparkSession, folder: str) -> DataFrame:
    ranked = prefix.rank_by(scored(spark, folder), "FF_ONE_OM_SUM_L13S", "RANK")
    return tidy(ranked.select("PK", "FF_ONE_OM_SUM_L13S", "RANK"))


@job
def churn_publish_wide(spark: SparkSession, folder: str) -> DataFrame:
    """All horizons scored as columns of one pass over the features."""
    today = slots.active_population(sales_rows(spark, folder, (slots.TODAY,)), "GROSS_SALES", 4)
    horizon = (4, 3, 2, 1)
    wide = today.withColumns({f"PROBA_{ph}S": proxy_score(F.col(f"FF_GROSS_SALES_SUM_L{ph}S")) for ph in horizon})
    return tidy(publish.publish_scored(wide, horizon, ["FF_REGION_MAX_L1S"]))


@job
def upload_list(spark: SparkSession, folder: str, n: int = UPLOADED) -> DataFrame:
    rows = scored(spark, folder).withColumnRenamed("TARGET", "CHURN")
    return tidy(publish.upload_sample(rows, n), digits=9)


@job
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    dealt = clean.stratified_folds(scored(spark, folder), "TARGET", [F.col("PK")], 6)
    return dealt.select("PK", "TARGET", "FOLD")


@job
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    weighted = clean.class_weights(scored(spark, folder), "TARGET")
    return tidy(weighted.select("PK", "TARGET", "WEIGHT"), digits=9)


@job
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    metrics = ["RN", "GROSS_SALES", "ONE_OM", "MARKUP", "BOOKING_DATES"]
    profile = clean.column_profile(facts(spark, folder), metrics, bins=10)
    bins = [F.col("HISTOGRAM")[b].alias(f"BIN_{b}") for b in range(10)]
    return tidy(profile.select("*", *bins).drop("HISTOGRAM"), digits=5)


@job
def mixed_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts(spark, folder).withColumn("GUARANTEED", F.col("HAS_SOME_GND") == 1)
    names = ["REGION", "SEGMENTATION", "DATE_TIME_SLOT", "MIN_BOOKING_DATE", "GUARANTEED", "RN"]
    return tidy(clean.mixed_profile(rows, names), digits=6)


@job
def correlated_pairs_(spark: SparkSession, folder: str) -> DataFrame:
    rows = slots.active_population(training(spark, folder, SCENARIOS), "GROSS_SALES", 1)
    names = [f"FF_{m}_SUM_L{n}S" for m in SUM_METRICS for n in (1, 13)] + ["FF_MARKUP_MEAN_L13S"]
    return tidy(correlated_pairs(rows, names, 0.8), digits=6)


JOBS["correlated_pairs"] = JOBS.pop("correlated_pairs_")


# ---- ledger ----------------------------------------------------------------------------------------


def base(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.base_ledger(views.ledger(spark, folder), LEDGER_TODAY)


def ledger_table(spark: SparkSession, folder: str, period: ledger.Period = LEDGER_TODAY) -> DataFrame:
    return ledger.ledger_table_of(views.ledger_events(spark, folder), period)


@job
def sql_base_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(base(spark, folder).select("PK", "ETL", "BOOKING_DATE", "RN_", "GROSS_SALES_", "BREAK", "R"))


@job
def sql_booking_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(base(spark, folder).select("PK", "BOOKING_DATE", "DAY_LAG", "DIFF_DAYS"))


@job
def sql_lifecycle_quarters(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ["PK", "BOOKING_DATE", "FIRST_BOOKING_DATE", "TIME_FROM_FIRST_BOOKING", "SPLIT_TIME", "TIME"]
    return tidy(base(spark, folder).select(*wanted))


@job
def sql_disputes(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ledger.dispute_features(views.disputes(spark, folder), LEDGER_TODAY))


@job
def sql_markups(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ledger.markup_features(views.markups(spark, folder), LEDGER_TODAY))


@job
def sql_trend_slope(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ledger.ledger_features(base(spark, folder)).select("PK", "SLOPE_RN", "SLOPE_GROSS_SALES"))


@job
def sql_label(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.ledger_label(base(spark, folder)).select("PK", "RN_LXM_TODAY")


@job
def sql_features(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ledger_table(spark, folder))


@job
def sql_features_multi_month(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(ledger_table(spark, folder, LEDGER_MONTHS))


@job
def sql_churn_variation(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger_table(spark, folder, LEDGER_MONTHS)
    return tidy(rows.groupBy("ETL", "CHURN_VARIATION").agg(F.count(F.lit(1)).alias("N_ROWS")))


# ---- calendar months -------------------------------------------------------------------------------


def month_table(spark: SparkSession, folder: str, scenarios) -> DataFrame:
    rows = views.activity(spark, folder).withColumnRenamed("ID_CUSTOMER_BRANCH", "PK")
    return months.month_features(rows, MONTHS_FEATURED, scenarios)


@job
def month_training_set(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar-month catalogue at full width, today and the month before."""
    lines = catalog.month_lines()
    rows = views.with_metrics(views.activity(spark, folder), [item.metric for item in lines])
    rows = rows.withColumnRenamed("ID_CUSTOMER_BRANCH", "PK")
    return tidy(months.month_features(rows, lines, [months.shift_months(MONTH_TODAY, -1), MONTH_TODAY]))


@job
def month_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = month_table(spark, folder, [MONTH_TODAY])
    return tidy(rows.drop("GROSS_SALES_TARGET", "CHURN"))


@job
def month_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = month_table(spark, folder, [MONTH_TODAY])
    return tidy(rows.select("PK", "SCENARIO_DATE", "GROSS_SALES_TARGET", "CHURN"))


def month_history(spark: SparkSession, folder: str) -> DataFrame:
    return month_table(spark, folder, months.month_starts(MONTH_FIRST, MONTH_LAST))


@job
def month_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(month_history(spark, folder))


#: Days that short months clip, each with steps of its own.
MONTH_ENDS = [dt.date(2001, 3, 31), dt.date(2001, 4, 30), dt.date(2001, 5, 31), dt.date(2001, 6, 30), dt.date(2001, 7, 31)]


@job
def month_end_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(month_table(spark, folder, MONTH_ENDS))


@job
def split_dev_test_calendar(spark: SparkSession, folder: str) -> DataFrame:
    marked = clean.split_newest(month_history(spark, folder), newest_is_smallest=False)
    return tidy(marked.select("PK", "SCENARIO_DATE", "SPLIT", "CHURN"))


@job
def dataset_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = month_history(spark, folder)
    return clean.dataset_status(rows, clean.trim_stages(rows, "GROSS_SALES_SUM_L12M"))


@job
def removal_effect(spark: SparkSession, folder: str) -> DataFrame:
    rows = month_history(spark, folder)
    return tidy(clean.removal_effect(rows, clean.trim_stages(rows, "GROSS_SALES_SUM_L12M")))


@job
def outlier_trim(spark: SparkSession, folder: str) -> DataFrame:
    kept = clean.outlier_trim(month_history(spark, folder), "GROSS_SALES_SUM_L12M")
    return tidy(kept.select("PK", "SCENARIO_DATE", "GROSS_SALES_SUM_L12M", "CHURN"))


@job
def ratio_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = month_history(spark, folder)
    have = {c.replace("_SUM_", "_"): c for c in rows.columns}
    short = rows.select("PK", "SCENARIO_DATE", *[F.col(c).alias(n) for n, c in have.items() if "_SUM_" in c])
    pairs = catalog.RATIO_PAIRS  # a pair without its columns is an error
    ratios = panel.add_ratios(short, pairs)
    return tidy(ratios.select("PK", "SCENARIO_DATE", *[f"P_{a}" for a in pairs]), digits=9)


@job
def balance_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger_table(spark, folder, LEDGER_MONTHS).select("PK", "ETL", "CHURN_VARIATION")
    return tidy(clean.balance_classes(rows, "CHURN_VARIATION", [F.col("PK"), F.col("ETL")]))


# ---- monthly panel ---------------------------------------------------------------------------------


@job
def panel_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(views.panel(spark, folder))


@job
def panel_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly maxima of daily activity."""
    largest = ["GROSS_SALES", "SEARCHES_TOTAL", "VALUATIONS_TOTAL", "BOOKINGCANCELLATION"]
    return tidy(panel.monthly_panel(views.activity(spark, folder), ["RN"], {}, {}, peaks=largest))


@job
def panel_volume_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.activity(spark, folder).select("CUSTOMER_REPORTING_LEVEL", "ID_CUSTOMER_BRANCH", "DATE", "RN")
    kept = panel.volume_filter(rows, {"CUSTOMER_REPORTING_LEVEL": 1000, "ID_CUSTOMER_BRANCH": 1000})
    return tidy(
        kept.groupBy("CUSTOMER_REPORTING_LEVEL", "ID_CUSTOMER_BRANCH").agg(
            F.sum("RN").alias("RN"), F.count(F.lit(1)).alias("N_ROWS")
        )
    )


@job
def panel_rolling_12m(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel.add_rolling_mean(views.panel(spark, folder))
    return tidy(rows.select(*panel.ENTITY, "DATE_MONTH", "RN", "AVG_MONTHLY_RN_12M"), digits=8)


@job
def panel_lags(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel.add_lags(views.panel(spark, folder), [*views.PANEL_VALUES, "IS_CHURNED"])
    return tidy(rows.drop(*views.PANEL_VALUES, "MONTH_NUMBER", "PAYMENT_CREDIT", "PAYMENT_PREPAYMENT"))


def model_panel(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel.add_lags(panel.add_rolling_mean(views.panel(spark, folder)), views.PANEL_VALUES)
    return panel.drop_leakage(rows, [*views.PANEL_VALUES, "IS_CHURNED"])


@job
def panel_leakage_drop(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(model_panel(spark, folder).drop("AVG_MONTHLY_RN_12M"))


@job
def panel_complete_cases(spark: SparkSession, folder: str) -> DataFrame:
    lagged = [f"{name}_LAG_{k}" for name in (*views.PANEL_SUMS, "AVG_MARKUP") for k in (1, 2, 3)]
    rows = panel.complete_cases(model_panel(spark, folder), lagged)
    return tidy(rows.select(*panel.ENTITY, "DATE_MONTH", "IS_CHURNED", "RN_LAG_1", "AVG_MARKUP_LAG_1"))


@job
def split_fixed_date(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel.split_by_date(views.panel(spark, folder), TRAIN_START, TRAIN_CUT)
    return tidy(rows.select(*panel.ENTITY, "DATE_MONTH", "SPLIT", "IS_CHURNED"))


@job
def newly_churned(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel.newly_churned(views.panel(spark, folder))
    return tidy(rows.select(*panel.ENTITY, "DATE_MONTH"))


@job
def retail_population(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.when(F.col("COMMERCIAL_AREA").isNotNull(), F.col("CUSTOMER_RL_BL_RETAIL")).alias("RETAIL")
    rows = views.daily(spark, folder).select("CUSTOMER_REPORTING_LEVEL", "DATE", "RN", flag)
    return tidy(panel.retail_population(rows, "RETAIL"))


# ---- daily anomalies -------------------------------------------------------------------------------


def watched(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.gate_active(views.daily(spark, folder), WATCH, GATE, least=10)


def rolled(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.rolling_stats(watched(spark, folder))


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    rows = anomaly.nbinom_scores(rolled(spark, folder))
    return anomaly.anomaly_flags(anomaly.country_day_probability(rows))


IDENTITY = ["CUSTOMER_REPORTING_LEVEL", "DATE", "RN"]
FLAG_COLUMNS = [*IDENTITY, *bi.FLAGS]


@job
def daily_active_gate(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(anomaly.gate_active(views.daily(spark, folder), WATCH, GATE).select(*IDENTITY, "RN_GATE"))


@job
def zero_trading_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = anomaly.zero_trading_runs(views.daily(spark, folder))
    return tidy(runs.select(*IDENTITY, "GRP", "CONSECUTIVE_ZERO_TRADING_DAYS"))


@job
def rolling_12w(spark: SparkSession, folder: str) -> DataFrame:
    rows = anomaly.rolling_stats(views.daily(spark, folder), require_history=False)
    return tidy(rows.select(*IDENTITY, "AVG_RN_12W", "STD_RN_12W"), digits=7)


@job
def rolling_weekday_12w(spark: SparkSession, folder: str) -> DataFrame:
    rows = anomaly.rolling_stats(views.daily(spark, folder), require_history=False)
    return tidy(rows.select(*IDENTITY, "AVG_RN_WEEKDAY12W", "STD_RN_WEEKDAY12W"), digits=7)


@job
def country_p80(spark: SparkSession, folder: str) -> DataFrame:
    rows = watched(spark, folder)
    return tidy(anomaly.country_p80(rows), digits=6)


@job
def country_p80_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """80th percentile per country over all days from a sketch: rows of each group, and whether its rank error holds."""
    rows, by = watched(spark, folder), ["CUSTOMER_RL_COUNTRY_NAME"]
    errors = anomaly.rank_error(rows, anomaly.country_p80(rows, by, approximate=True), by)
    return errors.select(*by, "N_ROWS", (F.col("RANK_ERROR") <= 1 / anomaly.SKETCH_ACCURACY).alias("WITHIN"))


@job
def daily_typed(spark: SparkSession, folder: str) -> DataFrame:
    rows = rolled(spark, folder)
    rows = rows.join(anomaly.country_p80(rows), list(anomaly.SEGMENT), "left")
    typed = anomaly.daily_typed(rows)
    wanted = ["CUSTOMER_RL_NAME", "CUSTOMER_RL_COUNTRY_NAME", "AVG_RN_12W", "P80_RN_COUNTRY"]
    return tidy(typed.select(*IDENTITY, *wanted), digits=2)


@job
def nbinom_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = anomaly.nbinom_scores(rolled(spark, folder))
    return tidy(rows.select(*IDENTITY, "CDF_RN_12W_NBINOM", "CDF_RN_WEEKDAY12W_NBINOM"), digits=7)


@job
def nbinom_pmf(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(anomaly.nbinom_density(rolled(spark, folder)).select(*IDENTITY, "PMF_RN_12W_NBINOM"), digits=7)


@job
def nbinom_floor(spark: SparkSession, folder: str) -> DataFrame:
    rows = anomaly.nbinom_scores(rolled(spark, folder))
    return tidy(rows.select(*IDENTITY, "CDF_RN_WEEKDAY12W_NBINOM_FLOOR"), digits=7)


@job
def country_day_probability(spark: SparkSession, folder: str) -> DataFrame:
    rows = anomaly.country_day_probability(anomaly.nbinom_scores(rolled(spark, folder)))
    return tidy(rows.select(*IDENTITY, F.col("AVG_COUNTRY_DAY_PROB").alias("COUNTRY_DAY_MEDIAN")), digits=7)


@job
def anomaly_flags(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(flagged(spark, folder).select(*FLAG_COLUMNS))


@job
def anomaly_entity(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(anomaly.entity_extract(flagged(spark, folder), 7).select(*FLAG_COLUMNS))


def profile(spark: SparkSession, folder: str) -> DataFrame:
    runs = anomaly.zero_trading_runs(views.daily(spark, folder))
    return anomaly.customer_profile(runs, PROFILE_ATTRIBUTES)


@job
def customer_profile(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(profile(spark, folder), digits=6)


# ---- dashboard -------------------------------------------------------------------------------------


@job
def bi_profile_daily(spark: SparkSession, folder: str) -> DataFrame:
    joined = bi.profile_daily(profile(spark, folder), views.daily(spark, folder))
    return tidy(joined.select("CUSTOMER_REPORTING_LEVEL", "SUM_RN", "DAILY_RN", "N_DAYS", "PEAK_RN"))


BI_MEASURES = {"SUM_OF_RN": "RN", "SUM_OF_CANCELLATIONS": "BOOKINGCANCELLATION", "SUM_OF_FLAGGED_RN": "RN_WITH_FLAG"}


@job
def bi_daily_measures(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(bi.daily_measures(flagged(spark, folder), BI_MEASURES))


@job
def bi_measures_long(spark: SparkSession, folder: str) -> DataFrame:
    two = {name: source for name, source in BI_MEASURES.items() if source != "RN_WITH_FLAG"}
    return tidy(bi.measures_long(bi.daily_measures(views.daily(spark, folder), two), list(two)))


@job
def bi_attr(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.daily(spark, folder)
    return bi.attribute(rows, ["CUSTOMER_RL_COUNTRY_NAME"], ["CUSTOMER_RL_NAME", "COMMERCIAL_AREA"])


@job
def bi_customer_rank(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(bi.customer_rank(views.daily(spark, folder)))


@job
def bi_area_bins(spark: SparkSession, folder: str) -> DataFrame:
    binned = bi.area_bins(profile(spark, folder), "COMMERCIAL_AREA")
    return binned.select("CUSTOMER_REPORTING_LEVEL", "COMMERCIAL_AREA", "AREA_GROUP", "LT_ACTIVE")


@job
def bi_flagged_rn(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(flagged(spark, folder).select(*IDENTITY, "RN_FLAG_ALL", "RN_WITH_FLAG"))


@job
def bi_member_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = bi.member_filter(
        views.daily(spark, folder), "COMMERCIAL_AREA", exclude=["China", "Americas Core"]
    )
    kept = bi.member_filter(rows, "CUSTOMER_RL_NAME", include=[f"NATION_{k}" for k in range(0, 25, 2)])
    return tidy(kept.select(*IDENTITY, "COMMERCIAL_AREA"))


@job
def flag_combinations(spark: SparkSession, folder: str) -> DataFrame:
    return bi.flag_combinations(flagged(spark, folder))


@job
def power_trend(spark: SparkSession, folder: str) -> DataFrame:
    fitted = bi.power_trend(profile(spark, folder), "MAX_CONSECUTIVE_ZERO_TRADING_DAYS", "AVG_RN")
    return tidy(fitted, digits=6)


@job
def bi_reference_average(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(bi.reference_average(views.daily(spark, folder), "RN"), digits=6)


# ---- sources and sinks -----------------------------------------------------------------------------


@job
def scan_orders(spark: SparkSession, folder: str) -> DataFrame:
    view = f"orders_{uuid.uuid4().hex}"  # never a name that a user has
    tables.read_table(spark, folder, "orders").createOrReplaceTempView(view)
    rows = tables.run_query(
        spark,
        f"SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_day FROM {view} "
        "WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) AND o_orderstatus = :status",
        since="2000-01-01",
        status="F",
    )
    return tidy(rows, digits=2)


@job
def snapshot_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    tables.write_snapshot(sales_rows(spark, folder), path, ["SCENARIO_DATE"])
    back = tables.read_snapshot(spark, path)
    return tidy(back.groupBy("SCENARIO_DATE").agg(
        F.count(F.lit(1)).alias("N_ROWS"), F.sum("FF_RN_SUM_L13S").alias("RN_TOTAL")
    ), digits=2)


@job
def csv_export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.daily(spark, folder)
    path = scratch_path(spark, "daily-csv")
    tables.write_csv(rows, path)
    return tidy(tables.read_csv(spark, path, rows.schema))


# ---- models ----------------------------------------------------------------------------------------

MODEL_LINES = [*AGG_LINES, *RECENCY_LINES]


def saved_training(spark: SparkSession, folder: str) -> DataFrame:
    """The training table as models read it: written once, one folder per scenario."""
    path = scratch_path(spark, "training")
    tables.write_snapshot(training(spark, folder, (4, *SCENARIOS), MODEL_LINES), path, ["SCENARIO_DATE"])
    return tables.read_snapshot(spark, path)


def model_rows(saved: DataFrame, scenarios, cp: int) -> DataFrame:
    rows = saved.where(F.col("SCENARIO_DATE").isin(*scenarios))
    return slots.active_population(rows, "GROSS_SALES", cp)


def client_split(spark: SparkSession, folder: str, cp: int = 1) -> tuple[DataFrame, DataFrame]:
    rows = clean.split_newest(model_rows(saved_training(spark, folder), SCENARIOS, cp))
    return rows.where(F.col("SPLIT") == "dev"), rows.where(F.col("SPLIT") == "test")


@job
def churn_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    dev, test = client_split(spark, folder)
    target = "CHURN_PH_1_CP_1S"
    fitted = model.fit(dev, target, catalog.CLIENT_MODEL_FEATURES)
    return model.score(fitted, test, target)


@job
def feature_ranking(spark: SparkSession, folder: str) -> DataFrame:
    dev, _ = client_split(spark, folder, 4)
    features = [c for c in dev.columns if c.startswith("FF_")]
    _, ranking = model.select_features(dev, "CHURN_PH_4_CP_4S", features, catalog.HOTEL_FORCED_FEATURES)
    return model.ranking_frame(spark, ranking)


@job
def cv_auc(spark: SparkSession, folder: str) -> DataFrame:
    rows = model_rows(saved_training(spark, folder), (slots.TODAY,), 1)
    return model.cv_auc(rows, "CHURN_PH_4_CP_4S", catalog.CLIENT_MODEL_FEATURES)


@job
def cv_results(spark: SparkSession, folder: str) -> DataFrame:
    dev, _ = client_split(spark, folder)
    found, _ = model.random_search(dev, "CHURN_PH_1_CP_1S", catalog.CLIENT_MODEL_FEATURES)
    return found


@job
def churn_regression(spark: SparkSession, folder: str) -> DataFrame:
    dev, test = client_split(spark, folder)
    target = "CHURN_PH_1_CP_1S"
    fitted = model.fit_regression(dev, target, catalog.CLIENT_MODEL_FEATURES)
    return model.score_regression(fitted, test, target)


@job
def r_squared(spark: SparkSession, folder: str) -> DataFrame:
    """Explained share of the label by the stand-in score, per class of sales and in all."""
    rows = scored(spark, folder).withColumn("LARGE", F.col("FF_GROSS_SALES_SUM_L13S") > 1_000_000)
    return tidy(model.r_squared(rows, ["LARGE"]), digits=6)


@job
def churn_regression_r2(spark: SparkSession, folder: str) -> DataFrame:
    """R2 of the boosted regression on the rows it was fitted on and on the newest scenarios."""
    sides = dict(zip(("dev", "test"), client_split(spark, folder), strict=True))
    target = "CHURN_PH_1_CP_1S"
    fitted = model.fit_regression(sides["dev"], target, catalog.CLIENT_MODEL_FEATURES)
    scores = [model.score_regression(fitted, rows, target).withColumn("SPLIT", F.lit(name)) for name, rows in sides.items()]
    return model.r_squared(scores[0].unionByName(scores[1]), ["SPLIT"])


@job
def tree_attribution(spark: SparkSession, folder: str) -> DataFrame:
    dev, test = client_split(spark, folder)
    fitted = model.fit(dev, "CHURN_PH_1_CP_1S", catalog.CLIENT_MODEL_FEATURES)
    return attribution.tree_attribution(fitted, test, catalog.CLIENT_MODEL_FEATURES)


@job
def score_batch(spark: SparkSession, folder: str) -> DataFrame:
    saved = saved_training(spark, folder)
    dev = model_rows(saved, SCENARIOS[2:], 1)
    path = scratch_path(spark, "model")
    model.save_model(
        model.fit(dev, "CHURN_PH_1_CP_1S", catalog.CLIENT_MODEL_FEATURES), path
    )
    return model.score_batch(model_rows(saved, (slots.TODAY,), 1), path)


@job
def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    dev, test = client_split(spark, folder)
    target = "CHURN_PH_1_CP_1S"
    fitted = model.fit(dev, target, catalog.CLIENT_MODEL_FEATURES)
    return model.permutation_importance(fitted, test, target, catalog.CLIENT_MODEL_FEATURES)


@job
def shadow_selection(spark: SparkSession, folder: str) -> DataFrame:
    dev, _ = client_split(spark, folder)
    return model.shadow_selection(dev, "CHURN_PH_1_CP_1S", catalog.CLIENT_MODEL_FEATURES)


@job
def publish_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Four horizons fitted, today scored with each, the wide table published and read back."""
    saved = saved_training(spark, folder).where(F.col("FF_HAS_SOME_GND_MAX_L1S") == 0)
    today = model_rows(saved, (slots.TODAY,), 4)
    dev = clean.split_newest(model_rows(saved, SCENARIOS, 4)).where(F.col("SPLIT") == "dev")
    features = [*catalog.CLIENT_MODEL_FEATURES, *catalog.HOTEL_FORCED_FEATURES]
    fitted = {
        ph: model.fit(dev, f"CHURN_PH_{ph}_CP_4S", features)
        for ph in (4, 3, 2, 1)
    }
    ensure_checkpoint_dir(spark)
    wide = model.score_horizons(fitted, today).checkpoint()  # scored once, then ranked and published
    name = f"churn_prediction_{uuid.uuid4().hex}"  # never a table that a user has
    tables.publish_table(publish.publish_scored(wide, list(fitted), features), name, scratch_path(spark, name))
    return spark.table(name)


@job
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    cells = evaluate.confusion_matrix(rows, threshold=0.6)
    metrics = evaluate.classification_metrics(cells).first().asDict()
    metrics["ROC_AUC"] = evaluate.roc_auc(rows).first()["ROC_AUC"]
    path = scratch_path(spark, "runs")
    model.log_run(spark, path, {"RUN": "today", "PH": 1, "CP": 1}, {k: v for k, v in metrics.items() if v is not None})
    return tidy(spark.read.parquet(path), digits=9)
