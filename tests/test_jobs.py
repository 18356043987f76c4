"""Jobs against DuckDB on the smallest tables; set EBBTIDE_ALL_JOBS=1 to compare every one of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ebbtide.plans.registry import JOBS

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer orders lineitem".split()
CHOSEN = """
churn_slots churn_training_set slot_presence slot_presence_long_windows month_scenarios sql_features_multi_month panel_lags zero_trading_runs
country_day_probability roc_curve contribution_curve balance_classes column_profile run_metrics ratio_features panel_monthly mixed_profile panel_peaks month_training_set slot_minimum slot_source r_squared
""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value if value is None or isinstance(value, (bool, int, str)) else float(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("EBBTIDE_ALL_JOBS") else CHOSEN)
def test_job_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    got = [tuple(plain(v) for v in row) for row in frame.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) or sorted(map(str, got)) == sorted(map(str, expected))


def test_every_statement_has_a_job():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(JOBS) <= set(entry.queries())


def test_reports_keep_the_first_rows_only(spark):
    curve = JOBS["contribution_topn"](spark, FOLDER, n=3).collect()
    assert sorted(r.POSITION for r in curve) == [1, 2, 3]
    listed = JOBS["upload_list"](spark, FOLDER, n=4).collect()
    everyone = sorted(r.PK for r in JOBS["project_scored"](spark, FOLDER).collect())
    assert [r.PK for r in listed] == everyone[:4]


def test_ledger_reads_the_lines_once(spark):
    plan = JOBS["sql_features_multi_month"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Generate explode" in plan
    ends = JOBS["month_end_scenarios"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert ends.count("lineitem.parquet") == 1


def test_ledger_of_separate_sources_equals_ledger_of_events(spark):
    from ebbtide.operators import ledger
    from ebbtide.plans.registry import LEDGER_MONTHS
    from ebbtide.sources import views

    apart = ledger.ledger_table(views.ledger(spark, FOLDER), views.disputes(spark, FOLDER), views.markups(spark, FOLDER), LEDGER_MONTHS)
    together = ledger.ledger_table_of(views.ledger_events(spark, FOLDER), LEDGER_MONTHS)
    rows = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.collect()), key=repr) for f in (apart, together)]
    assert apart.columns == together.columns and rows[0] == rows[1] and len(rows[0]) > 100
