import datetime as dt

import pytest

from ebbtide.session import scratch_path
from ebbtide.sources import tables

ROWS = [("a", dt.date(2021, 1, 1), 1.5, None), ("b, c", dt.date(2021, 1, 2), None, True)]
SCHEMA = "name string, day date, amount double, flag boolean"


def test_snapshot_and_csv_keep_values_and_types(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    tables.write_snapshot(frame, str(tmp_path / "s"), ["day"])
    assert sorted(tables.read_snapshot(spark, str(tmp_path / "s")).select("name", "day").collect()) == [r[:2] for r in ROWS]
    tables.write_csv(frame, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), frame.schema)
    assert back.schema == frame.schema and sorted(map(tuple, back.collect())) == ROWS


def test_slots_by_model_and_publish(spark, tmp_path):
    for model, value in (("HOTEL", 1), ("CLIENT", 2)):
        spark.createDataFrame([(value,)], "x int").write.parquet(str(tmp_path / tables.SLOT_TABLES[model]))
    assert tables.read_slots(spark, "CLIENT", str(tmp_path)).first().x == 2
    assert tables.read_slots(spark, "HOTEL", str(tmp_path)).first().x == 1
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for rows in (frame, frame.limit(1)):
        tables.publish_table(rows, "published_once", scratch_path(spark, "published"))
    assert spark.table("published_once").count() == 1
    spark.sql("DROP TABLE published_once")


def test_query_text_with_markers(spark):
    spark.createDataFrame(ROWS, SCHEMA).createOrReplaceTempView("small")
    assert tables.run_query(spark, "SELECT * FROM small WHERE amount > :least", least=1.0).count() == 1
    assert tables.run_query(spark, "SELECT count(*) AS n FROM small").first().n == 2


def test_unknown_model(spark):
    with pytest.raises(KeyError):
        tables.read_slots(spark, "OTHER")


def test_rounding_keeps_very_large_values(spark):
    from ebbtide.plans.registry import tidy

    values = [1e20, -3.5e17, 9.3e14, 0.12345, -0.00005, None]
    got = [r.v for r in tidy(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert got == [1e20, -3.5e17, 9.3e14, 0.1235, -0.0001, None]


def test_orders_outside_the_calendar_are_an_error(spark, tmp_path):
    import datetime as dt

    import pytest

    from ebbtide.sources import views

    for day, fine in ((dt.datetime(2000, 1, 5), True), (dt.datetime(2031, 1, 1), False), (dt.datetime(1969, 1, 1), False)):
        folder = tmp_path / str(day.year)
        spark.createDataFrame([(1, day)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
        if fine:
            assert views.oldest_order(spark, str(folder)) == day.date()
        else:
            with pytest.raises(ValueError):
                views.oldest_order(spark, str(folder))


def test_grid_of_slots_is_made_by_many_tasks(spark, tmp_path):
    from ebbtide.sources import views

    empty = {
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double",
        "lineitem": "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linenumber int, l_returnflag string, l_linestatus string",
    }
    some = {
        "customer": ([(k, k % 2, "M", 1.0) for k in range(40)] + [(None, 0, "M", 1.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "nation": ([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
    }
    order = [(1, 7, "F", "1-URGENT", dt.datetime(2001, 1, 5), 10.0)]
    for name, schema in empty.items():
        spark.createDataFrame(order if name == "orders" else [], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, (rows, schema) in some.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    facts = views.slot_facts(spark, str(tmp_path))
    plan = facts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grid = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert f"Repartition {2 * spark.sparkContext.defaultParallelism}, true" in plan[grid + 1]
    slots = (views.LAST_DAY - dt.date(2001, 1, 5)).days // views.SLOT_DAYS + 1
    found = [(r.PK, r.TIME_SLOT, r.GROSS_SALES) for r in facts.collect()]
    assert sorted(found) == [(k, s, 10.0 if (k, s) == (7, slots - 1) else 0.0) for k in range(40) for s in range(slots)]
