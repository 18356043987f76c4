import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators.prefix import bucket_of, exact_quantiles, rank_by, running_totals, top_share


def rows_with_hot_value(n=3000, seed=1):
    rng = random.Random(seed)
    values = [5.0 if rng.random() < 0.4 else round(rng.random() * 100, 2) for _ in range(n)]
    return [(i, v, rng.choice("xyz")) for i, v in enumerate(values)]


def test_running_totals_over_a_global_order(spark):
    rows = rows_with_hot_value()
    frame = spark.createDataFrame(rows, "id long, v double, g string")
    out = running_totals(frame, [F.col("v").desc(), F.col("id")], {"n": F.lit(1), "s": F.col("v")})
    assert out.columns == ["id", "v", "g", "n", "s"]
    total = 0.0
    for k, (row, want) in enumerate(zip(out.orderBy("n").collect(), sorted(rows, key=lambda r: (-r[1], r[0])), strict=True)):
        total += want[1]
        assert (row.id, row.n) == (want[0], k + 1) and row.s == pytest.approx(total)


def test_hot_value_is_spread_over_partitions(spark):
    rows = [(i, 1.0) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id long, v double")
    split = frame.repartitionByRange(4, F.col("v").desc(), F.col("id")).withColumn("p", F.spark_partition_id())
    assert max(r["count"] for r in split.groupBy("p").count().collect()) < 2500
    out = running_totals(frame, [F.col("v").desc(), F.col("id")], {"n": F.lit(1)})
    assert sorted(r.n for r in out.collect()) == list(range(1, 4001))


def test_running_totals_restart_per_group_even_for_null_groups(spark):
    rows = rows_with_hot_value(1500, 2) + [(5000 + i, float(i), None) for i in range(50)]
    frame = spark.createDataFrame(rows, "id long, v double, g string")
    out = running_totals(frame, [F.col("v"), F.col("id")], {"n": F.lit(1)}, ["g"]).collect()
    for group in ("x", "y", "z", None):
        mine = sorted((r for r in rows if r[2] == group), key=lambda r: (r[1], r[0]))
        assert [r.id for r in sorted((r for r in out if r.g == group), key=lambda r: r.n)] == [r[0] for r in mine]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.55, 0.8, 0.998, 1.0])
def test_quantiles_match_linear_interpolation(spark, q):
    rows = rows_with_hot_value(500, 3) + [(9999, None, "x")]
    frame = spark.createDataFrame(rows, "id long, v double, g string")
    whole = exact_quantiles(frame, "v", {"q": q}).first()["q"]
    assert whole == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], q))
    for row in exact_quantiles(frame, "v", {"q": q}, ["g"]).collect():
        assert row["q"] == pytest.approx(np.quantile([r[1] for r in rows if r[2] == row["g"] and r[1] is not None], q))


def test_rank_keeps_last_or_first_position_of_ties(spark):
    frame = spark.createDataFrame([(1, 9.0), (2, 7.0), (3, 7.0), (4, 1.0), (5, None)], "id long, v double")
    last = {r.id: r.rank for r in rank_by(frame, "v", "rank").collect()}
    first = {r.id: r.rank for r in rank_by(frame, "v", "rank", "min").collect()}
    assert last == {1: 1, 2: 3, 3: 3, 4: 4, 5: None}
    assert first == {1: 1, 2: 2, 3: 2, 4: 4, 5: None}


def test_contribution_curve_ends_at_one(spark):
    frame = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 0.001), ("d", 2.0), ("e", 3.0)], "PK string, m double")
    out = top_share(frame, "m", "PK").orderBy("POSITION").collect()
    assert [r.PK for r in out] == ["a", "b", "e", "d"]
    assert [r.CUMULATIVE for r in out] == [5.0, 8.0, 11.0, 13.0]
    assert out[-1].SHARE == pytest.approx(1.0)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rows_are_shuffled_once(spark, tmp_path):
    written = spark.createDataFrame(rows_with_hot_value(), "id long, v double, g string")
    written.write.parquet(f"{tmp_path}/rows")
    frame = spark.read.parquet(f"{tmp_path}/rows")
    out = running_totals(frame, [F.col("v").desc(), F.col("id")], {"n": F.lit(1)}, ["g"], {"all": "n"})
    out.collect()
    plan = plan_of(out).split("Initial Plan")[0]
    moved = [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION" in line and "Reused" not in line]
    assert len(moved) == 1 and "ReusedExchange" in plan
    sizes = {g: sum(r[2] == g for r in rows_with_hot_value()) for g in "xyz"}
    assert {(r.g, r.all) for r in out.collect()} == set(sizes.items())


def test_a_frequent_value_fills_many_buckets(spark):
    """Nine rows in ten share one value: they are dealt by the next column, and no bucket holds a tenth of the rows."""
    frame = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.rand(3)).otherwise(0.5).alias("v"), F.lit("t").alias("s"))
    for order in ([F.col("v"), F.col("id")], [F.col("v").desc(), F.col("id").desc()]):
        dealt = frame.withColumn("b", bucket_of(frame, order))
        assert max(r["count"] for r in dealt.groupBy("b").count().collect()) < 2_000
        ranked = running_totals(frame, order, {"n": F.lit(1)}).orderBy("n").collect()
        rows = sorted(frame.collect(), key=lambda r: (r.v, r.id), reverse=order[0] is not None and "DESC" in str(order[0]))
        assert [r.id for r in ranked] == [r.id for r in rows]


@pytest.mark.parametrize("kind", ["string", "date", "decimal(9,2)", "long", "timestamp"])
def test_every_kind_of_order_column(spark, kind):
    texts = {
        "string": ["", "a", "ab", "b", "é", "zz", "aaaaaaaab", "aaaaaaaaa"], "date": ["1960-01-01", "2024-02-29", "1970-01-01"],
        "decimal(9,2)": ["-3.25", "0", "7.10"], "long": [str(2**60), str(2**60 + 1), "-5"], "timestamp": ["1969-12-31 23:00:00", "2024-01-01"],
    }[kind]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "id long, t string").select("id", F.col("t").cast(kind).alias("v"))
    for order in (F.col("v"), F.col("v").desc(), F.col("v").asc_nulls_last(), F.col("v").desc_nulls_first()):
        got = [r.id for r in running_totals(frame, [order, F.col("id")], {"n": F.lit(1)}).orderBy("n").collect()]
        assert got == [r.id for r in frame.orderBy(order, "id").collect()]
