"""Input tables of the engine, derived from an orders / lineitem star schema.

Amounts are summed as whole cents (or hundredths of cents) so totals do not depend on row order.
Line items are reduced to one row per order, and orders to one row per key and period, before any
join or window sees them, so one very large order or customer is combined inside the map tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.panel import monthly_panel
from ebbtide.operators.slots import KEY, SLOT, SLOT_DATE
from ebbtide.sources.tables import read_table

# Calendar of the order tables; orders outside are an error, not left out.
FIRST_DAY = dt.date(1995, 1, 1)
LAST_DAY = dt.date(2001, 8, 1)
SLOT_DAYS = 91

URGENT = ("1-URGENT", "2-HIGH")


def cents(column: str) -> Column:
    """Amount with two decimals as a whole number."""
    return F.rint(F.col(column) * 100).cast("long")


def line_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Line items reduced to one row per order."""
    lines = read_table(spark, folder, "lineitem")
    price, discount, tax = cents("l_extendedprice"), cents("l_discount"), cents("l_tax")
    return lines.groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("rn"),
        F.sum(price * discount).alias("margin"),
        F.sum(price * tax).alias("override"),
        F.sum(tax).alias("tax_sum"),
        F.sum(discount).alias("discount_sum"),
        F.sum(F.col("l_linenumber").cast("long")).alias("aging_sum"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.count_if(F.col("l_linestatus") == "F").alias("n_closed"),
    )


def oldest_order(spark: SparkSession, folder: str) -> dt.date:
    """Day of the oldest order; raises if an order lies outside the calendar."""
    days = read_table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    oldest, newest = days.agg(F.min("day"), F.max("day")).first()
    if oldest is None:
        return LAST_DAY
    if oldest < FIRST_DAY or newest > LAST_DAY:
        raise ValueError(f"orders from {oldest} to {newest} reach beyond {FIRST_DAY} to {LAST_DAY}")
    return oldest


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with its date, customer and line totals (orders without lines are kept)."""
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.col("o_orderdate").cast("date").alias("day"),
        cents("o_totalprice").alias("sales"),
    )
    return orders.join(
        line_totals(spark, folder), orders.o_orderkey == F.col("l_orderkey"), "left"
    ).drop("l_orderkey")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with nation and region names."""
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return read_table(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))


def slot_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Dense customer x slot facts.

    The grid of empty slots is unioned to the orders and both are reduced by one aggregate, which
    fills the gaps without a join between grid and facts.  Names are looked up afterwards: text in the
    aggregate would turn it from hashing to sorting.
    """
    slot = F.floor(F.datediff(F.lit(LAST_DAY), F.col("day")) / SLOT_DAYS).cast("int")
    n_slots = (LAST_DAY - oldest_order(spark, folder)).days // SLOT_DAYS + 1
    orders = order_rows(spark, folder).select(F.col("o_custkey").alias(KEY), slot.alias(SLOT), "*")
    # customers are few bytes, often one task's, but give n_slots rows each: they are dealt out before, to a number of
    # tasks that is not merged again by size
    keys = read_table(spark, folder, "customer").select(F.col("c_custkey").alias(KEY)).repartition(2 * spark.sparkContext.defaultParallelism)
    grid = keys.select(KEY, F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias(SLOT))

    def total(column: str, scale: int = 1) -> Column:
        value = F.coalesce(F.sum(column), F.lit(0))
        return value if scale == 1 else value / scale

    def share(column: str, scale: int) -> Column:
        return F.sum(column) / F.nullif(F.sum("n_lines"), F.lit(0)) / scale

    facts = grid.unionByName(orders, allowMissingColumns=True).groupBy(KEY, SLOT).agg(
        F.date_sub(F.lit(LAST_DAY), F.col(SLOT) * SLOT_DAYS).alias(SLOT_DATE),
        total("rn").alias("RN"),
        total("sales", 100).alias("GROSS_SALES"),
        total("sales", 100).alias("GROSS_COMMERCIAL_COST"),
        total("margin", 10000).alias("ONE_OM"),
        total("override", 10000).alias("AMOUNT_OVERRIDE_EUR"),
        F.count_distinct("day").alias("BOOKING_DATES"),
        F.min("day").alias("MIN_BOOKING_DATE"),
        F.max("day").alias("MAX_BOOKING_DATE"),
        share("tax_sum", 100).alias("MARKUP"),
        share("discount_sum", 100).alias("CHANNEL_MARKUP"),
        share("aging_sum", 1).alias("CALLS_AVG_CASE_AGING"),
        F.count("o_orderkey").alias("SEARCHES_TOTAL"),
        F.count_if(F.col("o_orderpriority").isin(*URGENT)).alias("VALUATIONS_TOTAL"),
        F.count_if(F.col("o_orderstatus") == "F").alias("BOOKINGCANCELLATION"),
        total("n_returned").alias("SEARCHES_FAILED"),
    )
    owners = customers(spark, folder).select(
        F.col("c_custkey").alias(KEY),
        F.col("r_name").alias("REGION"),
        F.col("c_mktsegment").alias("SEGMENTATION"),
        F.col("n_name").alias("HOTEL_CATEGORY_GROUP"),
        (F.col("c_acctbal") < 0).cast("int").alias("HAS_SOME_GND"),
    )
    return facts.join(owners, KEY)


def with_metrics(facts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Facts with every metric of a catalogue: the ones without a source here are made of orders and pieces sold."""
    missing = [name for name in dict.fromkeys(names) if name not in facts.columns]
    return facts.withColumns(
        {name: F.col("RN") * (k % 5 + 1) + F.col("SEARCHES_TOTAL") * (k % 3) for k, name in enumerate(missing)}
    )


def ledger_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order rows with the customer as branch and its nation as reporting level."""
    owners = read_table(spark, folder, "customer", ["c_custkey", "c_nationkey"])
    return order_rows(spark, folder).join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("ID_CUSTOMER_BRANCH"), F.col("c_nationkey").alias("CUSTOMER_REPORTING_LEVEL"), "*"
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Booking ledger: one row per order."""
    return ledger_rows(spark, folder).select(
        "ID_CUSTOMER_BRANCH",
        "CUSTOMER_REPORTING_LEVEL",
        F.col("day").alias("BOOKING_DATE"),
        F.coalesce("rn", F.lit(0)).alias("RN"),
        (F.col("sales") / 100).alias("GROSS_SALES"),
    )


def disputes(spark: SparkSession, folder: str) -> DataFrame:
    """Case counters and disputed amounts of orders with returned lines."""
    return ledger_rows(spark, folder).where(F.col("n_returned") > 0).select(
        "ID_CUSTOMER_BRANCH",
        "CUSTOMER_REPORTING_LEVEL",
        F.col("day").alias("DATE"),
        F.col("n_closed").alias("BOOKINGS_WITH_CASES_OPS"),
        (F.col("n_lines") - F.col("n_closed")).alias("BOOKINGS_WITH_CASES_SALES"),
        F.col("o_orderpriority").isin(*URGENT).cast("long").alias("BOOKINGS_WITH_CASES_FINANCE"),
        (F.col("margin") / 10000).alias("DISPUTED_AMOUNT_EUR_CASES_FINANCE"),
    )


def markups(spark: SparkSession, folder: str) -> DataFrame:
    """Average tax and discount of each order that has lines."""
    return ledger_rows(spark, folder).where(F.col("n_lines") > 0).select(
        "ID_CUSTOMER_BRANCH",
        "CUSTOMER_REPORTING_LEVEL",
        F.col("day").alias("BOOKING_DATE"),
        (F.col("tax_sum") / F.col("n_lines") / 100).alias("MARKUP"),
        (F.col("discount_sum") / F.col("n_lines") / 100).alias("CHANNEL_MARKUP"),
    )


def ledger_events(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger, disputes and markups of each order in one row, so that the order tables are read once."""
    disputed, marked = F.col("n_returned") > 0, F.col("n_lines") > 0
    cases = {
        "BOOKINGS_WITH_CASES_OPS": F.col("n_closed"),
        "BOOKINGS_WITH_CASES_SALES": F.col("n_lines") - F.col("n_closed"),
        "BOOKINGS_WITH_CASES_FINANCE": F.col("o_orderpriority").isin(*URGENT).cast("long"),
        "DISPUTED_AMOUNT_EUR_CASES_FINANCE": F.col("margin") / 10000,
        "DISPUTED": F.lit(1),
    }
    rates = {
        "MARKUP": F.col("tax_sum") / F.col("n_lines") / 100,
        "CHANNEL_MARKUP": F.col("discount_sum") / F.col("n_lines") / 100,
        "MARKED": F.lit(1),
    }
    return ledger_rows(spark, folder).select(
        "ID_CUSTOMER_BRANCH",
        "CUSTOMER_REPORTING_LEVEL",
        F.col("day").alias("DAY"),
        F.coalesce("rn", F.lit(0)).alias("RN"),
        (F.col("sales") / 100).alias("GROSS_SALES"),
        F.lit(1).alias("BOOKED"),
        *[F.when(disputed, value).alias(name) for name, value in cases.items()],
        *[F.when(marked, value).alias(name) for name, value in rates.items()],
    )


ACTIVITY_SUMS = (
    "RN", "GROSS_SALES", "BOOKING_DATES", "SEARCHES_TOTAL", "VALUATIONS_TOTAL", "BOOKINGS_TOTAL",
    "SEARCHES_FAILED", "VALUATIONS_FAILED", "BOOKINGCANCELLATION", "BOOKINGS_WITH_CASES_OPS", "BOOKOUT",
    "BOOKINGS_WITH_CASES_SALES", "BOOKINGS_WITH_CASES_FINANCE", "CALLS_TOTAL_NUM_CASES",
)


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Daily activity per branch: one row per order, and an empty row at the start of every month."""
    urgent = F.col("o_orderpriority").isin(*URGENT)
    status = F.col("o_orderstatus")
    orders = ledger_rows(spark, folder).select(
        "CUSTOMER_REPORTING_LEVEL",
        "ID_CUSTOMER_BRANCH",
        F.col("day").alias("DATE"),
        F.coalesce("rn", F.lit(0)).alias("RN"),
        (F.col("sales") / 100).alias("GROSS_SALES"),
        F.lit(1).alias("BOOKING_DATES"),
        F.col("day").alias("MIN_BOOKING_DATE"),
        F.col("day").alias("MAX_BOOKING_DATE"),
        F.lit(1).alias("SEARCHES_TOTAL"),
        urgent.cast("int").alias("VALUATIONS_TOTAL"),
        (status == "O").cast("int").alias("BOOKINGS_TOTAL"),
        F.coalesce((F.col("n_returned") > 0).cast("int"), F.lit(0)).alias("SEARCHES_FAILED"),
        (urgent & F.coalesce(F.col("n_closed") > 0, F.lit(False))).cast("int").alias("VALUATIONS_FAILED"),
        (status == "F").cast("int").alias("BOOKINGCANCELLATION"),
        F.coalesce("n_closed", F.lit(0)).alias("BOOKINGS_WITH_CASES_OPS"),
        F.coalesce("n_returned", F.lit(0)).alias("BOOKOUT"),
        F.coalesce(F.col("n_lines") - F.col("n_closed"), F.lit(0)).alias("BOOKINGS_WITH_CASES_SALES"),
        (urgent & F.coalesce(F.col("n_returned") > 0, F.lit(False))).cast("int").alias("BOOKINGS_WITH_CASES_FINANCE"),
        F.coalesce("n_lines", F.lit(0)).alias("CALLS_TOTAL_NUM_CASES"),
        (F.col("tax_sum") / F.col("n_lines") / 100).alias("MARKUP"),
        F.when(status == "F", "C").when(status == "O", "P").otherwise("C & P").alias("CREDIT_OR_PREPAYMENT"),
    )
    months = F.sequence(F.lit(FIRST_DAY), F.lit(LAST_DAY), F.expr("interval 1 month"))
    grid = read_table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("CUSTOMER_REPORTING_LEVEL"),
        F.col("c_custkey").alias("ID_CUSTOMER_BRANCH"),
        F.explode(months).alias("DATE"),
        *[F.lit(0).alias(name) for name in ACTIVITY_SUMS],
    )
    return orders.unionByName(grid, allowMissingColumns=True)


PANEL_SUMS = [name for name in ACTIVITY_SUMS if name not in ("GROSS_SALES", "BOOKING_DATES", "BOOKOUT")]
PANEL_RATIOS = {
    "SEARCHES_FAILED_PCT": ("SEARCHES_FAILED", "SEARCHES_TOTAL"),
    "VALUATIONS_FAILED_PCT": ("VALUATIONS_FAILED", "VALUATIONS_TOTAL"),
    "CANCELLATION_V_BOOKING_RATIO": ("BOOKINGCANCELLATION", "BOOKINGS_TOTAL"),
}
PANEL_VALUES = [*PANEL_SUMS, "AVG_MARKUP", *PANEL_RATIOS]


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Dense customer x month panel."""
    return monthly_panel(
        activity(spark, folder),
        sums=PANEL_SUMS,
        means={"AVG_MARKUP": "MARKUP"},
        ratios=PANEL_RATIOS,
        payment="CREDIT_OR_PREPAYMENT",
    )


AREAS = {"AFRICA": "MEAI & ROE LT", "AMERICA": "Americas Core", "ASIA": "APAC Core", "MIDDLE EAST": "China"}


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Dense nation x day trading series (the area of one region is left unknown).

    Orders are summed per customer and day before the customer is looked up, and numbers per nation and day
    before the names are: text in the aggregate would turn it from hashing to sorting.
    """
    oldest_order(spark, folder)
    sold = (
        order_rows(spark, folder)
        .groupBy("o_custkey", F.col("day").alias("DATE"))
        .agg(F.sum("rn").alias("RN"), F.count_if(F.col("o_orderstatus") == "F").alias("BOOKINGCANCELLATION"))
    )
    owners = read_table(spark, folder, "customer", ["c_custkey", "c_nationkey"])
    sold = sold.join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("CUSTOMER_REPORTING_LEVEL"), "DATE", "RN", "BOOKINGCANCELLATION"
    )
    level = F.col("n_nationkey")
    area = F.when(F.col("r_name") == "AFRICA", AREAS["AFRICA"])
    for region, name in AREAS.items():
        area = area if region == "AFRICA" else area.when(F.col("r_name") == region, name)
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    grid = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        level.alias("CUSTOMER_REPORTING_LEVEL"),
        F.col("n_name").alias("CUSTOMER_RL_NAME"),
        F.col("r_name").alias("CUSTOMER_RL_COUNTRY_NAME"),
        (level % 2 == 0).alias("CUSTOMER_RL_BL_RETAIL"),
        (level % 3 == 0).alias("CUSTOMER_RL_WHOLESALE"),
        area.alias("COMMERCIAL_AREA"),
    )
    labels = ["CUSTOMER_RL_NAME", "CUSTOMER_RL_COUNTRY_NAME", "CUSTOMER_RL_BL_RETAIL", "CUSTOMER_RL_WHOLESALE"]
    days = grid.select(
        "CUSTOMER_REPORTING_LEVEL", F.explode(F.sequence(F.lit(FIRST_DAY), F.lit(LAST_DAY))).alias("DATE")
    )
    summed = (
        days.unionByName(sold, allowMissingColumns=True)
        .groupBy("CUSTOMER_REPORTING_LEVEL", "DATE")
        .agg(
            F.coalesce(F.sum("RN"), F.lit(0)).alias("RN"),
            F.coalesce(F.sum("BOOKINGCANCELLATION"), F.lit(0)).alias("BOOKINGCANCELLATION"),
        )
    )
    return summed.join(grid, "CUSTOMER_REPORTING_LEVEL").select(
        "CUSTOMER_REPORTING_LEVEL", "DATE", *labels, "COMMERCIAL_AREA", "RN", "BOOKINGCANCELLATION"
    )
