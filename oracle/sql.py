"""One SQL statement per job, written from the definitions and without the engine's shortcuts.

Windows, labels and scenarios are spelled out as conditional aggregates per scenario, quantiles use
``quantile_cont``, ranks use plain window functions over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from ebbtide.plans.catalog import client_lines, hotel_lines, month_lines
from ebbtide.plans.spec import Fn, Line

LENGTHS = (1, 2, 3, 4, 13)
PAIRS = [(ph, cp) for ph in (4, 3, 2, 1) for cp in (4, 3, 2, 1)]
SUMS = (
    "RN GROSS_SALES ONE_OM AMOUNT_OVERRIDE_EUR BOOKING_DATES SEARCHES_TOTAL VALUATIONS_TOTAL "
    "BOOKINGCANCELLATION SEARCHES_FAILED"
).split()
AVGS = "MARKUP CHANNEL_MARKUP CALLS_AVG_CASE_AGING".split()
ATTRIBUTES = "REGION SEGMENTATION HOTEL_CATEGORY_GROUP HAS_SOME_GND".split()
FLAGS = ("CDF_RN_12W_NBINOM_FLAG", "CDF_RN_WEEKDAY12W_NBINOM_FLAG", "AVG_COUNTRY_DAY_PROB_FLAG")


def rnd(expr: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


ORDERS = """
line AS (
  SELECT l_orderkey,
    sum(CAST(l_quantity AS BIGINT)) AS rn,
    sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS margin,
    sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS override,
    sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax_sum,
    sum(CAST(round(l_discount * 100) AS BIGINT)) AS discount_sum,
    sum(l_linenumber) AS aging_sum,
    count(*) AS n_lines,
    count(*) FILTER (l_returnflag = 'R') AS n_returned,
    count(*) FILTER (l_linestatus = 'F') AS n_closed
  FROM lineitem GROUP BY l_orderkey
),
ord AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority,
    CAST(o.o_orderdate AS DATE) AS day, CAST(o.o_totalprice AS DECIMAL(15,2)) AS sales, l.*
  FROM orders o LEFT JOIN line l ON o.o_orderkey = l.l_orderkey
)"""

URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"

SLOTS = ORDERS + f""",
per_slot AS (
  SELECT o_custkey, CAST(floor(date_diff('day', day, DATE '2001-08-01') / 91.0) AS INTEGER) AS slot,
    sum(rn) AS rn, sum(sales) AS sales, sum(margin) AS margin, sum(override) AS override,
    count(DISTINCT day) AS n_days, min(day) AS first_day, max(day) AS last_day,
    sum(tax_sum) AS tax_sum, sum(discount_sum) AS discount_sum, sum(aging_sum) AS aging_sum,
    sum(n_lines) AS n_lines, count(*) AS n_orders, count(*) FILTER ({URGENT}) AS n_urgent,
    count(*) FILTER (o_orderstatus = 'F') AS n_done, sum(n_returned) AS n_returned
  FROM ord GROUP BY 1, 2
),
slots AS (
  SELECT c.c_custkey AS PK, CAST(g.slot AS INTEGER) AS TIME_SLOT,
    DATE '2001-08-01' - CAST(g.slot * 91 AS INTEGER) AS DATE_TIME_SLOT,
    coalesce(p.rn, 0) AS RN,
    CAST(coalesce(p.sales, 0) AS DOUBLE) AS GROSS_SALES,
    CAST(coalesce(p.sales, 0) AS DOUBLE) AS GROSS_COMMERCIAL_COST,
    CAST(coalesce(p.margin, 0) AS DOUBLE) AS ONE_OM,
    CAST(coalesce(p.override, 0) AS DOUBLE) AS AMOUNT_OVERRIDE_EUR,
    coalesce(p.n_days, 0) AS BOOKING_DATES,
    p.first_day AS MIN_BOOKING_DATE, p.last_day AS MAX_BOOKING_DATE,
    p.tax_sum / p.n_lines / 100 AS MARKUP,
    p.discount_sum / p.n_lines / 100 AS CHANNEL_MARKUP,
    p.aging_sum / p.n_lines AS CALLS_AVG_CASE_AGING,
    coalesce(p.n_orders, 0) AS SEARCHES_TOTAL,
    coalesce(p.n_urgent, 0) AS VALUATIONS_TOTAL,
    coalesce(p.n_done, 0) AS BOOKINGCANCELLATION,
    coalesce(p.n_returned, 0) AS SEARCHES_FAILED,
    r.r_name AS REGION, c.c_mktsegment AS SEGMENTATION, n.n_name AS HOTEL_CATEGORY_GROUP,
    CAST(c.c_acctbal < 0 AS INTEGER) AS HAS_SOME_GND
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  CROSS JOIN (
    SELECT unnest(range(CAST(floor(date_diff('day', min(day), DATE '2001-08-01') / 91.0) AS INTEGER) + 1)) AS slot FROM ord
  ) g
  LEFT JOIN per_slot p ON p.o_custkey = c.c_custkey AND p.slot = g.slot
)"""


def inside(low: str, high: str, expr: str) -> str:
    return f"CASE WHEN TIME_SLOT BETWEEN {low} AND {high} THEN {expr} END"


def feature(metric: str, fn: str, length: int, mode: str = "agg") -> tuple[str, str]:
    low = "m" if mode == "agg" else f"m + {length - 1}"
    cell = inside(low, f"m + {length - 1}", metric)
    name = f"FF_{metric}_{fn}_L{length}S{'O' if mode == 'only' else ''}"
    if fn == "SUM":
        return rnd(f"coalesce(sum({cell}), 0)"), name
    if fn == "MEAN":
        return rnd(f"avg({cell})", 9), name
    if fn == "MAX":
        return f"max({cell})", name
    if fn == "MIN":
        least = f"min({cell})"
        return (f"CAST({least} AS BIGINT)" if metric == "RN" else rnd(least, 9 if metric == "MARKUP" else 6)), name
    pick = "min" if fn == "DIFF_DATE_MIN" else "max"
    return f"date_diff('day', {pick}({cell}), max(CASE WHEN TIME_SLOT = m THEN DATE_TIME_SLOT END))", name


def features(*specs: tuple[str, str, tuple, str]) -> list[tuple[str, str]]:
    return [feature(metric, fn, n, mode) for metric, fn, lengths, mode in specs for n in lengths]


AGG = [
    *features(*[(m, "SUM", LENGTHS, "agg") for m in SUMS]),
    *features(*[(m, "MEAN", LENGTHS, "agg") for m in AVGS]),
    *features(*[(m, "MAX", (1,), "agg") for m in ATTRIBUTES]),
]
ONLY = features(
    ("RN", "SUM", LENGTHS, "only"), ("SEARCHES_TOTAL", "SUM", LENGTHS, "only"), ("MARKUP", "MEAN", LENGTHS, "only")
)
RECENCY = features(
    ("MIN_BOOKING_DATE", "DIFF_DATE_MIN", LENGTHS, "agg"), ("MAX_BOOKING_DATE", "DIFF_DATE_MAX", LENGTHS, "agg")
)


SLOT_COLUMNS = (
    "PK TIME_SLOT DATE_TIME_SLOT RN GROSS_SALES GROSS_COMMERCIAL_COST ONE_OM AMOUNT_OVERRIDE_EUR BOOKING_DATES "
    "MIN_BOOKING_DATE MAX_BOOKING_DATE MARKUP CHANNEL_MARKUP CALLS_AVG_CASE_AGING SEARCHES_TOTAL VALUATIONS_TOTAL "
    "BOOKINGCANCELLATION SEARCHES_FAILED REGION SEGMENTATION HOTEL_CATEGORY_GROUP HAS_SOME_GND"
).split()


def catalogue(lines: Sequence[Line]) -> tuple[str, list[tuple[str, str]]]:
    """Slots with every metric of a catalogue, and all its features."""
    missing = [m for m in dict.fromkeys(item.metric for item in lines) if m not in SLOT_COLUMNS]
    made = "".join(f", RN * {k % 5 + 1} + SEARCHES_TOTAL * {k % 3} AS {m}" for k, m in enumerate(missing))
    columns = [
        feature(item.metric, fn.value.upper(), n, item.mode)
        for item in lines for n in item.lengths for fn in item.functions if fn is not Fn.ISNULL
    ]
    return f", wide AS (SELECT *{made} FROM slots)", columns


def label_columns(pairs=PAIRS, metric: str = "GROSS_SALES") -> list[tuple[str, str]]:
    columns = []
    for ph, cp in pairs:
        low, high = 4 - ph, 4 - ph + cp - 1
        total = f"coalesce(sum({inside(f'm - 4 + {low}', f'm - 4 + {high}', metric)}), 0)"
        columns.append((rnd(total), f"{metric}_TARGET_PH_{ph}_CP_{cp}"))
        columns.append((f"{total} < 0.005", f"CHURN_PH_{ph}_CP_{cp}S"))
    return columns


def scenario_rows(columns: list[tuple[str, str]], scenarios=(4,), source: str = "slots", having: str = "") -> str:
    listed = ", ".join(f"{expr} AS {name}" for expr, name in columns)
    values = ", ".join(f"({m})" for m in scenarios)
    return (
        f"SELECT PK, CAST(m AS INTEGER) AS SCENARIO_DATE{', ' + listed if listed else ''} "
        f"FROM {source} CROSS JOIN (VALUES {values}) s(m) WHERE TIME_SLOT >= m - 4 GROUP BY PK, m {having}"
    )


def with_(ctes: str, query: str) -> str:
    return f"WITH {ctes.strip().lstrip(',')} {query}"


ALL_SCENARIOS = (4, 5, 6, 7, 8)
REPLAYS = (5, 6, 7, 8)
SALES = [
    *features(*[(m, "SUM", LENGTHS, "agg") for m in ("GROSS_SALES", "ONE_OM", "RN")]),
    *features(("HAS_SOME_GND", "MAX", (1,), "agg"), ("REGION", "MAX", (1,), "agg")),
    *label_columns(),
]


def sales_cte(scenarios) -> str:
    return SLOTS + ", sales AS (" + scenario_rows(SALES, scenarios) + ")"


def scored_cte(ph: int = 1, cp: int = 1) -> str:
    return sales_cte((4,)) + f""",
scored AS (
  SELECT PK, SCENARIO_DATE, CHURN_PH_{ph}_CP_{cp}S AS TARGET,
    round(1 / (1 + FF_GROSS_SALES_SUM_L{ph}S / 100000.0), 3) AS PROBA,
    FF_ONE_OM_SUM_L13S, FF_GROSS_SALES_SUM_L13S
  FROM sales WHERE FF_GROSS_SALES_SUM_L4S > 0.005
)"""


ROC = """,
counts AS (
  SELECT PROBA AS t, count(*) FILTER (TARGET) AS pos, count(*) FILTER (NOT TARGET) AS neg FROM scored GROUP BY PROBA
),
run AS (
  SELECT t, pos, neg, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER (ORDER BY t DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n,
    lead(pos) OVER (ORDER BY t DESC) AS pos2, lead(neg) OVER (ORDER BY t DESC) AS neg2
  FROM counts
),
curve AS (
  SELECT t AS THRESHOLD, fp / n AS FPR, tp / p AS TPR FROM run WHERE pos2 IS NULL OR pos <> pos2 OR neg <> neg2
)"""

CELLS = """,
cells AS (
  SELECT count(*) FILTER (NOT TARGET AND PROBA < 0.6) AS TN, count(*) FILTER (NOT TARGET AND PROBA >= 0.6) AS FP,
    count(*) FILTER (TARGET AND PROBA < 0.6) AS FN, count(*) FILTER (TARGET AND PROBA >= 0.6) AS TP FROM scored
)"""

CURVE = """,
kept AS (SELECT PK, FF_ONE_OM_SUM_L13S AS v FROM scored WHERE FF_ONE_OM_SUM_L13S > 0.005),
ranked AS (
  SELECT PK, v, row_number() OVER (ORDER BY v DESC, PK) AS pos,
    sum(v) OVER (ORDER BY v DESC, PK ROWS UNBOUNDED PRECEDING) AS cum, sum(v) OVER () AS total FROM kept
)"""


def profile_sql() -> str:
    metrics = ["RN", "GROSS_SALES", "ONE_OM", "MARKUP", "BOOKING_DATES"]
    parts = []
    for m in metrics:
        bins = ", ".join(
            f"coalesce(count(v) FILTER (least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * 10), 0), 9) = {b}), 0)"
            f" AS BIN_{b}"
            for b in range(10)
        )
        parts.append(
            f"SELECT '{m}' AS \"COLUMN\", count(v) AS N, count(*) - count(v) AS N_MISSING, "
            f"count(DISTINCT v) AS N_DISTINCT, {rnd('min(v)', 5)} AS MIN, {rnd('max(v)', 5)} AS MAX, "
            f"{rnd('avg(v)', 5)} AS MEAN, {rnd('stddev_samp(v)', 5)} AS STD, {rnd('quantile_cont(v, 0.25)', 5)} AS Q25, "
            f"{rnd('quantile_cont(v, 0.5)', 5)} AS MEDIAN, {rnd('quantile_cont(v, 0.75)', 5)} AS Q75, {bins} "
            f"FROM (SELECT CAST({m} AS DOUBLE) AS v, min(CAST({m} AS DOUBLE)) OVER () AS lo, "
            f"max(CAST({m} AS DOUBLE)) OVER () AS hi FROM slots)"
        )
    return with_(SLOTS, " UNION ALL ".join(parts))


def mixed_profile_sql() -> str:
    parts = []
    for name, kind in (("REGION", "text"), ("SEGMENTATION", "text"), ("DATE_TIME_SLOT", "date"), ("MIN_BOOKING_DATE", "date"), ("GUARANTEED", "boolean"), ("RN", "number")):
        source = "HAS_SOME_GND = 1" if name == "GUARANTEED" else name
        gaps = "(SELECT max(g) FROM (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM (SELECT DISTINCT v AS d FROM t)))"
        parts.append(
            f"(WITH t AS (SELECT {source} AS v FROM slots), c AS (SELECT CAST(v AS VARCHAR) AS v, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY v) "
            f"SELECT '{name}' AS \"COLUMN\", '{kind}' AS KIND, CAST(coalesce(sum(n), 0) AS BIGINT) AS N, (SELECT count(*) FROM t) - CAST(coalesce(sum(n), 0) AS BIGINT) AS N_MISSING, "
            f"count(*) AS N_DISTINCT, {'NULL' if kind == 'number' else 'min(v)'} AS LEAST, {'NULL' if kind == 'number' else 'max(v)'} AS MOST, "
            "(SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS TOP_VALUE, (SELECT max(n) FROM c) AS TOP_COUNT, "
            + (rnd("sum(n * length(v)) / sum(n)", 6) if kind == "text" else "CAST(NULL AS DOUBLE)") + " AS MEAN_LENGTH, "
            + (rnd("sum(n) FILTER (v = 'true') / sum(n)", 9) if kind == "boolean" else "CAST(NULL AS DOUBLE)") + " AS TRUE_SHARE, "
            + (f"CAST({gaps} AS INTEGER)" if kind == "date" else "CAST(NULL AS INTEGER)") + " AS LONGEST_GAP FROM c)"
        )
    return with_(SLOTS, "SELECT * FROM (" + " UNION ALL ".join(parts) + ")")


def correlation_sql() -> str:
    names = [f"FF_{m}_SUM_L{n}S" for m in SUMS for n in (1, 13)] + ["FF_MARKUP_MEAN_L13S"]
    columns = [*AGG, *label_columns([(1, 1)])]
    pairs = [
        f"SELECT '{a}' AS VARIABLE_1, '{b}' AS VARIABLE_2, corr({a}, {b}) AS c FROM t"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    return with_(
        SLOTS + ", s AS (" + scenario_rows(columns, REPLAYS) + "), t AS (SELECT * FROM s WHERE FF_GROSS_SALES_SUM_L1S > 0.005)",
        f"SELECT VARIABLE_1, VARIABLE_2, {rnd('c', 6)} AS CORRELATION FROM ({' UNION ALL '.join(pairs)}) "
        "WHERE round(c, 12) <> 1 AND c > 0.8",
    )


# ---- ledger ----------------------------------------------------------------------------------------

LEDGER_ROWS = ORDERS + """,
owned AS (
  SELECT c.c_custkey AS branch, c.c_nationkey AS lvl, o.*,
    CAST(c.c_custkey AS VARCHAR) || ' | ' || CAST(c.c_nationkey AS VARCHAR) AS PK
  FROM ord o JOIN customer c ON o.o_custkey = c.c_custkey
)"""


def ledger_ctes(months: list[str], history: int = 24, label: int = 2) -> str:
    values = ", ".join(f"(DATE '{m}')" for m in months)
    totals = []
    for src, name in (
        ("sale", "BOOKINGS_WITH_CASES_SALES"), ("ops", "BOOKINGS_WITH_CASES_OPS"),
        ("fin", "BOOKINGS_WITH_CASES_FINANCE"), ("amt", "DISPUTED_AMOUNT_EUR_CASES_FINANCE"),
    ):
        for tag, when in (("", "true"), ("_L2M", "day >= brk - INTERVAL 2 MONTH"), ("_L12M", "day >= brk - INTERVAL 12 MONTH")):
            totals.append(f"coalesce(sum({src}) FILTER ({when}), 0) AS {name}{tag}")
    means = []
    for src, name in (("mk", "MARKUP"), ("ch", "CHANNEL_MARKUP")):
        for tag, when in (("", "true"), ("_L2M", "day >= brk - INTERVAL 2 MONTH"), ("_L12M", "day >= brk - INTERVAL 12 MONTH")):
            means.append(f"coalesce(avg({src}) FILTER ({when}), 0) AS {name}{tag}")
    return LEDGER_ROWS + f""",
months AS (SELECT m AS ETL, CAST(m - INTERVAL {label} MONTH AS DATE) AS brk FROM (VALUES {values}) t(m)),
daily AS (
  SELECT PK, ETL, brk, day, sum(coalesce(rn, 0)) AS RN_, CAST(sum(sales) AS DOUBLE) AS GROSS_SALES_
  FROM owned JOIN months ON day > ETL - INTERVAL {history} MONTH AND day <= ETL
  WHERE PK IS NOT NULL GROUP BY PK, ETL, brk, day
),
windowed AS (
  SELECT *, lag(day, 1, day) OVER (PARTITION BY PK, ETL ORDER BY day) AS DAY_LAG,
    min(day) OVER (PARTITION BY PK, ETL) AS FIRST_BOOKING_DATE,
    row_number() OVER (PARTITION BY PK, ETL ORDER BY day) AS R
  FROM daily
),
base AS (
  SELECT *, date_diff('day', DAY_LAG, day) AS DIFF_DAYS,
    coalesce(date_diff('day', FIRST_BOOKING_DATE, brk), 0) AS age,
    CAST(round(coalesce(date_diff('day', FIRST_BOOKING_DATE, brk), 0) / 4.0) AS INTEGER) AS step
  FROM windowed
),
disp AS (
  SELECT PK, ETL, {", ".join(totals)}
  FROM (
    SELECT PK, ETL, brk, day, n_closed AS ops, n_lines - n_closed AS sale,
      CAST({URGENT} AS INTEGER) AS fin, margin AS amt
    FROM owned JOIN months ON day > ETL - INTERVAL {history} MONTH AND day <= brk WHERE n_returned > 0
  ) GROUP BY PK, ETL
),
mark AS (
  SELECT PK, ETL, {", ".join(means)}
  FROM (
    SELECT PK, ETL, brk, day, tax_sum / n_lines / 100 AS mk, discount_sum / n_lines / 100 AS ch
    FROM owned JOIN months ON day > ETL - INTERVAL {history} MONTH AND day <= brk WHERE n_lines > 0
  ) GROUP BY PK, ETL
),
feat AS (
  SELECT PK, ETL, coalesce(date_diff('day', max(day), max(brk)), 0) AS TIME_FROM_LAST_BOOKING,
    count(DISTINCT day) AS DATES,
    count(DISTINCT day) FILTER (day >= brk - INTERVAL 2 MONTH) AS DATES_L2M,
    count(DISTINCT day) FILTER (day >= brk - INTERVAL 12 MONTH) AS DATES_L12M,
    coalesce(sum(RN_), 0) AS RN,
    coalesce(sum(RN_) FILTER (day >= brk - INTERVAL 2 MONTH), 0) AS RN_L2M,
    coalesce(sum(RN_) FILTER (day >= brk - INTERVAL 12 MONTH), 0) AS RN_L12M,
    coalesce(sum(GROSS_SALES_), 0) AS GROSS_SALES,
    coalesce(sum(GROSS_SALES_) FILTER (day >= brk - INTERVAL 2 MONTH), 0) AS GROSS_SALES_L2M,
    coalesce(sum(GROSS_SALES_) FILTER (day >= brk - INTERVAL 12 MONTH), 0) AS GROSS_SALES_L12M,
    coalesce(nullif(regr_slope(RN_, R), 'nan'::DOUBLE), 0) AS SLOPE_RN,
    coalesce(nullif(regr_slope(GROSS_SALES_, R), 'nan'::DOUBLE), 0) AS SLOPE_GROSS_SALES
  FROM base WHERE day < brk GROUP BY PK, ETL
  HAVING sum(RN_) > 0 AND sum(GROSS_SALES_) > 0 AND coalesce(sum(RN_) FILTER (day >= brk - INTERVAL 12 MONTH), 0) > 0
),
lab AS (SELECT PK, ETL, coalesce(sum(CASE WHEN day >= brk THEN RN_ ELSE 0 END), 0) AS RN_LXM_TODAY FROM base GROUP BY PK, ETL),
final AS (
  SELECT f.*, RN / DATES AS RN_BY_BOOKING_DATES, GROSS_SALES / DATES AS GROSS_SALES_BY_BOOKING_DATES,
    disp.* EXCLUDE (PK, ETL), mark.* EXCLUDE (PK, ETL), RN_L2M = 0 AS CHURN_L2M, RN_LXM_TODAY = 0 AS CHURN,
    CASE WHEN RN_L2M = 0 AND RN_LXM_TODAY = 0 THEN 'C_L2M__C' WHEN RN_L2M = 0 THEN 'C_L2M__NOT_C'
      WHEN RN_LXM_TODAY = 0 THEN 'NOT_C_L2M__C' ELSE 'NOT_C_L2M__NOT_C' END AS CHURN_VARIATION
  FROM feat f JOIN lab USING (PK, ETL) LEFT JOIN disp USING (PK, ETL) LEFT JOIN mark USING (PK, ETL)
)"""


ONE_MONTH = ["2001-07-01"]
SEVEN_MONTHS = [f"2001-0{k}-01" for k in range(1, 8)]
DISPUTE_COLUMNS = [
    f"{n}{t}"
    for n in ("BOOKINGS_WITH_CASES_SALES", "BOOKINGS_WITH_CASES_OPS", "BOOKINGS_WITH_CASES_FINANCE",
              "DISPUTED_AMOUNT_EUR_CASES_FINANCE")
    for t in ("", "_L2M", "_L12M")
]
MARKUP_COLUMNS = [f"{n}{t}" for n in ("MARKUP", "CHANNEL_MARKUP") for t in ("", "_L2M", "_L12M")]


def rounded(names: list[str], digits: int) -> str:
    return ", ".join(f"{rnd(n, digits)} AS {n}" for n in names)


def ledger_final(months: list[str]) -> str:
    whole = ["TIME_FROM_LAST_BOOKING", "DATES", "DATES_L2M", "DATES_L12M"]
    money = [
        "RN", "RN_L2M", "RN_L12M", "GROSS_SALES", "GROSS_SALES_L2M", "GROSS_SALES_L12M", "SLOPE_RN", "SLOPE_GROSS_SALES",
        *DISPUTE_COLUMNS,
    ]
    return with_(
        ledger_ctes(months),
        f"SELECT PK, {text('ETL')} AS ETL, {', '.join(whole)}, {rounded(money, 4)}, {rounded(MARKUP_COLUMNS, 9)}, "
        f"{rounded(['RN_BY_BOOKING_DATES', 'GROSS_SALES_BY_BOOKING_DATES'], 7)}, "
        "CHURN_L2M, CHURN, CHURN_VARIATION FROM final",
    )


# ---- months and panel ------------------------------------------------------------------------------

ACTIVITY_SUMS = (
    "RN GROSS_SALES BOOKING_DATES SEARCHES_TOTAL VALUATIONS_TOTAL BOOKINGS_TOTAL SEARCHES_FAILED VALUATIONS_FAILED "
    "BOOKINGCANCELLATION BOOKINGS_WITH_CASES_OPS BOOKOUT BOOKINGS_WITH_CASES_SALES BOOKINGS_WITH_CASES_FINANCE CALLS_TOTAL_NUM_CASES"
).split()

ACTIVITY = LEDGER_ROWS + f""",
activity AS (
  SELECT lvl, branch, day AS DATE, coalesce(rn, 0) AS RN, CAST(sales AS DOUBLE) AS GROSS_SALES, 1 AS BOOKING_DATES,
    day AS MIN_BOOKING_DATE, day AS MAX_BOOKING_DATE, 1 AS SEARCHES_TOTAL,
    CAST({URGENT} AS INTEGER) AS VALUATIONS_TOTAL, CAST(o_orderstatus = 'O' AS INTEGER) AS BOOKINGS_TOTAL,
    CAST(coalesce(n_returned, 0) > 0 AS INTEGER) AS SEARCHES_FAILED,
    CAST({URGENT} AND coalesce(n_closed, 0) > 0 AS INTEGER) AS VALUATIONS_FAILED,
    CAST(o_orderstatus = 'F' AS INTEGER) AS BOOKINGCANCELLATION,
    coalesce(n_closed, 0) AS BOOKINGS_WITH_CASES_OPS, coalesce(n_returned, 0) AS BOOKOUT,
    coalesce(n_lines - n_closed, 0) AS BOOKINGS_WITH_CASES_SALES,
    CAST({URGENT} AND coalesce(n_returned, 0) > 0 AS INTEGER) AS BOOKINGS_WITH_CASES_FINANCE,
    coalesce(n_lines, 0) AS CALLS_TOTAL_NUM_CASES,
    tax_sum / n_lines / 100 AS MARKUP,
    CASE o_orderstatus WHEN 'F' THEN 'C' WHEN 'O' THEN 'P' ELSE 'C & P' END AS CREDIT_OR_PREPAYMENT
  FROM owned
  UNION ALL BY NAME
  SELECT c_nationkey AS lvl, c_custkey AS branch, CAST(g AS DATE) AS DATE,
    {", ".join(f"0 AS {n}" for n in ACTIVITY_SUMS)}
  FROM customer CROSS JOIN generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) t(g)
)"""


ACTIVITY_COLUMNS = [
    "DATE", *ACTIVITY_SUMS, "MIN_BOOKING_DATE", "MAX_BOOKING_DATE", "MARKUP", "CREDIT_OR_PREPAYMENT",
]


def month_catalogue() -> tuple[str, list[tuple[str, str]]]:
    """Activity with every metric of the monthly catalogue, and all its features."""
    lines = month_lines()
    names = list(dict.fromkeys(item.metric for item in lines))
    missing = [m for m in names if m not in ACTIVITY_COLUMNS]
    made = "".join(f", RN * {k % 5 + 1} + SEARCHES_TOTAL * {k % 3} AS {m}" for k, m in enumerate(missing))
    forms = {
        "SUM": lambda x: rnd(f"coalesce(sum({x}), 0)"), "MEAN": lambda x: rnd(f"avg({x})", 9), "MAX": lambda x: f"CAST(max({x}) AS BIGINT)",
        "DIFF_DATE_MIN": lambda x: f"date_diff('day', min({x}), CAST(mx - INTERVAL 1 MONTH AS DATE))",
        "DIFF_DATE_MAX": lambda x: f"date_diff('day', max({x}), CAST(mx - INTERVAL 1 MONTH AS DATE))",
    }
    columns = [
        (forms[fn.value.upper()](MONTH_CELL.format(n=n, x=item.metric)), f"{item.metric}_{fn.value.upper()}_L{n}M")
        for item in lines for n in item.lengths for fn in item.functions if fn is not Fn.ISNULL
    ]
    return f", wide_activity AS (SELECT *{made} FROM activity)", columns


MONTH_CELL = "CASE WHEN DATE > mx - INTERVAL 1 MONTH - INTERVAL {n} MONTH AND DATE <= mx - INTERVAL 1 MONTH THEN {x} END"


def month_ctes(scenarios: list[str], wide: str = "", catalogue: list[tuple[str, str]] | None = None) -> str:
    columns = list(catalogue or [])
    for n in () if catalogue else (1, 12):
        cell = MONTH_CELL
        for m in ACTIVITY_SUMS:
            columns.append((rnd(f"coalesce(sum({cell.format(n=n, x=m)}), 0)"), f"{m}_SUM_L{n}M"))
        for m, fn in (("MIN_BOOKING_DATE", "min"), ("MAX_BOOKING_DATE", "max")):
            columns.append((
                f"date_diff('day', {fn}({cell.format(n=n, x=m)}), CAST(mx - INTERVAL 1 MONTH AS DATE))",
                f"{m}_DIFF_DATE_{fn.upper()}_L{n}M",
            ))
        columns.append((rnd(f"avg({cell.format(n=n, x='MARKUP')})", 9), f"MARKUP_MEAN_L{n}M"))
    target = "sum(CASE WHEN DATE > mx - INTERVAL 1 MONTH THEN GROSS_SALES END)"
    columns.append((rnd(f"coalesce({target}, 0)"), "GROSS_SALES_TARGET"))
    columns.append((f"coalesce({target}, 0) < 0.005", "CHURN"))
    listed = ", ".join(f"{e} AS {n}" for e, n in columns)
    values = ", ".join(f"(DATE '{s}')" for s in scenarios)
    return ACTIVITY + wide + f""",
monthly AS (
  SELECT branch AS PK, {text("mx")} AS SCENARIO_DATE, {listed}
  FROM {"wide_activity" if wide else "activity"} JOIN (VALUES {values}) t(mx) ON DATE <= mx AND DATE > mx - INTERVAL 1 MONTH - INTERVAL 12 MONTH
  GROUP BY branch, mx
)"""


HISTORY = [f"2000-{k:02d}-01" for k in range(4, 13)] + [f"2001-{k:02d}-01" for k in range(1, 7)]

STAGES = """,
q AS (SELECT quantile_cont(GROSS_SALES_SUM_L12M, 0.55) AS lo, quantile_cont(GROSS_SALES_SUM_L12M, 0.998) AS hi FROM monthly),
staged AS (SELECT m.*, GROSS_SALES_SUM_L12M AS v, lo, hi FROM monthly m CROSS JOIN q)"""
STAGE_WHERE = {
    "loaded": "true",
    "upper_removed": "v < hi",
    "lower_removed": "v < hi AND v > lo",
    "upper_end": "v >= hi",
    "lower_end": "v < hi AND v <= lo",
}

PANEL_SUMS = [n for n in ACTIVITY_SUMS if n not in ("GROSS_SALES", "BOOKING_DATES", "BOOKOUT")]
PANEL_RATIOS = {
    "SEARCHES_FAILED_PCT": ("SEARCHES_FAILED", "SEARCHES_TOTAL"),
    "VALUATIONS_FAILED_PCT": ("VALUATIONS_FAILED", "VALUATIONS_TOTAL"),
    "CANCELLATION_V_BOOKING_RATIO": ("BOOKINGCANCELLATION", "BOOKINGS_TOTAL"),
}
PANEL_VALUES = [*PANEL_SUMS, "AVG_MARKUP", *PANEL_RATIOS]
FINE = ("AVG_MARKUP", *PANEL_RATIOS)
PANEL = ACTIVITY + f""",
panel AS (
  SELECT lvl AS CUSTOMER_REPORTING_LEVEL, branch AS ID_CUSTOMER_BRANCH, CAST(date_trunc('month', DATE) AS DATE) AS DATE_MONTH,
    {", ".join(f"sum({n}) AS {n}" for n in PANEL_SUMS)}, avg(MARKUP) AS AVG_MARKUP,
    {", ".join(f"sum({a}) / nullif(sum({b}), 0) AS {n}" for n, (a, b) in PANEL_RATIOS.items())},
    max(coalesce(CREDIT_OR_PREPAYMENT, '')) IN ('C', 'C & P') AS PAYMENT_CREDIT,
    max(coalesce(CREDIT_OR_PREPAYMENT, '')) IN ('P', 'C & P') AS PAYMENT_PREPAYMENT,
    CAST(month(date_trunc('month', min(DATE))) AS INTEGER) AS MONTH_NUMBER, sum(RN) = 0 AS IS_CHURNED
  FROM activity GROUP BY 1, 2, 3
)"""
ENTITY = "CUSTOMER_REPORTING_LEVEL, ID_CUSTOMER_BRANCH"
MONTH = f"{text('DATE_MONTH')} AS DATE_MONTH"


def panel_column(name: str) -> str:
    return rnd(name, 9) if name in FINE else f"CAST({name} AS BIGINT)"


def lag_columns(names: list[str]) -> str:
    over = f"OVER (PARTITION BY {ENTITY} ORDER BY DATE_MONTH)"
    cells = []
    for name in names:
        for k in (1, 2, 3):
            cell = f"lag({name}, {k}) {over}"
            if name in FINE:
                cell = rnd(cell, 9)
            elif name != "IS_CHURNED":
                cell = f"CAST({cell} AS BIGINT)"
            cells.append(f"{cell} AS {name}_LAG_{k}")
    return ", ".join(cells)


# ---- daily -----------------------------------------------------------------------------------------

DAILY = ORDERS + """,
sold AS (
  SELECT c.c_nationkey AS lvl, o.day, sum(o.rn) AS rn, count(*) FILTER (o.o_orderstatus = 'F') AS done
  FROM ord o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2
),
daily AS (
  SELECT n.n_nationkey AS CUSTOMER_REPORTING_LEVEL, CAST(g AS DATE) AS DATE, n.n_name AS CUSTOMER_RL_NAME,
    r.r_name AS CUSTOMER_RL_COUNTRY_NAME, n.n_nationkey % 2 = 0 AS CUSTOMER_RL_BL_RETAIL,
    n.n_nationkey % 3 = 0 AS CUSTOMER_RL_WHOLESALE,
    CASE r.r_name WHEN 'AFRICA' THEN 'MEAI & ROE LT' WHEN 'AMERICA' THEN 'Americas Core' WHEN 'ASIA' THEN 'APAC Core'
      WHEN 'MIDDLE EAST' THEN 'China' END AS COMMERCIAL_AREA,
    CAST(coalesce(s.rn, 0) AS BIGINT) AS RN, CAST(coalesce(s.done, 0) AS BIGINT) AS BOOKINGCANCELLATION
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  CROSS JOIN generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY) t(g)
  LEFT JOIN sold s ON s.lvl = n.n_nationkey AND s.day = CAST(g AS DATE)
)"""
DAY_ID = f"CUSTOMER_REPORTING_LEVEL, {text('DATE')} AS DATE, RN"

GATED = DAILY + """,
period AS (
  SELECT *, sum(CASE WHEN DATE BETWEEN DATE '2000-06-01' AND DATE '2000-11-30' THEN RN ELSE 0 END)
    OVER (PARTITION BY CUSTOMER_REPORTING_LEVEL) AS RN_GATE
  FROM daily WHERE DATE BETWEEN DATE '1999-08-01' AND DATE '2001-08-01'
),
gated AS (SELECT * FROM period WHERE RN_GATE <> 0),
watched AS (SELECT * FROM gated WHERE RN_GATE > 10)"""


def rolling(source: str) -> str:
    recent = "(PARTITION BY CUSTOMER_REPORTING_LEVEL ORDER BY DATE ROWS BETWEEN 84 PRECEDING AND 1 PRECEDING)"
    weekday = (
        "(PARTITION BY CUSTOMER_REPORTING_LEVEL, dayname(DATE) ORDER BY DATE ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    )
    return (
        f"SELECT *, avg(RN) OVER {recent} AS AVG_RN_12W, stddev_samp(RN) OVER {recent} AS STD_RN_12W, "
        f"avg(RN) OVER {weekday} AS AVG_RN_WEEKDAY12W, stddev_samp(RN) OVER {weekday} AS STD_RN_WEEKDAY12W FROM {source}"
    )


ROLLED = GATED + f""",
history AS ({rolling("watched")}),
rolled AS (
  SELECT * FROM history WHERE AVG_RN_12W IS NOT NULL AND STD_RN_12W IS NOT NULL
    AND AVG_RN_WEEKDAY12W IS NOT NULL AND STD_RN_WEEKDAY12W IS NOT NULL
)"""


def log_pmf(i: str, mu: str, r: str) -> str:
    p = f"({r} / ({r} + {mu}))"
    return f"lgamma({i} + {r}) - lgamma({r}) - lgamma({i} + 1) + {r} * ln({p}) + {i} * ln(1 - {p})"


def cdf(mu: str, r: str) -> str:
    """Sum of the probability function, evaluated once per distinct (count, mean, deviation)."""
    return f"""SELECT k, mu, r, sum(exp({log_pmf("i", "mu", "r")})) AS cdf
    FROM (SELECT DISTINCT RN AS k, {mu} AS mu, {r} AS r FROM rolled WHERE {mu} > 0 AND {r} > 0) d,
      LATERAL (SELECT unnest(range(0, d.k + 1)) AS i) GROUP BY k, mu, r"""


SCORED_DAYS = ROLLED + f""",
cdf_recent AS ({cdf("AVG_RN_12W", "STD_RN_12W")}),
cdf_weekday AS ({cdf("AVG_RN_WEEKDAY12W", "STD_RN_WEEKDAY12W")}),
days AS (
  SELECT t.*, a.cdf AS CDF_RN_12W_NBINOM, b.cdf AS CDF_RN_WEEKDAY12W_NBINOM,
    CASE WHEN t.AVG_RN_12W >= 5 THEN b.cdf END AS CDF_RN_WEEKDAY12W_NBINOM_FLOOR
  FROM rolled t
  LEFT JOIN cdf_recent a ON a.k = t.RN AND a.mu = t.AVG_RN_12W AND a.r = t.STD_RN_12W
  LEFT JOIN cdf_weekday b ON b.k = t.RN AND b.mu = t.AVG_RN_WEEKDAY12W AND b.r = t.STD_RN_WEEKDAY12W
),
medians AS (
  SELECT *, median(CDF_RN_WEEKDAY12W_NBINOM_FLOOR) OVER (PARTITION BY CUSTOMER_RL_COUNTRY_NAME, DATE) AS AVG_COUNTRY_DAY_PROB
  FROM days
),
flagged AS (
  SELECT *, coalesce(CDF_RN_12W_NBINOM <= 0.01, false) AS CDF_RN_12W_NBINOM_FLAG,
    coalesce(CDF_RN_WEEKDAY12W_NBINOM <= 0.01, false) AS CDF_RN_WEEKDAY12W_NBINOM_FLAG,
    coalesce(AVG_COUNTRY_DAY_PROB >= 0.01, false) AS AVG_COUNTRY_DAY_PROB_FLAG
  FROM medians
),
complete AS (
  SELECT *, {" AND ".join(FLAGS)} AS RN_FLAG_ALL, CASE WHEN {" AND ".join(FLAGS)} THEN RN END AS RN_WITH_FLAG FROM flagged
)"""

RUNS = DAILY + """,
marked AS (
  SELECT *, CASE WHEN RN > 0 THEN 0 ELSE sum(CASE WHEN RN = 0 THEN 0 ELSE 1 END)
      OVER (PARTITION BY CUSTOMER_REPORTING_LEVEL ORDER BY DATE) END AS GRP,
    sum(RN) OVER (PARTITION BY CUSTOMER_REPORTING_LEVEL ORDER BY DATE) AS so_far
  FROM daily
),
runs AS (
  SELECT *, CASE WHEN RN = 0 AND so_far > 0
    THEN sum(1) OVER (PARTITION BY CUSTOMER_REPORTING_LEVEL, GRP ORDER BY DATE) ELSE 0 END AS CONSECUTIVE_ZERO_TRADING_DAYS
  FROM marked
),
profile AS (
  SELECT CUSTOMER_REPORTING_LEVEL, CUSTOMER_RL_NAME, CUSTOMER_RL_COUNTRY_NAME, CUSTOMER_RL_BL_RETAIL, CUSTOMER_RL_WHOLESALE,
    COMMERCIAL_AREA, avg(RN) AS AVG_RN, sum(RN) AS SUM_RN,
    max(CONSECUTIVE_ZERO_TRADING_DAYS) AS MAX_CONSECUTIVE_ZERO_TRADING_DAYS
  FROM runs GROUP BY ALL
)"""


def statements() -> dict[str, str]:
    """SQL per job name."""
    sql: dict[str, str] = {}

    # slot engine
    sql["churn_slots"] = with_(
        SLOTS,
        f"SELECT PK, TIME_SLOT, {text('DATE_TIME_SLOT')} AS DATE_TIME_SLOT, CAST(RN AS BIGINT) AS RN, "
        f"{rounded(['GROSS_SALES', 'GROSS_COMMERCIAL_COST', 'ONE_OM', 'AMOUNT_OVERRIDE_EUR'], 4)}, BOOKING_DATES, "
        f"{text('MIN_BOOKING_DATE')} AS MIN_BOOKING_DATE, {text('MAX_BOOKING_DATE')} AS MAX_BOOKING_DATE, "
        f"{rounded(['MARKUP', 'CHANNEL_MARKUP'], 9)}, {rnd('CALLS_AVG_CASE_AGING')} AS CALLS_AVG_CASE_AGING, "
        "SEARCHES_TOTAL, VALUATIONS_TOTAL, BOOKINGCANCELLATION, CAST(SEARCHES_FAILED AS BIGINT) AS SEARCHES_FAILED, "
        "REGION, SEGMENTATION, HOTEL_CATEGORY_GROUP, HAS_SOME_GND FROM slots",
    )
    sql["slot_source"] = sql["churn_slots"]
    least = features(*[(m, "MIN", LENGTHS, "agg") for m in ("MARKUP", "CALLS_AVG_CASE_AGING", "RN")])
    sql["slot_minimum"] = with_(SLOTS, scenario_rows(least, ALL_SCENARIOS))
    sql["slot_features_agg"] = with_(SLOTS, scenario_rows(AGG))
    sql["slot_features_only"] = with_(SLOTS, scenario_rows(ONLY))
    sql["slot_recency"] = with_(SLOTS, scenario_rows(RECENCY, ALL_SCENARIOS))
    has = "count(*) FILTER (TIME_SLOT = {s}) > 0"
    sql["slot_presence"] = with_(
        SLOTS + ", traded AS (SELECT * FROM slots WHERE GROSS_SALES > 0)",
        scenario_rows(
            [], ALL_SCENARIOS, "traded",
            "HAVING " + " AND ".join(has.format(s=f"m - {k}") for k in range(5)),
        ),
    )
    for name, lines, metric in (
        ("client", client_lines(), "GROSS_SALES"), ("hotel", hotel_lines(), "GROSS_COMMERCIAL_COST")
    ):
        extra, columns = catalogue(lines)
        sql[f"{name}_training_set"] = with_(
            SLOTS + extra, scenario_rows([*columns, *label_columns(metric=metric)], ALL_SCENARIOS, "wide")
        )
    sql["slot_presence_long_windows"] = with_(
        SLOTS + ", traded AS (SELECT * FROM slots WHERE GROSS_SALES > 0)",
        scenario_rows(
            features(("RN", "SUM", (2, 4), "agg")), ALL_SCENARIOS, "traded",
            "HAVING count(CASE WHEN TIME_SLOT BETWEEN m AND m + 1 THEN 1 END) > 0"
            " AND count(CASE WHEN TIME_SLOT BETWEEN m AND m + 3 THEN 1 END) > 0",
        ),
    )
    sql["churn_labels_16"] = with_(SLOTS, scenario_rows(label_columns()))
    long_parts = " UNION ALL ".join(
        f"SELECT PK, SCENARIO_DATE, {ph} AS PH, {cp} AS CP, GROSS_SALES_TARGET_PH_{ph}_CP_{cp} AS TARGET, "
        f"CHURN_PH_{ph}_CP_{cp}S AS CHURN FROM l"
        for ph, cp in PAIRS
    )
    sql["churn_labels_long"] = with_(SLOTS + ", l AS (" + scenario_rows(label_columns()) + ")", long_parts)
    sql["churn_training_set"] = with_(SLOTS, scenario_rows([*AGG, *ONLY, *RECENCY, *label_columns()], (5,)))
    sql["churn_today"] = with_(SLOTS, scenario_rows([*AGG, *RECENCY, *label_columns()]))
    sql["churn_scenarios"] = with_(SLOTS, scenario_rows([*AGG, *RECENCY, *label_columns()], REPLAYS))
    sql["scenario_control_totals"] = with_(
        sales_cte(ALL_SCENARIOS),
        f"SELECT SCENARIO_DATE, count(*) AS N_ROWS, {rnd('sum(GROSS_SALES_TARGET_PH_1_CP_1)', 2)} AS TARGET_TOTAL, "
        f"{rnd('sum(FF_GROSS_SALES_SUM_L1S)', 2)} AS LAST_SLOT_TOTAL FROM sales GROUP BY SCENARIO_DATE",
    )
    sql["active_population"] = with_(
        sales_cte(ALL_SCENARIOS),
        "SELECT PK, SCENARIO_DATE, FF_GROSS_SALES_SUM_L4S, CHURN_PH_1_CP_1S FROM sales WHERE FF_GROSS_SALES_SUM_L4S > 0.005",
    )
    sql["exclude_guaranteed"] = with_(
        sales_cte(ALL_SCENARIOS),
        "SELECT PK, SCENARIO_DATE, FF_GROSS_SALES_SUM_L1S FROM sales WHERE FF_HAS_SOME_GND_MAX_L1S = 0",
    )
    sql["split_dev_test"] = with_(
        sales_cte(REPLAYS),
        "SELECT PK, SCENARIO_DATE, CASE WHEN SCENARIO_DATE IN (SELECT DISTINCT SCENARIO_DATE FROM sales ORDER BY 1 LIMIT 2) "
        "THEN 'test' ELSE 'dev' END AS SPLIT, FF_GROSS_SALES_SUM_L1S FROM sales",
    )
    sql["column_profile"] = profile_sql()
    sql["mixed_profile"] = mixed_profile_sql()
    sql["correlated_pairs"] = correlation_sql()

    # evaluation and publishing
    sql["project_scored"] = with_(scored_cte(), "SELECT PK, SCENARIO_DATE, TARGET, PROBA FROM scored")
    sql["upload_list"] = with_(
        scored_cte(),
        f"SELECT PK, {text('SCENARIO_DATE')} AS SCENARIO_DATE, TARGET AS CHURN, PROBA FROM scored "
        "ORDER BY PK, SCENARIO_DATE LIMIT 10000",
    )
    sql["high_risk_true_churn"] = with_(
        scored_cte(), "SELECT PK, SCENARIO_DATE, PROBA FROM scored WHERE PROBA >= 0.75 AND TARGET"
    )
    curve = f"{rnd('THRESHOLD', 9)} AS THRESHOLD, {rnd('FPR', 9)} AS FPR, {rnd('TPR', 9)} AS TPR"
    sql["roc_curve"] = with_(
        scored_cte() + ROC, f"SELECT {curve} FROM curve UNION ALL SELECT NULL, 0.0, 0.0"
    )
    sql["roc_auc"] = with_(
        scored_cte() + ROC, f"SELECT {rnd('sum(neg * (tp - pos / 2)) / (max(p) * max(n))', 9)} AS ROC_AUC FROM run"
    )
    sql["r_squared"] = with_(
        scored_cte(),
        "SELECT FF_GROSS_SALES_SUM_L13S > 1000000 AS LARGE, count(*) AS N_ROWS, "
        f"{rnd('1 - sum(pow(CAST(CAST(TARGET AS INTEGER) AS DOUBLE) - PROBA, 2)) / nullif(var_pop(CAST(TARGET AS INTEGER)) * count(*), 0)', 6)} AS R2 "
        "FROM scored WHERE TARGET IS NOT NULL GROUP BY ALL",
    )
    sql["roc_points"] = with_(
        scored_cte() + ROC,
        f"SELECT CAST(REQUESTED AS DOUBLE) AS REQUESTED, {curve} FROM (SELECT *, row_number() OVER (PARTITION BY REQUESTED "
        "ORDER BY abs(THRESHOLD - REQUESTED), THRESHOLD DESC) AS k FROM curve "
        "CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) q(REQUESTED)) WHERE k = 1",
    )
    sql["confusion_matrix"] = with_(scored_cte() + CELLS, "SELECT * FROM cells")
    sql["classification_metrics"] = with_(
        scored_cte() + CELLS,
        f"SELECT {rnd('(TN + TP) / (TN + TP + FN + FP)', 9)} AS ACCURACY, {rnd('TP / nullif(TP + FP, 0)', 9)} AS "
        f"POSITIVE_ACCURACY, {rnd('TN / nullif(TN + FN, 0)', 9)} AS NEGATIVE_ACCURACY FROM cells",
    )
    auc = "sum(neg * (tp - pos / 2)) / (max(p) * max(n))"
    sql["run_metrics"] = with_(
        scored_cte() + CELLS + ROC,
        "SELECT 'today' AS RUN, '1' AS PH, '1' AS CP, METRIC, VALUE FROM ("
        f"SELECT 'ACCURACY' AS METRIC, {rnd('(TN + TP) / (TN + TP + FN + FP)', 9)} AS VALUE FROM cells"
        f" UNION ALL SELECT 'POSITIVE_ACCURACY', {rnd('TP / nullif(TP + FP, 0)', 9)} FROM cells"
        f" UNION ALL SELECT 'NEGATIVE_ACCURACY', {rnd('TN / nullif(TN + FN, 0)', 9)} FROM cells"
        f" UNION ALL SELECT 'ROC_AUC', {rnd(auc, 9)} FROM run) WHERE VALUE IS NOT NULL",
    )
    sql["contribution_curve"] = with_(
        scored_cte() + CURVE,
        f"SELECT PK, {rnd('v')} AS FF_ONE_OM_SUM_L13S, pos AS POSITION, {rnd('cum')} AS CUMULATIVE, "
        f"{rnd('cum / total', 9)} AS SHARE FROM ranked",
    )
    sql["contribution_topn"] = with_(
        scored_cte() + CURVE,
        f"SELECT PK, pos AS POSITION, {rnd('cum / total', 9)} AS SHARE FROM ranked ORDER BY pos LIMIT 50000",
    )
    sql["rank_max_margin"] = with_(
        scored_cte(),
        f"SELECT PK, {rnd('FF_ONE_OM_SUM_L13S')} AS FF_ONE_OM_SUM_L13S, count(*) OVER (ORDER BY FF_ONE_OM_SUM_L13S DESC "
        "RANGE UNBOUNDED PRECEDING) AS RANK FROM scored",
    )
    probas = ", ".join(
        f"round(1 / (1 + FF_GROSS_SALES_SUM_L{ph}S / 100000.0), 3) AS PROBA_{ph}S, CHURN_PH_{ph}_CP_4S AS CHURN_{ph}S"
        for ph in (4, 3, 2, 1)
    )
    sql["churn_publish_wide"] = with_(
        sales_cte((4,)),
        f"SELECT PK, SCENARIO_DATE, FF_ONE_OM_SUM_L13S, FF_REGION_MAX_L1S, {probas}, count(*) OVER (ORDER BY "
        "FF_ONE_OM_SUM_L13S DESC RANGE UNBOUNDED PRECEDING) AS RANK FROM sales WHERE FF_GROSS_SALES_SUM_L4S > 0.005",
    )
    sql["stratified_folds"] = with_(
        scored_cte(),
        "SELECT PK, TARGET, CAST((row_number() OVER (PARTITION BY TARGET ORDER BY PK) - 1) % 6 AS INTEGER) AS FOLD FROM scored",
    )
    sql["class_weights"] = with_(
        scored_cte(),
        f"SELECT PK, TARGET, {rnd('count(*) OVER () / ((SELECT count(DISTINCT TARGET) FROM scored) * count(*) OVER (PARTITION BY TARGET))', 9)}"
        " AS WEIGHT FROM scored",
    )

    # ledger
    one = ledger_ctes(ONE_MONTH)
    sql["sql_base_ledger"] = with_(
        one,
        f"SELECT PK, {text('ETL')} AS ETL, {text('day')} AS BOOKING_DATE, CAST(RN_ AS BIGINT) AS RN_, "
        f"{rnd('GROSS_SALES_')} AS GROSS_SALES_, {text('brk')} AS BREAK, R FROM base",
    )
    sql["sql_booking_gaps"] = with_(
        one, f"SELECT PK, {text('day')} AS BOOKING_DATE, {text('DAY_LAG')} AS DAY_LAG, DIFF_DAYS FROM base"
    )
    sql["sql_lifecycle_quarters"] = with_(
        one,
        f"SELECT PK, {text('day')} AS BOOKING_DATE, {text('FIRST_BOOKING_DATE')} AS FIRST_BOOKING_DATE, "
        "age AS TIME_FROM_FIRST_BOOKING, step AS SPLIT_TIME, CASE WHEN day >= brk - step THEN 'T4' "
        "WHEN day >= brk - 2 * step THEN 'T3' WHEN day >= brk - 3 * step THEN 'T2' ELSE 'T1' END AS TIME FROM base",
    )
    sql["sql_disputes"] = with_(one, f"SELECT PK, {text('ETL')} AS ETL, {rounded(DISPUTE_COLUMNS, 4)} FROM disp")
    sql["sql_markups"] = with_(one, f"SELECT PK, {text('ETL')} AS ETL, {rounded(MARKUP_COLUMNS, 9)} FROM mark")
    sql["sql_trend_slope"] = with_(one, f"SELECT PK, {rounded(['SLOPE_RN', 'SLOPE_GROSS_SALES'], 4)} FROM feat")
    sql["sql_label"] = with_(one, "SELECT PK, CAST(RN_LXM_TODAY AS BIGINT) AS RN_LXM_TODAY FROM lab")
    sql["sql_features"] = ledger_final(ONE_MONTH)
    sql["sql_features_multi_month"] = ledger_final(SEVEN_MONTHS)
    many = ledger_ctes(SEVEN_MONTHS)
    sql["sql_churn_variation"] = with_(
        many, f"SELECT {text('ETL')} AS ETL, CHURN_VARIATION, count(*) AS N_ROWS FROM final GROUP BY ETL, CHURN_VARIATION"
    )
    sql["balance_classes"] = with_(
        many + """, quota AS (
          SELECT floor(count(*) FILTER (CHURN_VARIATION IN ('C_L2M__NOT_C', 'NOT_C_L2M__C')) / 2) AS q FROM final
        ), numbered AS (
          SELECT PK, ETL, CHURN_VARIATION, row_number() OVER (PARTITION BY CHURN_VARIATION ORDER BY PK, ETL) AS k FROM final
        )""",
        f"SELECT PK, {text('ETL')} AS ETL, CHURN_VARIATION FROM numbered CROSS JOIN quota "
        "WHERE CHURN_VARIATION IN ('C_L2M__NOT_C', 'NOT_C_L2M__C') OR k <= q",
    )

    # calendar months
    today, past = month_ctes(["2001-07-01"]), month_ctes(HISTORY)
    sql["month_training_set"] = with_(month_ctes(["2001-06-01", "2001-07-01"], *month_catalogue()), "SELECT * FROM monthly")
    sql["month_features"] = with_(today, "SELECT * EXCLUDE (GROSS_SALES_TARGET, CHURN) FROM monthly")
    sql["month_labels"] = with_(today, "SELECT PK, SCENARIO_DATE, GROSS_SALES_TARGET, CHURN FROM monthly")
    ends = ["2001-03-31", "2001-04-30", "2001-05-31", "2001-06-30", "2001-07-31"]
    sql["month_end_scenarios"] = with_(month_ctes(ends), "SELECT * FROM monthly")
    sql["month_scenarios"] = with_(past, "SELECT * FROM monthly")
    sql["split_dev_test_calendar"] = with_(
        past,
        "SELECT PK, SCENARIO_DATE, CASE WHEN SCENARIO_DATE IN ('2001-06-01', '2001-05-01') THEN 'test' ELSE 'dev' END AS SPLIT, "
        "CHURN FROM monthly",
    )
    sql["dataset_status"] = with_(
        past + STAGES,
        " UNION ALL ".join(
            f"SELECT '{s}' AS STAGE, count(*) AS N_ROWS, count(DISTINCT PK) AS N_KEYS FROM staged WHERE {w}"
            for s, w in STAGE_WHERE.items()
        ),
    )
    sql["removal_effect"] = with_(
        past + STAGES,
        " UNION ALL ".join(
            f"SELECT '{s}' AS STAGE, round(avg(CAST(CHURN AS INTEGER)), 2) AS CHURN_PROBABILITY FROM staged WHERE {w}"
            for s, w in STAGE_WHERE.items()
        ),
    )
    sql["outlier_trim"] = with_(
        past + STAGES, "SELECT PK, SCENARIO_DATE, GROSS_SALES_SUM_L12M, CHURN FROM staged WHERE v < hi AND v > lo"
    )
    ratio_pairs = [
        (n, d, f"L{k}M")
        for k in (1, 12)
        for n, d in (
            ("BOOKINGCANCELLATION", "GROSS_SALES"), ("BOOKINGS_WITH_CASES_OPS", "GROSS_SALES"), ("BOOKOUT", "GROSS_SALES"),
            ("BOOKINGS_WITH_CASES_SALES", "GROSS_SALES"), ("BOOKINGS_WITH_CASES_FINANCE", "GROSS_SALES"),
            ("CALLS_TOTAL_NUM_CASES", "GROSS_SALES"),
            ("SEARCHES_FAILED", "SEARCHES_TOTAL"), ("VALUATIONS_TOTAL", "SEARCHES_TOTAL"),
        )
        if not (n == "VALUATIONS_TOTAL" and k == 1)
    ]
    sql["ratio_features"] = with_(
        past,
        "SELECT PK, SCENARIO_DATE, "
        + ", ".join(f"{rnd(f'{n}_SUM_{t} / greatest(1, {d}_SUM_{t})', 9)} AS P_{n}_{t}" for n, d, t in ratio_pairs)
        + " FROM monthly",
    )

    # panel
    values = ", ".join(f"{panel_column(n)} AS {n}" for n in PANEL_VALUES)
    sql["panel_monthly"] = with_(
        PANEL, f"SELECT {ENTITY}, {MONTH}, {values}, PAYMENT_CREDIT, PAYMENT_PREPAYMENT, MONTH_NUMBER, IS_CHURNED FROM panel"
    )
    peaks = "GROSS_SALES SEARCHES_TOTAL VALUATIONS_TOTAL BOOKINGCANCELLATION".split()
    sql["panel_peaks"] = with_(
        ACTIVITY,
        f"SELECT lvl AS CUSTOMER_REPORTING_LEVEL, branch AS ID_CUSTOMER_BRANCH, CAST(CAST(date_trunc('month', DATE) AS DATE) AS VARCHAR) AS DATE_MONTH, CAST(sum(RN) AS BIGINT) AS RN, "
        + ", ".join(rnd(f"max({m})") + f" AS {m}" if m == "GROSS_SALES" else f"CAST(max({m}) AS BIGINT) AS {m}" for m in peaks)
        + ", CAST(month(min(DATE)) AS INTEGER) AS MONTH_NUMBER, sum(RN) = 0 AS IS_CHURNED FROM activity GROUP BY lvl, branch, date_trunc('month', DATE)",
    )
    sql["panel_volume_filter"] = with_(
        ACTIVITY,
        "SELECT lvl AS CUSTOMER_REPORTING_LEVEL, branch AS ID_CUSTOMER_BRANCH, CAST(sum(RN) AS BIGINT) AS RN, count(*) AS N_ROWS "
        "FROM activity WHERE lvl IN (SELECT lvl FROM activity GROUP BY lvl HAVING sum(RN) >= 1000) "
        "AND branch IN (SELECT branch FROM activity GROUP BY branch HAVING sum(RN) >= 1000) GROUP BY lvl, branch",
    )
    preceding = f"(PARTITION BY {ENTITY} ORDER BY DATE_MONTH ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    sql["panel_rolling_12m"] = with_(
        PANEL,
        f"SELECT {ENTITY}, {MONTH}, CAST(RN AS BIGINT) AS RN, {rnd(f'avg(RN) OVER {preceding}', 8)} AS AVG_MONTHLY_RN_12M FROM panel",
    )
    sql["panel_lags"] = with_(
        PANEL, f"SELECT {ENTITY}, {MONTH}, IS_CHURNED, {lag_columns([*PANEL_VALUES, 'IS_CHURNED'])} FROM panel"
    )
    sql["panel_leakage_drop"] = with_(
        PANEL,
        f"SELECT {ENTITY}, {MONTH}, PAYMENT_CREDIT, PAYMENT_PREPAYMENT, MONTH_NUMBER, IS_CHURNED, {lag_columns(PANEL_VALUES)} FROM panel",
    )
    filled = " AND ".join(f"{n}_LAG_{k} IS NOT NULL" for n in [*PANEL_SUMS, "AVG_MARKUP"] for k in (1, 2, 3))
    sql["panel_complete_cases"] = with_(
        PANEL + f", lagged AS (SELECT {ENTITY}, {MONTH}, IS_CHURNED, {lag_columns(PANEL_VALUES)} FROM panel)",
        f"SELECT {ENTITY}, DATE_MONTH, IS_CHURNED, RN_LAG_1, AVG_MARKUP_LAG_1 FROM lagged WHERE {filled}",
    )
    sql["split_fixed_date"] = with_(
        PANEL,
        f"SELECT {ENTITY}, {MONTH}, CASE WHEN DATE_MONTH < DATE '2001-01-01' THEN 'train' ELSE 'test' END AS SPLIT, IS_CHURNED "
        "FROM panel WHERE DATE_MONTH >= DATE '2000-01-01'",
    )
    sql["newly_churned"] = with_(
        PANEL + f", prior AS (SELECT *, lag(IS_CHURNED) OVER (PARTITION BY {ENTITY} ORDER BY DATE_MONTH) AS was FROM panel)",
        f"SELECT {ENTITY}, {MONTH} FROM prior WHERE IS_CHURNED AND was = false",
    )
    sql["retail_population"] = with_(
        DAILY + ", r AS (SELECT *, CASE WHEN COMMERCIAL_AREA IS NOT NULL THEN CUSTOMER_RL_BL_RETAIL END AS RETAIL FROM daily)",
        f"SELECT {DAY_ID}, RETAIL FROM r WHERE coalesce(RETAIL, true)",
    )

    # daily anomalies
    sql["daily_active_gate"] = with_(GATED, f"SELECT {DAY_ID}, CAST(RN_GATE AS BIGINT) AS RN_GATE FROM gated")
    sql["zero_trading_runs"] = with_(
        RUNS,
        f"SELECT {DAY_ID}, CAST(GRP AS BIGINT) AS GRP, CAST(CONSECUTIVE_ZERO_TRADING_DAYS AS INTEGER) AS "
        "CONSECUTIVE_ZERO_TRADING_DAYS FROM runs",
    )
    full = DAILY + f", h AS ({rolling('daily')})"
    sql["rolling_12w"] = with_(full, f"SELECT {DAY_ID}, {rounded(['AVG_RN_12W', 'STD_RN_12W'], 7)} FROM h")
    sql["rolling_weekday_12w"] = with_(
        full, f"SELECT {DAY_ID}, {rounded(['AVG_RN_WEEKDAY12W', 'STD_RN_WEEKDAY12W'], 7)} FROM h"
    )
    segment = "CUSTOMER_RL_COUNTRY_NAME, CUSTOMER_RL_BL_RETAIL, CUSTOMER_RL_WHOLESALE"
    sql["country_p80"] = with_(
        GATED,
        f"SELECT {segment}, {text('DATE')} AS DATE, {rnd('quantile_cont(CAST(RN AS DOUBLE), 0.8)', 6)} AS P80_RN_COUNTRY "
        "FROM watched GROUP BY ALL",
    )
    sql["country_p80_sketch"] = with_(
        GATED, "SELECT CUSTOMER_RL_COUNTRY_NAME, CAST(count(RN) AS BIGINT) AS N_ROWS, true AS WITHIN FROM watched GROUP BY ALL"
    )
    sql["daily_typed"] = with_(
        ROLLED,
        f"SELECT {text('CUSTOMER_REPORTING_LEVEL')} AS CUSTOMER_REPORTING_LEVEL, {text('DATE')} AS DATE, CAST(RN AS INTEGER) AS RN, "
        "CUSTOMER_RL_NAME, CUSTOMER_RL_COUNTRY_NAME, round(CAST(CAST(AVG_RN_12W AS FLOAT) AS DOUBLE), 2) AS AVG_RN_12W, "
        f"round(CAST(CAST(quantile_cont(CAST(RN AS DOUBLE), 0.8) OVER (PARTITION BY {segment}, DATE) AS FLOAT) AS DOUBLE), 2) "
        "AS P80_RN_COUNTRY FROM rolled",
    )
    cdfs = ["CDF_RN_12W_NBINOM", "CDF_RN_WEEKDAY12W_NBINOM"]
    sql["nbinom_scores"] = with_(SCORED_DAYS, f"SELECT {DAY_ID}, {rounded(cdfs, 7)} FROM days")
    sql["nbinom_floor"] = with_(SCORED_DAYS, f"SELECT {DAY_ID}, {rounded(['CDF_RN_WEEKDAY12W_NBINOM_FLOOR'], 7)} FROM days")
    pmf = f"CASE WHEN AVG_RN_12W > 0 AND STD_RN_12W > 0 THEN exp({log_pmf('RN', 'AVG_RN_12W', 'STD_RN_12W')}) END"
    sql["nbinom_pmf"] = with_(ROLLED, f"SELECT {DAY_ID}, {rnd(pmf, 7)} AS PMF_RN_12W_NBINOM FROM rolled")
    sql["country_day_probability"] = with_(
        SCORED_DAYS, f"SELECT {DAY_ID}, {rnd('AVG_COUNTRY_DAY_PROB', 7)} AS COUNTRY_DAY_MEDIAN FROM medians"
    )
    flags = ", ".join(FLAGS)
    sql["anomaly_flags"] = with_(SCORED_DAYS, f"SELECT {DAY_ID}, {flags} FROM flagged")
    sql["anomaly_entity"] = with_(SCORED_DAYS, f"SELECT {DAY_ID}, {flags} FROM flagged WHERE CUSTOMER_REPORTING_LEVEL = 7")
    sql["customer_profile"] = with_(
        RUNS,
        f"SELECT CUSTOMER_REPORTING_LEVEL, CUSTOMER_RL_NAME, {segment}, COMMERCIAL_AREA, {rnd('AVG_RN', 6)} AS AVG_RN, "
        "CAST(SUM_RN AS BIGINT) AS SUM_RN, CAST(MAX_CONSECUTIVE_ZERO_TRADING_DAYS AS INTEGER) AS "
        "MAX_CONSECUTIVE_ZERO_TRADING_DAYS FROM profile",
    )

    # dashboard
    sql["bi_profile_daily"] = with_(
        RUNS,
        "SELECT p.CUSTOMER_REPORTING_LEVEL, CAST(p.SUM_RN AS BIGINT) AS SUM_RN, CAST(d.DAILY_RN AS BIGINT) AS DAILY_RN, N_DAYS, PEAK_RN "
        "FROM profile p JOIN (SELECT CUSTOMER_REPORTING_LEVEL, sum(RN) AS DAILY_RN, count(*) AS N_DAYS, max(RN) AS PEAK_RN FROM daily "
        "GROUP BY 1) d USING (CUSTOMER_REPORTING_LEVEL)",
    )
    sql["bi_daily_measures"] = with_(
        SCORED_DAYS,
        f"SELECT CUSTOMER_REPORTING_LEVEL, CUSTOMER_RL_NAME, {text('DATE')} AS DATE, CAST(sum(RN) AS BIGINT) AS SUM_OF_RN, "
        "CAST(sum(BOOKINGCANCELLATION) AS BIGINT) AS SUM_OF_CANCELLATIONS, CAST(sum(RN_WITH_FLAG) AS BIGINT) AS SUM_OF_FLAGGED_RN "
        "FROM complete GROUP BY ALL",
    )
    sql["bi_measures_long"] = with_(
        DAILY,
        " UNION ALL ".join(
            f"SELECT CUSTOMER_REPORTING_LEVEL, CUSTOMER_RL_NAME, {text('DATE')} AS DATE, '{n}' AS MEASURE, CAST(sum({c}) AS DOUBLE) "
            "AS VALUE FROM daily GROUP BY ALL"
            for n, c in (("SUM_OF_RN", "RN"), ("SUM_OF_CANCELLATIONS", "BOOKINGCANCELLATION"))
        ),
    )
    one_of = "CASE WHEN min({c}) = max({c}) THEN min({c}) WHEN count({c}) > 0 THEN '*' END AS {c}"
    sql["bi_attr"] = with_(
        DAILY,
        f"SELECT CUSTOMER_RL_COUNTRY_NAME, {one_of.format(c='CUSTOMER_RL_NAME')}, {one_of.format(c='COMMERCIAL_AREA')} "
        "FROM daily GROUP BY CUSTOMER_RL_COUNTRY_NAME",
    )
    sql["bi_customer_rank"] = with_(
        DAILY,
        "SELECT CUSTOMER_REPORTING_LEVEL, CAST(SUM_RN AS BIGINT) AS SUM_RN, CAST(rank() OVER (ORDER BY SUM_RN DESC) AS VARCHAR) AS RN_RANK "
        "FROM (SELECT CUSTOMER_REPORTING_LEVEL, sum(RN) AS SUM_RN FROM daily GROUP BY 1)",
    )
    sql["bi_area_bins"] = with_(
        RUNS + """, binned AS (
          SELECT *, CASE
            WHEN COMMERCIAL_AREA IN ('APAC Core', 'Americas Core', 'Med & MEAI Core', 'North Europe Core') THEN 'Core'
            WHEN COMMERCIAL_AREA IN ('APAC LT', 'Americas LT', 'Iberia, UK & Dach LT', 'MEAI & ROE LT') THEN 'LT'
            ELSE 'Others' END AS AREA_GROUP FROM profile
        )""",
        "SELECT CUSTOMER_REPORTING_LEVEL, COMMERCIAL_AREA, AREA_GROUP, AREA_GROUP = 'LT' AND AVG_RN >= 2 AS LT_ACTIVE FROM binned",
    )
    sql["bi_flagged_rn"] = with_(SCORED_DAYS, f"SELECT {DAY_ID}, RN_FLAG_ALL, RN_WITH_FLAG FROM complete")
    members = ", ".join(f"'NATION_{k}'" for k in range(0, 25, 2))
    sql["bi_member_filter"] = with_(
        DAILY,
        f"SELECT {DAY_ID}, COMMERCIAL_AREA FROM daily WHERE (COMMERCIAL_AREA IS NULL OR COMMERCIAL_AREA NOT IN ('China', "
        f"'Americas Core')) AND CUSTOMER_RL_NAME IN ({members})",
    )
    sql["flag_combinations"] = with_(SCORED_DAYS, f"SELECT {flags}, count(*) AS N_ROWS FROM flagged GROUP BY ALL")
    x, y = "ln(MAX_CONSECUTIVE_ZERO_TRADING_DAYS)", "ln(AVG_RN)"
    sql["power_trend"] = with_(
        RUNS,
        f"SELECT {rnd(f'exp(regr_intercept({y}, {x}))', 6)} AS A, {rnd(f'regr_slope({y}, {x})', 6)} AS B, count(*) AS N_POINTS "
        "FROM profile WHERE MAX_CONSECUTIVE_ZERO_TRADING_DAYS > 0 AND AVG_RN > 0",
    )
    sql["bi_reference_average"] = with_(DAILY, f"SELECT {rnd('avg(RN)', 6)} AS REFERENCE FROM daily")

    # sources and sinks
    sql["scan_orders"] = (
        f"SELECT o_orderkey, o_custkey, {rnd('o_totalprice', 2)} AS o_totalprice, {text('CAST(o_orderdate AS DATE)')} AS o_day "
        "FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus = 'F'"
    )
    sql["snapshot_roundtrip"] = with_(
        sales_cte(ALL_SCENARIOS),
        f"SELECT SCENARIO_DATE, count(*) AS N_ROWS, {rnd('sum(FF_RN_SUM_L13S)', 2)} AS RN_TOTAL FROM sales GROUP BY SCENARIO_DATE",
    )
    sql["csv_export_roundtrip"] = with_(
        DAILY,
        f"SELECT CUSTOMER_REPORTING_LEVEL, {text('DATE')} AS DATE, CUSTOMER_RL_NAME, {segment}, COMMERCIAL_AREA, RN, "
        "BOOKINGCANCELLATION FROM daily",
    )
    return sql
