"""Validation, upserts, joins, sources and sinks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside import constants as K
from trackside.functions.scalars import (
    clamp,
    compound_code,
    int_or_zero,
    iso_micros,
    null_if_nan,
    parse_iso,
    parse_with_format,
    path_token,
    pct_true,
)
from trackside.operators.numbering import numbered
from trackside.operators.quality import any_value, mean_within, quality_report, within
from trackside.operators.tables import dedup_first, expand_range, union_all, upsert
from trackside.operators.validate import split_valid
from trackside.plans.builds import pick_run, triage
from trackside.plans.gateway import ReadOnlySql
from trackside.plans.season import list_sessions, resolve_session
from trackside.plans.served import run_history
from trackside.session import scratch_path
from trackside.sources.archive import archive_json, read_archive
from trackside.sources.bronze import land_bronze, read_bronze, read_files
from trackside.sources.ci import JOBS_SCHEMA, flatten_steps, read_reports
from trackside.sources.files import names
from trackside.sources.lakehouse import publish, published, read_table, replace_partitions
from trackside.sources.runs import log_runs, run_record
from trackside.specs import DOUBLE, LONG, RUNS, TEXT, TIME, Field, TableSpec
from workload.registry import query, table
from workload.series import ISO


def k_of():
    """The number inside an event's props."""
    return F.regexp_extract("props", r"(\d+)", 1).cast("bigint")


K_SQL = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

# --- validation -----------------------------------------------------------------------------

_RAW_SPEC = TableSpec(
    "raw_events",
    (
        Field("session_key", LONG),
        Field("year", LONG, between=K.YEAR_RANGE),
        Field("date", TIME),
        Field("reading", DOUBLE, False),
        Field("category", TEXT),
    ),
)
_TYPED_SPEC = TableSpec(
    "typed_events",
    (Field("session_key", LONG), Field("rpm", LONG, False), Field("drs", LONG, False), Field("note", TEXT, False)),
    mode="types",
)


def _raw_events(spark, sf_dir):
    """Events as untyped text records, some of them broken in one or more columns."""
    k = F.col("k")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k_of())
        .select(
            "event_id",
            F.when(k % 17 == 0, F.lit(None))
            .when(k % 13 == 0, F.lit("n/a"))
            .otherwise(F.col("user_id").cast("string"))
            .alias("session_key"),
            (k + 1990).alias("year"),
            F.when(k % 11 == 0, F.lit("broken")).otherwise(iso_micros(F.col("ts"))).alias("date"),
            F.when(k % 19 == 0, F.lit("x")).when(k % 7 == 0, F.lit(None)).otherwise(F.col("value").cast("string")).alias("reading"),
            F.when(k % 23 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("category"),
        )
    )


_RAW = f"""
    e AS (SELECT *, {K_SQL} AS k FROM events),
    raw AS (SELECT event_id,
                   CASE WHEN k % 17 = 0 THEN NULL WHEN k % 13 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS session_key,
                   k + 1990 AS year,
                   CASE WHEN k % 11 = 0 THEN 'broken' ELSE strftime(ts, {ISO}) END AS date,
                   CASE WHEN k % 19 = 0 THEN 'x' WHEN k % 7 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS reading,
                   CASE WHEN k % 23 = 0 THEN NULL ELSE event_type END AS category
            FROM e),
    checked AS (SELECT *, concat_ws('; ',
                   CASE WHEN session_key IS NOT NULL AND try_cast(session_key AS BIGINT) IS NULL
                        THEN 'session_key: cannot be read as bigint' END,
                   CASE WHEN session_key IS NULL THEN 'session_key: field required' END,
                   CASE WHEN year NOT BETWEEN 2000 AND 2100 THEN 'year: outside [2000, 2100]' END,
                   CASE WHEN try_cast(date AS TIMESTAMP) IS NULL THEN 'date: cannot be read as timestamp_ntz' END,
                   CASE WHEN reading IS NOT NULL AND try_cast(reading AS DOUBLE) IS NULL
                        THEN 'reading: cannot be read as double' END,
                   CASE WHEN category IS NULL THEN 'category: field required' END) AS problems
                FROM raw)
"""


@query(
    f"""
    WITH {_RAW}
    SELECT event_id, CAST(session_key AS BIGINT) AS session_key, year, strftime(CAST(date AS TIMESTAMP), {ISO}) AS date,
           CAST(reading AS DOUBLE) AS reading, category
    FROM checked WHERE problems = ''
    """
)
def validate_valid(spark, sf_dir):
    valid = split_valid(_raw_events(spark, sf_dir), _RAW_SPEC, "contract not met").valid
    return valid.withColumn("date", iso_micros(F.col("date")))


@query(
    f"""
    WITH {_RAW}
    SELECT event_id, session_key, year, date, reading, category, problems AS error_detail,
           'contract not met' AS quarantine_reason
    FROM checked WHERE problems <> ''
    """
)
def validate_quarantine(spark, sf_dir):
    return split_valid(_raw_events(spark, sf_dir), _RAW_SPEC, "contract not met").quarantine.drop(
        "quarantine_timestamp"
    )


@query(
    f"""
    WITH e AS (SELECT event_id, CASE WHEN {K_SQL} % 29 = 0 THEN NULL ELSE user_id END AS session_key, value AS rpm,
                      CASE WHEN {K_SQL} % 3 = 0 THEN '1.7' WHEN {K_SQL} % 5 = 0 THEN NULL
                           ELSE ' ' || {K_SQL} || ' ' END AS drs,
                      {K_SQL} AS note
               FROM events)
    SELECT event_id, session_key, CAST(trunc(rpm) AS BIGINT) AS rpm, try_cast(trim(drs) AS BIGINT) AS drs,
           CAST(note AS VARCHAR) AS note
    FROM e WHERE session_key IS NOT NULL AND drs IS NOT NULL AND drs <> '1.7'
    """
)
def validate_types(spark, sf_dir):
    """Cast mode: fractions are cut, unreadable or missing integers leave the table."""
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(k_of() % 29 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("session_key"),
        F.col("value").alias("rpm"),
        F.when(k_of() % 3 == 0, F.lit("1.7"))
        .when(k_of() % 5 == 0, F.lit(None))
        .otherwise(F.concat(F.lit(" "), k_of().cast("string"), F.lit(" ")))
        .alias("drs"),
        k_of().alias("note"),
    )
    return split_valid(raw, _TYPED_SPEC, "types").valid


@query(
    f"""
    WITH t AS (SELECT event_id, CASE WHEN {K_SQL} % 5 = 0 THEN 'x' || {K_SQL} WHEN {K_SQL} % 5 = 1 THEN {K_SQL} || '.7'
                                     WHEN {K_SQL} % 5 = 2 THEN NULL ELSE CAST({K_SQL} AS VARCHAR) END AS raw
               FROM events)
    SELECT event_id, coalesce(CAST(trunc(try_cast(raw AS DOUBLE)) AS BIGINT), 0) AS reading FROM t
    """
)
def coerce_numeric(spark, sf_dir):
    text = k_of().cast("string")
    raw = (
        F.when(k_of() % 5 == 0, F.concat(F.lit("x"), text))
        .when(k_of() % 5 == 1, F.concat(text, F.lit(".7")))
        .when(k_of() % 5 == 2, F.lit(None))
        .otherwise(text)
    )
    return table(spark, sf_dir, "events").select("event_id", int_or_zero(raw).alias("reading"))


@query(
    f"""
    SELECT o_orderkey,
           CASE o_orderkey % 4 WHEN 2 THEN strftime(o_orderdate - INTERVAL 3 HOURS, {ISO})
                               WHEN 3 THEN NULL ELSE strftime(o_orderdate, {ISO}) END AS at,
           CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, {ISO}) END AS exact_at
    FROM orders
    """
)
def parse_timestamps(spark, sf_dir):
    """ISO text without zone, in UTC, with an offset, and broken."""
    iso = iso_micros(F.col("o_orderdate"))
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, iso)
        .when(kind == 1, F.concat(iso, F.lit("Z")))
        .when(kind == 2, F.concat(iso, F.lit("+03:00")))
        .otherwise(F.concat(F.lit("about "), iso))
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", text.alias("text"))
        .select(
            "o_orderkey",
            iso_micros(parse_iso(F.col("text"))).alias("at"),
            iso_micros(parse_with_format(F.col("text"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("exact_at"),
        )
    )


@query(
    """
    SELECT p_partkey,
           CASE upper(p_type) WHEN 'ECONOMY' THEN 2.0::DOUBLE ELSE 2.0::DOUBLE END AS unknown_code,
           CASE WHEN p_size % 6 = 0 THEN 1.0::DOUBLE WHEN p_size % 6 = 1 THEN 2.0 WHEN p_size % 6 = 2 THEN 3.0
                WHEN p_size % 6 = 3 THEN 4.0 WHEN p_size % 6 = 4 THEN 5.0 ELSE 2.0 END AS compound_num,
           CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END AS position,
           greatest(0.0, least(100.0, p_retailprice / 10 - 20)) AS clamped,
           replace(p_name, ' ', '_') AS token,
           CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price
    FROM part
    """
)
def normalise_defaults(spark, sf_dir):
    """Defaults, code tables, clamping and tokens on the part table with gaps put in."""
    size = F.col("p_size")
    names = F.array(*[F.lit(n) for n in ("soft", "Medium", "HARD", "intermediate", "WET", "unknown")])
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        compound_code(F.col("p_type")).alias("unknown_code"),
        compound_code(names[size % 6]).alias("compound_num"),
        F.coalesce(F.when(size % 10 != 0, size), F.lit(0)).alias("position"),
        clamp(F.col("p_retailprice") / 10 - 20, 0.0, 100.0).alias("clamped"),
        path_token(F.col("p_name")).alias("token"),
        null_if_nan(F.when(size % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))).alias("price"),
    )


# --- joins and set operations ---------------------------------------------------------------


@query(
    """
    SELECT s.s_name AS driver, n.n_name AS team, l.l_orderkey, l.l_linenumber, l.l_quantity,
           strftime(l.l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') AS date
    FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
    """
)
def dim_enrich_inner(spark, sf_dir):
    dim = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(dim, F.col("l_suppkey") == F.col("s_suppkey"))
        .orderBy(F.asc_nulls_last("l_linenumber"), F.desc_nulls_last("l_quantity"), "l_orderkey")
        .select(
            F.col("s_name").alias("driver"),
            F.col("n_name").alias("team"),
            "l_orderkey",
            "l_linenumber",
            "l_quantity",
            iso_micros(F.col("l_shipdate")).alias("date"),
        )
    )


@query(
    """
    SELECT o.o_orderkey, coalesce(s.s_name, 'N/A') AS handled_by
    FROM orders o LEFT JOIN supplier s ON o.o_custkey = s.s_suppkey
    """
)
def dim_enrich_left(spark, sf_dir):
    """Rows without a dimension row stay, with a fallback text."""
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "supplier"), F.col("o_custkey") == F.col("s_suppkey"), "left")
        .select("o_orderkey", F.coalesce("s_name", F.lit("N/A")).alias("handled_by"))
    )


@query(
    """
    SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity,
           coalesce(a.c_name, CAST(l.l_partkey AS VARCHAR)) AS first_name,
           coalesce(b.c_name, CAST(l.l_suppkey AS VARCHAR)) AS second_name
    FROM lineitem l LEFT JOIN customer a ON l.l_partkey = a.c_custkey LEFT JOIN customer b ON l.l_suppkey = b.c_custkey
    """
)
def dim_twice_left(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    first = people.toDF("l_partkey", "first_name")
    second = people.toDF("l_suppkey", "second_name")
    return (
        table(spark, sf_dir, "lineitem")
        .join(first, "l_partkey", "left")
        .join(second, "l_suppkey", "left")
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            "l_quantity",
            F.coalesce("first_name", F.col("l_partkey").cast("string")).alias("first_name"),
            F.coalesce("second_name", F.col("l_suppkey").cast("string")).alias("second_name"),
        )
    )


@query(
    """
    SELECT DISTINCT c.c_custkey, c.c_name, c.c_mktsegment FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
    """
)
def exists_distinct(spark, sf_dir):
    """Customers with at least one finished order."""
    finished = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return (
        table(spark, sf_dir, "customer")
        .join(finished, "c_custkey", "left_semi")
        .select("c_custkey", "c_name", "c_mktsegment")
        .distinct()
        .orderBy(F.asc_nulls_last("c_mktsegment"), F.asc_nulls_last("c_custkey"))
    )


@query(
    """
    SELECT DISTINCT n.n_name, s.s_name
    FROM supplier s JOIN nation n
      ON try_cast(CAST(s.s_nationkey AS VARCHAR) AS BIGINT) = try_cast(CAST(n.n_nationkey AS VARCHAR) AS BIGINT)
    """
)
def cast_key_join(spark, sf_dir):
    """Keys of different types, compared as numbers."""
    supplier = table(spark, sf_dir, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("string"))
    nation = table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("double"))
    key = F.col("s_nationkey").try_cast("bigint") == F.col("n_nationkey").try_cast("bigint")
    return supplier.join(nation, key).select("n_name", "s_name").distinct()


@query(
    """
    SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
    """
)
def union_missing_cols(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    return union_all([customers, suppliers])


@query(
    """
    SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS date FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn = 1
    """
)
def dedup_keep_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = dedup_first(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", iso_micros(F.col("o_orderdate")).alias("date"))


@query(
    """
    WITH t AS (SELECT l_suppkey, max(l_quantity) AS max_quantity, max(l_extendedprice) AS max_price,
                      round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) * 100, 4) AS high_discount_pct,
                      round(avg(CASE WHEN l_tax > 0.02 THEN 1.0 ELSE 0.0 END) * 100, 4) AS high_tax_pct
               FROM lineitem GROUP BY l_suppkey),
    p AS (SELECT l_suppkey, min(l_extendedprice) AS best_return FROM lineitem
          WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY l_suppkey)
    SELECT t.*, p.best_return FROM t LEFT JOIN p ON t.l_suppkey = p.l_suppkey
    """
)
def pct_time_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    metrics = rows.groupBy("l_suppkey").agg(
        F.max("l_quantity").alias("max_quantity"),
        F.max("l_extendedprice").alias("max_price"),
        F.round(pct_true(F.col("l_discount") > 0.05), 4).alias("high_discount_pct"),
        F.round(pct_true(F.col("l_tax") > 0.02), 4).alias("high_tax_pct"),
    )
    best = (
        rows.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
        .groupBy("l_suppkey")
        .agg(F.min("l_extendedprice").alias("best_return"))
    )
    return metrics.join(best, "l_suppkey", "left")


def _order_sessions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_key"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("session_name"),
        F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("country_name"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("circuit_short_name"),
        F.col("o_orderdate").alias("date_start"),
    )


_ORDER_SESSIONS = """
    s AS (SELECT o_orderkey AS session_key, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS session_name,
                 'Status ' || o_orderstatus AS country_name, o_orderdate AS date_start FROM orders)
"""


@query(
    f"""
    WITH {_ORDER_SESSIONS},
    g AS (SELECT *, max(country_name ILIKE '%status f%') OVER (PARTITION BY year) AS any_gp FROM s),
    h AS (SELECT * FROM g WHERE country_name ILIKE '%status f%' OR NOT any_gp),
    n AS (SELECT *, max(session_name ILIKE '%sprint%') OVER (PARTITION BY year) AS any_name FROM h),
    k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY date_start DESC, session_key DESC) AS rn
          FROM n WHERE session_name ILIKE '%sprint%' OR NOT any_name)
    SELECT year, session_key, session_name, country_name, year AS year_actual FROM k WHERE rn = 1
    """
)
def latest_with_fallback(spark, sf_dir):
    """Latest finished order per year; the name filter matches nothing and therefore keeps all."""
    found = resolve_session(_order_sessions(spark, sf_dir), None, "status F", "Sprint")
    return found.select("year", "session_key", "session_name", "country_name", "year_actual")


@query(
    f"""
    WITH {_ORDER_SESSIONS}
    SELECT year, session_key, session_name, year AS year_actual FROM s WHERE session_name ILIKE '%urgent%'
    """
)
def sessions_of_type(spark, sf_dir):
    listed = list_sessions(_order_sessions(spark, sf_dir), None, "urgent")
    return listed.select("year", "session_key", "session_name", "year_actual")


@query(
    """
    WITH t AS (SELECT l_suppkey, l_linenumber AS a,
                      CASE WHEN l_quantity < 10 THEN NULL ELSE CAST(l_quantity - 15 AS BIGINT) END AS b FROM lineitem),
    u AS (SELECT l_suppkey, CAST(a AS BIGINT) AS a,
                 CASE WHEN coalesce(b, a + 10) < a THEN a + 5 ELSE coalesce(b, a + 10) END AS b FROM t),
    x AS (SELECT l_suppkey, a, unnest(generate_series(a, b)) AS lap FROM u)
    SELECT l_suppkey, count(*) AS laps, CAST(sum(lap) AS BIGINT) AS lap_sum, CAST(sum(lap - a) AS BIGINT) AS index_sum,
           max(lap - a) AS longest
    FROM x GROUP BY l_suppkey
    """
)
def expand_ranges(spark, sf_dir):
    """Line items as ranges with open and inverted ends, one row per integer."""
    end = F.when(F.col("l_quantity") >= 10, (F.col("l_quantity") - 15).cast("bigint"))
    ranges = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("first"), end.alias("last"))
    return (
        expand_range(ranges, "first", "last", index="at", value="lap")
        .groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("laps"),
            F.sum("lap").alias("lap_sum"),
            F.sum("at").alias("index_sum"),
            F.max("at").alias("longest"),
        )
    )


@query(
    """
    WITH t AS (SELECT count(*) AS total, avg(l_quantity) AS mean_quantity,
                      count(*) FILTER (WHERE NOT coalesce(l_quantity BETWEEN 1 AND 40, false)) AS f1,
                      count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.08, false)) AS f2,
                      count(*) FILTER (WHERE l_tax IS NULL) AS f3 FROM lineitem)
    SELECT 'quantity_range' AS rule, f1 AS failing, total FROM t
    UNION ALL SELECT 'discount_range', f2, total FROM t
    UNION ALL SELECT 'tax_present', f3, total FROM t
    UNION ALL SELECT 'not_empty', 0, total FROM t
    UNION ALL SELECT 'mean_quantity', CASE WHEN mean_quantity BETWEEN 20 AND 30 THEN 0 ELSE 1 END, total FROM t
    UNION ALL SELECT 'mean_price', CASE WHEN (SELECT avg(l_extendedprice) FROM lineitem) BETWEEN 50 AND 250 THEN 0 ELSE 1 END, total FROM t
    UNION ALL SELECT 'any_flag', 0, total FROM t
    """
)
def quality_rules(spark, sf_dir):
    return quality_report(
        table(spark, sf_dir, "lineitem"),
        {
            "quantity_range": within("l_quantity", (1, 40)),
            "discount_range": within("l_discount", (0, 0.08)),
            "tax_present": F.col("l_tax").isNotNull(),
        },
        table_rules={
            "mean_quantity": mean_within("l_quantity", (20, 30)),
            "mean_price": mean_within("l_extendedprice", K.MEAN_LAP_RANGE),
            "any_flag": any_value("l_returnflag"),
        },
    )


# --- sources and sinks: write to the shared folder and return what is read back --------------


@query(
    """
    SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
    """
)
def upsert_dim(spark, sf_dir):
    """Publish customers, upsert suppliers by key over the published table, read it back."""
    path = scratch_path(spark, "upsert")
    columns = ["c_custkey", "c_name", "c_acctbal"]
    publish(spark, table(spark, sf_dir, "customer").select(*columns), path)
    batch = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").toDF(*columns)
    publish(spark, upsert(published(spark, path), batch, ["c_custkey"]), path)
    return published(spark, path)


@query(
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, replace(o_orderpriority, ' ', '_') AS gp, o_orderstatus AS session,
           count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY ALL
    """
)
def land_and_scan(spark, sf_dir):
    """Orders landed as raw records by year, priority and status, then read back by partition."""
    root = scratch_path(spark, "bronze")
    land_bronze(
        table(spark, sf_dir, "orders"),
        root,
        "orders",
        F.year("o_orderdate"),
        F.col("o_orderpriority"),
        F.col("o_orderstatus"),
    )
    return (
        read_bronze(spark, root, "orders")
        .groupBy(F.col("_year").alias("year"), F.col("_gp").alias("gp"), F.col("_session").alias("session"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    """
    SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_returnflag = 'R' THEN l_quantity * 2 ELSE l_quantity END AS l_quantity
    FROM lineitem
    """
)
def partition_replace(spark, sf_dir):
    """All return flags written, then one flag's partition replaced by a corrected batch."""
    path = scratch_path(spark, "replace")
    columns = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    rows = table(spark, sf_dir, "lineitem").select(*columns)
    replace_partitions(rows, path, ["l_returnflag"])
    corrected = rows.where(F.col("l_returnflag") == "R").withColumn("l_quantity", F.col("l_quantity") * 2)
    replace_partitions(corrected, path, ["l_returnflag"])
    return spark.read.parquet(path).select(*columns)


@query(
    f"""
    WITH {_RAW}, s AS (SELECT DISTINCT year FROM raw)
    SELECT s.year AS session_key, 'validation' AS pipeline_name, CAST(0.12 AS DOUBLE) AS duration_seconds,
           'SUCCESS' AS status,
           (SELECT count(*) FROM checked WHERE problems = '' AND checked.year = s.year) AS total_rows_processed
    FROM s
    """
)
def run_log(spark, sf_dir):
    """Rows written, logged for each year of the batch."""
    root = scratch_path(spark, "runs")
    checked = split_valid(_raw_events(spark, sf_dir), _RAW_SPEC, "contract not met")
    checked.valid.write.parquet(f"{root}/valid")
    written = spark.read.parquet(f"{root}/valid").select(F.col("year").alias("session_key"), F.lit(1).alias("total_rows_processed"))
    asked = _raw_events(spark, sf_dir).select(F.col("year").alias("session_key"), F.lit(0).alias("total_rows_processed"))
    log_runs(spark, root, run_record("validation", None, 0.1234, 0), written.unionByName(asked))
    history = run_history({RUNS.name: read_table(spark, root, RUNS)})
    return history.select("session_key", "pipeline_name", "duration_seconds", "status", "total_rows_processed")


@query("SELECT role AS partition, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def archive_raw_json(spark, sf_dir):
    """Conversations written as JSON files by role, packed into the archive, read from there."""
    root = scratch_path(spark, "raw")
    replaced = table(spark, sf_dir, "conversations")
    replaced.write.partitionBy("role").json(root)
    archive_json(spark, root, f"{root}-archive")
    lines = read_archive(spark, f"{root}-archive").select(
        F.regexp_extract("partition", "role=(.*)", 1).alias("partition"),
        F.explode(F.split("content", "\n")).alias("line"),
    )
    text = F.from_json("line", "conv_id long, turn long, text string")["text"]
    return (
        lines.where(F.col("line") != "")
        .groupBy("partition")
        .agg(F.count(F.lit(1)).alias("records"), F.sum(F.length(text)).cast("bigint").alias("chars"))
    )


# --- nested records and build triage --------------------------------------------------------


def _jobs(spark, sf_dir):
    """Each conversation turn as a build job whose lines are steps, as JSON text."""
    step = lambda line: F.struct(
        line.alias("name"),
        F.when(F.length(line) % 3 == 0, F.lit("failure")).otherwise(F.lit("success")).alias("conclusion"),
    )
    jobs = F.array(F.struct(F.col("role").alias("name"), F.transform(F.split("text", "\n"), step).alias("steps")))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"), F.to_json(jobs).alias("payload")
    )


_STEPS = """
    steps AS (SELECT conv_id * 1000 + turn AS run_id, role AS job, unnest(string_split(text, chr(10))) AS step FROM conversations),
    s AS (SELECT *, CASE WHEN length(step) % 3 = 0 THEN 'failure' ELSE 'success' END AS step_conclusion FROM steps)
"""


@query(f"WITH {_STEPS} SELECT run_id, job, step, step_conclusion FROM s")
def json_steps_flatten(spark, sf_dir):
    parsed = _jobs(spark, sf_dir).select("run_id", F.from_json("payload", JOBS_SCHEMA).alias("jobs"))
    return flatten_steps(parsed)


@query(
    """
    WITH c AS (SELECT conv_id, count(*) AS turns, list({'chars': length(text), 'role': role} ORDER BY turn) AS actions
               FROM conversations GROUP BY conv_id),
    r AS (SELECT *, conv_id = (SELECT min(conv_id) FROM c) AS corrupt FROM c)
    SELECT CASE WHEN turns % 5 = 0 THEN 0 ELSE conv_id END AS evaluated_run_id, 'conversation' AS workflow_name,
      turns % 2 = 0 AS alert_triggered, to_json(actions)::VARCHAR AS actions, turns AS attempts,
      row_number() OVER (ORDER BY CASE WHEN turns % 5 = 0 THEN 0 ELSE conv_id END DESC) AS position
    FROM r WHERE NOT corrupt QUALIFY evaluated_run_id > 0
    """
)
def stored_reports(spark, sf_dir):
    """A report for each conversation, one to a file; the first is cut in two, some have no id, all have a field of their own."""
    folder = scratch_path(spark, "reports")
    said = F.struct(F.length("text").alias("chars"), "role")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns")
    )
    report = F.to_json(
        F.struct(
            F.when(F.col("attempts") % 5 != 0, F.col("conv_id")).alias("evaluated_run_id"), F.lit("conversation").alias("workflow_name"),
            (F.col("attempts") % 2 == 0).alias("alert_triggered"), F.col("turns.said").alias("actions"), "attempts",
        )
    )
    text = F.when(F.col("conv_id") == turns.agg(F.min("conv_id")).scalar(), F.left(report, F.lit(20))).otherwise(report)
    # Small rows but many files: dealt out, as few bytes would come to few tasks, which also put their own files in place.
    dealt = turns.select(text.alias("value"), "conv_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("conv_id"))
    files = dealt.select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    files.text(folder)
    found = numbered(read_reports(spark, folder, "part-*")).where("evaluated_run_id > 0")
    return found.select(
        "evaluated_run_id", "workflow_name", "alert_triggered", F.to_json(F.variant_get("report", "$.actions", "variant")).alias("actions"),
        F.variant_get("report", "$.attempts", "bigint").alias("attempts"), "position",
    )


@query(
    """
    SELECT event_id, user_id, event_type, value, CASE WHEN user_id % 11 % 3 = 0 THEN props END AS props,
      CASE WHEN user_id % 11 % 2 = 1 THEN NULL ELSE user_id % 11 END AS lane
    FROM events
    """
)
def mixed_type_files(spark, sf_dir):
    """Files of eleven groups of users in one plan: ``value`` is text in some and a number in others, ``lane`` a short or a long
    number or missing, ``props`` only in every third."""
    root = scratch_path(spark, "files")
    rows = table(spark, sf_dir, "events").withColumn("part", F.pmod("user_id", F.lit(11))).select("event_id", "user_id", "event_type", "value", "props", "part")
    for remainder in range(6):
        some = rows.where(F.col("part") % 6 == remainder)
        some = some.withColumn("lane", F.col("part").cast("smallint" if remainder else "bigint")) if remainder % 2 == 0 else some
        some = some.withColumn("value", F.col("value").cast("string")) if remainder % 2 else some
        some = some if remainder % 3 == 0 else some.drop("props")
        some.write.mode("append").partitionBy("part").parquet(root)
    found = read_files(spark, [f"{root}/{name}" for name in names(spark, root) if name.startswith("part=")])
    return found.withColumns({"value": F.col("value").cast("double"), "lane": F.col("lane").cast("bigint")})


def _runs(spark, sf_dir):
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("id"),
        F.col("role").alias("name"),
        F.when(turn % 4 == 3, F.lit("in_progress")).otherwise(F.lit("completed")).alias("status"),
        F.when(turn % 4 == 0, F.lit("failure"))
        .when(turn % 4 == 1, F.lit("timed_out"))
        .when(turn % 4 == 2, F.lit("success"))
        .alias("conclusion"),
        F.when(turn % 2 == 0, F.concat(F.lit("sha"), F.col("conv_id").cast("string"))).alias("head_sha"),
    )


@query(
    f"""
    WITH {_STEPS},
    f AS (SELECT run_id, count(*) AS n, max(regexp_matches(lower(step), 'black|format|isort')) AS fmt,
                 max(regexp_matches(lower(step), 'flake8|lint|static')) AS lint,
                 max(regexp_matches(lower(step), 'pytest|test')) AS test
          FROM s WHERE step_conclusion = 'failure' GROUP BY run_id),
    r AS (SELECT conv_id * 1000 + turn AS id, role, conv_id, turn, turn % 4 IN (0, 1) AS alert FROM conversations)
    SELECT id AS evaluated_run_id, role AS workflow_name,
           CASE WHEN turn % 4 = 3 THEN 'in_progress' ELSE 'completed' END AS status,
           CASE turn % 4 WHEN 0 THEN 'failure' WHEN 1 THEN 'timed_out' WHEN 2 THEN 'success' END AS conclusion,
           CASE WHEN turn % 2 = 0 THEN 'sha' || conv_id ELSE 'Unknown' END AS commit_sha,
           alert AS alert_triggered, CASE WHEN alert THEN coalesce(n, 0) ELSE 0 END AS failed_steps,
           alert AND coalesce(fmt, true) AS format_failed, alert AND coalesce(lint, true) AS lint_failed,
           alert AND coalesce(test, true) AS test_failed
    FROM r LEFT JOIN f ON f.run_id = r.id
    """
)
def build_triage(spark, sf_dir):
    """Report for every run."""
    jobs = _jobs(spark, sf_dir).select("run_id", F.from_json("payload", JOBS_SCHEMA).alias("jobs"))
    report = triage(_runs(spark, sf_dir), jobs)
    return report.withColumn("failed_steps", F.size("failed_steps").cast("bigint"))


@query(
    """
    SELECT role AS name, max(conv_id * 1000 + turn) AS id FROM conversations GROUP BY role
    """
)
def newest_run(spark, sf_dir):
    return pick_run(_runs(spark, sf_dir), ["id"], ["name"]).select("name", "id")


_ADHOC = """
    WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT c_mktsegment, count(*) AS customers, round(sum(total), 2) AS total, CAST(sum(n) AS BIGINT) AS orders
    FROM spend JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment
"""


@query(_ADHOC)
def readonly_sql(spark, sf_dir):
    def register(session):
        for name in ("orders", "customer"):
            session.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)

    return ReadOnlySql(spark, register).query(_ADHOC)
