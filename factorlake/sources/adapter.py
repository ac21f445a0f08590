"""Panel, calendar and universe tables derived from the order tables.

Symbols are suppliers, sessions are 14-day buckets of ship dates, prices are unit prices of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY, SESSION_DAYS = "1995-01-02", 14
KEYS = ["ts_code", "trade_date"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(a: str, b: str) -> Column:
    """Sum of products of two columns of two decimals, exactly."""
    return F.sum(F.col(a).cast("decimal(14,2)") * F.col(b).cast("decimal(6,2)"))


def panel(spark: SparkSession, sf_dir: str, days: int = SESSION_DAYS) -> DataFrame:
    """One row for each symbol and session with lines: open, high, low, close, volume and amount."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0 AND l_shipdate IS NOT NULL")
    day = F.to_date("l_shipdate")
    bucket = F.floor(F.datediff(day, F.lit(FIRST_DAY).cast("date")) / days).cast("int")
    turn = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    priced = lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ts_code"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), bucket * days).alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        "l_extendedprice",
        turn.alias("turn"),
    )
    bars = priced.groupBy(*KEYS).agg(
        F.min_by("price", "turn").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "turn").alias("close"),
        F.sum("l_quantity").alias("vol"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )
    return bars.select(*KEYS, "open", "high", "low", "close", F.col("close").alias("raw_close"), "vol", "amount", F.lit(1.0).alias("adj_factor"))


def calendar(bars: DataFrame) -> DataFrame:
    """Sessions with their index; the table is as long as the calendar, so one task numbers it."""
    from pyspark.sql import Window

    return bars.select("trade_date").distinct().withColumn("session_index", F.row_number().over(Window.orderBy("trade_date")) - 1)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ts_code"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of symbols: area (nation), exchange (region), industry (a bucket of the balance), status."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ts_code"),
            F.col("n_name").alias("area"),
            F.col("r_name").alias("exchange"),
            F.concat(F.lit("I"), F.pmod(F.floor(F.col("s_acctbal") / 2000), F.lit(6)).cast("string")).alias("industry"),
            F.when(F.col("s_acctbal") < 0, "P").otherwise("L").alias("list_status"),
        )
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named pools: one for each region and each industry. Every thirteenth symbol is also in WATCH."""
    own = securities(spark, sf_dir)
    number = F.substring("ts_code", 2, 12).cast("long")
    watch = own.filter(number % 13 == 0).select(F.lit("WATCH").alias("universe_id"), "ts_code")
    unknown = own.filter(number % 13 == 1).select(F.lit("WATCH").alias("universe_id"), F.concat(F.lit("X"), "ts_code").alias("ts_code"))
    return own.select(F.col("exchange").alias("universe_id"), "ts_code").union(own.select("industry", "ts_code")).union(watch).union(unknown)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly totals announced 30 days after the quarter; every seventh symbol revises them 60 days after it."""
    lines = table(spark, sf_dir, "lineitem")
    quarter_end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    totals = lines.groupBy(F.col("l_suppkey").alias("s"), quarter_end.alias("end_date")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), exact_sum("l_extendedprice", "l_discount").cast("double").alias("cost")
    )
    code = F.concat(F.lit("S"), F.col("s").cast("string")).alias("ts_code")
    first = totals.select(code, F.date_add("end_date", 30).alias("ann_date"), "end_date", "revenue", "cost")
    again = totals.filter("s % 7 = 0").select(code, F.date_add("end_date", 60).alias("ann_date"), "end_date", (F.col("revenue") + 100).alias("revenue"), F.when(F.col("s") % 14 != 0, F.col("cost")).alias("cost"))
    return first.union(again)


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly (Monday) mean price and volume of all lines; every ninth week is missing."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit(FIRST_DAY).cast("date")) / 7).cast("int")
    weekly = lines.groupBy(week.alias("week")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("close"), F.sum("l_quantity").alias("vol"))
    return weekly.filter("week % 9 <> 8").select(F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("week") * 7).alias("trade_date"), "close", "vol")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of adjacent symbols, long one unit of the first and short one of the second."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey")
    pair = F.concat(F.lit("T"), F.floor((F.col("s_suppkey") - 1) / 2).cast("string"))
    return own.select(pair.alias("target_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ts_code"), F.when(F.col("s_suppkey") % 2 == 1, 1.0).otherwise(-1.0).alias("quantity"))


def panel_sql(days: int = SESSION_DAYS) -> str:
    """panel(), calendar(), symbols and the complete grid for DuckDB, as a list of common table expressions."""
    return _PANEL_SQL.replace("14", str(days))


_PANEL_SQL = """
lines AS (
  SELECT 'S' || l_suppkey AS ts_code,
         DATE '1995-01-02' + (14 * floor((l_shipdate::DATE - DATE '1995-01-02') / 14.0))::INT AS trade_date,
         l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice, l_shipdate, l_orderkey, l_linenumber, l_partkey
  FROM lineitem WHERE l_quantity > 0 AND l_shipdate IS NOT NULL),
panel AS (
  SELECT ts_code, trade_date, first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(price) AS high, min(price) AS low,
         last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS raw_close,
         sum(l_quantity) AS vol, round(sum(l_extendedprice), 2) AS amount, 1.0::DOUBLE AS adj_factor
  FROM lines GROUP BY ts_code, trade_date),
calendar AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS session_index FROM (SELECT DISTINCT trade_date FROM panel)),
symbols AS (SELECT 'S' || s_suppkey AS ts_code FROM supplier),
grid AS (
  SELECT s.ts_code, c.trade_date, c.session_index, open, high, low, close, raw_close, vol, amount, adj_factor
  FROM calendar c CROSS JOIN symbols s LEFT JOIN panel p ON p.ts_code = s.ts_code AND p.trade_date = c.trade_date)"""
PANEL_SQL = panel_sql()

SECURITIES_SQL = """
securities AS (
  SELECT 'S' || s_suppkey AS ts_code, n_name AS area, r_name AS exchange,
         'I' || ((floor(s_acctbal / 2000)::BIGINT % 6 + 6) % 6) AS industry, CASE WHEN s_acctbal < 0 THEN 'P' ELSE 'L' END AS list_status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
memberships AS (
  SELECT exchange AS universe_id, ts_code FROM securities UNION ALL SELECT industry, ts_code FROM securities
  UNION ALL SELECT 'WATCH', ts_code FROM securities WHERE substr(ts_code, 2)::BIGINT % 13 = 0
  UNION ALL SELECT 'WATCH', 'X' || ts_code FROM securities WHERE substr(ts_code, 2)::BIGINT % 13 = 1)"""

REPORTS_SQL = """
totals AS (
  SELECT l_suppkey AS s, last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS end_date,
         round(sum(l_extendedprice), 2) AS revenue, sum(l_extendedprice::DECIMAL(14,2) * l_discount::DECIMAL(6,2))::DOUBLE AS cost FROM lineitem GROUP BY ALL),
reports AS (
  SELECT 'S' || s AS ts_code, end_date + 30 AS ann_date, end_date, revenue, cost FROM totals
  UNION ALL SELECT 'S' || s, end_date + 60, end_date, revenue + 100, CASE WHEN s % 14 <> 0 THEN cost END FROM totals WHERE s % 7 = 0)"""

CONTEXT_SQL = """
context AS (
  SELECT DATE '1995-01-02' + (7 * week)::INT AS trade_date, close, vol FROM (
    SELECT floor((l_shipdate::DATE - DATE '1995-01-02') / 7.0)::INT AS week, round(avg(l_extendedprice / l_quantity), 4) AS close, sum(l_quantity) AS vol
    FROM lineitem WHERE l_quantity > 0 GROUP BY 1) WHERE week % 9 <> 8)"""

TARGETS_SQL = """
targets AS (
  SELECT 'T' || floor((s_suppkey - 1) / 2.0)::BIGINT AS target_id, 'S' || s_suppkey AS ts_code, CASE WHEN s_suppkey % 2 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS quantity FROM supplier)"""
