"""Loading panels and finding what is wrong with them. Every check returns the violating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["ts_code", "trade_date"]
PRICES = ["open", "high", "low", "close", "raw_close", "adj_factor"]
AMOUNTS = ["vol", "amount"]
REQUIRED = [*KEYS, *PRICES, *AMOUNTS]


def read_panel(spark: SparkSession, path: str, format: str = "parquet", optional: tuple[str, ...] = (), **options) -> DataFrame:
    """Rows of a panel file (Parquet, JSON or CSV): the required columns, the optional ones that it has, no others."""
    return keep_columns(spark.read.format(format).options(**options).load(path), optional)


def keep_columns(df: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*REQUIRED, *[c for c in optional if c in df.columns])


def check_keys_unique(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or KEYS)).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def check_universe_dates(df: DataFrame, symbols: DataFrame, start: str, end: str) -> DataFrame:
    """Rows outside the universe or the range of dates."""
    inside = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    known = symbols.select("ts_code").distinct().withColumn("__known", F.lit(True))
    marked = df.join(known, "ts_code", "left").withColumn("reason", F.when(F.col("__known").isNull(), "universe").when(~inside, "dates"))
    return marked.filter("reason IS NOT NULL").drop("__known")


def _finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def check_prices(df: DataFrame) -> DataFrame:
    """Prices that aren't finite and above 0, volumes and amounts that aren't finite and at least 0."""
    bad = [F.when(~(_finite(c) & (F.col(c) > 0)), F.lit(c)) for c in PRICES] + [F.when(~(_finite(c) & (F.col(c) >= 0)), F.lit(c)) for c in AMOUNTS]
    marked = df.withColumn("bad_fields", F.array_join(F.array_compact(F.array(*bad)), ","))
    return marked.filter("bad_fields <> ''")


def check_ohlc_envelope(df: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    room = F.col("high") * tolerance
    return df.filter((F.col("low") > F.least("open", "close") + room) | (F.col("high") < F.greatest("open", "close") - room))


def check_numeric_type(df: DataFrame, core: list[str], external: list[str]) -> DataFrame:
    """Cells that aren't numbers. Core fields may be numeric text; external ones may not be text at all (quoted), and
    neither may be booleans, be it as text or as a column of them."""
    boolean = lambda c: F.lit(df.schema[c].dataType.simpleString() == "boolean")
    checks = []
    for c in core:
        checks.append(F.when(F.col(c).isNotNull() & (boolean(c) | F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull()), F.lit(c)))
    for c in external:
        checks.append(F.when(F.col(c).isNotNull() & (boolean(c) | F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull() | F.col(c).cast("string").startswith('"')), F.lit(c)))
    return df.withColumn("bad_fields", F.array_join(F.array_compact(F.array(*checks)), ",")).filter("bad_fields <> ''")


def check_point_in_time(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows where a field is present but its available date is missing or later than the session."""
    late = [F.when(F.col(f).isNotNull() & (F.col(f"{f}__available_date").isNull() | (F.col(f"{f}__available_date") > F.col("trade_date"))), F.lit(f)) for f in fields]
    return df.withColumn("bad_fields", F.array_join(F.array_compact(F.array(*late)), ",")).filter("bad_fields <> ''")


def derive_amount(df: DataFrame, declared: bool = True) -> DataFrame:
    """amount from volume (lots) and price where it is missing and the price is not adjusted."""
    plain = F.abs(F.col("close") - F.col("raw_close")) <= 1e-9 * F.greatest(F.abs("close"), F.abs("raw_close"))
    fill = F.col("amount").isNull() & plain & F.col("vol").isNotNull() & F.lit(declared)
    return df.withColumn("derived", fill).withColumn("amount", F.when(fill, F.col("vol") * F.col("close") * 100 / 1000).otherwise(F.col("amount")))


def default_raw_columns(df: DataFrame) -> DataFrame:
    """An unadjusted upload: the raw close is the close, and the factor is 1."""
    have = set(df.columns)
    raw = F.coalesce("raw_close", "close") if "raw_close" in have else F.col("close")
    factor = F.coalesce("adj_factor", F.lit(1.0)) if "adj_factor" in have else F.lit(1.0)
    return df.withColumns({"raw_close": raw, "adj_factor": factor})


def normalize_signed_zero(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) for c in fields})


def adjust_prices(daily: DataFrame, adj: DataFrame) -> DataFrame:
    """Prices times the day's factor over the symbol's first observed one."""
    rows = daily.drop("adj_factor").join(adj, KEYS, "left")
    first = F.first("adj_factor", ignorenulls=True).over(Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scale = F.col("adj_factor") / first
    return rows.withColumn("raw_close", F.col("close")).withColumns({c: F.col(c) * scale for c in ("open", "high", "low", "close")})


def require_adjustment(daily: DataFrame, adj: DataFrame) -> DataFrame:
    return daily.join(adj.filter("adj_factor IS NOT NULL"), KEYS, "left_anti")


def join_daily_basic(bars: DataFrame, basic: DataFrame) -> DataFrame:
    """One basic row for each bar at most: check_keys_unique(basic) has to be empty."""
    return bars.join(basic, KEYS, "left")


def calendar_from_flags(days: DataFrame) -> DataFrame:
    """(cal_date, is_open): open days as trade_date. Civil days that are missing or repeated have problem set."""
    span = days.agg(F.min("cal_date").alias("a"), F.max("cal_date").alias("b")).filter("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b")).alias("cal_date"))
    seen = days.groupBy("cal_date").agg(F.count("*").alias("n"), F.max("is_open").alias("is_open"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return every.join(seen, "cal_date", "full_outer").withColumn("problem", problem).filter("is_open = 1 OR problem IS NOT NULL").select(F.col("cal_date").alias("trade_date"), "problem")


def calendar_previous_check(days: DataFrame) -> DataFrame:
    return days.filter(F.col("pretrade_date").isNotNull() & (F.col("pretrade_date") >= F.col("cal_date")))


def calendars_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sessions of one calendar only."""
    left, right = a.select("trade_date").distinct(), b.select("trade_date").distinct()
    return left.exceptAll(right).withColumn("only_in", F.lit("first")).union(right.exceptAll(left).withColumn("only_in", F.lit("second")))


def rows_in_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows on dates that are no sessions."""
    return bars.join(F.broadcast(calendar.select("trade_date")), "trade_date", "left_anti")


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, fingerprint): the same for the same rows in any order."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda a: F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.concat_ws("-", F.sum(half(1)).cast("string"), F.sum(half(16)).cast("string")).alias("fingerprint"))


def scope_view(bars: DataFrame, symbols: DataFrame, start: str, end: str) -> DataFrame:
    """The rows of a part of a frozen table."""
    cut = bars.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return cut.join(symbols.select("ts_code").distinct(), "ts_code", "left_semi")


def scope_violations(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols asked for that the frozen table doesn't hold."""
    return symbols.select("ts_code").distinct().join(bars, "ts_code", "left_anti")


def compose_states(bars: DataFrame, states: DataFrame, names: list[str]) -> DataFrame:
    """Long state rows (ts_code, trade_date, state, value) as columns `names` of market rows. A state that a symbol and date
    claim twice is an error (claimed_twice() lists them)."""

    def one(name: str) -> Column:
        own = F.col("state") == name
        twice = F.concat(F.lit(f"claimed twice: {name} "), F.max("ts_code"), F.lit(" "), F.max("trade_date").cast("string"))
        return F.when(F.count_if(own) > 1, F.raise_error(twice).cast("double")).otherwise(F.max(F.when(own, F.col("value")))).alias(name)

    wide = states.filter(F.col("state").isin(names)).groupBy(*KEYS).agg(*[one(n) for n in names])
    return bars.join(wide, KEYS, "left")


def claimed_twice(states: DataFrame) -> DataFrame:
    return states.groupBy(*KEYS, "state").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def normalize_statements(rows: DataFrame, symbols: DataFrame, fields: list[str]) -> DataFrame:
    """Text cells of statement snapshots as numbers, with the reasons that speak against a row."""
    known = symbols.select("ts_code").distinct().withColumn("__known", F.lit(True))
    reasons = [F.when(F.col("__known").isNull(), F.lit("symbol")), F.when(F.col("end_date").isNull() | (F.col("ann_date") < F.col("end_date")), F.lit("dates"))]
    reasons += [F.when(F.col(f).isNotNull() & F.expr(f"try_cast(`{f}` AS DOUBLE)").isNull(), F.lit(f)) for f in fields]
    joined = rows.join(known, "ts_code", "left").withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ","))
    return joined.withColumns({f: F.expr(f"try_cast(`{f}` AS DOUBLE)") for f in fields}).drop("__known")


def write_collections(collections: dict[str, DataFrame], folder: str, partition: str = "trade_date") -> DataFrame:
    """Each collection as Parquet, by date where it has one, and a manifest (collection, n_rows, columns)."""
    spark = next(iter(collections.values())).sparkSession
    rows = []
    for name, df in collections.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition) if partition in df.columns else writer).parquet(f"{folder}/{name}")
        rows.append((name, spark.read.parquet(f"{folder}/{name}").count(), ",".join(sorted(df.columns))))
    manifest = spark.createDataFrame(rows, "collection string, n_rows long, columns string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def synthetic_panel(calendar: DataFrame, symbols: DataFrame, seed: int = 7) -> DataFrame:
    """Log-normal bars for every symbol and session: a market move and an own one, from hashes of their keys."""

    def normal(*key) -> Column:
        unit = lambda part: (F.pmod(F.xxhash64(F.lit(f"{seed}{part}"), *key), F.lit(1 << 30)) + 0.5) / (1 << 30)
        return F.sqrt(-2 * F.log(unit("a"))) * F.cos(2 * 3.141592653589793 * unit("b"))

    cells = symbols.select("ts_code").crossJoin(F.broadcast(calendar.select("trade_date")))
    move = 0.006 * normal(F.col("trade_date")) + 0.012 * normal(F.col("ts_code"), F.col("trade_date"))
    path = F.sum(move).over(Window.partitionBy("ts_code").orderBy("trade_date"))
    close = 20 * F.exp(path)
    open_ = close * F.exp(0.004 * normal(F.col("trade_date"), F.col("ts_code")))
    made = cells.withColumn("close", close).withColumn("open", open_)
    return made.withColumns({
        "high": F.greatest("open", "close") * 1.003, "low": F.least("open", "close") * 0.997, "raw_close": F.col("close"),
        "vol": F.round(1000 * F.exp(0.5 * normal(F.col("ts_code"), F.col("trade_date"), F.lit(1)))), "adj_factor": F.lit(1.0),
    }).withColumn("amount", F.col("vol") * F.col("close") / 10)
