"""Queries of joins in time, statements and universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, statements, universe
from ..operators.universe import Group, Selection
from ..sources import adapter
from .factor_queries import grid_of
from .registry import register, rounded, rounded_sql
from .source_queries import number

P, R, S = adapter.PANEL_SQL, adapter.REPORTS_SQL, adapter.SECURITIES_SQL


def sessions(s: SparkSession, d: str) -> DataFrame:
    return adapter.calendar(adapter.panel(s, d))


def disclosed(s: SparkSession, d: str) -> DataFrame:
    """Reports with a second, different version on the same day for every fifth symbol."""
    rows = adapter.reports(s, d)
    return rows.union(rows.filter(number() % 5 == 0).withColumn("revenue", F.col("revenue") + 1))


_DISCLOSED = f"""{R}, disclosed AS (SELECT * FROM reports UNION ALL SELECT ts_code, ann_date, end_date, revenue + 1, cost FROM reports WHERE substr(ts_code, 2)::BIGINT % 5 = 0)"""
_AGREED = """agreed AS (SELECT ts_code, ann_date, end_date, CASE WHEN count(DISTINCT revenue) + max((revenue IS NULL)::INT) <= 1 THEN max(revenue) END AS revenue,
  CASE WHEN count(DISTINCT cost) + max((cost IS NULL)::INT) <= 1 THEN max(cost) END AS cost,
  concat_ws(',', CASE WHEN count(DISTINCT revenue) + max((revenue IS NULL)::INT) > 1 THEN 'revenue' END, CASE WHEN count(DISTINCT cost) + max((cost IS NULL)::INT) > 1 THEN 'cost' END) AS conflicts FROM disclosed GROUP BY ALL)"""
_NEXT = "(SELECT min(trade_date) FROM calendar c WHERE c.trade_date > {d})"
register(
    "next_session_after",
    lambda s, d: asof.next_session_after(adapter.reports(s, d), sessions(s, d)).select("ts_code", "ann_date", "end_date", "available"),
    f"WITH {P}, {R} SELECT ts_code, ann_date, end_date, {_NEXT.format(d='r.ann_date')} AS available FROM reports r",
)
register("quarantine_conflicts", lambda s, d: asof.quarantine_conflicts(disclosed(s, d), ["revenue", "cost"]), f"WITH {_DISCLOSED}, {_AGREED} SELECT * FROM agreed")
register(
    "join_reports_asof",
    lambda s, d: asof.join_reports_asof(grid_of(s, d).select("ts_code", "trade_date"), disclosed(s, d), ["revenue", "cost"], sessions(s, d)),
    f"""WITH {P}, {_DISCLOSED}, {_AGREED}, known AS (SELECT *, {_NEXT.format(d='a.ann_date')} AS available FROM agreed a)
    SELECT g.ts_code, g.trade_date, e.end_date, e.available, e.ann_date, e.revenue, e.cost FROM grid g LEFT JOIN known e ON e.ts_code = g.ts_code AND e.available <= g.trade_date
    QUALIFY row_number() OVER (PARTITION BY g.ts_code, g.trade_date ORDER BY e.end_date DESC NULLS LAST, e.available DESC, e.ann_date DESC) = 1""",
)
register(
    "check_report_dates",
    lambda s, d: asof.check_report_dates(adapter.reports(s, d).withColumn("ann_date", F.when(number() % 6 == 2, F.date_sub("end_date", 1)).otherwise(F.col("ann_date"))), adapter.symbols(s, d).filter(number() % 4 != 1)).select("ts_code", "end_date", "ann_date", "reason"),
    f"""WITH {R}, t AS (SELECT ts_code, substr(ts_code, 2)::BIGINT AS n, end_date, CASE WHEN n % 6 = 2 THEN end_date - 1 ELSE ann_date END AS ann_date FROM reports)
    SELECT ts_code, end_date, ann_date, CASE WHEN n % 4 = 1 THEN 'universe' ELSE 'order' END AS reason FROM t WHERE n % 4 = 1 OR n % 6 = 2""",
)


def _facts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A fact for each customer; each is derived from the one of half its number."""
    day = lambda k: F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(F.col("c_custkey") * k, F.lit(97)).cast("int"))
    rows = adapter.table(s, d, "customer").select(F.col("c_custkey").alias("fact_id"), day(7).alias("recorded"), day(11).alias("retrieved"), F.when(F.col("c_custkey") % 3 != 0, day(13)).alias("published"))
    edges = rows.filter("fact_id > 1").select("fact_id", F.floor(F.col("fact_id") / 2).alias("input_id"))
    return rows, edges


def _knowledge(s: SparkSession, d: str) -> DataFrame:
    return asof.knowledge_time(*_facts(s, d))


register(
    "knowledge_time",
    _knowledge,
    """WITH RECURSIVE own AS (SELECT c_custkey AS fact_id, greatest(DATE '2000-01-01' + (c_custkey * 7 % 97)::INT, DATE '2000-01-01' + (c_custkey * 11 % 97)::INT, CASE WHEN c_custkey % 3 <> 0 THEN DATE '2000-01-01' + (c_custkey * 13 % 97)::INT END) AS own FROM customer),
    reach AS (SELECT fact_id, fact_id AS input_id FROM own UNION SELECT r.fact_id, floor(r.input_id / 2)::BIGINT FROM reach r WHERE r.input_id > 1)
    SELECT r.fact_id, max(o.own) AS known_at, NULL::VARCHAR AS problem FROM reach r JOIN own o ON o.fact_id = r.input_id GROUP BY 1""",
)


def _selections(s: SparkSession, d: str) -> DataFrame:
    rows = adapter.reports(s, d)
    return rows.select("ts_code", "end_date", F.col("ann_date").alias("known_date"), F.when(F.datediff("ann_date", "end_date") > 40, 2).otherwise(1).alias("revision"), "revenue", F.when(number() % 8 == 3, "USD").otherwise("CNY").alias("unit"), F.when((number() % 9 == 4) & (F.month("end_date") == 3), "other").otherwise("own").alias("entity"))


_SELECTIONS = f"""{R}, selections AS (SELECT ts_code, end_date, ann_date AS known_date, CASE WHEN ann_date - end_date > 40 THEN 2 ELSE 1 END AS revision, revenue, CASE WHEN substr(ts_code, 2)::BIGINT % 8 = 3 THEN 'USD' ELSE 'CNY' END AS unit,
  CASE WHEN substr(ts_code, 2)::BIGINT % 9 = 4 AND month(end_date) = 3 THEN 'other' ELSE 'own' END AS entity FROM reports)"""
register(
    "join_selections_asof",
    lambda s, d: asof.join_selections_asof(grid_of(s, d).select("ts_code", "trade_date"), _selections(s, d), ["revenue"], sessions(s, d)),
    f"""WITH {P}, {_SELECTIONS}, known AS (SELECT *, {_NEXT.format(d='a.known_date')} AS available FROM selections a)
    SELECT g.ts_code, g.trade_date, e.end_date, e.available, e.revision, e.revenue FROM grid g LEFT JOIN known e ON e.ts_code = g.ts_code AND e.available <= g.trade_date
    QUALIFY row_number() OVER (PARTITION BY g.ts_code, g.trade_date ORDER BY e.end_date DESC NULLS LAST, e.available DESC, e.revision DESC) = 1""",
)
register(
    "check_units_scope",
    lambda s, d: asof.check_units_scope(_selections(s, d).union(_selections(s, d).filter(number() % 6 == 5)), "CNY"),
    f"""WITH {_SELECTIONS}, t AS (SELECT * FROM selections UNION ALL SELECT * FROM selections WHERE substr(ts_code, 2)::BIGINT % 6 = 5)
    SELECT ts_code, count(*) AS n, 'unit' AS problem FROM t WHERE unit <> 'CNY' GROUP BY 1
    UNION ALL SELECT ts_code, count(*), 'records' FROM (SELECT ts_code, end_date, revision FROM t GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
    UNION ALL SELECT ts_code, count(DISTINCT entity), 'entities' FROM t GROUP BY 1 HAVING count(DISTINCT entity) > 1""",
)

_FIELDS = statements.FLOWS + statements.POINTS


def statement_rows(s: SparkSession, d: str) -> DataFrame:
    """Statements of each supplier and quarter: flows from the year's start on, balances at the end."""
    lines = adapter.table(s, d, "lineitem")
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    q = lines.groupBy(F.col("l_suppkey").alias("s"), end.alias("end_date")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("a"), adapter.exact_sum("l_extendedprice", "l_discount").alias("b"), adapter.exact_sum("l_extendedprice", "l_tax").alias("c"), F.sum("l_quantity").alias("v")
    )
    q = q.withColumns({k: F.col(k).cast("decimal(24,4)") for k in "abcv"})
    year = Window.partitionBy("s", F.year("end_date")).orderBy("end_date")
    ytd = lambda x: F.sum(x).over(year).cast("decimal(24,4)")
    made = {
        "revenue": ytd("a"), "operate_profit": ytd("b"), "n_income": ytd("c"), "n_income_attr_p": ytd(F.col("c") - F.col("v")), "n_cashflow_act": ytd(F.col("b") - F.col("c")), "capex": ytd(F.col("v") * 10 - 1500),
        "total_assets": F.col("a") * 3, "total_liab": F.col("a"), "total_cur_assets": F.col("a") * 2, "total_cur_liab": F.col("b"), "money_cap": F.col("c"), "accounts_receiv": F.col("b"), "goodwill": F.col("v"), "st_borr": F.col("c"), "lt_borr": F.col("v") * 2,
    }
    rows = q.select("s", "end_date", *[x.cast("decimal(24,4)").alias(k) for k, x in made.items()])
    base = rows.select(
        F.concat(F.lit("S"), F.col("s").cast("string")).alias("ts_code"), "end_date", F.date_add("end_date", 30).alias("ann_date"), F.when(F.col("s") % 3 == 0, F.date_add("end_date", 33)).alias("f_ann_date"),
        F.when(F.col("s") % 13 == 5, "99").otherwise("1").alias("report_type"), F.when(F.col("s") % 2 == 0, "CNY_1000").otherwise("CNY").alias("unit"), "s", *_FIELDS,
    )
    again = base.filter("s % 7 = 0").withColumns({"ann_date": F.date_add("end_date", 60), "f_ann_date": F.lit(None).cast("date"), "report_type": F.lit("4"), "revenue": (F.col("revenue") + 100).cast("decimal(24,4)")})
    clash = base.filter("s % 9 = 4").withColumn("revenue", (F.col("revenue") + 1).cast("decimal(24,4)"))
    return base.union(again).union(clash).drop("s")


_ROWS = f"""q AS (SELECT l_suppkey AS s, last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS end_date, round(sum(l_extendedprice), 2)::DECIMAL(24,4) AS a, sum(l_extendedprice::DECIMAL(14,2) * l_discount::DECIMAL(6,2))::DECIMAL(24,4) AS b,
  sum(l_extendedprice::DECIMAL(14,2) * l_tax::DECIMAL(6,2))::DECIMAL(24,4) AS c, sum(l_quantity)::DECIMAL(24,4) AS v FROM lineitem GROUP BY ALL),
raw AS (SELECT s, end_date, sum(a) OVER w AS revenue, sum(b) OVER w AS operate_profit, sum(c) OVER w AS n_income, sum(c - v) OVER w AS n_income_attr_p, sum(b - c) OVER w AS n_cashflow_act, sum(v * 10 - 1500) OVER w AS capex,
  a * 3 AS total_assets, a AS total_liab, a * 2 AS total_cur_assets, b AS total_cur_liab, c AS money_cap, b AS accounts_receiv, v AS goodwill, c AS st_borr, v * 2 AS lt_borr
  FROM q WINDOW w AS (PARTITION BY s, year(end_date) ORDER BY end_date)),
base AS (SELECT 'S' || s AS ts_code, end_date, end_date + 30 AS ann_date, CASE WHEN s % 3 = 0 THEN end_date + 33 END AS f_ann_date, CASE WHEN s % 13 = 5 THEN '99' ELSE '1' END AS report_type, CASE WHEN s % 2 = 0 THEN 'CNY_1000' ELSE 'CNY' END AS unit, * EXCLUDE (end_date) FROM raw),
statement_rows AS (SELECT * FROM base UNION ALL SELECT * REPLACE (end_date + 60 AS ann_date, NULL AS f_ann_date, '4' AS report_type, revenue + 100 AS revenue) FROM base WHERE s % 7 = 0
  UNION ALL SELECT * REPLACE (revenue + 1 AS revenue) FROM base WHERE s % 9 = 4),
scaled AS (SELECT ts_code, end_date, year(end_date) * 4 + quarter(end_date) - 1 AS period_index, greatest(ann_date, f_ann_date) AS disclosed, report_type,
  {', '.join(f"{f} * CASE WHEN unit = 'CNY' THEN 1 ELSE 1000 END AS {f}" for f in _FIELDS)} FROM statement_rows),
facts AS (SELECT ts_code, end_date, period_index, CASE WHEN report_type <> '99' THEN 'consolidated' END AS scope, CASE WHEN field IN ({', '.join(repr(f) for f in statements.POINTS)}) THEN 'point' WHEN report_type <> '99' THEN 'ytd' END AS basis,
  disclosed, (SELECT min(trade_date) FROM calendar c WHERE c.trade_date > disclosed) AS available, report_type, field, value FROM (UNPIVOT scaled ON {', '.join(_FIELDS)} INTO NAME field VALUE value))"""


def facts_of(s: SparkSession, d: str) -> DataFrame:
    return statements.normalize_facts(statement_rows(s, d), sessions(s, d), _FIELDS)


register("report_type_map", lambda s, d: statements.map_report_types(statement_rows(s, d)).groupBy("report_type", "scope", "basis").agg(F.count("*").alias("n_rows")), f"WITH {P}, {_ROWS} SELECT report_type, CASE WHEN report_type <> '99' THEN 'consolidated' END AS scope, CASE WHEN report_type <> '99' THEN 'ytd' END AS basis, count(*) AS n_rows FROM statement_rows GROUP BY ALL")
register(
    "scale_units",
    lambda s, d: statements.scale_units(statement_rows(s, d), ["revenue"]).select("ts_code", "end_date", "ann_date", F.col("revenue").cast("double").alias("revenue")),
    f"WITH {P}, {_ROWS} SELECT ts_code, end_date, ann_date, (revenue * CASE WHEN unit = 'CNY' THEN 1 ELSE 1000 END)::DOUBLE AS revenue FROM statement_rows",
)
register(
    "normalize_statement_facts",
    lambda s, d: facts_of(s, d).select("ts_code", "end_date", "period_index", "scope", "basis", "disclosed", "available", "field", F.col("value").cast("double").alias("value"), F.array_join("reasons", ",").alias("reasons")),
    f"WITH {P}, {_ROWS} SELECT ts_code, end_date, period_index, scope, basis, disclosed, available, field, value::DOUBLE AS value, concat_ws(',', CASE WHEN scope IS NULL THEN 'REPORT_TYPE' END, CASE WHEN available IS NULL THEN 'NOT_YET_AVAILABLE' END) AS reasons FROM facts",
)


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts, and each symbol's dates of study: all sessions on which something new is known of it."""
    facts = facts_of(s, d)
    return facts, statements.transitions(facts)


_VALUES = """dates AS MATERIALIZED (SELECT DISTINCT ts_code, available AS as_of FROM facts WHERE available IS NOT NULL),
newest AS (SELECT f.*, as_of FROM facts f JOIN dates USING (ts_code) WHERE available <= as_of AND scope = 'consolidated' QUALIFY rank() OVER (PARTITION BY ts_code, as_of, field, period_index, basis ORDER BY disclosed DESC) = 1),
vals AS MATERIALIZED (SELECT ts_code, as_of, field, period_index, basis, CASE WHEN count(DISTINCT value) = 1 THEN max(value) END AS value FROM newest GROUP BY ALL),
latest AS MATERIALIZED (SELECT ts_code, as_of, field, max(period_index) AS period_index FROM vals GROUP BY ALL)"""
_QUARTERS = """quarters AS MATERIALIZED (SELECT c.ts_code, c.as_of, c.field, c.period_index, CASE WHEN c.field = 'capex' AND x < 0 THEN NULL ELSE x END AS quarter FROM (
  SELECT v.*, CASE WHEN v.period_index % 4 = 0 THEN v.value ELSE v.value - b.value END AS x FROM vals v LEFT JOIN vals b ON b.ts_code = v.ts_code AND b.as_of = v.as_of AND b.field = v.field AND b.period_index = v.period_index - 1 AND b.basis = 'ytd' WHERE v.basis = 'ytd') c),
ttms AS (SELECT *, CASE WHEN count(quarter) OVER w = 4 THEN sum(quarter) OVER w END AS ttm FROM quarters WINDOW w AS (PARTITION BY ts_code, as_of, field ORDER BY period_index RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)),
averages AS (SELECT a.ts_code, a.as_of, a.field, a.period_index, a.value AS point, b.value AS year_before, (a.value + b.value) / 2.0 AS average FROM vals a LEFT JOIN vals b ON a.ts_code = b.ts_code AND a.as_of = b.as_of AND a.field = b.field AND b.period_index = a.period_index - 4 AND b.basis = 'point' WHERE a.basis = 'point')"""
register(
    "statement_value_asof",
    lambda s, d: statements.fact_versions(facts_of(s, d).filter("scope = 'consolidated'")).select(
        "ts_code", "field", "period_index", "scope", "basis", F.col("available").alias("from_date"), F.date_sub("until", 1).alias("through_date"), F.col("value").cast("double").alias("value"), F.array_join("reasons", ",").alias("reasons")
    ),
    f"""WITH {P}, {_ROWS}, days AS (SELECT ts_code, field, period_index, scope, basis, disclosed, min(available) AS available, CASE WHEN count(DISTINCT value) = 1 THEN max(value) END AS value, CASE WHEN count(DISTINCT value) > 1 THEN 'CONFLICTING_DISCLOSURES' ELSE '' END AS reasons
      FROM facts WHERE scope = 'consolidated' AND available IS NOT NULL GROUP BY ALL),
    shown AS (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY ts_code, field, period_index, scope, basis, available ORDER BY disclosed DESC) = 1)
    SELECT ts_code, field, period_index, scope, basis, available AS from_date, lead(available) OVER (PARTITION BY ts_code, field, period_index, scope, basis ORDER BY available) - 1 AS through_date, value::DOUBLE AS value, reasons FROM shown""",
)
register("latest_period", lambda s, d: statements.latest_period(*_asked(s, d), "revenue"), f"WITH {P}, {_ROWS}, {_VALUES} SELECT ts_code, as_of, period_index FROM latest WHERE field = 'revenue'")


def _legs(states: dict[str, statements.State], column: str, digits: int = 4):
    def query(s: SparkSession, d: str) -> DataFrame:
        made = statements.state_ratios(*_asked(s, d), states)
        return made.filter("period_index IS NOT NULL").select("ts_code", "as_of", F.col("state").alias("field"), "period_index", rounded("value", digits).alias(column))

    return query


def _legs_sql(source: str, column: str, kind: str, digits: int = 4) -> str:
    x = f"x.{column}::DOUBLE"
    return f"WITH {P}, {_ROWS}, {_VALUES}, {_QUARTERS} SELECT l.ts_code, l.as_of, l.field, l.period_index, {rounded_sql(x, digits)} AS {column} FROM latest l LEFT JOIN {source} x ON x.ts_code = l.ts_code AND x.as_of = l.as_of AND x.field = l.field AND x.period_index = l.period_index WHERE l.field IN ({', '.join(repr(f) for f in kind)})"


register("quarter_value", _legs(statements.QUARTERS, "quarter"), _legs_sql("quarters", "quarter", statements.FLOWS))
register("ttm", _legs(statements.TTMS, "ttm"), _legs_sql("ttms", "ttm", statements.FLOWS))
register("point_value", _legs({f: statements.State(f, lambda x, f=f: x.point(f)) for f in statements.POINTS}, "point", 3), _legs_sql("averages", "point", statements.POINTS, 3))
register("average_assets", _legs(statements.AVERAGES, "average", 3), _legs_sql("averages", "average", statements.POINTS, 3))

_FLOW_CELLS = ", ".join(f"max(ttm) FILTER (field = '{f}')::DOUBLE AS t_{f}" for f in statements.FLOWS)
_POINT_CELLS = ", ".join(f"max(point) FILTER (field = '{f}')::DOUBLE AS p_{f}" for f in statements.POINTS)
_WIDE = f"""flows AS (SELECT ts_code, as_of, period_index, max(quarter) FILTER (field = 'revenue')::DOUBLE AS q_revenue, {_FLOW_CELLS} FROM ttms GROUP BY ALL),
points AS (SELECT ts_code, as_of, period_index, max(average) FILTER (field = 'total_assets')::DOUBLE AS a_total_assets, max(year_before) FILTER (field = 'total_assets')::DOUBLE AS y_total_assets, {_POINT_CELLS} FROM averages GROUP BY ALL),
wide AS (SELECT * FROM flows FULL JOIN points USING (ts_code, as_of, period_index)),
years AS (SELECT w.*, b.q_revenue AS y_q_revenue, b.t_revenue AS y_t_revenue FROM wide w LEFT JOIN wide b ON b.ts_code = w.ts_code AND b.as_of = w.as_of AND b.period_index = w.period_index - 4)"""
# Anchor, numerator, denominator and what is taken off, as the definitions say.
_STATE_SQL = {
    "revenue_quarter_yoy": ("revenue", "q_revenue", "y_q_revenue", 1),
    "revenue_ttm_yoy": ("revenue", "t_revenue", "y_t_revenue", 1),
    "operating_margin": ("revenue", "t_operate_profit", "t_revenue", 0),
    "parent_net_margin": ("revenue", "t_n_income_attr_p", "t_revenue", 0),
    "cash_revenue_ratio": ("revenue", "t_n_cashflow_act", "t_revenue", 0),
    "profit_cash_asset_gap": ("n_income", "t_n_income - t_n_cashflow_act", "a_total_assets", 0),
    "cash_assets_ratio": ("n_cashflow_act", "t_n_cashflow_act", "a_total_assets", 0),
    "capex_revenue_ratio": ("revenue", "t_capex", "t_revenue", 0),
    "cash_less_capex_assets": ("n_cashflow_act", "t_n_cashflow_act - t_capex", "a_total_assets", 0),
    "assets_yoy": ("total_assets", "p_total_assets", "y_total_assets", 1),
    "cash_asset_share": ("total_assets", "p_money_cap", "p_total_assets", 0),
    "current_coverage": ("total_assets", "p_total_cur_assets", "p_total_cur_liab", 0),
    "liability_asset_share": ("total_assets", "p_total_liab", "p_total_assets", 0),
    "borrowings_asset_share": ("total_assets", "p_st_borr + p_lt_borr", "p_total_assets", 0),
    "receivable_asset_share": ("total_assets", "p_accounts_receiv", "p_total_assets", 0),
    "goodwill_asset_share": ("total_assets", "p_goodwill", "p_total_assets", 0),
}


def _state_sql(name: str) -> str:
    anchor, top, bottom, less = _STATE_SQL[name]
    return f"SELECT d.ts_code, d.as_of, '{name}' AS state, l.period_index, CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) END - {less} AS value FROM dates d LEFT JOIN (SELECT * FROM latest WHERE field = '{anchor}') l USING (ts_code, as_of) LEFT JOIN years y ON y.ts_code = l.ts_code AND y.as_of = l.as_of AND y.period_index = l.period_index"


_STATES = f"WITH {P}, {_ROWS}, {_VALUES}, {_QUARTERS}, {_WIDE}"
_ALL_SQL = " UNION ALL ".join(_state_sql(n) for n in statements.STATES)


def _ratios(s: SparkSession, d: str) -> DataFrame:
    return statements.state_ratios(*_asked(s, d))


for _name in statements.STATES:
    register(
        f"state_{_name}",
        lambda s, d, n=_name: statements.state_ratios(*_asked(s, d), {n: statements.STATES[n]}).select("ts_code", "as_of", "state", "period_index", rounded("value").alias("value")),
        f"{_STATES}, made AS ({_state_sql(_name)}) SELECT ts_code, as_of, state, period_index, {rounded_sql('value')} AS value FROM made",
    )


def _typed_ratios(s: SparkSession, d: str) -> DataFrame:
    facts, asked = _asked(s, d)
    typed = facts.withColumn("company_type", F.when(number() % 5 == 3, "2").otherwise("1"))
    return statements.state_ratios(typed, asked, {n: statements.STATES[n] for n in ("operating_margin", "liability_asset_share")})


register(
    "state_company_types",
    lambda s, d: _typed_ratios(s, d).select("ts_code", "as_of", "state", "period_index", rounded("value").alias("value"), F.array_contains("reasons", "UNSUPPORTED_COMPANY_TYPE").alias("unsupported")),
    f"""{_STATES}, made AS ({_state_sql("operating_margin")} UNION ALL {_state_sql("liability_asset_share")}), t AS (SELECT *, substr(ts_code, 2)::BIGINT % 5 = 3 AND period_index IS NOT NULL AS unsupported FROM made)
    SELECT ts_code, as_of, state, period_index, CASE WHEN NOT unsupported THEN {rounded_sql('value')} END AS value, unsupported FROM t""",
)


def _intervals(s: SparkSession, d: str) -> DataFrame:
    return statements.state_intervals(_ratios(s, d), "2002-12-31")


_INTERVALS = f"{_STATES}, made AS ({_ALL_SQL}), intervals AS (SELECT ts_code, state, value, as_of AS from_date, coalesce(lead(as_of) OVER (PARTITION BY ts_code, state ORDER BY as_of) - 1, DATE '2002-12-31') AS through_date FROM made)"
register("state_intervals", lambda s, d: _intervals(s, d).withColumn("value", rounded("value")), f"{_INTERVALS} SELECT ts_code, state, from_date, through_date, {rounded_sql('value')} AS value FROM intervals")
register(
    "expand_intervals_daily",
    lambda s, d: statements.expand_intervals(_intervals(s, d), sessions(s, d)).withColumn("value", rounded("value")),
    f"{_INTERVALS} SELECT ts_code, trade_date, state, {rounded_sql('value')} AS value, from_date AS available_date FROM intervals JOIN calendar ON trade_date BETWEEN from_date AND through_date",
)
register("state_coverage", lambda s, d: statements.state_coverage(_ratios(s, d)), f"{_STATES}, made AS ({_ALL_SQL}) SELECT state, count(value) AS ok_rows, count(*) - count(value) AS missing_rows FROM made GROUP BY 1")
register("state_reason_counts", lambda s, d: statements.state_reason_counts(_ratios(s, d)))

_PAIRS = [["industry"], ["exchange"], ["list_status"], ["industry", "exchange"], ["industry", "list_status"], ["exchange", "list_status"]]
register(
    "build_pools",
    lambda s, d: universe.build_pools(adapter.securities(s, d), ["industry", "exchange", "list_status"]),
    f"WITH {S}, t AS (" + " UNION ALL ".join(f"SELECT '{'+'.join(p)}' AS kind, concat_ws('|', {', '.join(p)}) AS value, ts_code FROM securities" for p in _PAIRS) + ") SELECT DISTINCT kind, value, ts_code, count(*) OVER (PARTITION BY kind, value) AS n_symbols FROM t QUALIFY n_symbols >= 3",
)


def _members(s: SparkSession, d: str) -> DataFrame:
    bars = adapter.panel(s, d)
    return bars.filter("vol > 60").select(F.concat(F.lit("IX"), (number() % 3).cast("string")).alias("index_code"), "ts_code", "trade_date")


register(
    "index_members_latest",
    lambda s, d: universe.index_members_latest(_members(s, d), "1996-01-01", "1999-12-31"),
    f"""WITH {P}, m AS (SELECT 'IX' || substr(ts_code, 2)::BIGINT % 3 AS index_code, ts_code, trade_date FROM panel WHERE vol > 60 AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
    SELECT * FROM m QUALIFY trade_date = max(trade_date) OVER (PARTITION BY index_code)""",
)
register(
    "hierarchy_pools",
    lambda s, d: universe.hierarchy_pools(adapter.securities(s, d), ["exchange", "area", "industry"]),
    f"WITH {S} SELECT level, pool, count(DISTINCT ts_code) AS n_symbols FROM (UNPIVOT (SELECT ts_code, exchange, area, industry FROM securities) ON exchange, area, industry INTO NAME level VALUE pool) GROUP BY ALL",
)
_G1, _G2, _G3 = Group({"exchange": ("ASIA", "EUROPE"), "list_status": ("L",)}), Group(pools=("WATCH", "I1")), Group({"industry": ("I0", "I2")})
_SEL = Selection((_G1, _G2), ("S1", "S2"), (_G3,), ("S2", "S4"))


def _both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return adapter.securities(s, d), adapter.memberships(s, d)


_G1SQL = "SELECT ts_code FROM securities WHERE exchange IN ('ASIA', 'EUROPE') AND list_status = 'L'"
_G2SQL = "SELECT DISTINCT ts_code FROM memberships WHERE universe_id IN ('WATCH', 'I1')"
_STEPS = f"""{S}, s0 AS ({_G1SQL} UNION {_G2SQL}), s1 AS (SELECT * FROM s0 UNION SELECT unnest(['S1', 'S2'])), s2 AS (SELECT * FROM s1 EXCEPT SELECT ts_code FROM securities WHERE industry IN ('I0', 'I2')), s3 AS (SELECT * FROM s2 WHERE ts_code NOT IN ('S2', 'S4'))"""
register("universe_filters_and", lambda s, d: universe.in_group(*_both(s, d), _G1), f"WITH {S} {_G1SQL}")
register("universe_groups_or", lambda s, d: universe.steps(*_both(s, d), _SEL)[0][1], f"WITH {_STEPS} SELECT * FROM s0")
register("universe_resolve", lambda s, d: universe.resolve(*_both(s, d), _SEL), f"WITH {_STEPS} SELECT * FROM s3")
register(
    "universe_step_counts",
    lambda s, d: universe.step_counts(*_both(s, d), _SEL),
    f"""WITH {_STEPS}, n AS (SELECT 0 AS step, 'include_groups' AS name, count(*) AS after FROM s0 UNION ALL SELECT 1, 'include_symbols', count(*) FROM s1 UNION ALL SELECT 2, 'exclude_groups', count(*) FROM s2 UNION ALL SELECT 3, 'exclude_symbols', count(*) FROM s3),
    b AS (SELECT *, coalesce(lag(after) OVER (ORDER BY step), 0) AS before FROM n) SELECT step, name, before, after, greatest(after - before, 0) AS added, greatest(before - after, 0) AS removed FROM b""",
)
register(
    "universe_unknown_member_keep",
    lambda s, d: universe.with_attributes(*_both(s, d)).select("ts_code", "exchange", "industry"),
    f"WITH {S} SELECT ts_code, exchange, industry FROM (SELECT ts_code FROM securities UNION SELECT ts_code FROM memberships) LEFT JOIN securities USING (ts_code)",
)
