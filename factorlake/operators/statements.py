"""Company statements: facts with disclosure times, values as of a date, and ratios made of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import next_session_after

# Report types (scope, basis), unit scales and the fields of the three statements.
REPORT_TYPES = {
    "1": ("consolidated", "ytd"), "2": ("consolidated", "quarter"), "3": ("consolidated", "quarter"), "4": ("consolidated", "ytd"), "5": ("consolidated", "ytd"),
    "6": ("parent", "ytd"), "7": ("parent", "quarter"), "8": ("parent", "quarter"), "9": ("parent", "ytd"), "10": ("parent", "ytd"), "12": ("parent", "ytd"),
}
UNIT_SCALES = {"CNY": 1, "CNY_1000": 1000, "CNY_10000": 10000}
FLOWS = ["revenue", "operate_profit", "n_income", "n_income_attr_p", "n_cashflow_act", "capex"]
POINTS = ["total_assets", "total_liab", "total_cur_assets", "total_cur_liab", "money_cap", "accounts_receiv", "goodwill", "st_borr", "lt_borr"]
OUTFLOWS = {"capex"}
FACT = ["ts_code", "field", "period_index", "scope", "basis"]


class Legs:
    """Columns of a state's legs, made of cells `<field>_<quarters back>` (value, reasons), and notes of what they need."""

    def __init__(self, basis: str = "ytd"):
        self.basis = basis
        self.needs: list[tuple[str, int, Column]] = []
        self.faults: list[Column] = []

    def fact(self, field: str, back: int, needed: Column | None = None) -> Column:
        self.needs.append((field, back, F.lit(True) if needed is None else needed))
        return F.col(f"{field}_{back}")["value"]

    def point(self, field: str, back: int = 0) -> Column:
        return self.fact(field, back)

    def average(self, field: str) -> Column:
        """Mean of a balance now and a year before."""
        return (self.fact(field, 0) + self.fact(field, 4)) / 2

    def quarter(self, field: str, back: int = 0) -> Column:
        """A single quarter: year-to-date values less those of the quarter before, but for the first; a negative
        outflow is missing. Facts by quarter are taken as they are."""
        own = self.fact(field, back)
        if self.basis == "quarter":
            return own
        later = (F.col("period_index") - back) % 4 != 0
        made = F.when(later, own - self.fact(field, back + 1, later)).otherwise(own)
        if field not in OUTFLOWS:
            return made
        self.faults.append(F.when(made < 0, F.lit("NEGATIVE_DERIVED_OUTFLOW")))
        return F.when(made >= 0, made)

    def ttm(self, field: str, back: int = 0) -> Column:
        """Four quarters in a row, all of them present."""
        return sum((self.quarter(field, back + i) for i in range(1, 4)), self.quarter(field, back))

    def over(self, top: Column, bottom: Column) -> Column:
        self.faults.append(F.when(bottom <= 0, F.lit("DENOMINATOR_NONPOSITIVE")))
        return F.when(bottom > 0, top.cast("double") / bottom.cast("double"))

    def reasons(self) -> Column:
        """Why the value is missing: what speaks against its facts, or that there is none."""
        each = [F.when(needed, F.coalesce(F.col(f"{field}_{back}")["reasons"], F.array(F.lit("NO_AVAILABLE_FACT")))) for field, back, needed in self.needs]
        return F.array_sort(F.array_distinct(F.concat(F.flatten(F.array_compact(F.array(*each))), F.array_compact(F.array(*self.faults or [F.lit(None).cast("string")])))))


@dataclass(frozen=True)
class State:
    """A ratio of a company's statements at the newest known period of its anchor field."""

    anchor: str
    value: Callable[[Legs], Column]


def share_of_assets(*fields: str) -> State:
    return State("total_assets", lambda x: x.over(sum((x.point(f) for f in fields[1:]), x.point(fields[0])), x.point("total_assets")))


def margin(field: str) -> State:
    return State("revenue", lambda x: x.over(x.ttm(field), x.ttm("revenue")))


# Names, anchors and formulas of the states.
STATES = {
    "assets_yoy": State("total_assets", lambda x: x.over(x.point("total_assets"), x.point("total_assets", 4)) - 1),
    "borrowings_asset_share": share_of_assets("st_borr", "lt_borr"),
    "capex_revenue_ratio": margin("capex"),
    "cash_asset_share": share_of_assets("money_cap"),
    "cash_assets_ratio": State("n_cashflow_act", lambda x: x.over(x.ttm("n_cashflow_act"), x.average("total_assets"))),
    "cash_less_capex_assets": State("n_cashflow_act", lambda x: x.over(x.ttm("n_cashflow_act") - x.ttm("capex"), x.average("total_assets"))),
    "cash_revenue_ratio": margin("n_cashflow_act"),
    "current_coverage": State("total_assets", lambda x: x.over(x.point("total_cur_assets"), x.point("total_cur_liab"))),
    "goodwill_asset_share": share_of_assets("goodwill"),
    "liability_asset_share": share_of_assets("total_liab"),
    "operating_margin": margin("operate_profit"),
    "parent_net_margin": margin("n_income_attr_p"),
    "profit_cash_asset_gap": State("n_income", lambda x: x.over(x.ttm("n_income") - x.ttm("n_cashflow_act"), x.average("total_assets"))),
    "receivable_asset_share": share_of_assets("accounts_receiv"),
    "revenue_quarter_yoy": State("revenue", lambda x: x.over(x.quarter("revenue"), x.quarter("revenue", 4)) - 1),
    "revenue_ttm_yoy": State("revenue", lambda x: x.over(x.ttm("revenue"), x.ttm("revenue", 4)) - 1),
}
#: Single legs of every field, as states.
QUARTERS = {f: State(f, lambda x, f=f: x.quarter(f)) for f in FLOWS}
TTMS = {f: State(f, lambda x, f=f: x.ttm(f)) for f in FLOWS}
AVERAGES = {f: State(f, lambda x, f=f: x.average(f)) for f in POINTS}


def period_index(date: str) -> Column:
    return F.year(date) * 4 + F.quarter(date) - 1


def lookup(values: dict, key: Column) -> Column:
    made = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(made, key)


def map_report_types(rows: DataFrame) -> DataFrame:
    """scope and basis of each report type; null for unknown ones."""
    return rows.withColumns({"scope": lookup({k: v[0] for k, v in REPORT_TYPES.items()}, F.col("report_type")), "basis": lookup({k: v[1] for k, v in REPORT_TYPES.items()}, F.col("report_type"))})


def scale_units(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Values in single units, exactly."""
    scale = lookup(UNIT_SCALES, F.col("unit")).cast("decimal(6,0)")
    return rows.withColumns({f: (F.col(f).cast("decimal(24,4)") * scale).cast("decimal(30,4)") for f in fields})


def normalize_facts(rows: DataFrame, calendar: DataFrame, fields: list[str]) -> DataFrame:
    """Wide statement rows to one fact for each field: coordinate, disclosure, the session it is known from, and
    the reasons that speak against it. Balance-sheet fields have the basis `point`."""
    typed = map_report_types(scale_units(rows, fields))
    disclosed = typed.withColumn("disclosed", F.greatest("ann_date", "f_ann_date"))
    known = next_session_after(disclosed, calendar, "disclosed")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("scope").isNull(), F.lit("REPORT_TYPE")),
            F.when(F.col("disclosed").isNull(), F.lit("NO_DISCLOSURE")),
            F.when(F.col("disclosed") < F.col("end_date"), F.lit("DISCLOSED_BEFORE_PERIOD_END")),
            F.when(F.col("end_date") != F.last_day(F.add_months(F.trunc("end_date", "quarter"), 2)), F.lit("UNSUPPORTED_REPORT_PERIOD")),
            F.when(F.col("available").isNull(), F.lit("NOT_YET_AVAILABLE")),
        )
    )
    kept = [c for c in ("company_type",) if c in rows.columns]
    long = known.select("ts_code", "end_date", period_index("end_date").alias("period_index"), "scope", "basis", "disclosed", "available", reasons.alias("reasons"), *kept, *fields).unpivot(
        ["ts_code", "end_date", "period_index", "scope", "basis", "disclosed", "available", "reasons", *kept], fields, "field", "value"
    )
    blank = F.when(F.col("value").isNull(), F.array(F.lit("VALUE_MISSING"))).otherwise(F.array().cast("array<string>"))
    return long.withColumn("reasons", F.concat("reasons", blank)).withColumn("basis", F.when(F.col("field").isin(POINTS), "point").otherwise(F.col("basis")))


def fact_versions(facts: DataFrame) -> DataFrame:
    """One row for each value that a coordinate (FACT) has in turn: known from `available` until the day before `until`
    (null: still). The newest disclosure counts; differing values in it, or any reason against one of its facts, make
    the value null with reasons. No fact meets another one but its coordinate's next."""
    each = facts.filter("available IS NOT NULL").groupBy(*FACT, "disclosed").agg(
        F.min("available").alias("available"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
        ((F.min("value") < F.max("value")) | (F.max(F.col("value").isNull()) & F.max("value").isNotNull())).alias("differ"),
        F.max("value").alias("value"),
    )
    reasons = F.when(F.col("differ"), F.array_union("reasons", F.array(F.lit("CONFLICTING_DISCLOSURES")))).otherwise(F.col("reasons"))
    until = F.lead("available").over(Window.partitionBy(*FACT).orderBy("available", "disclosed"))
    made = each.withColumn("reasons", reasons).withColumns({"value": F.when(F.size("reasons") == 0, F.col("value")), "until": until}).drop("differ")
    return made.filter("until IS NULL OR until > available")


def known_then(as_of: str = "as_of") -> Column:
    return (F.col("available") <= F.col(as_of)) & (F.col("until").isNull() | (F.col(as_of) < F.col("until")))


def values_asof(facts: DataFrame, as_of: DataFrame) -> DataFrame:
    """For each (ts_code, as_of) and coordinate: the value known by then, and the reasons if there is none."""
    return fact_versions(facts).join(as_of, "ts_code").filter(known_then()).select(*FACT, "as_of", "reasons", "value")


def latest_periods(facts: DataFrame, as_of: DataFrame, fields: list[str], scope: str = "consolidated", basis: str = "ytd") -> DataFrame:
    """(ts_code, as_of, field, period_index): the newest period of which something is known by then; null for none.
    A running maximum over what is disclosed and what is asked, by symbol and field."""
    own = facts.filter((F.col("scope") == scope) & F.col("basis").isin(basis, "point") & F.col("field").isin(fields) & F.col("available").isNotNull())
    news = own.select("ts_code", "field", F.col("available").alias("as_of"), "period_index", F.lit(False).alias("asked"))
    asked = as_of.select("ts_code", "as_of").distinct().select("ts_code", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"), "as_of", F.lit(None).cast("int").alias("period_index"), F.lit(True).alias("asked"))
    newest = F.max("period_index").over(Window.partitionBy("ts_code", "field").orderBy("as_of"))
    return news.unionByName(asked).withColumn("period_index", newest).filter("asked").drop("asked")


def latest_period(facts: DataFrame, as_of: DataFrame, field: str, scope: str = "consolidated", basis: str = "ytd") -> DataFrame:
    return latest_periods(facts, as_of, [field], scope, basis).filter("period_index IS NOT NULL").select("ts_code", "as_of", "period_index")


def state_ratios(facts: DataFrame, as_of: DataFrame, states: dict[str, State] | None = None, scope: str = "consolidated", basis: str = "ytd", company_types: tuple[str, ...] = ("1",)) -> DataFrame:
    """(ts_code, as_of, state, period_index, value, reasons): each state at its anchor's newest period; the value is null,
    with reasons, if a leg is missing or the denominator is not above 0. `basis` is that of the flows' facts. Where facts
    have a company_type, states are for companies of `company_types` alone: banks' and insurers' fields mean other things.

    All steps are dealt by symbol, so facts move once. The cells of one period that hold from one disclosure to the next
    are a row, a symbol's rows are an array, and each date picks from it the periods that some leg looks at: a fact is
    never copied to the dates that it is asked for.
    """
    states = states or STATES
    built = {name: (s, Legs(basis)) for name, s in states.items()}
    values = {name: s.value(legs) for name, (s, legs) in built.items()}
    needed = sorted({(f, back) for _, legs in built.values() for f, back, _ in legs.needs})
    fields = sorted({f for f, _ in needed})
    anchors = sorted({s.anchor for s in states.values()})
    used = facts.filter((F.col("scope") == scope) & F.col("basis").isin(basis, "point") & F.col("field").isin(sorted({*fields, *anchors})) & F.col("available").isNotNull())
    if "company_type" in used.columns:
        foreign = ~F.coalesce(F.col("company_type").isin(*company_types), F.lit(False))
        used = used.withColumn("reasons", F.when(foreign, F.array_union("reasons", F.array(F.lit("UNSUPPORTED_COMPANY_TYPE")))).otherwise(F.col("reasons")))
    history = period_history(used.filter(F.col("field").isin(fields)), fields)

    own = lambda a: F.max(F.when(F.col("field") == a, F.col("period_index")))
    news = used.filter(F.col("field").isin(anchors)).groupBy("ts_code", F.col("available").alias("as_of")).agg(*[own(a).alias(f"__{a}") for a in anchors])
    asked = as_of.select("ts_code", "as_of").distinct().withColumn("__asked", F.lit(True))
    upto = Window.partitionBy("ts_code").orderBy("as_of")
    newest = news.unionByName(asked, allowMissingColumns=True).withColumns({f"__{a}": F.max(f"__{a}").over(upto) for a in anchors}).filter("__asked")
    at = newest.withColumn("period_index", F.explode(F.array_distinct(F.array(*[F.col(f"__{a}") for a in anchors]))))
    oldest = max((b for _, b in needed), default=0)
    back = lambda x: F.col("period_index") - x["at"]
    then = lambda x: (x["available"] <= F.col("as_of")) & (x["until"].isNull() | (F.col("as_of") < x["until"]))
    seen = F.filter("__history", lambda x: back(x).between(0, oldest) & then(x))
    met = at.join(history, "ts_code", "left").withColumn("__seen", F.map_from_entries(F.transform(seen, lambda x: F.struct(back(x).alias("k"), x["now"].alias("v")))))
    rows = met.select("ts_code", "as_of", "period_index", *[f"__{a}" for a in anchors], *[F.try_element_at("__seen", F.lit(b))[f].alias(f"{f}_{b}") for f, b in needed])

    def made(name: str) -> Column:
        none = F.col("period_index").isNull()
        value = values[name].cast("double")
        why = F.when(none, F.array(F.lit("NO_AVAILABLE_ANCHOR_PERIOD"))).when(value.isNull(), built[name][1].reasons()).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(name).alias("state"), value.alias("value"), why.alias("reasons"))

    each = F.array(*[F.when(F.col("period_index").eqNullSafe(F.col(f"__{s.anchor}")), made(n)) for n, s in states.items()])
    return rows.select("ts_code", "as_of", "period_index", F.explode(F.array_compact(each)).alias("s")).select("ts_code", "as_of", "s.state", "period_index", "s.value", "s.reasons")


def period_history(facts: DataFrame, fields: list[str]) -> DataFrame:
    """(ts_code, __history): a symbol's periods as an array of (at, available, until, now): `now` has for each field the
    value and reasons known of period `at` from `available` until the day before `until` (null: still)."""
    versions = fact_versions(facts.select(*FACT, "disclosed", "available", "reasons", "value").repartition("ts_code"))
    cell = F.struct("value", "reasons")
    changes = versions.groupBy("ts_code", "period_index", "available").agg(*[F.max(F.when(F.col("field") == f, cell)).alias(f) for f in fields])
    way = Window.partitionBy("ts_code", "period_index").orderBy("available")
    now = F.struct(*[F.last(f, ignorenulls=True).over(way).alias(f) for f in fields])
    held = changes.select("ts_code", F.struct(F.col("period_index").alias("at"), "available", F.lead("available").over(way).alias("until"), now.alias("now")).alias("__one"))
    return held.groupBy("ts_code").agg(F.collect_list("__one").alias("__history"))


def transitions(facts: DataFrame) -> DataFrame:
    """Dates on which something new is known of a symbol: states change on no others."""
    return facts.filter("available IS NOT NULL").select("ts_code", F.col("available").alias("as_of")).distinct()


def state_intervals(ratios: DataFrame, end: str) -> DataFrame:
    """Validity of each state's values: from their date to the day before the next, or to `end`."""
    following = F.lead("as_of").over(Window.partitionBy("ts_code", "state").orderBy("as_of"))
    return ratios.select("ts_code", "state", "value", F.col("as_of").alias("from_date"), F.coalesce(F.date_sub(following, 1), F.lit(end).cast("date")).alias("through_date"))


def expand_intervals(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row for each session in each interval. Intervals and sessions meet by month, so that an interval is
    compared with the sessions of its months only."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    months = intervals.filter("from_date <= through_date").withColumn("__m", F.explode(F.sequence(month("from_date"), month("through_date"))))
    sessions = calendar.select("trade_date", month("trade_date").alias("__m"))
    met = months.join(F.broadcast(sessions), "__m").filter(F.col("trade_date").between(F.col("from_date"), F.col("through_date")))
    return met.select("ts_code", "trade_date", "state", "value", F.col("from_date").alias("available_date"))


def state_coverage(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("state").agg(F.count("value").alias("ok_rows"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing_rows"))


def state_reason_counts(ratios: DataFrame) -> DataFrame:
    """(state, reason, n): how often each reason stands against a state."""
    return ratios.select("state", F.explode("reasons").alias("reason")).groupBy("state", "reason").agg(F.count("*").alias("n"))
