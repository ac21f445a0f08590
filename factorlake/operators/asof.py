"""Joins in time: what was known at a date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_folder


def next_sessions(dates: DataFrame, calendar: DataFrame, column: str) -> DataFrame:
    """(column, available): for each distinct date the first session strictly after it, null if there is none.

    Distinct dates and sessions are at most as many as civil days; one window over both finds them.
    """
    sessions = calendar.select(F.col("trade_date").alias("d"), F.col("trade_date").alias("session"))
    both = dates.select(F.col(column).alias("d")).distinct().filter("d IS NOT NULL").withColumn("session", F.lit(None).cast("date")).unionByName(sessions)
    after = Window.orderBy(F.datediff("d", F.lit("1970-01-01").cast("date"))).rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("available", F.min("session").over(after)).filter("session IS NULL").select(F.col("d").alias(column), "available")


def next_session_after(df: DataFrame, calendar: DataFrame, column: str = "ann_date", name: str = "available") -> DataFrame:
    found = next_sessions(df, calendar, column).withColumnRenamed("available", name)
    return df.join(F.broadcast(found), column, "left")


def quarantine_conflicts(reports: DataFrame, fields: list[str], keys: tuple[str, ...] = ("ts_code", "ann_date", "end_date")) -> DataFrame:
    """One row for each disclosure: a field with differing values, null being one, is null and named in conflicts."""
    different = {f: (F.countDistinct(f) + F.max(F.col(f).isNull().cast("int"))) > 1 for f in fields}
    agreed = [F.when(~different[f], F.max(f)).alias(f) for f in fields]
    logged = F.array_join(F.array_compact(F.array(*[F.when(different[f], F.lit(f)) for f in fields])), ",").alias("conflicts")
    return reports.groupBy(*keys).agg(*agreed, logged)


def join_latest(grid: DataFrame, events: DataFrame, order: list[str], fields: list[str], available: str = "available") -> DataFrame:
    """Each grid row with the event that is greatest by `order` among those of its symbol available by its date.

    Rows and events are merged by symbol; a running maximum of (order, fields) carries the event forward. A null
    field of that event stays null.
    """
    record = F.struct(*order, *fields)
    kind = events.select(record.alias("r")).schema["r"].dataType
    names = grid.columns
    both = grid.select(*names, F.col("trade_date").alias("__at"), F.lit(None).cast(kind).alias("r"), F.lit(True).alias("__row")).unionByName(
        events.filter(F.col(available).isNotNull()).select("ts_code", F.col(available).alias("__at"), record.alias("r"), F.lit(False).alias("__row")), allowMissingColumns=True
    )
    upto = Window.partitionBy("ts_code").orderBy(F.datediff("__at", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.max("r").over(upto)).filter("__row")
    return found.select(*names, *[F.col(f"found.{c}").alias(c) for c in [*order, *fields]])


def join_reports_asof(grid: DataFrame, reports: DataFrame, fields: list[str], calendar: DataFrame) -> DataFrame:
    """At each date the newest period disclosed by then, in its newest disclosure; known from the session after."""
    events = next_session_after(quarantine_conflicts(reports, fields), calendar)
    return join_latest(grid, events, ["end_date", "available", "ann_date"], fields)


def join_selections_asof(grid: DataFrame, selections: DataFrame, fields: list[str], calendar: DataFrame) -> DataFrame:
    """As join_reports_asof() for observations with a known date and a revision."""
    events = next_session_after(selections, calendar, "known_date")
    return join_latest(grid, events, ["end_date", "available", "revision"], fields)


def check_report_dates(reports: DataFrame, symbols: DataFrame) -> DataFrame:
    known = symbols.select("ts_code").distinct().withColumn("__known", F.lit(True))
    marked = reports.join(known, "ts_code", "left")
    reason = F.when(F.col("__known").isNull(), "universe").when(F.col("ann_date").isNull() | F.col("end_date").isNull(), "dates").when(F.col("ann_date") < F.col("end_date"), "order")
    return marked.withColumn("reason", reason).filter("reason IS NOT NULL").drop("__known")


#: What is wrong with a fact, by rank: the greatest found holds. From _CYCLE on nothing that its inputs tell can change it.
PROBLEMS = (None, "unresolved_input", "cycle", "unknown_input")
_UNRESOLVED, _CYCLE, _UNKNOWN = 1, 2, 3


def _settle(links: DataFrame) -> DataFrame:
    """Each link of a fact once, with the latest and worst of all its links; `few` if one row is left of the fact.

    A fact that waits for no input, or whose problem is final, is a row without input_id.
    """
    once = links.groupBy("fact_id", "input_id").agg(*[F.max(c).alias(c) for c in ("known_at", "deep", "steps", "problem")])
    fact = Window.partitionBy("fact_id")
    whole = {c: F.max(c).over(fact) for c in ("known_at", "deep", "problem")}
    marked = once.withColumns(whole | {"__waits": F.count("input_id").over(fact), "__place": F.row_number().over(fact.orderBy(F.col("input_id").desc_nulls_last()))})
    kept = marked.withColumn("few", (F.col("__waits") <= 1) | (F.col("problem") >= _CYCLE)).filter(F.when(F.col("few"), F.col("__place") == 1).otherwise(F.col("input_id").isNotNull()))
    return kept.withColumn("input_id", F.when(F.col("problem") < _CYCLE, F.col("input_id"))).drop("__waits", "__place")


def knowledge_time(facts: DataFrame, edges: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(fact_id, known_at, problem): the latest of a fact's own times and, through any number of steps, of its inputs'.

    `facts` has recorded, retrieved and published dates; `edges` (fact_id, input_id) leads from derived facts to inputs.
    A fact has no time, but a problem, if an input is not among the facts (unknown_input), an input has a problem itself
    (unresolved_input), it is in or behind a cycle (cycle), or more than `most_steps` steps lead to it (too_deep; without
    a number any may).

    In a round a link to a fact that waits for no input takes its time, and a link to a fact that waits for one input
    leads to that input from then on. So links double their length, and chains and trees take rounds by the logarithm of
    their depth; only facts that wait for several inputs at once take a round for each step between them. A link of as
    many steps as there are facts has passed a cycle, and what is left when no link moves waits for one.

    A round's tables are merged with each other and none is broadcast: over all rounds that would send most facts to the
    driver.
    """
    known = facts.select(F.col("fact_id").alias("input_id"), F.lit(True).alias("__known"))
    links = edges.select("fact_id", "input_id").filter("input_id IS NOT NULL").join(known.hint("merge"), "input_id", "left").withColumn("problem", F.when(F.col("__known").isNull(), _UNKNOWN)).drop("__known")
    own = facts.select("fact_id", F.greatest("recorded", "retrieved", "published").alias("known_at"))
    # deep: steps that lead to the fact, as far as they are known; steps: those that the link stands for
    start = own.join(links.hint("merge"), "fact_id", "left").withColumns({"problem": F.coalesce("problem", F.lit(0)), "deep": F.lit(0).cast("long"), "steps": F.lit(1).cast("long")})
    state = cut(_settle(start))
    rows, parts, before = state.count(), int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    turn = 0
    while True:
        waiting = state.filter("input_id IS NOT NULL")
        now = waiting.agg(F.count("*"), F.sum("steps")).first()
        if now[0] == 0 or now == before:  # a link that moves is done with, is merged with another or gets longer
            break
        before = now
        few = state.filter("few").select(F.col("fact_id").alias("input_id"), F.struct("input_id", "known_at", "deep", "steps", "problem").alias("__to"))
        met = waiting.join(few.hint("merge"), "input_id", "left")
        steps = F.when(F.col("__to.input_id").isNotNull(), F.col("steps") + F.col("__to.steps")).otherwise(F.col("steps"))
        heard = F.when(F.col("__to.problem") == _CYCLE, _CYCLE).when(F.col("__to.problem") > 0, _UNRESOLVED)
        moved = met.select(
            "fact_id", F.when(F.col("__to").isNull(), F.col("input_id")).otherwise(F.col("__to.input_id")).alias("input_id"), F.greatest("known_at", "__to.known_at").alias("known_at"),
            F.greatest("deep", F.col("steps") + F.col("__to.deep")).alias("deep"), steps.alias("steps"), F.greatest("problem", heard, F.when(steps >= rows, _CYCLE)).alias("problem"),
        )
        done = state.filter("input_id IS NULL").coalesce(parts)  # or a round would add its parts to those of all before
        state = cut(done.unionByName(_settle(moved.repartition("fact_id"))))
        turn += 1
        if turn % 8 == 0:  # sizes guessed for joins multiply with each round, and cut() keeps them; a file has its own
            folder = f"{shared_folder(state.sparkSession)}/lineage-{uuid.uuid4().hex}"
            state.write.parquet(folder)
            state = state.sparkSession.read.schema(state.schema).parquet(folder)
    problem = F.array(*[F.lit(p) for p in PROBLEMS])[F.col("problem")]
    if most_steps is not None:
        problem = F.when((F.col("problem") < _CYCLE) & (F.col("deep") > most_steps), "too_deep").otherwise(problem)
    told = state.filter("input_id IS NULL").select("fact_id", "known_at", problem.alias("problem"))
    left = waiting.select("fact_id").distinct().select("fact_id", F.lit(None).cast("date").alias("known_at"), F.lit(PROBLEMS[_CYCLE]).alias("problem"))
    return told.withColumn("known_at", F.when(F.col("problem").isNull(), F.col("known_at"))).unionByName(left)


def check_units_scope(selections: DataFrame, unit: str) -> DataFrame:
    """Selections whose unit is another one, and keys with several records or symbols with several entities."""
    units = selections.filter(F.col("unit") != unit).groupBy("ts_code").agg(F.count("*").alias("n")).withColumn("problem", F.lit("unit"))
    repeated = selections.groupBy("ts_code", "end_date", "revision").agg(F.count("*").alias("c")).filter("c > 1").groupBy("ts_code").agg(F.count("*").alias("n")).withColumn("problem", F.lit("records"))
    entities = selections.groupBy("ts_code").agg(F.countDistinct("entity").alias("n")).filter("n > 1").withColumn("problem", F.lit("entities"))
    return units.unionByName(repeated).unionByName(entities)
