"""Universes as sets of symbols."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = ["industry", "area", "exchange", "list_status"]


@dataclass(frozen=True)
class Group:
    """Symbols that meet all filters: attribute to values, any of which does. `pools` are universe ids."""

    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pools: tuple[str, ...] = ()


@dataclass(frozen=True)
class Selection:
    include: tuple[Group, ...] = ()
    include_symbols: tuple[str, ...] = ()
    exclude: tuple[Group, ...] = ()
    exclude_symbols: tuple[str, ...] = ()


def build_pools(securities: DataFrame, attributes: list[str], least: int = 3) -> DataFrame:
    """(kind, value, ts_code, n_symbols): the members of pools by each attribute and each pair of attributes, a row each, of
    pools of at least `least` symbols. A pool of any size is rows like any other: its count alone meets in one place."""
    sets = [[a] for a in attributes] + [[a, b] for i, a in enumerate(attributes) for b in attributes[i + 1 :]]
    named = [F.struct(F.concat_ws("+", *[F.lit(a) for a in s]).alias("kind"), F.when(F.concat(*s).isNotNull(), F.concat_ws("|", *s)).alias("value")) for s in sets]
    rows = securities.select("ts_code", F.explode(F.array(*named)).alias("p")).select("p.*", "ts_code").filter("value IS NOT NULL").distinct()
    return rows.join(rows.groupBy("kind", "value").agg(F.count("*").alias("n_symbols")).filter(F.col("n_symbols") >= least), ["kind", "value"])


def index_members_latest(members: DataFrame, start: str, end: str) -> DataFrame:
    """(index_code, ts_code) at each index's last date in the range."""
    inside = members.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    last = inside.groupBy("index_code").agg(F.max("trade_date").alias("trade_date"))
    return inside.join(F.broadcast(last), ["index_code", "trade_date"], "left_semi")


def hierarchy_pools(levels: DataFrame, names: list[str]) -> DataFrame:
    """Pool sizes at each level of a hierarchy of industries."""
    return levels.unpivot(["ts_code"], names, "level", "pool").filter("pool IS NOT NULL").groupBy("level", "pool").agg(F.countDistinct("ts_code").alias("n_symbols"))


def with_attributes(securities: DataFrame, memberships: DataFrame) -> DataFrame:
    """All symbols, members without attributes too: their attributes are null, so no filter matches them."""
    every = securities.select("ts_code").union(memberships.select("ts_code")).distinct()
    return every.join(securities, "ts_code", "left")


def in_group(securities: DataFrame, memberships: DataFrame, group: Group) -> DataFrame:
    """Symbols of a group."""
    found = with_attributes(securities, memberships)
    for attribute, values in group.filters.items():
        found = found.filter(F.col(attribute).isin(*values))
    found = found.select("ts_code")
    if group.pools:
        found = found.join(memberships.filter(F.col("universe_id").isin(*group.pools)).select("ts_code"), "ts_code", "left_semi")
    return found


def steps(securities: DataFrame, memberships: DataFrame, selection: Selection) -> list[tuple[str, DataFrame]]:
    """The set after each step: groups joined, symbols added, groups taken away, symbols taken away."""
    spark = securities.sparkSession
    listed = lambda codes: spark.createDataFrame([(c,) for c in codes], "ts_code string")
    now = listed(())
    for g in selection.include:
        now = now.union(in_group(securities, memberships, g))
    made = [("include_groups", now := now.distinct())]
    made.append(("include_symbols", now := now.union(listed(selection.include_symbols)).distinct()))
    for i, g in enumerate(selection.exclude):
        gone = in_group(securities, memberships, g) if i == 0 else gone.union(in_group(securities, memberships, g))
    made.append(("exclude_groups", now := now.join(gone, "ts_code", "left_anti") if selection.exclude else now))
    made.append(("exclude_symbols", now.join(listed(selection.exclude_symbols), "ts_code", "left_anti")))
    return made


def resolve(securities: DataFrame, memberships: DataFrame, selection: Selection) -> DataFrame:
    return steps(securities, memberships, selection)[-1][1]


def step_counts(securities: DataFrame, memberships: DataFrame, selection: Selection) -> DataFrame:
    """Sizes before and after each step."""
    made = steps(securities, memberships, selection)
    sizes = None
    for i, (name, df) in enumerate(made):
        own = df.agg(F.count("*").alias("after")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "after")
        sizes = own if sizes is None else sizes.union(own)
    from pyspark.sql import Window

    before = F.coalesce(F.lag("after").over(Window.orderBy("step")), F.lit(0))
    change = F.col("after") - F.col("before")
    return sizes.withColumn("before", before).select("step", "name", "before", "after", F.greatest(change, F.lit(0)).alias("added"), F.greatest(-change, F.lit(0)).alias("removed"))
