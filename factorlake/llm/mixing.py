"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a 60-bit hash of its doc_id. Sums of words by source and hash bucket
tell in which bucket a source's budget ends; only that bucket is summed again, 4096 times finer, until it
holds a single place. Then every document is kept or not by comparing its hash with its source's
threshold: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, whole

HASH_BITS, STEP_BITS = 60, 12
# Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows of a table by source that are broadcast, by exact count; beyond, the join is dealt by source and bucket.
BROADCAST_SOURCES = 100_000


def place_of(key: str = "doc_id") -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def with_source(df: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """`df` (source, place) joined to a row for each source. Few rows: broadcast. Else each source's row is
    repeated for each of 256 buckets of places, so that a source with a third of all rows is dealt out."""
    if few:
        own = sources.withColumnRenamed("source", "__s")
        return df.join(F.broadcast(own), df["source"].eqNullSafe(own["__s"])).drop("__s")
    own = sources.withColumnRenamed("source", "__s").withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))))
    return df.join(own, df["source"].eqNullSafe(own["__s"]) & (F.shiftright("place", HASH_BITS - 8) == own["__b"])).drop("__s", "__b")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets from (source, source_size): all words shared by weight, none above `most` times its source.

    Sources by code point, null last, take the weights in turn. Stopping at the bound and sharing the excess
    again by weight ends where all sources below their bound have one common target for each unit of weight;
    ordered by bound for each unit of weight, that level is the first that the next bound reaches. These
    windows see one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn).cast("long")).withColumn("bound", F.col("source_size") * most)
    ranked = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("bound").over(before), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighed.withColumn("level", level)
    shared = F.min(F.when(F.col("bound") / F.col("weight") >= F.col("level"), F.struct(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(all_rows)["level"]
    return levels.withColumn("target", F.least(F.col("weight") * F.coalesce(shared, F.lit(0.0)), F.col("bound").cast("double"))).select("source", "source_size", "weight", "target")


def plan_mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> tuple[DataFrame, bool]:
    """From (source, place, size): a row for each source with its target, its whole epochs and the threshold
    below which a document is taken once more; and whether these rows are few.

    The threshold is the end of the run of places whose words come nearest to the budget.
    """
    sizes = df.groupBy("source").agg(F.sum("size").alias("source_size"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets(sizes, weights, most).withColumn("epochs", full)
    budget = F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))
    state = cut(state.withColumns({"budget": budget, "cell": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "inside": F.lit(0).cast("long"), "places": F.lit(2).cast("long")}))
    few = state.count() <= BROADCAST_SOURCES
    width = HASH_BITS
    while width > 0 and state.filter("places > 1").limit(1).count():
        width -= STEP_BITS
        near = with_source(df, state.select("source", "cell"), few).filter(F.shiftright("place", width + STEP_BITS) == F.col("cell"))
        cells = near.groupBy("source", F.shiftright("place", width).alias("next")).agg(F.sum("size").alias("sum"), F.countDistinct("place").alias("n") if width == 0 else F.count("*").alias("n"))
        own = state.withColumnRenamed("source", "__s")
        joined = cells.join(F.broadcast(own) if few else own, cells["source"].eqNullSafe(own["__s"])).drop("__s")
        upto = F.sum("sum").over(Window.partitionBy("source").orderBy("next"))
        crossed = joined.withColumn("upto", F.col("below") + upto).filter((F.col("upto") > F.col("budget")))
        first = crossed.groupBy("source").agg(F.min_by(F.struct("next", "upto", "sum", "n"), "next").alias("c"))
        first = first.withColumnRenamed("source", "__s")
        state = cut(
            state.join(F.broadcast(first) if few else first, state["source"].eqNullSafe(first["__s"]), "left").select(
                *[c for c in state.columns if c not in ("cell", "below", "inside", "places")],
                F.coalesce(F.col("c.next"), F.shiftleft("cell", STEP_BITS)).alias("cell"),
                F.coalesce(F.col("c.upto") - F.col("c.sum"), "below").alias("below"),
                F.coalesce(F.col("c.sum"), F.lit(0)).cast("long").alias("inside"),
                F.coalesce(F.col("c.n"), F.lit(0)).cast("long").alias("places"),
            )
        )
    more = F.when(F.col("below") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("below"), 1).otherwise(0)
    return state.select("source", "source_size", "target", "epochs", F.shiftleft(F.col("cell") + more, width).alias("threshold")), few


#: Names of what add_mix() adds.
SIZE, SOURCE, PLACE, SOURCE_SIZE, TARGET, COPIES = "__mix_size", "__mix_source", "__mix_place", "__mix_source_size", "__mix_target", "__mix_copies"


def add_mix(df: DataFrame, weights: tuple[int, ...], most: int, text: str, key: str, source: str) -> DataFrame:
    """`df` with a column for each of the names above; its own columns stay as they are."""
    rows = df.withColumns({SIZE: word_count(text), SOURCE: F.col(source), PLACE: place_of(key)})
    plan, few = plan_mix(cut(rows.select(F.col(SOURCE).alias("source"), F.col(PLACE).alias("place"), F.col(SIZE).alias("size"))), weights, most)
    slim = rows.select(F.struct(*df.columns, SIZE, SOURCE).alias("__row"), F.col(SOURCE).alias("source"), F.col(PLACE).alias("place"))
    copies = F.col("epochs") + F.when(F.col("place") < F.col("threshold"), 1).otherwise(0)
    joined = with_source(slim, plan, few)
    return joined.select("__row.*", F.col("place").alias(PLACE), F.col("source_size").alias(SOURCE_SIZE), F.col("target").alias(TARGET), F.least(copies, F.lit(most)).cast("long").alias(COPIES))


def mix_sources(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """All rows of `df` with size (words), source_size, target, copies (how often the mix takes the row) and
    taken (copies times size).

    A null text or one without words has size 0, and is copied `most` times at most like any other. A null source is a
    source, the last. Rows that share a doc_id are taken alike. A source whose documents are few or large comes as near
    to its target as the run of whole documents allows. If no text has words, targets are 0 and nothing is taken; an
    empty table gives an empty result. Input columns with the names of the five new ones are replaced; all others,
    whatever their names, stay.
    """
    made = add_mix(df, weights, most, text, key, source)
    new = {"size": F.col(SIZE), "source_size": F.col(SOURCE_SIZE), "target": F.col(TARGET), "copies": F.col(COPIES), "taken": F.col(COPIES) * F.col(SIZE)}
    return made.select(*[c for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def take_mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the rows of `df`, with their own columns as they came, each as often as the mix takes it. Nulls,
    ties, repeated rows and empty tables are as in mix_sources()."""
    made = add_mix(df, weights, most, text, key, source)
    times = F.when(F.col(COPIES) > 0, F.sequence(F.lit(1), F.col(COPIES).cast("int"))).otherwise(F.array().cast("array<int>"))
    return made.withColumn("__mix_n", F.explode(times)).select(df.columns)
