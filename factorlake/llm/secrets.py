"""Secret scans by an inverted index of trigrams, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must hold.
The index has a posting (trigram, doc_id) for each document and each trigram that some rule asks for.
Intersecting postings gives each rule's candidates, and only these are run through the expression; a
rule without mandatory trigrams, as hexadecimal runs are, scans all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole

#: Candidate rows are broadcast up to this many bytes (24 a row and 4 a rule, counted before); beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression, and the least length of the group that decides."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
# Public forms of keys and tokens.
PUBLIC_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
]
RULES = BASE_RULES + PUBLIC_RULES


def exact_runs(parsed, most: int = 64) -> list[set[str]]:
    """The runs of a parsed expression for which all strings are known: each a set of at most `most`."""
    runs: list[set[str]] = []
    now: set[str] = {""}

    def ended() -> None:
        nonlocal now
        if now != {""}:
            runs.append(now)
        now = {""}

    def known(op, arg) -> set[str] | None:
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            found: set[str] = set()
            for o, a in arg:
                if str(o) == "LITERAL":
                    found.add(chr(a).lower())
                else:
                    return None
            return found
        if name == "BRANCH":
            parts = [of(p) for p in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if name == "SUBPATTERN":
            return of(arg[3])
        if name == "MAX_REPEAT" and arg[1] == 1 and arg[0] in (0, 1):
            own = of(arg[2])
            return None if own is None else own | ({""} if arg[0] == 0 else set())
        return None

    def of(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            own = known(op, arg)
            if own is None or len(out) * len(own) > most:
                return None
            out = {a + b for a in out for b in own}
        return out

    for op, arg in parsed:
        own = known(op, arg)
        if own is None:
            ended()
        elif len(now) * len(own) > most:
            ended()
            now = own
        else:
            now = {a + b for a in now for b in own}
    ended()
    return runs


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A Boolean query in lower case: all of its clauses must hold; a clause holds if all trigrams of one of
    its sets occur. No clause: the expression has no mandatory trigrams."""
    clauses = []
    for run in exact_runs(re._parser.parse(pattern)):
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in sets:
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return clauses


def build_index(df: DataFrame, trigrams: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Postings (trigram: place in `trigrams`, key) of the lower-cased texts, for the trigrams asked for."""
    low = df.select(F.col(key).alias("key"), F.lower(whole(text)).alias("low"))
    hits = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])
    return low.select("key", F.explode(F.array_compact(hits)).alias("trigram"))


def find_candidates(index: DataFrame, trigrams: list[str], queries: list[list[list[frozenset[str]]]]) -> DataFrame:
    """Postings intersected by each query: key and the places of the queries that hold; keys without any are left out."""
    place = {t: i for i, t in enumerate(trigrams)}
    have = index.groupBy("key").agg(F.collect_set("trigram").alias("have"))

    def holds(needed: frozenset[str]) -> Column:
        return F.size(F.array_intersect("have", F.array(*[F.lit(place[t]) for t in sorted(needed)]))) == len(needed)

    met = [F.when(reduce(Column.__and__, [reduce(Column.__or__, [holds(s) for s in sets]) for sets in clauses]), F.lit(i)) for i, clauses in enumerate(queries) if clauses]
    return have.select("key", F.array_compact(F.array(*met)).alias("rules")).filter(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in a text, as structs (start, kind, end) in code points, end exclusive.

    The gaps between leftmost matches that don't overlap, and the matches themselves, give the places.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.char_length(s))
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    decides = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda s: F.char_length(s)).alias("long"), F.transform(decides, lambda s: F.char_length(s)).alias("decides"))
    empty = F.lit(0)
    start = F.struct(empty.alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["long"], empty)
        span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        kept = F.when(F.coalesce(x["decides"], empty) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.when(F.size(found) == 0, start["spans"]).otherwise(F.aggregate(parts, start, step)["spans"])


def find_secrets(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id", name: str = "secrets") -> DataFrame:
    """All rows and columns of `df` with the column `name`: structs (start, kind, end), by start and then by the
    rules' order; kind is the rule's place, places are code points.

    The candidates' table holds a key and the rules that it is a candidate for; where that fits BROADCAST_BYTES by
    exact count it is broadcast, else both sides are shuffled by key. Keys may be null or repeat: candidates
    are then joined to all rows of that key, and the expression decides. A null or empty text has no
    secrets; an empty table gives an empty result. An input column of that name is replaced, all others stay.
    """
    rules = RULES if rules is None else rules
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for clauses in queries for sets in clauses for s in sets for t in s})
    df = df.drop(name)
    if trigrams:
        found = cut(find_candidates(build_index(df, trigrams, text, key), trigrams, queries))
        found = found.select(F.col("key").alias("__key"), F.col("rules").alias("__rules"))
        if found.count() * (24 + 4 * len(rules)) <= BROADCAST_BYTES:
            found = F.broadcast(found)
        rows = df.join(found, df[key].eqNullSafe(found["__key"]), "left").drop("__key")
    else:
        rows = df.withColumn("__rules", F.array().cast("array<int>"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for i, (rule, clauses) in enumerate(zip(rules, queries, strict=True)):
        own = spans_of(whole(text), rule, i)
        each.append(F.when(F.array_contains("__rules", i), own).otherwise(none) if clauses else own)
    return rows.withColumn(name, F.array_sort(F.concat(*each))).drop("__rules")


def spans_text(secrets: str = "secrets", rules: list[Rule] | None = None) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in (RULES if rules is None else rules)])
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(kind: int, secrets: str = "secrets") -> Column:
    return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every secret of every text replaced by `mark`; overlapping spans are replaced as one. Null texts stay
    null, and all other columns, whatever their names, stay as they came; rows that repeat are given each, and an empty
    table gives an empty result."""
    found = find_secrets(df, rules, text, key, "__secrets")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["parts"], F.array(F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["parts"]).alias("parts"))

    done = F.aggregate("__secrets", start, step)
    clean = F.concat(F.array_join(done["parts"], ""), F.substr(F.col(text), done["at"] + 1, F.char_length(text)))
    return found.withColumn(text, F.when(F.size("__secrets") > 0, clean).otherwise(F.col(text))).drop("__secrets")
