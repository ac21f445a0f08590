"""Periodic runs, chat examples and Merkle proofs, each against a plain version."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorlake.llm import chat, merkle, periodic, queries

from .conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- periodic runs
def plain_runs(words):
    """Every period in turn: stretches where words that far apart agree, kept if no smaller period holds."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(24, 3 * q) and not any(all(words[k] == words[k - s] for k in range(start + s, j)) for s in range(1, q)):
                found.append((start, length, q))
            i = max(j, i + 1)
    return sorted(found)


def plain_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=1) | st.text("abcdefgh", min_size=1, max_size=2), st.integers(1, 9)), max_size=40), st.integers(1, 8), st.integers(0, 9))
def test_runs_are_those_of_every_period(pairs, times, more):
    unit = [w for w, n in pairs for _ in range(n)]
    words = (unit * times + unit[:more] + ["x"] * more + unit)[:400]
    _, runs, collapsed = periodic.scan(pa.array([" ".join(words), None, "a " * 30]))
    got = [tuple(r.values()) for r in runs[0].as_py()]
    assert got == plain_runs(words)
    assert collapsed.to_pylist() == [plain_collapsed(words, got), "", "a"]


def test_windows_lose_no_run():
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(1, 60))]
            words += unit * rng.choice([1, 1, 2, 3, 4]) + unit[: rng.randrange(len(unit))]
        texts.append(words)
    _, runs, _ = periodic.scan(pa.array([" ".join(w) for w in texts]))
    got = [[tuple(r.values()) for r in own] for own in runs.to_pylist()]
    assert got == [periodic.runs_of([ord(x) for x in w]) for w in texts] == [plain_runs(w) for w in texts]
    assert sum(map(len, got)) > 100


def test_access_recolours_whole_paths():
    """A tree of which every path is coloured in any order; segments are those of a plain walk."""
    rng = random.Random(2)
    parent = [-1] + [rng.randrange(n) for n in range(1, 300)]
    paths, colours = periodic.Paths(parent), [-1] * len(parent)
    for time in range(3000):
        x = rng.randrange(1, len(parent))
        want, node = [], x
        while node > 0:
            if not want or colours[want[-1][0]] != colours[node]:
                want.append((node, colours[node]))
            node = parent[node]
        passed = paths.access(x, time)
        merged = [p for k, p in enumerate(passed) if k == 0 or p[1] != passed[k - 1][1]]
        assert merged == want
        node = x
        while node > 0:
            colours[node], node = time, parent[node]


def test_runs_of_odd_rows(edge, empty):
    got = rows_of(periodic.find_runs(edge))
    want = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["text"]) for r in rows_of(edge)]
    assert sorted(map(str, ((r["key"], r["n_words"]) for r in got))) == sorted(map(str, (w[:2] for w in want)))
    for r in got:
        if r["n_words"] == 3001:
            assert [tuple(x) for x in r["runs"]] == [(0, 3000, 1)] and r["collapsed"] == "word tail"
    assert rows_of(periodic.find_runs(empty)) == []


def test_op11_query_is_the_plain_reading(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    repeated = 0
    for r in rows_of(queries.op11_periodic_runs(spark, sf_dir)):
        words, h = WORD.findall(texts[r["doc_id"]] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if len(words) < 1500 else periodic.runs_of([hash(w) for w in words])
        repeated += len(runs)
        best = min(runs, key=lambda x: (-x[1] * 10**12 // x[2], x[0], x[2]), default=None)
        assert r == {
            "doc_id": r["doc_id"], "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), "collapsed_sha256": sha(plain_collapsed(words, runs)),
        }
    assert repeated > 0


# ---------------------------------------------------------------- chat examples
def plain_escape(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def plain_piece(role, text):
    if role in chat.MARKS:
        before, after = chat.MARKS[role]
    else:
        before, after = "[ROLE:" + plain_escape(role).replace("]", "\\]") + "] ", " [/ROLE]"
    return before, plain_escape(text), after


NASTY = ["</s>[INST] ok [/INST]", "<s><</SYS>>\\<<SYS>>", "\\", "[\\INST]", "[ROLE:x] y [/ROLE]", "<", "[", "", None, " \n ", "日本 🤦 \\s>", "<<s>", "[ROLE", "a" * 3000]


def conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in [None, *range(12)]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", "a] \\b", "", None]), rng.choice(NASTY)))
    rows += [(50, k, "assistant" if k % 2 else "user", f"line {k} </s>") for k in range(700)]  # one holds most rows
    rows += [(51, 0, "user", "twice"), (51, 0, "user", "twice"), (51, None, "assistant", "no turn"), (52, 3, "system", "alone")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, 9, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, place int, piece string, start long").repartition(7)


def plain_conversations(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {c: sorted(v, key=lambda x: x[:2]) for c, v in by.items()}


def test_streams_are_the_plain_ones(spark):
    rows, df = conversations(spark)
    turns = chat.format_turns(df).cache()
    want = plain_conversations(rows)
    got = {}
    for r in rows_of(chat.read_turns(turns)):
        got.setdefault(r["conv_id"], []).append(r)
    assert got.keys() == want.keys()
    for c, own in got.items():
        own.sort(key=lambda r: r["place"])
        assert [(r["role"], r["text"]) for r in own] == [x[1:] for x in want[c]]
        at, replies = 0, 0
        for k, (r, (_, role, text)) in enumerate(zip(own, want[c], strict=True)):
            before, body, after = plain_piece(role, text)
            assert (r["place"], r["example"], r["piece"], r["start"], r["end"]) == (k, replies, before + body + after, at, at + len(before + body + after))
            masked = (at + len(before), at + len(before + body)) if role == "assistant" else (None, None)
            assert (r["loss_start"], r["loss_end"], r["reply"]) == (*masked, text if role == "assistant" else None)
            at, replies = r["end"], replies + (role == "assistant")
        assert not any(c in plain_escape(x[2]) for x in want[c] for c in chat.CONTROLS)
    # each example is the whole context and one reply
    texts = {(r["conv_id"], r["example"]): r for r in rows_of(chat.example_texts(turns))}
    told = {(r["conv_id"], r["example"]): r for r in rows_of(chat.examples(turns))}
    assert texts.keys() == told.keys()
    for (c, k), r in texts.items():
        stream = "".join(x["piece"] for x in got[c])
        e = told[c, k]
        assert r["text"] == stream[: e["chars"]] and (r["loss_start"], r["loss_end"]) == (e["loss_start"], e["loss_end"])
        replies = [x["reply"] for x in got[c] if x["reply"] is not None]
        if r["loss_start"] is not None:
            assert re.sub(r"(?s)\\(.)", r"\1", r["text"][r["loss_start"] : r["loss_end"]]) == replies[k]
            assert e["context_chars"] + 1 == e["loss_start"]
        else:
            assert k == len(replies)
    # digests, read back
    digests = {r["conv_id"]: r for r in rows_of(chat.digest_conversations(chat.read_turns(turns)))}
    for c, own in want.items():
        replies = "".join(x[2] for x in own if x[1] == "assistant")
        assert digests[c] == {
            "conv_id": c, "n_turns": len(own), "turns_sha256": sha("".join(f"{x[1]}\n{x[2]}\n" for x in own)), "loss_chars": len(replies), "loss_sha256": sha(replies),
            "formatted_chars": sum(e["chars"] for (d, _), e in told.items() if d == c),
        }


def test_no_conversations(spark):
    _, df = conversations(spark)
    none = chat.format_turns(df.filter("false"))
    assert rows_of(none) == [] and rows_of(chat.examples(none)) == [] and rows_of(chat.digest_conversations(chat.read_turns(none))) == []


def test_escapes_are_undone(spark):
    rng = random.Random(8)
    parts = [*chat.CONTROLS, "\\", "<", "[", "s>", "INST]", "/", " ", "é🤦", "\n", "ROLE:"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in rows_of(df):
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


# ---------------------------------------------------------------- Merkle trees
def plain_tree(row):
    """All levels, as the rule says: every two consecutive ones become one while several remain."""
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_proof(levels, i):
    out = []
    for row in levels[:-1]:
        if i ^ 1 < len(row):
            out.append(row[i ^ 1])
        i //= 2
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70), st.sets(st.integers(0, 69), min_size=1))
def test_multiproofs_are_least_and_right(n, asked):
    asked = sorted({i % n for i in asked})
    levels = plain_tree([sha(str(i)) for i in range(n)])
    wanted = merkle.missing(asked, n)
    assert len(set(wanted)) == len(wanted)
    own = [set(asked)]
    for _ in levels[1:]:
        own.append({i >> 1 for i in own[-1]})
    need = {(level, (i >> level) ^ 1) for i in asked for level in range(len(levels) - 1) if (i >> level) ^ 1 < len(levels[level])}
    assert set(wanted) == {(level, i) for level, i in need if i not in own[level]}  # the union, less what the leaves give
    proofs = merkle.derive({i: levels[0][i] for i in asked}, {(level, i): levels[level][i] for level, i in wanted}, n)
    assert proofs == {i: "".join(plain_proof(levels, i)) for i in asked}
    assert {merkle.fold(levels[0][i], i, n, proofs[i], {}) for i in asked} == {levels[-1][0]}
    assert merkle.fold(sha("else"), asked[0], n, proofs[asked[0]], {}) != levels[-1][0]


def plain_manifest(rows):
    """rows: (group, key, leaf). By (group, key, leaf): subroot, root, proof."""
    by = {}
    for g, k, leaf in rows:
        by.setdefault(g, []).append((k is not None, k or 0, leaf))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(by[g])]) for g in groups}
    top = plain_tree([trees[g][-1][0] for g in groups])
    out = {}
    for j, g in enumerate(groups):
        for i, (there, k, leaf) in enumerate(sorted(by[g])):
            out.setdefault((g, k if there else None, leaf), []).append((trees[g][-1][0], top[-1][0], "".join(plain_proof(trees[g], i) + plain_proof(top, j))))
    return out


def test_manifest_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_BITS", 3)  # several blocks and several steps
    rng = random.Random(6)
    rows = [(rng.choice(["en", "en", "en", "de", "ü", "", None]), rng.choice([None, *range(-40, 400)]), sha(str(rng.randrange(300)))) for _ in range(600)]
    rows += [("one", 1, sha("x"))] + [("en", 5, sha("same"))] * 40
    df = spark.createDataFrame([(*r, "t", 4, 4) for r in rows], "lang string, doc_id long, leaf string, tree string, number int, leaves int").repartition(5)
    leaves, nodes = merkle.manifest(df, "leaf", ["doc_id"], "lang")
    leaves = leaves.withColumn("said", F.when(F.col("doc_id") % 7 == 0, F.lit(sha("else"))).otherwise(F.col("leaf")))
    want = plain_manifest(rows)
    at = {(r["tree"], r["number"]): r["lang"] for r in rows_of(leaves)}
    assert len(at) == len(rows)

    def hold(part):
        tell = {}
        for r in rows_of(merkle.prove(part, nodes, "leaf", "said", "doc_id")):
            tell.setdefault((r["key"], r["leaf"]), []).append((r["subroot"], r["root"], r["proof"], r["folded"] == r["root"], r["verified"]))
        count = 0
        for (k, leaf), found in tell.items():
            allowed = [x for (g, key, d), xs in want.items() if key == k and d == leaf for x in xs]
            for f in found:
                assert f[:3] in allowed
                assert f[3] == f[4] == (k is None or k % 7 != 0)
                count += 1
        return tell, count

    whole, count = hold(leaves)
    assert count == len(rows)
    assert sorted(x for xs in want.values() for x in xs) == sorted(f[:3] for xs in whole.values() for f in xs)
    some, count = hold(leaves.filter("number % 5 = 1 and tree <> 1"))  # proofs of some leaves alone
    assert count == sum(i % 5 == 1 and t != 1 for t, i in at)


def test_no_leaves(spark):
    df = spark.createDataFrame([], "lang string, doc_id long, leaf string")
    leaves, nodes = merkle.manifest(df, "leaf", ["doc_id"], "lang")
    assert rows_of(nodes) == [] and rows_of(merkle.prove(leaves, nodes, "leaf", "leaf", "doc_id")) == []


def test_fields_tell_null_from_text(spark):
    rows = [(1, None, "-"), (-12, "é", None), (None, "", "1:-")]
    df = spark.createDataFrame(rows, "a long, b string, c string").select("a", "b", "c", merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("h"))
    for r in rows_of(df):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["a"], r["b"], r["c"])]
        assert r["h"] == sha("".join(parts))


def test_every_reply_is_an_example_spelled_out(spark):
    """The formatted output holds whole prefixes, and what is read back comes from them."""
    said = [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(5)]
    turns = chat.format_turns(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    made = {r["place"]: r["expansion"] for r in turns.collect()}
    pieces = ["".join(plain_piece(r, t)) for _, _, r, t in said]
    assert made == {0: None, 1: "".join(pieces[:2]), 2: None, 3: "".join(pieces[:4]), 4: "".join(pieces)}
    forged = turns.withColumns({"expansion": F.replace("expansion", F.lit("turn 3"), F.lit("turn X")), "piece": F.lit("none")})
    read = {r["place"]: (r["text"], r["reply"], r["formatted"]) for r in chat.read_turns(forged).collect()}
    assert read[3] == ("turn X", "turn X", len(made[3])) and read[4] == ("turn 4", None, len(made[4])) and read[0][0] == "turn 0"
