"""The numbered queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, media, merkle, mixing, neighbours, pages, periodic, quality, secrets, sharding, simhash, token_counts
from .common import WORD, table, utf8_crc32, whole


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_rows(docs.withColumn("text_crc32", utf8_crc32())).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < len(secrets.BASE_RULES))
    counts = [secrets.count_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_text().alias("spans"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return made.select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_audio(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.read_audio(stored).withColumnRenamed("key", "doc_id")


def op6_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, net, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.extract_text(table(spark, sf_dir, "pages"))
    return made.select(F.col("key").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("key", "doc_id")


def key_crc32() -> Column:
    """Unsigned CRC-32 of the decimal doc_id; null of a null one."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """A tenth of the documents with words, by their doc_id's hash, end in repetitions of a stretch of their own words.
    Documents with a null doc_id stay as they are."""
    n, g = F.col("__n"), F.floor(F.col("__h") / 10)
    a = (g % n).cast("int")
    p = F.floor(1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    words = F.col("__words")
    unit = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    tenth = F.col("__h") % 10 == 0
    found = docs.withColumn("__h", key_crc32()).withColumn("__words", F.when(tenth, F.regexp_extract_all(whole(), F.lit(WORD), F.lit(0))))
    sized = found.withColumn("__n", F.size("__words"))
    return sized.withColumn("text", F.when(tenth & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(F.col("text"))).drop("__h", "__words", "__n")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run is found by exact fractions: exponents are compared by cross products."""
    found = periodic.find_runs(repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a),
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: A conversation that the table of op12 is given besides its own.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.read_turns(chat.format_turns(said.unionByName(more))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_chars = F.col("n_chars")
    digest = lambda n: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    hashed = docs.select("doc_id", "lang", digest(n_chars).alias("leaf"), F.when((key_crc32() % 7 == 0) & n_chars.isNotNull(), digest(n_chars + 1)).alias("__changed"))
    leaves, nodes = merkle.manifest(hashed, "leaf", ["doc_id"], "lang")
    proved = merkle.prove(leaves.withColumn("said", F.coalesce("__changed", "leaf")), nodes, "leaf", "said", "doc_id")
    return proved.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_histogram_shards,
        op2_secret_scan,
        op3_source_mix,
        op4_byte_pairs,
        op5_telephony_audio,
        op6_graph_neighbours,
        op7_simhash,
        op8_quality,
        op9_page_text,
        op10_token_counts,
        op11_periodic_runs,
        op12_chat_format,
        op13_merkle_manifest,
    )
}

# Columns and rules are those of the Spark queries; texts hold no letters that fold outside ASCII.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

_PUBLIC = {
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "github": "gh[opsu]_[A-Za-z0-9]{36,}",
    "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": "AIza[A-Za-z0-9_-]{35,}",
}
_TEXT_SQL = "array_to_string(list_transform({x}, lambda x: ['assign', 'access', 'hex', 'pem', 'jwt', 'github', 'slack', 'google'][x.k + 1] || ':' || x.s || ':' || x.e), ',')"


def _spans_sql(name: str, pattern: str, group: int, least: int, order: int) -> str:
    """Spans of one kind: the lengths of the gaps between matches and of the matches give their places."""
    return f"""
    {name} AS (
      SELECT rid, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
          's': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
          'k': {order},
          'e': list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))),
          'ok': length(d[i]) >= {least} }}), lambda x: x.ok) AS spans
      FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS d,
                   string_split_regex(t, '{pattern}') AS g FROM docs))"""


def _leaf_sql(n_chars: str) -> str:
    """The digest of a document's fields, with n_chars as given."""
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    told = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR END" for f in fields]
    return f"sha256({' || '.join(told)})"


ORACLES = {
    "op2_secret_scan": f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    {_spans_sql("a", _ASSIGN, 2, 8, 0)},
    {_spans_sql("b", "AKIA[A-Z0-9]+", 0, 16, 1)},
    {_spans_sql("c", "[0-9a-f]{32,}", 0, 32, 2)},
    {",".join(_spans_sql(n, p, 0, 1, 3 + i) for i, (n, p) in enumerate(_PUBLIC.items()))},
    whole AS (
      SELECT doc_id, len(a.spans) AS n_assign, len(b.spans) AS n_access, len(c.spans) AS n_hex,
        list_sort(list_transform(flatten([a.spans, b.spans, c.spans, {", ".join(f"{n}.spans" for n in _PUBLIC)}]), lambda x: {{'s': x.s::BIGINT, 'k': x.k::BIGINT, 'e': x.e::BIGINT}})) AS spans
      FROM docs JOIN a USING (rid) JOIN b USING (rid) JOIN c USING (rid) {" ".join(f"JOIN {n} USING (rid)" for n in _PUBLIC)}),
    texts AS (SELECT *, {_TEXT_SQL.format(x="list_filter(spans, lambda x: x.k < 3)")} AS base, {_TEXT_SQL.format(x="spans")} AS every FROM whole)
    SELECT doc_id, n_assign::BIGINT AS n_assign, n_access::BIGINT AS n_access, n_hex::BIGINT AS n_hex, sha256(base) AS base_sha256, every AS spans FROM texts""",
    "op3_source_mix": r"""
    WITH docs AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS place
      FROM documents),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
    weighed AS (
      SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight, source_size * 3 AS bound FROM sizes),
    levels AS (
      SELECT *, (SELECT sum(source_size) FROM sizes)::DOUBLE AS total, (SELECT sum(weight) FROM weighed)::DOUBLE AS weights,
        coalesce(sum(bound) OVER w, 0)::DOUBLE AS bound_before, coalesce(sum(weight) OVER w, 0)::DOUBLE AS weight_before
      FROM weighed WINDOW w AS (ORDER BY bound::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (
      SELECT coalesce((total - bound_before) / (weights - weight_before), 0) AS level FROM levels
      WHERE bound::DOUBLE / weight::DOUBLE >= (total - bound_before) / (weights - weight_before)
      ORDER BY bound::DOUBLE / weight::DOUBLE, source NULLS LAST LIMIT 1),
    plan AS (
      SELECT *, greatest(0.0, target - epochs * source_size) AS budget FROM (
        SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM (
          SELECT source, source_size, least(weight * level, bound::DOUBLE) AS target FROM weighed, level))),
    runs AS (
      SELECT doc_id, size, source_size, target, epochs, budget,
        sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto, sum(size) OVER (PARTITION BY d.source, place) AS own
      FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, size, source_size, target,
      (size * (epochs + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM runs""",
    "op12_chat_format": r"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (
      SELECT *, role = 'assistant' AS reply,
        length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'),
          '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[ROLE:', '[\ROLE:'), '[/ROLE]', '[\/ROLE]'))
        + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 19 WHEN 'assistant' THEN 6 ELSE 16 + length(role) END AS chars
      FROM said),
    placed AS (
      SELECT *, sum(chars) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC) = 1 AS final
      FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (reply), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (reply), '')) AS loss_sha256,
      coalesce(sum(upto) FILTER (reply OR final), 0)::BIGINT AS formatted_chars
    FROM placed GROUP BY conv_id""",
    "op13_merkle_manifest": f"""
    WITH RECURSIVE crc AS (
      SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) x(n)),
    docs AS (
      SELECT row_number() OVER () AS rid, *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
          lambda c, b: xor(list_extract(t, (xor(c, b) & 255) + 1), c >> 8)), 4294967295) AS h
      FROM documents, crc),
    leaves AS (
      SELECT rid, doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN h % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql("n_chars + 1")} END AS changed FROM docs),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
    nodes AS (
      SELECT lang, 0 AS level, i, leaf AS d, n FROM numbered
      UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
    subroots AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM nodes WHERE n = 1),
    tops AS (
      SELECT 0 AS level, j AS i, d, m AS n FROM subroots
      UNION ALL SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, i // 2),
    sides AS (
      SELECT x.rid, k.level, coalesce(s.d, '') AS d, k.i % 2 AS odd FROM numbered x JOIN nodes k ON x.lang IS NOT DISTINCT FROM k.lang AND x.i >> k.level = k.i AND k.n > 1
        LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM k.lang AND s.level = k.level AND s.i = xor(k.i, 1::BIGINT)
      UNION ALL
      SELECT x.rid, 1000 + k.level, coalesce(s.d, ''), k.i % 2 FROM numbered x JOIN subroots r ON x.lang IS NOT DISTINCT FROM r.lang JOIN tops k ON r.j >> k.level = k.i AND k.n > 1
        LEFT JOIN tops s ON s.level = k.level AND s.i = xor(k.i, 1::BIGINT)),
    proofs AS (SELECT rid, list({{'d': d, 'odd': odd}} ORDER BY level) AS way, string_agg(d, '' ORDER BY level) AS joined FROM sides GROUP BY rid),
    folds AS (
      SELECT x.rid, coalesce(x.changed, x.leaf) AS d, coalesce(p.way, []) AS way, 0 AS k FROM numbered x LEFT JOIN proofs p USING (rid)
      UNION ALL SELECT rid, CASE WHEN way[k + 1].odd = 1 THEN sha256(way[k + 1].d || d) ELSE sha256(d || way[k + 1].d) END, way, k + 1 FROM folds WHERE k < len(way))
    SELECT x.doc_id, x.leaf, r.d AS subroot, top.d AS root, sha256(coalesce(p.joined, '')) AS proof_sha256, f.d AS folded_root, f.d = top.d AS verified
    FROM numbered x JOIN subroots r ON x.lang IS NOT DISTINCT FROM r.lang JOIN folds f ON f.rid = x.rid AND f.k = len(f.way) LEFT JOIN proofs p ON p.rid = x.rid,
      (SELECT d FROM tops WHERE n = 1) top""",
}
