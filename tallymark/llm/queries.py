"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import block_labeller, bm25_wand, circulant_minhash, decode_scan, entropy_mix, kd_shards, link_trust, negative_mining, period_runs, robust_outliers, rule_ensemble, suffix_runs, tool_links
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=0.85)


@query
def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents"))


@query
def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    score = rule_ensemble.scored(docs.select("doc_id", "text"), model)
    return score.select("doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= rule_ensemble.CUTOFF).cast("int").alias("predicted"))


@query
def op8_decode_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode_scan.find_secrets(table(spark, sf_dir, "documents"))

    def listed(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in decode_scan.KINDS],
                        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
                        F.col("layers").alias("n_layers"), F.col("skipped").alias("n_skipped"))


@query
def op4_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = bm25_wand.split_text(table(spark, sf_dir, "benchmark"))
    found = bm25_wand.search(table(spark, sf_dir, "documents").select("doc_id", "text"), items)
    return found.select("doc_id", F.col("leaks.passages").alias("n_passages"), F.col("leaks.retrieved").alias("n_retrieved"),
                        F.col("leaks.best").alias("best_score"), F.col("leaks.items").alias("item_ids"),
                        (F.size("leaks.items") > 0).alias("contaminated"))


@query
def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.judge(table(spark, sf_dir, "documents"))


URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block"))


@query
def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    return link_trust.judge(table(spark, sf_dir, "pages"), rules)


@query
def op9_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = block_labeller.extract(pages, block_labeller.train(pages))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op10_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_links.chat_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(list(tool_links.CHAT_SCHEMAS), "name string, field string, type string, required boolean")
    found = tool_links.link(calls, results, schemas)
    return found.withColumn("errors", F.array_join("errors", ","))


SQL["op10_tool_links"] = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, min(struct_pack(r := role, t := text)) AS m FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), t AS (SELECT conv_id, turn, m.r AS role, m.t AS text FROM m),
c AS (SELECT * FROM t WHERE role IN ('system', 'user')),
d AS (
  SELECT c.*, CASE WHEN p.turn IS NOT NULL THEN p.turn WHEN a.turn IS NOT NULL THEN q.turn END AS needs, a2.turn IS NOT NULL AS has_result, a2.text AS result
  FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
  LEFT JOIN t a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 AND a.role = 'assistant'
  LEFT JOIN c q ON q.conv_id = c.conv_id AND q.turn = c.turn - 2
  LEFT JOIN t a2 ON a2.conv_id = c.conv_id AND a2.turn = c.turn + 1 AND a2.role = 'assistant'
), l AS (
  SELECT conv_id, turn, 0 AS level FROM d WHERE needs IS NULL
  UNION ALL SELECT d.conv_id, d.turn, l.level + 1 FROM d JOIN l ON l.conv_id = d.conv_id AND l.turn = d.needs
), e AS (
  SELECT d.*, l.level, 'call-' || d.conv_id || '-' || d.turn AS call_id, CASE role WHEN 'system' THEN 'configure' ELSE 'answer' END AS name,
         concat_ws(',', CASE WHEN text IS NULL THEN 'missing:text' END, CASE WHEN NOT has_result THEN 'no result' END) AS errors
  FROM d JOIN l USING (conv_id, turn)
)
SELECT conv_id, call_id, turn::BIGINT AS position, name, level, has_result, errors = '' AS valid, errors,
       '{"arguments":{"role":' || to_json(role) || CASE WHEN text IS NULL THEN '' ELSE ',"text":' || to_json(text) END || ',"turn":' || turn || '},"id":"'
       || call_id || '","level":' || level || ',"name":"' || name || '","result":' || CASE WHEN has_result THEN to_json(coalesce(result, '')) ELSE 'null' END || '}' AS json
FROM e
"""


@query
def op5_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_runs.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = period_runs.repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = period_runs.find_runs(docs).select("doc_id", "runs.*")
    best = F.array_min(F.transform("found", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("found", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumns({"best": best, "listed": listed})
    return rows.select("doc_id", F.size("found").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
                       F.col("best.period").alias("period"), F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
                       F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
                       "n_words")


@query
def op12_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negative_mining.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


SQL["op12_negative_mining"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(table(spark, sf_dir, "documents"), shards=40)


# The columns of the operators above that their contracts fix to the last value, with SQL.

WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


@query
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_link_trust(spark, sf_dir).select("page_id", "host", "path", "rule")


SQL["page_rules"] = f"""
WITH r(rule) AS (VALUES {", ".join(f"('{rule}')" for rule, _ in URL_RULES)}),
parts AS (SELECT rule, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM r),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM a),
p AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, (SELECT max_by(rule, length(rule)) FROM parts
       WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule FROM p
"""


@query
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = robust_outliers.base_statistics(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


SQL["text_statistics"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT k, unnest([{{'i': i, 'v': array_to_string(w[i:i + 7], ' ')}} FOR i IN range(1, len(w) - 6)]) AS x FROM d WHERE len(w) >= 8),
s AS (SELECT k, x.i AS i, count(*) OVER (PARTITION BY k, x.v) AS c FROM g),
n AS (SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS own FROM s WHERE c > 1),
m AS (SELECT k, sum(own)::BIGINT AS n_repeat_words FROM n GROUP BY k),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{WORD}')] AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN m USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
"""


@query
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_circulant_minhash(spark, sf_dir).select("doc_id", "n_shingles")


SQL["shingle_counts"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) < 3 THEN least(len(w), 1)
       ELSE len(list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])) END::BIGINT AS n_shingles FROM d
"""


@query
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_entropy_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


SQL["mix_targets"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), f AS (
  -- Sources are filled to twice their size until what is left, dealt by weight, fits under the rest.
  SELECT 0 AS round, source, source_size, weight, false AS full_up FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, full_up OR weight * spare / open_weight > 2 * source_size FROM (
    SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (full_up) OVER (), 0) AS spare,
           sum(weight) FILTER (NOT full_up) OVER () AS open_weight FROM f
  ) WHERE round <= (SELECT count(*) FROM s)
), l AS (SELECT * FROM f WHERE round = (SELECT max(round) FROM f)),
t AS (
  SELECT source, source_size, CASE WHEN full_up THEN 2.0 * source_size ELSE weight *
         (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (full_up) OVER (), 0)) / sum(weight) FILTER (NOT full_up) OVER () END AS target
  FROM l
)
SELECT doc_id, size, source_size, round(target::DOUBLE, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


@query
def plain_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decode_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SQL["plain_secrets"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len([x FOR x IN regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) IF length(x) >= 6])::BIGINT AS n_assign,
  len([x FOR x IN regexp_extract_all(t, 'AKIA[A-Z0-9]+') IF length(x) >= 20])::BIGINT AS n_access,
  len([x FOR x IN regexp_extract_all(t, '[0-9a-f]+') IF length(x) >= 24])::BIGINT AS n_hex FROM d
"""
