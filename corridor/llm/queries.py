"""The queries of this subpackage, each over the whole of its tables, and SQL for what SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm import bpe, chatformat, decontam, langid, mixing, periodic, quality, rules, secrets, sharding, simhash, toxicity, trie
from corridor.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).withColumn("shards", F.array_join(F.col("shards").cast("array<string>"), ","))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.preference_pairs(chatformat.paired(table(spark, sf_dir, "conversations")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), periodic.repeat_some)
    first = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
        lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    out = found.withColumn("_best", first).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.*", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.withColumn("exponent_milli", F.floor(1000 * F.col("length") / F.col("period")).cast("long"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rules.base_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.base_failed().alias("base_failed"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1_mixing: all but the words that the permutation takes."""
    return op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6_secrets: how many base spans of each kind."""
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_decontamination, op3_simhash, op4_quality, op5_toxicity, op6_secrets, op7_language, op8_sharding, op9_rules, op10_preferences, op11_prefix_trie, op12_periodic_runs, op13_bpe, rule_statistics, mix_targets, secret_counts)
}

_TABLE = ",".join(map(str, sharding.lookup_table()))

#: crc32 of the decimal ids of ``{of}``: the table of the reversed polynomial, then byte by byte.
_CRC = """
crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
              FROM (SELECT unnest(range(256)) AS i) z),
crc AS (SELECT id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM ({of}) z, crc_table)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": f"""
WITH {_CRC.format(of="SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL")},
own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS v
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
seq AS (SELECT a.c, list_concat(coalesce(b.v[1:h % 6], []), a.v[h % 6 + 1:]) AS s FROM own a JOIN crc ON id = a.c LEFT JOIN own b ON b.c = a.c - a.c % 100),
pre AS (SELECT c, d, md5(CAST(s[1:d] AS VARCHAR)) AS p, md5(CAST(s[1:d - 1] AS VARCHAR)) AS up, len(s) AS n, coalesce(length(s[d].text), 0) AS chars,
               list_transform(range(d + 1), lambda k: md5(CAST(s[1:k] AS VARCHAR))) AS above FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM seq) z),
node AS (SELECT d, p, any_value(up) AS up, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY d, up),
below AS (SELECT k AS d, q AS p, sum((n_convs - 1) * chars) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
          FROM (SELECT n_convs, chars, n_children, unnest(range(d + 1)) AS k, unnest(above) AS q FROM node LEFT JOIN kids USING (d, p)) z GROUP BY k, q)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below USING (d, p) LEFT JOIN kids USING (d, p) LEFT JOIN node u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.up
""",
    "op12_periodic_runs": rf"""
WITH {_CRC.format(of="SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL")},
raw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM raw LEFT JOIN crc ON id = doc_id),
docs AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM place),
win AS (SELECT r, n, i, md5(array_to_string(w[i - 14:i + 1], ' ')) AS m FROM (SELECT r, n, w, unnest(range(15, n)) AS i FROM docs WHERE n >= 24) z),
cell AS (SELECT x.r, x.i, x.i - y.i AS p FROM win x JOIN win y ON x.r = y.r AND x.m = y.m AND x.i > y.i AND 3 * (x.i - y.i) <= x.n),
part AS (SELECT r, p, min(i) - 15 - p AS s, max(i) AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM cell) z GROUP BY r, p, k),
run AS (SELECT r, s, e - s + 1 AS l, min(p) AS p FROM part WHERE e - s + 1 >= greatest(24, 3 * p) GROUP BY r, s, e),
best AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines, first({{'s': s, 'l': l, 'p': p}} ORDER BY l / p DESC, s, p) AS b FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM docs WHERE r IN (SELECT r FROM run)) z ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, CAST(1000 * b.l // b.p AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, array_to_string(w, ' '))) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
""",
    "op8_sharding": f"""
WITH placed AS (
  SELECT doc_id, coalesce(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT % {sharding.SLOTS} AS INTEGER), 0) AS slot FROM documents)
SELECT doc_id, slot, CAST(list_extract([{_TABLE}], slot + 1) AS INTEGER) AS shard FROM placed
""",
    "op10_preferences": r"""
WITH clean AS (
  SELECT DISTINCT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role, text) AS k FROM clean),
sizes AS (SELECT pair_id, max(k) FILTER (chosen) AS nc, max(k) FILTER (NOT chosen) AS nr FROM numbered GROUP BY pair_id
          HAVING count(*) FILTER (chosen) > 0 AND count(*) FILTER (NOT chosen) > 0),
same AS (
  SELECT s.pair_id, coalesce(min(a.k) FILTER (b.k IS NULL OR a.role <> b.role OR a.text <> b.text) - 1, min(nc)) AS n_prefix
  FROM sizes s JOIN numbered a ON a.pair_id = s.pair_id AND a.chosen LEFT JOIN numbered b ON b.pair_id = a.pair_id AND NOT b.chosen AND b.k = a.k
  GROUP BY s.pair_id),
said AS (
  SELECT n.*, e.n_prefix, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r, length(role) + 5 AS lead,
         length(role) + length(text) + 13 AS size FROM numbered n JOIN same e USING (pair_id)),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY pair_id, chosen, k > n_prefix ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM said),
spans AS (SELECT *, CAST(before + lead AS BIGINT) || ':' || CAST(before + lead + length(text) AS BIGINT) AS span FROM placed)
SELECT pair_id, CAST(min(n_prefix) AS INTEGER) AS n_prefix,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (chosen AND k <= n_prefix), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (chosen AND k > n_prefix), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (NOT chosen AND k > n_prefix), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY k) FILTER (chosen AND k > n_prefix AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(span, ',' ORDER BY k) FILTER (NOT chosen AND k > n_prefix AND role = 'assistant'), '') AS rejected_spans
FROM spans GROUP BY pair_id
""",
    "mix_targets": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 1.5 * sum(n) OVER () AS total FROM s),
o AS (SELECT *, 2.0 * n / w AS most, row_number() OVER (ORDER BY 2.0 * n / w, source) AS k FROM w),
u AS (SELECT *, (total - (sum(2.0 * n) OVER r - 2.0 * n)) / (sum(w) OVER () - (sum(w) OVER r - w)) AS unit FROM o WINDOW r AS (ORDER BY k)),
one AS (SELECT arg_min(unit, k) FILTER (unit <= most) AS unit FROM u)
SELECT doc_id, size, n AS source_size, round(coalesce(least(w * one.unit, 2.0 * n), 2.0 * n), 4) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, one
""",
    "secret_counts": r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM documents
""",
    "rule_statistics": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  row_number() OVER () AS row_id FROM documents),
win AS (SELECT row_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) z),
twice AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, g) AS n FROM win) z WHERE n > 1),
reps AS (SELECT row_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) o GROUP BY row_id),
stats AS (
  SELECT row_id, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed FROM stats LEFT JOIN reps USING (row_id)
""",
}
