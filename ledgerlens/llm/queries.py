"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fingerprint, knn, language_id, line_dedup, mixing, packing, ppm, secrets, shingle_join, spelling, url_rules, vectors


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(k: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(k))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = language_id.fit(docs, F.coalesce(_fold(3), F.lit(0)) != 1)
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "explained", "accepted")


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(_docs(spark, sf_dir))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(_docs(spark, sf_dir))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_docs(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(_docs(spark, sf_dir), _fold(7) != 2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(_docs(spark, sf_dir).select("doc_id", "text"), min_words=1)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


#: fixed values: the rules that the query judges by (host, path, verdict)
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_shingle_join, op3_order_minhash, op4_vectors, op5_best_fit_packing, op6_secrets, op7_mixing, op8_ppm, op9_line_dedup, op10_url_rules, op11_top_k, op12_spelling, op13_divergence)
    return {f.__name__: f for f in found}


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_URL_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
rest AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS r
  FROM pages),
cut AS (
  SELECT page_id, regexp_replace(r, '[?#](.|\\n)*$', '') AS r FROM rest),
parts AS (
  SELECT page_id,
    translate(CASE WHEN instr(r, '/') > 0 THEN substr(r, 1, instr(r, '/') - 1) ELSE r END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(r, '/') > 0 THEN substr(r, instr(r, '/')) ELSE '' END AS path
  FROM cut),
fit AS (
  SELECT p.*, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC) AS k
  FROM parts p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""

_WORDS_SQL = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)"

# The level that uncapped sources share falls into place once the sources are
# sorted by cap / weight: the first k of them are capped.
_MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, {_WORDS_SQL}::BIGINT AS size, substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 3) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    3 * source_size AS cap FROM s),
o AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caps,
    sum(weight) OVER (ORDER BY cap / weight DESC, source DESC) AS left_weight, sum(source_size) OVER () AS total FROM w),
l AS (
  SELECT (total - coalesce(caps, 0))::DOUBLE AS rest, left_weight::DOUBLE AS wt FROM o
  WHERE cap::DOUBLE * left_weight >= weight * (total - coalesce(caps, 0)) ORDER BY cap / weight, source LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN cap * wt < weight * rest THEN cap::DOUBLE ELSE weight::DOUBLE * rest / wt END AS target
  FROM o, l),
e AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole FROM t),
h AS (
  SELECT g.source, draw, size, more AS gap, false AS taken
  FROM (SELECT source, draw, sum(size)::BIGINT AS size FROM d GROUP BY source, draw) g
  JOIN (SELECT source, target - whole * source_size AS more FROM e) m ON g.source IS NOT DISTINCT FROM m.source WHERE more > 0),
u0 AS (
  SELECT *, NOT taken AND size <= gap AND sum(CASE WHEN NOT taken AND size <= gap THEN size END)
    OVER (PARTITION BY source ORDER BY draw) <= gap AS take FROM h),
r0 AS (
  SELECT source, draw, size, taken OR coalesce(take, false) AS taken,
    gap - coalesce(sum(CASE WHEN take THEN size END) OVER (PARTITION BY source), 0) AS gap FROM u0),
u1 AS (
  SELECT *, NOT taken AND size <= gap AND sum(CASE WHEN NOT taken AND size <= gap THEN size END)
    OVER (PARTITION BY source ORDER BY draw) <= gap AS take FROM r0),
r1 AS (
  SELECT source, draw, size, taken OR coalesce(take, false) AS taken,
    gap - coalesce(sum(CASE WHEN take THEN size END) OVER (PARTITION BY source), 0) AS gap FROM u1),
u2 AS (
  SELECT *, NOT taken AND size <= gap AND sum(CASE WHEN NOT taken AND size <= gap THEN size END)
    OVER (PARTITION BY source ORDER BY draw) <= gap AS take FROM r1),
r2 AS (
  SELECT source, draw, size, taken OR coalesce(take, false) AS taken,
    gap - coalesce(sum(CASE WHEN take THEN size END) OVER (PARTITION BY source), 0) AS gap FROM u2),
u3 AS (
  SELECT *, NOT taken AND size <= gap AND sum(CASE WHEN NOT taken AND size <= gap THEN size END)
    OVER (PARTITION BY source ORDER BY draw) <= gap AS take FROM r2),
r3 AS (
  SELECT source, draw, size, taken OR coalesce(take, false) AS taken,
    gap - coalesce(sum(CASE WHEN take THEN size END) OVER (PARTITION BY source), 0) AS gap FROM u3),
c AS (SELECT source, draw FROM r3 WHERE taken)
SELECT d.doc_id, d.size, e.source_size, e.target,
  ((e.whole + CASE WHEN c.draw IS NOT NULL THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.draw = c.draw
"""


_LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, place, string_split(trim(regexp_replace(lower(line), '[\x09-\x0D\x20]+', ' ', 'g'), ' '), ' ') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)
  WHERE regexp_matches(line, '[^\x09-\x0D\x20]')),
class AS (
  SELECT doc_id, place, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM line),
named AS (
  SELECT s, len(s) AS n, row_number() OVER (ORDER BY min({'d': doc_id, 'p': place})) AS id, min({'d': doc_id, 'p': place}) AS first FROM class GROUP BY s),
token AS (SELECT id, n, unnest(s) AS t FROM named WHERE n >= 4),
pair AS (
  SELECT a.id, a.n AS an, b.n AS bn, count(*) AS shared FROM token a JOIN token b
  ON a.t = b.t AND a.id > b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.id, b.id, a.n, b.n),
late AS (SELECT DISTINCT id FROM pair WHERE 100 * shared >= 80 * (an + bn - shared)),
gone AS (
  SELECT doc_id, list(place) AS places FROM class JOIN named USING (s)
  WHERE id IN (SELECT id FROM late) OR (doc_id, place) <> (first.d, first.p) GROUP BY doc_id),
kept AS (
  SELECT doc_id, text, places, CASE WHEN places IS NULL THEN text
    ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(places, i - 1)), chr(10)) END AS kept
  FROM documents LEFT JOIN gone USING (doc_id))
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END::INT AS n_lines,
  coalesce(len(places), 0)::INT AS n_removed, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256
FROM kept
"""


_TOP_K_SQL = r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.uid, q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.uid <> d.uid AND len(q.v) = len(d.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""

# Words meet where one letter is left out: at the same place (exchanged), or of one of them.  The
# checksum is made byte by byte from a table by its rule, as there is no function for it.
_SPELLING_SQL = r"""
WITH RECURSIVE step AS (
  SELECT b, b::BIGINT AS v, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM step WHERE k < 8),
tbl AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
run AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
byte AS (
  SELECT *, list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))) AS bytes FROM run),
sum AS (
  SELECT run, n, xor(list_reduce(list_transform(bytes, lambda b: b::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM byte, tbl),
word AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM sum),
w AS (SELECT word, sum(n)::BIGINT AS n FROM word WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w)),
pair AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM pair GROUP BY word),
form AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form FROM form
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN form f ON c.form = f.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM form f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""

# Every pair of sources meets on every term; the operator adds what absent terms have in common only once.
_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
occ AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0)::HUGEINT AS n
  FROM grp g JOIN kept k USING (lang) LEFT JOIN occ o USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM cell JOIN size USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q
  FROM cell JOIN size USING (lang) GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": _MIX_SQL, "op9_line_dedup": _LINES_SQL, "op10_url_rules": _URL_SQL, "op11_top_k": _TOP_K_SQL, "op12_spelling": _SPELLING_SQL, "op13_divergence": _DIVERGENCE_SQL}
