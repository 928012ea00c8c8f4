"""Registered queries of this subpackage, and the SQL that some are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, centroids, counts, decontaminate, embeddings, jaccard, langid, lines, lm, quality, substring, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), lower=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).drop("ids")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("at")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_lm_scores, op3_toxicity, op4_quality, op5_language, op6_bpe, op7_token_counts, op8_embedding_dedup, op9_decontamination, op10_jaccard_join, op11_centroids, op12_line_dedup, op13_filter_audit)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_REACH = """
reach AS (SELECT a AS id, a AS c FROM (SELECT a FROM link UNION SELECT b FROM link)
  UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.c = link.a),
label AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_NEAREST = "SELECT vec_id, v.e, min_by(k, struct_pack(d := vv + cc - 2 * list_dot_product(v.e, c.e), k := k)) AS k, min(vv + cc - 2 * list_dot_product(v.e, c.e)) AS distance FROM v CROSS JOIN (SELECT k, e, list_dot_product(e, e) AS cc FROM c{r}) c GROUP BY vec_id, v.e"
_ROUND = """a{r} AS ({nearest}),
s{r} AS (SELECT k, i, sum(x::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i),
c{next} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS e FROM s{r} GROUP BY k) m USING (k)),
"""

ORACLES = {
    "op1_substring_dedup": f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
win AS (SELECT doc_id, p, string_agg(word, ' ') OVER x AS k FROM word WINDOW x AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) QUALIFY count(*) OVER x = 20),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS p FROM later),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93),
{_REACH.strip()}
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(component_id, v.vec_id) AS component_id, coalesce(component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) k ON k.a = v.vec_id LEFT JOIN label ON label.id = v.vec_id""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p, len(ws) AS m FROM d),
bw AS (SELECT item_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS q, len(ws) AS n FROM b),
same AS (SELECT doc_id, item_id, p - q AS diagonal, p, m, n FROM dw JOIN bw USING (w)),
few AS (SELECT * FROM same QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= 11),
run AS (SELECT doc_id, item_id, diagonal, p, m, n, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM few),
good AS (SELECT doc_id, item_id, c AS agree FROM run WHERE n >= 13 AND c >= 11 AND least(diagonal + n, m) - greatest(diagonal, 0) >= 13)
SELECT doc_id, item_id, max(agree)::INT AS agree, 13 AS aligned FROM good GROUP BY doc_id, item_id""",
    "op10_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN array_to_string(ws[p:p + 2], ' ') ELSE array_to_string(ws, ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
{_REACH.strip()}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN label ON label.id = w.doc_id""",
    "op11_centroids": f"""
WITH v AS MATERIALIZED (SELECT vec_id, e, list_dot_product(e, e) AS vv FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, e FROM v QUALIFY k < 16),
{"".join(_ROUND.format(r=r, next=r + 1, nearest=_NEAREST.format(r=r)) for r in range(3))}
a3 AS ({_NEAREST.format(r=3)}),
named AS (SELECT k, sha256(array_to_string(list_transform(e, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM c3)
SELECT vec_id, k::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN named USING (k)""",
    "op12_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT k.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM k LEFT JOIN f USING (key) WHERE first IS NULL OR first = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)""",
    "op13_filter_audit": rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
f AS (SELECT part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS m, coalesce(quality = 1, false) AS g, coalesce(toxic = 1, false) AS x
  FROM w LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (g) AS g, count(*) FILTER (x) AS x FROM f GROUP BY part, m),
i AS (SELECT unnest(range(5))::INT AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, step, 1 << o[step] AS own, coalesce(list_sum(list_transform(o[1:step - 1], lambda j: 1 << j)), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (m & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (m & before = 0 AND m & own <> 0), 0) AS removed,
  coalesce(sum(n) FILTER (m & before <> 0 AND m & own <> 0), 0) AS redundant, coalesce(sum(n) FILTER (m = own), 0) AS unique_fails,
  coalesce(sum(g) FILTER (m & before = 0 AND m & own <> 0), 0) AS good_lost, coalesce(sum(x) FILTER (m & before = 0 AND m & own <> 0), 0) AS toxic_lost FROM c, s GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda j: chr(65 + j)), '') AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
}
