"""The subpackage's registered queries, thin over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinleaf.llm import decontamination, jaccard_join, kmeans_tree, lm_scoring, packing, pii, secrets, sharding, suffix_dedup, toxicity
from twinleaf.llm.common import read

SHARDS = 24


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read(spark, sf_dir, "labels").filter("quality = 1")
    out = lm_scoring.cross_entropy_difference(read(spark, sf_dir, "documents"), target)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_label_propagation(read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return kmeans_tree.nearest(vectors, vectors.filter("vec_id % 50 = 0"))[0]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict:
    return {
        "op1_cross_entropy_difference": op1,
        "op2_balanced_label_propagation": op2,
        "op3_kmeans_tree_search": op3,
        "op4_suffix_dedup": op4,
        "op5_pii_candidate_boosting": op5,
        "op6_spaced_seed_decontamination": op6,
        "op7_secret_automaton": op7,
        "op8_signature_tree_join": op8,
        "op9_toxicity_cnn": op9,
        "op10_power_of_two_packing": op10,
    }


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM documents),
tok AS (SELECT doc_id, unnest(w) AS b, unnest(list_concat(['\x01'], w[1:len(w) - 1])) AS a FROM words WHERE len(w) > 0),
tgt AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
t AS (SELECT tok.*, (tgt.doc_id IS NOT NULL)::INT AS g FROM tok LEFT JOIN tgt USING (doc_id)),
tot AS (SELECT count(*) AS n0, sum(g) AS n1 FROM t),
uni AS (SELECT b AS w, count(*) AS c0, sum(g) AS c1 FROM t GROUP BY b
        UNION ALL SELECT '\x01', count(*), sum(g) FROM t WHERE a = '\x01'),
bi AS (SELECT a, b, count(*) AS c0, sum(g) AS c1 FROM t GROUP BY a, b),
l AS (SELECT bi.a, bi.b,
        -ln((bi.c0 + 5 * (w.c0 + 1000 * w.c0 / n0) / (n0 + 1000)) / (v.c0 + 5)) AS l0,
        -ln((bi.c1 + 5 * (w.c1 + 1000 * w.c0 / n0) / (n1 + 1000)) / (v.c1 + 5)) AS l1
      FROM bi JOIN uni w ON w.w = bi.b JOIN uni v ON v.w = bi.a, tot),
s AS (SELECT doc_id, count(*) AS n, avg(l1) AS x1, avg(l0) AS x0 FROM t JOIN l USING (a, b) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(x1, 6) AS loss_target, round(x0, 6) AS loss_background, round(x1 - x0, 6) AS score
FROM documents d LEFT JOIN s USING (doc_id)
"""


OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE m < doc_id),
o AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM g),
k AS (SELECT doc_id, i, sum((e IS NULL OR i > e)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM r),
s AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""

# Any equal run of four tokens starts an alignment: two substitutions in 13 tokens leave one.
OP6_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM benchmark),
a AS (SELECT doc_id, unnest(range(1, len(t) - 2)) AS k, t FROM t WHERE len(t) > 3),
b AS (SELECT item_id, unnest(range(1, len(t) - 2)) AS k, t FROM i WHERE len(t) > 12),
four AS (SELECT DISTINCT doc_id, item_id, a.k - b.k AS lag FROM (SELECT doc_id, k, t[k:k + 3] AS s FROM a) a JOIN (SELECT item_id, k, t[k:k + 3] AS s FROM b) b USING (s)),
one AS (SELECT DISTINCT doc_id, item_id, a.k - b.k AS lag FROM (SELECT doc_id, unnest(t) AS s, unnest(range(1, len(t) + 1)) AS k FROM t) a JOIN (SELECT item_id, unnest(t) AS s, unnest(range(1, len(t) + 1)) AS k FROM i WHERE len(t) < 13) b USING (s)),
al AS (SELECT doc_id, item_id, lag, least(len(i.t), 13) AS width, list_transform(range(1, len(i.t) + 1), lambda k: coalesce(list_extract(i.t, k) = CASE WHEN k + lag > 0 THEN list_extract(t.t, k + lag) END, false)::INT) AS same
  FROM (SELECT * FROM four UNION ALL SELECT * FROM one) x JOIN t USING (doc_id) JOIN i USING (item_id)),
m AS (SELECT doc_id, item_id, width, list_max(list_transform(range(1, len(same) - width + 2), lambda k: list_sum(same[k:k + width - 1])))::BIGINT AS matched FROM al)
SELECT doc_id, item_id, max(matched) AS matched, max(width) AS width FROM m WHERE matched * 100 >= width * 80 GROUP BY ALL
"""

OP7_SQL = r"""
WITH rules(kind, nr, least, pattern) AS (VALUES
  ('assign', 0, 12, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), ('access', 1, 18, 'AKIA[A-Z0-9]+'), ('hex', 2, 16, '[0-9a-f]+'),
  ('github', 3, 40, 'gh[pousr]_[A-Za-z0-9]+'), ('slack', 4, 15, 'xox[abprs]-[A-Za-z0-9-]+'), ('jwt', 5, 40, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+'), ('pem', 6, 0, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----')),
t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, kind, nr, least, regexp_split_to_array(t, pattern) AS gaps, regexp_extract_all(t, pattern, 0) AS found, CASE WHEN kind = 'assign' THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern, 0) END AS value FROM t, rules),
m AS (SELECT doc_id, kind, nr, least, unnest(found) AS x, unnest(value) AS v, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS j FROM f),
p AS (SELECT *, sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, kind ORDER BY j) AS e FROM m),
s AS (SELECT doc_id, kind, nr, e - length(x) AS b, kind || ':' || (e - length(x)) || ':' || e AS span FROM p WHERE length(v) >= least),
g AS (SELECT doc_id, count(*) FILTER (WHERE nr = 0) AS n0, count(*) FILTER (WHERE nr = 1) AS n1, count(*) FILTER (WHERE nr = 2) AS n2, string_agg(span, ',' ORDER BY b, nr) FILTER (WHERE nr < 3) AS base, string_agg(span, ',' ORDER BY b, nr) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(seen) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_cross_entropy_difference": OP1_SQL,
        "op4_suffix_dedup": OP4_SQL,
        "op6_spaced_seed_decontamination": OP6_SQL,
        "op7_secret_automaton": OP7_SQL,
        "op8_signature_tree_join": OP8_SQL,
    }
