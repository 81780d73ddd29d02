"""Queries that go through files: readers, writers, caches and settings, each written and read again, with their DuckDB statements."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from twinleaf.functions import lexical
from twinleaf.operators import factors, metrics, models
from twinleaf.operators.durable import fresh_path
from twinleaf.plans.sql import GRAMS2, PAIRS, SCORED, TOK, VECS, features
from twinleaf.sources import config, files
from twinleaf.sources import fixtures as fx

REGISTERED: dict = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def keep(f):
        REGISTERED[name] = f
        if statement:
            STATEMENTS[name] = statement
        return f

    return keep


def _six(df):
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in df.dtypes])


@query("s2_pair_files", f"WITH {PAIRS} SELECT 'train' AS part, id, CASE WHEN length(question1) > 50 THEN question1 ELSE 'nan' END AS question1, question2, is_duplicate FROM pairs UNION ALL SELECT 'test', id, question1, question2, NULL FROM pairs")
def _(spark, sf_dir):
    """Train and test pairs through quoted CSV, nulls filled."""
    p = fx.pairs(spark, sf_dir)
    train, test = fresh_path(spark), fresh_path(spark)
    fx.write_pairs_csv(p.withColumn("question1", F.when(F.length("question1") > 50, F.col("question1"))), train)
    fx.write_pairs_csv(p.select(F.col("id").alias("test_id"), "question1", "question2"), test)
    one = fx.read_pairs_csv(spark, train, "id LONG, qid1 LONG, qid2 LONG, question1 STRING, question2 STRING, is_duplicate INT")
    two = fx.read_pairs_csv(spark, test, fx.TEST_SCHEMA)
    cols = ["part", "id", "question1", "question2", "is_duplicate"]
    one = one.withColumn("part", F.lit("train"))
    two = two.select(F.lit("test").alias("part"), F.col("test_id").alias("id"), "question1", "question2", F.lit(None).cast("int").alias("is_duplicate"))
    return one.select(cols).unionByName(two)


def _groups(spark, sf_dir) -> str:
    f, t = lexical.features(), fx.tokenized(spark, sf_dir)
    folder = fresh_path(spark)
    files.write_group(t.select("id", f["b2_jaccard"].alias("jaccard"), f["b6_wc_diff"].cast("long").alias("diff")), folder, "words")
    files.write_group(t.filter("id % 3 > 0").select("id", f["b4_total_unique_words"].cast("long").alias("union")), folder, "sets")
    return folder


_WORDS = f"round({features()['b2_jaccard'].removeprefix('round(').removesuffix(', 6)::DOUBLE')}, 6)::DOUBLE"
_UNION, _DIFF = features()["b4_total_unique_words"], features()["b6_wc_diff"]


@query("s3_feature_groups", f"WITH {TOK} SELECT id, {_WORDS} AS words_jaccard, ({_DIFF})::BIGINT AS words_diff, CASE WHEN id % 3 > 0 THEN ({_UNION})::BIGINT END AS sets_union FROM tok")
def _(spark, sf_dir):
    return _six(files.read_groups(spark, _groups(spark, sf_dir), {"words": ["jaccard", "diff"], "sets": ["union"]}))


@query("p11_enabled_groups", f"WITH {TOK} SELECT id, ({_UNION})::BIGINT AS sets_union FROM tok WHERE id % 3 > 0")
def _(spark, sf_dir):
    return files.read_groups(spark, _groups(spark, sf_dir), {"words": ["jaccard", "diff"], "sets": ["union"]}, enabled=("sets",))


@query("s4_kcore_file", f"WITH {PAIRS}, k AS (SELECT lower(question1) AS q, arg_max(id % 7, id) AS k FROM pairs GROUP BY 1) SELECT id, coalesce(a.k, 0)::BIGINT AS kcores1, coalesce(b.k, 0)::BIGINT AS kcores2 FROM pairs LEFT JOIN k a ON a.q = lower(question1) LEFT JOIN k b ON b.q = lower(question2)")
def _(spark, sf_dir):
    """Core numbers from a CSV whose last line of a question counts."""
    p, path = fx.pairs(spark, sf_dir), fresh_path(spark)
    p.select("id", F.lower("question1").alias("question"), (F.col("id") % 7).alias("kcores")).repartitionByRange(4, "id").sortWithinPartitions("id").select("question", "kcores").write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cores = files.read_kcores(spark, path)
    return files.with_kcores(p, cores).select("id", "kcores1", "kcores2")


@query("s5_text_vectors", "SELECT 'w' || vec_id AS word, len(embedding)::INT AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS turned FROM embeddings")
def _(spark, sf_dir):
    e, path = fx.table(spark, sf_dir, "embeddings"), fresh_path(spark)
    e.select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id")), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "))).write.text(path)
    v = files.read_word_vectors(spark, path)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)
    return v.select("word", F.size("vec").alias("size"), F.round(total(F.col("vec")), 4).alias("total"), F.round(total(F.transform("vec", lambda x, i: x * (i + 1))), 4).alias("turned"))


@query("s7_matrix_cache", f"WITH {GRAMS2} SELECT id, side, gram, c AS count FROM g JOIN voc USING (gram)")
def _(spark, sf_dir):
    """A sparse matrix of counts: made and kept by the first call, read by the second."""
    from twinleaf.operators import ngrams

    path = fresh_path(spark)

    def make():
        c = ngrams.grams(fx.pairs(spark, sf_dir), 2)
        return c.join(ngrams.frequent(c, 5).select("gram"), "gram").select("id", "side", "gram", "count")

    files.cached(spark, path, make)
    return files.cached(spark, path, lambda: spark.range(0).selectExpr("id", "0 AS side", "'' AS gram", "id AS count"))


def _vectors(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))


@query("s9_factor_cache", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6) + 0) AS again FROM embeddings")
def _(spark, sf_dir):
    """All directions, kept and read again, give back every vector they were taken from."""
    v, path = _vectors(spark, sf_dir), fresh_path(spark)
    wide = v.select(F.size("a")).first()[0]
    factors.save(spark, path, *factors.directions(v, "a", wide))
    values, vectors = factors.load(spark, path)
    n = v.count()
    u = factors.projected_rows(v, "vec_id", "a", np.divide(n**0.5, values, out=np.zeros_like(values), where=values > 0)[:, None] * vectors)
    back = factors.projected_rows(u, "vec_id", "a", (values / n**0.5 * vectors.T))
    return back.select("vec_id", F.transform("a", lambda x: F.round(x, 6) + 0).alias("again"))


@query("v1_v2_whitened", "SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS mean FROM range(5) a(i), range(5) b(j)")
def _(spark, sf_dir):
    """Parts along singular directions, over their singular values: mean squares are 1 and mean products 0."""
    v = _vectors(spark, sf_dir)
    values, vectors = factors.directions(v, "a", 5)
    u = v.select(F.posexplode(factors.projected(F.col("a"), values, vectors, v.count())).alias("i", "x"), "vec_id")
    both = u.join(u.select("vec_id", F.col("i").alias("j"), F.col("x").alias("y")), "vec_id")
    return both.groupBy("i", "j").agg((F.round(F.avg(F.col("x") * F.col("y")), 6) + 0).alias("mean"))


@query("s10_csv_sink", f"WITH {TOK} SELECT id, {_WORDS} AS jaccard, ({_DIFF})::BIGINT AS diff FROM tok")
def _(spark, sf_dir):
    f, path = lexical.features(), fresh_path(spark)
    fx.tokenized(spark, sf_dir).select("id", F.round(f["b2_jaccard"], 6).alias("jaccard"), f["b6_wc_diff"].cast("long").alias("diff")).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="id long, jaccard double, diff long")


@query("s11_submission", f"WITH {SCORED} SELECT id AS test_id, p AS is_duplicate FROM scored")
def _(spark, sf_dir):
    path = fresh_path(spark)
    files.write_submission(fx.scored(spark, sf_dir).withColumnRenamed("id", "test_id"), path)
    return spark.read.csv(path, header=True, schema="test_id long, is_duplicate double")


@query("s13_error_file", f"WITH {SCORED}, t AS (SELECT id, y, p FROM scored WHERE y = 0 ORDER BY p DESC, id DESC LIMIT 100) SELECT t.id, t.y, t.p, md5(regexp_replace(text, '[^ -~]+', ' ', 'g')) AS digest FROM t JOIN documents ON doc_id = t.id")
def _(spark, sf_dir):
    """The worst false positives with their whole texts, quoted."""
    path = fresh_path(spark)
    texts = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^ -~]+", " ").alias("text"))
    files.write_errors(metrics.top_errors(fx.scored(spark, sf_dir), 0).join(texts, "id"), path)
    got = spark.read.csv(path, header=True, escape='"', schema="id long, y int, p double, text string", multiLine=True, maxCharsPerColumn=-1, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return got.select("id", "y", "p", F.md5("text").alias("digest"))


NAMES = ["b1_word_match", "b2_jaccard", "b4_total_unique_words"]


@query("s14_feature_map", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', 'q')" for i, n in enumerate(NAMES)) + ") t(\"at\", name, kind)")
def _(spark, sf_dir):
    path = fresh_path(spark)
    files.write_feature_map(spark, NAMES, path)
    return files.read_feature_map(spark, path)


def _featured(spark, sf_dir):
    f = lexical.features()
    return fx.tokenized(spark, sf_dir).select("id", F.col("is_duplicate").alias("y"), f["b2_jaccard"].cast("double").alias("b2_jaccard"))


@query("s8_k9_saved_model", f"WITH {PAIRS} SELECT id, true AS same FROM pairs")
def _(spark, sf_dir):
    """A saved model, loaded, scores every row as before."""
    x, path = _featured(spark, sf_dir), fresh_path(spark)
    model = models.logistic(x, ["b2_jaccard"])
    files.save_model(model, path)
    again = models.logits(files.load_model(LogisticRegressionModel, path), x, ["b2_jaccard"]).withColumnRenamed("logit", "again")
    return models.logits(model, x, ["b2_jaccard"]).join(again.select("id", "again"), "id").select("id", (F.col("logit") == F.col("again")).alias("same"))


SETTINGS = 'base { folds = 3, alpha = 0.1, name = "b" }\nmodel = ${base}\nmodel { alpha = 0.5 }\nfiles = ["a", "b"]\n'


@query("s15_s16_settings", "SELECT * FROM (VALUES ('base', '{\"alpha\": 0.1, \"folds\": 3, \"name\": \"b\"}'), ('files', '[\"a\", \"b\"]'), ('model', '{\"alpha\": 0.5, \"folds\": 7, \"name\": \"b\"}')) t(key, value)")
def _(spark, sf_dir):
    """Nested settings with a reference, an override in the text and one from outside."""
    got = config.parse(SETTINGS, {"model.folds": "7"})
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in got.items()], "key string, value string")


@query("d7_v5_u4_elements", f"""WITH {VECS} SELECT vec_id, list_transform(a, lambda x: round(x / sqrt(list_dot_product(a, a)), 6) + 0) AS unit,
  list_concat(list_transform(list_zip(a, b), lambda t: round((t[1] + t[2]) / 2, 6) + 0), list_transform(list_zip(a, b), lambda t: round((t[1] - t[2]) / 2, 6) + 0)) AS halves,
  list_transform(list_concat(a, b), lambda x: round(x, 6) + 0) AS stacked FROM v""")
def _(spark, sf_dir):
    """Every element of normed vectors, of half sums and differences, and of two vectors side by side."""
    from twinleaf.functions import vectors

    v = _vectors(spark, sf_dir)
    v = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    six = lambda c: F.transform(c, lambda x: F.round(x, 6) + 0)
    return v.select("vec_id", six(vectors.normalized(F.col("a"))).alias("unit"), six(vectors.symmetrized(F.col("a"), F.col("b"))).alias("halves"), six(F.concat("a", "b")).alias("stacked"))


@query("v6_axis_residuals", f"""WITH {VECS}, r AS (SELECT vec_id, a, b, a[9:] AS x, b[9:] AS y FROM v)
SELECT vec_id AS id, round(sqrt(list_dot_product(x, x) / list_dot_product(a, a)), 6) AS norm1, round(sqrt(list_dot_product(y, y) / list_dot_product(b, b)), 6) AS norm2,
  round(sqrt(list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y)), 6) AS distance, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 6) AS cosine FROM r""")
def _(spark, sf_dir):
    """Residuals of two vectors when the first eight axes are taken as directions: what is left are the other axes."""
    v = _vectors(spark, sf_dir)
    v = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").withColumnRenamed("vec_id", "id")
    wide = v.select(F.size("a")).first()[0]
    return _six(factors.residual_features(v, "a", "b", np.eye(8, wide)))
