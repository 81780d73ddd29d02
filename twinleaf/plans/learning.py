"""Queries of models: folds, n-gram factors and the final model, with DuckDB statements where Newton's method can be written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.functions import lexical, vectors
from twinleaf.functions.constants import CLASS_WEIGHTS
from twinleaf.operators import assemble, factors, models, ngrams
from twinleaf.operators.durable import durable, fresh_path
from twinleaf.plans.sql import PAIRS, SCORED, STOPS
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


def _newton(rows: str, folds: int, weight: str, penalty: float) -> str:
    """Coefficients ``b(f, b0, b1)`` of a logistic curve on x for each fold left out (``folds`` 1: on all rows of fold -1)."""
    return f"""WITH RECURSIVE {SCORED}, d AS MATERIALIZED ({rows}),
it AS (SELECT f, 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM range({folds}) t(f)
  UNION ALL SELECT f, i + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT f, i, any_value(b0) AS b0, any_value(b1) AS b1, sum(v * (q - y)) AS g0, sum(v * (q - y) * x) + {penalty} * any_value(b1) AS g1,
      sum(v * q * (1 - q)) AS h00, sum(v * q * (1 - q) * x) AS h01, sum(v * q * (1 - q) * x * x) + {penalty} AS h11
    FROM (SELECT f, i, b0, b1, y, x, {weight} AS v, 1 / (1 + exp(-(b0 + b1 * x))) AS q FROM it JOIN d ON d.fold <> it.f) GROUP BY f, i) WHERE i < 30),
b AS (SELECT f, b0, b1 FROM it WHERE i = 30)"""


_ALL = "SELECT id, y, p AS x, w, -1 AS fold FROM scored"
_TEN = "SELECT id, y, p AS x, w, ntile(10) OVER (PARTITION BY y ORDER BY id) - 1 AS fold FROM scored"


def _four(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 4) + 0).alias(c) if k == "double" else c for c, k in df.dtypes])


@query("k1_one_feature", f"{_newton(_ALL, 1, '1', 1.0)} SELECT id, y, round(b0 + b1 * x, 4) + 0 AS logit FROM d, b")
def _(spark, sf_dir):
    s = durable(fx.scored(spark, sf_dir))
    return _four(models.logits(models.logistic(s, ["p"]), s, ["p"]))


@query("k2_one_feature_weighted", f"{_newton(_ALL, 1, 'w', 1.0)} SELECT id, y, round(b0 + b1 * x, 4) + 0 AS logit FROM d, b")
def _(spark, sf_dir):
    s = durable(fx.scored(spark, sf_dir))
    return _four(models.logits(models.logistic(s, ["p"], weighted=True), s, ["p"]))


@query("q5_platt_scaling", f"{_newton(_ALL, 1, '1', 0.0)} SELECT id, y, round(1 / (1 + exp(-(b0 + b1 * x))), 4) + 0 AS p FROM d, b")
def _(spark, sf_dir):
    return _four(models.platt(durable(fx.scored(spark, sf_dir))))


@query("k3_ten_folds", f"{_newton(_TEN, 10, '1', 1.0)} SELECT id, y, fold::INT AS fold, round(b0 + b1 * x, 4) + 0 AS logit FROM d JOIN b ON b.f = d.fold")
def _(spark, sf_dir):
    return _four(models.cross_fitted(durable(fx.scored(spark, sf_dir)), None, ["p"])[0])


_PARTS = "SELECT id, y, p AS x, w, ntile(10) OVER (PARTITION BY y ORDER BY id) - 1 AS fold FROM scored WHERE id % 7 > 0"


@query("k3_a11_test_means", f"{_newton(_PARTS, 10, 'w', 1.0)} SELECT id, round(avg(b0 + b1 * p), 4) + 0 AS logit FROM (SELECT * FROM scored WHERE id % 7 = 0), b GROUP BY id")
def _(spark, sf_dir):
    """Weighted models of ten folds; the mean of their logits for rows none of them has seen."""
    s = durable(fx.scored(spark, sf_dir))
    return _four(models.cross_fitted(s.filter("id % 7 > 0"), s.filter("id % 7 = 0"), ["p"], weighted=True)[1])


@query("k5_elastic_net_search")
def _(spark, sf_dir):
    """Out-of-fold loss of each mixture and strength of penalty."""
    return models.elastic_net_search(fx.scored(spark, sf_dir), ["p"], [(a, m) for a in (0.1, 1.0) for m in (0.15, 0.5)], folds=3)


_WORDS = PAIRS + r""", ws AS (
  SELECT id, 1 AS side, list_filter(regexp_extract_all(lower(question1), '\b\w\w+\b'), lambda w: NOT list_contains(STOPS, w)) AS w FROM pairs
  UNION ALL SELECT id, 2, list_filter(regexp_extract_all(lower(question2), '\b\w\w+\b'), lambda w: NOT list_contains(STOPS, w)) FROM pairs),
g AS (SELECT id, side, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS c FROM (SELECT id, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM ws, range(1, 4) t(n)) GROUP BY ALL),
voc AS (SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 3)""".replace("STOPS", STOPS)


def _word_counts(spark, sf_dir, binary: bool = False):
    c = durable(ngrams.word_grams(fx.pairs(spark, sf_dir), 1, 3, stop_words=True, binary=binary))
    return c, ngrams.frequent(c, 3)


@query("n1_word_ngrams", f"WITH {_WORDS} SELECT id, side, gram, c AS count FROM g JOIN voc USING (gram)")
def _(spark, sf_dir):
    """Runs of one to three words of two letters or more, without stop words, in three texts or more."""
    c, voc = _word_counts(spark, sf_dir)
    return c.join(voc.select("gram"), "gram").select("id", "side", "gram", "count")


@query("n2_n3_combined_matrix", f"""WITH {_WORDS}, ab AS (SELECT id, gram, max((side = 1)::INT) AS a, max((side = 2)::INT) AS b FROM g JOIN voc USING (gram) GROUP BY id, gram)
SELECT id, gram, abs(a - b)::BIGINT AS diff, (a * b)::BIGINT AS both FROM ab""")
def _(spark, sf_dir):
    """Every element of the binary matrices' absolute difference and product."""
    c, voc = _word_counts(spark, sf_dir, binary=True)
    return ngrams.combined(c, voc)


def ngram_factors(spark, sf_dir, k: int = 5) -> DataFrame:
    """(id, y, w, a, b): both questions' parts along the singular directions of the stacked n-gram counts."""
    c, voc = _word_counts(spark, sf_dir)
    u, _ = factors.stacked_factors(c, voc, k)
    sides = [u.filter(F.col("side") == s).select("id", F.col("factors").alias(n)) for s, n in ((1, "a"), (2, "b"))]
    y = fx.pairs(spark, sf_dir).select("id", F.col("is_duplicate").alias("y"), assemble.class_weight().alias("w"))
    zero = F.array(*[F.lit(0.0)] * k)
    both = y.join(sides[0], "id", "left").join(sides[1], "id", "left")
    return durable(both.withColumns({n: F.coalesce(n, zero) for n in "ab"}))


@query("v1_v2_truncated_svd")
def _(spark, sf_dir):
    x = ngram_factors(spark, sf_dir)
    return x.select("id", F.concat("a", "b").alias("factors"))


@query("v3_v4_factor_distances")
def _(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return ngram_factors(spark, sf_dir).select("id", vectors.minkowski(a, b, 2).alias("euclidean"), (vectors.dot(a, b) / (vectors.norm(a) * vectors.norm(b) + 1e-9)).alias("cosine"))


def _symmetric(spark, sf_dir, k: int = 5) -> tuple[DataFrame, list[str]]:
    x = ngram_factors(spark, sf_dir, k)
    s = vectors.symmetrized(F.col("a"), F.col("b"))
    names = [f"f{j}" for j in range(2 * k)]
    return durable(x.select("id", "y", "w", *[s[j].alias(n) for j, n in enumerate(names)])), names


@query("k6_feed_forward")
def _(spark, sf_dir):
    x, names = _symmetric(spark, sf_dir)
    return models.feed_forward(x, names)


@query("k7_boosted_factors")
def _(spark, sf_dir):
    x, names = _symmetric(spark, sf_dir)
    return models.predictions(models.boosted_trees(x, names), x, names)


@query("k8_final_model")
def _(spark, sf_dir):
    """Groups, mirrored copies, weights, holdout, trees, quality, errors, scores and the submission; returns the submission."""
    f, t = lexical.features(), fx.tokenized(spark, sf_dir)
    names = ["b1_word_match", "b2_jaccard", "b6_wc_diff", "len_q1", "len_q2"]
    x = durable(t.select("id", F.col("is_duplicate").alias("y"), "question1", "question2", *[f[n].cast("double").alias(n) for n in names[:3]], F.length("question1").cast("double").alias("len_q1"), F.length("question2").cast("double").alias("len_q2")))
    out = models.final_model(x.filter("id % 5 > 0"), x.filter("id % 5 = 0"), names, [("len_q1", "len_q2")], CLASS_WEIGHTS, fresh_path(spark))
    return out["submission"]
