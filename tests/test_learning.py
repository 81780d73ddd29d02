"""Models and factors against numpy, and the final model's course."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinleaf.operators import factors, models, ngrams


def test_stacked_factors(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (12, 7)).astype(float)
    counts = spark.createDataFrame([(i // 2, i % 2 + 1, f"g{j}", int(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "id long, side int, gram string, count long")
    u, s = factors.stacked_factors(counts, ngrams.frequent(counts, 1), 3)
    want, sv, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, sv[:3])
    got = np.array([r.factors for r in u.orderBy("id", "side").collect()])
    assert np.allclose(np.abs(got), np.abs(want[:, :3]) * np.sqrt(12), atol=1e-6)


def test_too_wide_a_matrix_is_an_error(monkeypatch, spark):
    monkeypatch.setattr(factors, "MOST_TERMS", 1)
    counts = spark.createDataFrame([(0, 1, "a", 1), (0, 1, "b", 1)], "id long, side int, gram string, count long")
    with pytest.raises(ValueError):
        factors.stacked_factors(counts, ngrams.frequent(counts, 1), 1)


def newton(x, y, w, penalty=1.0):
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
    return b


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] + 0.3)))).astype(int)
    w = np.where(y == 1, 0.472, 1.309)
    df = spark.createDataFrame([(i, int(y[i]), float(w[i]), float(x[i, 0]), float(x[i, 1]), f"a {i}", f'b, "{i}"') for i in range(300)], "id long, y int, w double, f double, g double, question1 string, question2 string")
    return df, x, y, w


@pytest.mark.parametrize("weighted", [False, True])
def test_logistic_against_newton(data, weighted):
    df, x, y, w = data
    b = newton(x, y, w if weighted else np.ones(300), 1 / 0.5)
    model = models.logistic(df, ["f", "g"], alpha=0.5, weighted=weighted)
    assert np.allclose([model.intercept, *model.coefficients], b, atol=1e-6)


def test_folds_and_test_means(data):
    df, x, y, w = data
    oof, means = models.cross_fitted(df.filter("id < 250"), df.filter("id >= 250"), ["f", "g"], folds=4, weighted=True)
    rows = {r.id: r for r in oof.collect()}
    assert len(rows) == 250 and {r.fold for r in rows.values()} == {0, 1, 2, 3}
    fold = np.array([rows[i].fold for i in range(250)])
    logits = np.zeros((4, 300))
    for k in range(4):
        b = newton(x[:250][fold != k], y[:250][fold != k], w[:250][fold != k])
        logits[k] = b[0] + x @ b[1:]
    assert np.allclose([rows[i].logit for i in range(250)], [logits[fold[i], i] for i in range(250)], atol=1e-5)
    assert np.allclose([r.logit for r in means.orderBy("id").collect()], logits[:, 250:].mean(0), atol=1e-5)


def test_elastic_net_search(data):
    rows = models.elastic_net_search(data[0], ["f", "g"], [(0.001, 0.5), (10.0, 0.5)], folds=3).collect()
    assert len(rows) == 2 and rows[1].log_loss < rows[0].log_loss < 0.75


def test_final_model(spark, data, tmp_path):
    df = data[0].drop("w")
    folder = str(tmp_path / "out")
    out = models.final_model(df.filter("id < 200"), df.filter("id >= 200"), ["f", "g"], [("f", "g")], {0: 1.309, 1: 0.472}, folder, rounds=4)
    assert out["submission"].count() == 100
    assert spark.read.csv(f"{folder}/submission", header=True).count() == 100
    assert {"map", "model", "dump", "quality", "errors", "scores", "progress", "submission"} <= set(os.listdir(folder))
    assert [r.part for r in out["quality"].collect()] == ["train", "valid"]
    scores = out["scores"].collect()
    assert sum(r.weight for r in scores) == pytest.approx(1) and all(r.cover > 0 for r in scores)
    losses = [r.loss for r in out["progress"].orderBy("round").collect()]
    assert losses == sorted(losses, reverse=True) and len(losses) == 4
    errors = spark.read.csv(f"{folder}/errors", header=True, escape='"').collect()
    assert errors and all(r.question2 == f'b, "{r.id}"' for r in errors)
    assert json.loads(spark.read.text(f"{folder}/quality").first()[0])["part"] in ("train", "valid")


def test_word_grams(spark):
    df = spark.createDataFrame([(1, "The cat, a cat sat", "x")], "id long, question1 string, question2 string")
    got = {(r.side, r.gram): r["count"] for r in ngrams.word_grams(df, 1, 2, stop_words=True).collect()}
    assert got == {(1, "cat"): 2, (1, "sat"): 1, (1, "cat cat"): 1, (1, "cat sat"): 1}
    assert ngrams.word_grams(df, 1, 1, binary=True).filter(F.col("count") > 1).isEmpty()


@pytest.mark.parametrize("bytes_held", [1 << 29, 1])
def test_factors_by_restarted_blocks(spark, monkeypatch, bytes_held):
    """Longer sides than are decomposed at once, with and without restarts."""
    monkeypatch.setattr(factors, "BASIS_BYTES", bytes_held)
    rng = np.random.default_rng(5)
    x = rng.poisson(0.4 * rng.random((160, 1)) * rng.random((1, 90)) * 4).astype(float)
    x[:, 0] += 1
    counts = spark.createDataFrame([(i // 2, i % 2 + 1, f"g{j}", int(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "id long, side int, gram string, count long")
    u, s = factors.stacked_factors(counts, ngrams.frequent(counts, 1), 3)
    want, sv, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, sv[:3])
    assert np.allclose(np.abs([r.factors for r in u.orderBy("id", "side").collect()]), np.abs(want[:, :3]) * np.sqrt(160), atol=1e-6)
    y = np.hstack([x[0::2] / np.linalg.norm(x[0::2], axis=1)[:, None], x[1::2] / np.linalg.norm(x[1::2], axis=1)[:, None]])
    want = np.linalg.svd(y, full_matrices=False)[0]
    got = np.array([r.factors for r in factors.sparse_factors(counts, ngrams.frequent(counts, 1), 3).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(want[:, :3]), atol=1e-6)


def test_factors_of_one_rank(spark):
    counts = spark.createDataFrame([(i, 1, f"g{j}", 2) for i in range(80) for j in range(3)], "id long, side int, gram string, count long")
    u, s = factors.stacked_factors(counts, ngrams.frequent(counts, 1), 2)
    assert np.allclose(s, [2 * np.sqrt(240), 0])
    assert np.allclose(np.abs([r.factors for r in u.collect()]), [[1, 0]] * 80)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_measures_of_packed_grams(spark, monkeypatch, n):
    """As by exploding and joining; ids whose rows are apart, empty and null texts, signs of many bytes, grams too many to hold."""
    monkeypatch.setattr(ngrams, "SLICE", 3)
    monkeypatch.setattr(ngrams, "COUNTED", 40)
    rng = np.random.default_rng(n)
    make = lambda: "".join(rng.choice(list("abAB \tÉ😀"), rng.integers(0, 12)))
    df = spark.createDataFrame([(i // 2 if i % 5 == 0 else i, make(), make() if i % 7 else None) for i in range(60)] + [(0, "abab", "ab"), (0, "ba", "b")], "id long, question1 string, question2 string")
    c = ngrams.grams(df, n)
    voc = ngrams.frequent(c, 3)
    plain = [ngrams.jaccards(c, voc), ngrams.tfidf_distances(c, voc, 120), c.join(voc, "gram").withColumn("x", F.col("count") * (F.log(F.lit(121) / (1 + F.col("df"))) + 1)).groupBy("id", "side").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))]
    want = [sorted(tuple(r) for r in df.collect()) for df in plain]
    for held in (1_000_000, 2):
        monkeypatch.setattr(ngrams, "MOST_HELD", held)
        got = [ngrams.pair_jaccards(df, n, 3), ngrams.pair_tfidf_distances(df, n, 3, 120), ngrams.text_tfidf_norms(df, n, 3, 120)]
        for a, b in zip(got, want):
            assert held == 2 or "Generate" not in a._jdf.queryExecution().optimizedPlan().toString()
            a = sorted(tuple(r) for r in a.collect())
            assert len(a) == len(b) and np.allclose(a, b, atol=1e-7)


def test_grams_are_counted_where_their_text_is(spark):
    """One exchange, of the texts; none of the grams."""
    df = spark.createDataFrame([(1, "The cat, a cat sat", "x")], "id long, question1 string, question2 string")
    for c in (ngrams.word_grams(df, 1, 2), ngrams.grams(df, 2)):
        plan = c._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("weighted", [False, True])
def test_elastic_net_in_few_passes(spark, data, monkeypatch, weighted):
    """As Spark's own solver, and no coefficient can be moved for the better; a pass for each step, of which there are few."""
    df, x, y, w = data
    passes, plain = [], models._elastic_sums
    monkeypatch.setattr(models, "_elastic_sums", lambda *a: passes.append(1) or plain(*a))
    w = w if weighted else np.ones(300)
    for alpha in (0.02, 1.0):
        passes.clear()
        b = models._elastic_net(df, ["f", "g"], alpha, 0.5, weighted)
        assert len(passes) <= 15
        own = models._logistic(models.assembled(df, ["f", "g"]), alpha, 0.5, weighted)
        assert np.allclose(b, [own.intercept, *own.coefficients], atol=1e-4)

        def worth(b, w=w, alpha=alpha):
            z = b[0] + x @ b[1:]
            return (w * (np.logaddexp(0, z) - y * z)).sum() + (0.5 * np.abs(b[1:]).sum() + 0.25 * (b[1:] ** 2).sum()) / alpha

        assert all(worth(b) <= worth(b + s * e) for e in np.eye(3) for s in (1e-4, -1e-4))
    passes.clear()
    assert models.out_of_fold(df, ["f", "g"], folds=2, l1=0.5, weighted=weighted).count() == 300 and 0 < len(passes) <= 30
    assert models._elastic_net(df.filter("y = 1"), ["f", "g"], 1.0, 0.5, weighted).tolist() == [np.inf, 0, 0]
