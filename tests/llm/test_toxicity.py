"""Training on every labelled row: parts, rounds, long texts and thresholds."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinleaf.llm import toxicity


def prose(rng, n):
    return " ".join(rng.choice("the of and to in it is was calm plain word other river house garden".split()) for _ in range(n))


def test_rows_beyond_three_thousand_are_learnt_from(spark):
    """Of each label the 3,000 smallest hashes once were all that training saw: only later rows and those held out have the word."""
    rng = random.Random(4)
    ids = spark.range(8400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"), F.xxhash64("id").alias("h")).collect()
    held = {r.doc_id for r in ids if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    order = sorted((r for r in ids if r.toxic and r.doc_id not in held), key=lambda r: r.h)
    first = {r.doc_id for r in order[:3000]}
    assert len(order) > 3200
    docs = spark.createDataFrame([(r.doc_id, prose(rng, 12) + (" vile" if r.doc_id in first else " grim" if r.toxic else "")) for r in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")
    rows = [r for r in toxicity.score(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows]) > 0.95


def test_long_texts_are_learnt_from(spark):
    """Texts over 2 MB once were left out: without them there is one label."""
    rng = random.Random(5)
    run = prose(rng, 20_000)
    texts = [prose(rng, 30) for _ in range(40)] + [run * 25 + " vile crude " + prose(rng, 30) for _ in range(4)] + ["vile crude " + prose(rng, 20)]
    assert len(texts[40]) > 2 << 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i >= 40)) for i in range(44)], "doc_id long, toxic int"), held_out=False)
    scores = model.scores(texts)
    assert min(scores[40:]) > max(scores[:40])


def test_tasks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_BYTES", 3000)
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, 25) + (" vile" if i % 3 == 0 else "")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    one = toxicity.fit(docs.repartition(5), labels)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "20000")
        other = toxicity.fit(docs.coalesce(1), labels)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert np.array_equal(one.embedding, other.embedding) and np.array_equal(one.weights, other.weights) and one.thresholds == other.thresholds
    rows = docs.collect()
    assert np.mean([(s >= 0.5) == (r.doc_id % 3 == 0) for r, s in zip(rows, one.scores([r.text for r in rows]))]) > 0.9


def test_peaks_of_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    model, _ = toxicity._started()
    table = rng.integers(0, toxicity.BUCKETS, (50, 2 + len(toxicity.STEMS)))
    sizes = np.array([0, 1, 40, 2, 7, 0, 33])
    ids = rng.integers(0, 50, sizes.sum())
    whole = toxicity._peaks(model, table, ids, sizes)
    monkeypatch.setattr(toxicity, "WORDS", 5)
    pieces = toxicity._peaks(model, table, ids, sizes)
    for k in range(len(toxicity.WIDTHS)):
        assert pieces[0][k] == pytest.approx(whole[0][k], abs=1e-6) and ((pieces[1][k] < 0) == (whole[1][k] < 0)).all()
        assert (pieces[1][k] == whole[1][k]).mean() > 0.9  # equal words tie


def test_thresholds_against_plain_loops(spark):
    rng = random.Random(8)
    rows = [(lang, y, round(rng.gauss(y, 1), 2)) for lang, n in (("en", 400), ("fr", 120), ("de", 12)) for y in [int(rng.random() < 0.4) for _ in range(n)]] + [("es", 0, 0.25)] * 30

    def plain(rows):
        pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
        values = sorted({s for _, _, s in rows})
        gains = [(sum(s <= a for s in neg) / len(neg) - sum(s <= a for s in pos) / len(pos), b - a, (a + b) / 2) for a, b in zip(values, values[1:])]
        top = max(g for g, _, _ in gains)
        return max((gap, at) for g, gap, at in gains if g >= top - 1e-9)[1]

    want = {lang: plain([r for r in rows if r[0] == lang]) for lang in ("en", "fr")}
    want |= dict.fromkeys(("de", "es"), plain(rows))
    df = spark.createDataFrame(rows, "lang string, toxic long, logit double")
    assert toxicity.thresholds(df.repartition(3)) == pytest.approx(want)
    assert toxicity.thresholds(df.filter("toxic = 0")) == dict.fromkeys(toxicity.FUNCTION_WORDS, 0.0)
    assert toxicity.thresholds(df.limit(0)) == dict.fromkeys(toxicity.FUNCTION_WORDS, 0.0)
