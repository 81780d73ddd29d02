"""Defined cases of every operator: clashing columns, rows without id, repeated rows and very long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinleaf.llm import decontamination, jaccard_join, kmeans_tree, lm_scoring, packing, pii, secrets, sharding, suffix_dedup, toxicity
from twinleaf.llm.queries import vocabulary

#: Names that operators use inside.
CLASHES = ["chunk", "bucket", "blob", "grp", "salt", "hashes", "at", "seed", "shard", "class", "tokens", "rank", "leaf", "cand", "base", "bytes", "row", "near", "score", "matched", "n", "target", "is_target", "toxic", "slot", "length", "start", "own", "root", "_own", "item_id", "vec_id", "cid", "ids", "spans"]


def with_clashes(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice("the of and to in it is was vile crude calm plain word other".split()) + rng.choice(["", "", "x", "ly"]) for _ in range(n))
    item = [f"q{k}z" for k in range(15)]
    texts = [prose(60) for _ in range(40)]
    texts += ["a" * 300_000, prose(40_000), " ".join(item) + " " + "b " * 60_000, "1 2 3 4 5 6 7 8 9 " * 4000, "é" * 70_000, None, "", texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, texts[1]), (None, None), (3, texts[3]), (3, texts[4])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (5, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (2, ""), (None, "only these four words"), (1, " ".join(item))], "item_id long, text string")
    x = np.random.default_rng(2).normal(size=(60, 8))
    vecs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 8), (7, [float(v) for v in x[7]]), (61, [1.0, None] + [0.0] * 6), (62, [])], "vec_id long, embedding array<float>")
    return docs, labels, bench, vecs


OPERATORS = {
    "op1": lambda d, l, b, v: lm_scoring.cross_entropy_difference(d, l.filter("quality = 1")),
    "op2": lambda d, l, b, v: sharding.balanced_label_propagation(d, 5).select("doc_id", "size", "text_crc32"),
    "op3": lambda d, l, b, v: kmeans_tree.nearest(v, v.filter("vec_id % 10 = 0"))[0],
    "op4": lambda d, l, b, v: suffix_dedup.deduplicate(d),
    "op5": lambda d, l, b, v: pii.find(d, pii.fit(d)),
    "op6": lambda d, l, b, v: decontamination.find(d, b),
    "op7": lambda d, l, b, v: secrets.scan(d),
    "op8": lambda d, l, b, v: jaccard_join.components(d),
    "op9": lambda d, l, b, v: toxicity.score(d, l).select("doc_id", "held_out", F.round("score", 4).alias("score"), "predicted"),
    "op10": lambda d, l, b, v: packing.pack(d, vocabulary()).drop("sequence_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, tables, name):
    plain = sorted(map(str, OPERATORS[name](*tables).collect()))
    assert sorted(map(str, OPERATORS[name](*map(with_clashes, tables)).collect())) == plain
    if name in ("op1", "op2", "op4", "op5", "op7", "op8", "op9"):
        assert len(plain) == tables[0].count()


def test_filters_keep_other_columns(spark, tables):
    docs, labels, bench, _ = map(with_clashes, tables)
    for df in (toxicity.reject(docs, labels, docs), jaccard_join.keep_first(docs), decontamination.keep_clean(docs, bench), secrets.redact(docs)):
        assert df.columns == docs.columns and df.filter("salt <> 'x'").isEmpty() and not df.isEmpty()


def test_long_texts_are_taken_whole(spark, tables):
    docs, labels, bench, _ = tables
    texts = {r.doc_id: r.text for r in docs.filter("doc_id >= 40").collect()}
    packed = {r.doc_id: r.n for r in packing.pack(docs, vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed[41] > 40_000 and packed[45] == 1
    sets = {r.doc_id: r.n_shingles for r in jaccard_join.components(docs).collect()}
    words = texts[41].split()
    assert sets[41] == len({tuple(words[k:k + 5]) for k in range(len(words) - 4)}) and sets[40] == 1
    scored = {r.doc_id: r.n_tokens for r in lm_scoring.cross_entropy_difference(docs, labels.select("doc_id")).collect() if r.doc_id != 3}
    assert scored[41] == 40_000 and scored[42] == 60_015
    assert {r.doc_id for r in decontamination.find(docs, bench).filter("item_id = 1").collect()} == {42}
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicate(docs).filter("doc_id >= 40").collect()}
    assert removed[40] == removed[44] == 0 and removed[47] == removed[48] == len(tables[0].filter("doc_id = 0").first().text)


def test_repeated_rows(spark, tables):
    """Rows of one doc_id: each is packed and scored; pairs with items come once; a vector given twice is one."""
    docs, labels, bench, vecs = tables
    assert packing.pack(docs.filter("doc_id = 3"), vocabulary()).filter("start = 0").count() == 3
    found = decontamination.find(docs.union(docs), bench).collect()
    assert len(found) == len(set(found)) and found
    got = kmeans_tree.nearest(vecs, vecs.filter("vec_id = 0"))[0].collect()
    assert len({r.vec_id for r in got}) == 5 and 0 not in {r.vec_id for r in got}


def test_convolution_against_plain_loops():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.2, {})
    coded = [toxicity.encoded(" ".join(f"word number{i}" for i in range(n)))[0] for n in (0, 1, 2, 7, 0)]
    got = model.pooled(coded)
    for slots, pooled in zip(coded, got):
        x = [sum(model.embedding[s] for s in row) for row in slots]
        want = []
        for width, f, b in zip(toxicity.WIDTHS, model.filters, model.biases):
            for k in range(toxicity.FILTERS):
                best = 0.0
                for at in range(len(x) - width + 1):
                    best = max(best, float(np.concatenate(x[at:at + width]) @ f[:, k] + b[k]))
                want.append(best)
        assert pooled == pytest.approx(want, abs=1e-3)
    assert model.logits(coded) == pytest.approx(got @ model.weights + 0.2, abs=1e-3)


def test_few_links_are_joined_by_one_task_and_many_in_rounds(spark, monkeypatch):
    """Both give the same components; few links take a few jobs, as rounds of many fill the driver with what it notes of each task."""
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(120)] + [(5000, k) for k in range(4000, 4100)] + [(7, 7)]
    df, sc, got = spark.createDataFrame(edges, "u long, v long"), spark.sparkContext, {}
    for most in (1 << 17, 0):
        monkeypatch.setattr(jaccard_join, "EDGES", most, raising=False)
        sc.setJobGroup(f"links {most}", "")
        got[most] = sorted(map(tuple, jaccard_join.connected(df).collect()))
        if most:
            assert len(sc.statusTracker().getJobIdsForGroup(f"links {most}")) <= 10
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[1 << 17] and dict(got[0])[300] == 0 and {r for c, r in got[0] if 4000 <= c <= 5000} == {4000}
    assert jaccard_join.connected(df.limit(0)).count() == 0
