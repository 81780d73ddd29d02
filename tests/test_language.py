import gzip
from itertools import permutations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from twinleaf.functions import cascade, stemming, transport, vectors
from twinleaf.operators import factors, models, tagging
from twinleaf.plans import registry
from twinleaf.sources import config, files


def test_stems():
    want = {"consistency": "consist", "running": "run", "happy": "happi", "by": "by", "hopping": "hop", "hoping": "hope", "relational": "relat", "agreed": "agre", "flies": "fli", "dies": "die", "conditional": "condit", "gas": "gas", "gaps": "gap", "generously": "generous", "controlling": "control", "exceedingly": "exceed", "skis": "ski", "analogously": "analog"}
    assert {w: stemming.stem(w) for w in want} == want


def test_stemmed_column(spark):
    df = spark.createDataFrame([("Running cats",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(stemming.stemmed("t")).collect()] == ["run cat", None, ""]


def test_cascade(spark):
    rows = [('Why "What" is it? A dog.', 'why "what" is it? a dog.'), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r[0] == r[1] for r in df.select(cascade.lower_starts(F.col("t")), "want").collect())
    cases = {
        "I've 15,000 e-mails in the U.S.A.": "I have 15000 email s in America",
        "costs $5.50 & 3%": "costs dollar 87 and 3 percent",
        "Is this big thing 5rs ?": "is this bing thing 5 rs ?",
        "naïve": "na non_ascii_word ve",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string").withColumn("got", cascade.padded(cascade.ruled(F.col("t"))))
    got = {r.t: r.got for r in df.collect()}
    assert got["costs $5.50 & 3%"] == "costs dollar 87 and 3 percent"
    assert got["naïve"] == "na non_ascii_word ve"
    assert "15000" in got["I've 15,000 e-mails in the U.S.A."] and got["I've 15,000 e-mails in the U.S.A."].endswith("America")
    assert "bing" in got["Is this big thing 5rs ?"]
    assert "big" in spark.createDataFrame([("a big dog",)], "t string").select(cascade.ruled(F.col("t"), greedy=False)).first()[0]


def test_vocabulary_rules(spark):
    known = {"year", "old", "programmer", "a"}
    assert cascade.split_dashes("a year-old q-x", known) == "a year old q_x"
    assert cascade.keep_meaningful("a (programmer)", known) == "a (programmer)"
    assert cascade.keep_meaningful("a (zzz)", known).split() == ["a", "(", "quoted_item", ")"]
    df = spark.createDataFrame([("He is a year-old (zzz)",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(cascade.clean_string(spark, F.col("t"), known)).collect()] == ["he is a year old ( quoted_item )", "", ""]


def test_vocabulary_in_a_table(spark):
    """As with words sent out, without collecting the table; rows with the same key, nulls and words that only a split joins."""
    words = ["year", "old", "programmer", "a", "big_x"]
    texts = ["He is a year-old (zzz)", "x_year-old", "a (big-x)", "(year old)", None, "", "no", "a-b-c 'q-z'", "a (programmer) and [zzz]"]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "id long, t string")
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted(map(str, df.select("id", cascade.clean_string(spark, F.col("t"), words).alias("t")).collect()))
    assert sorted(map(str, cascade.cleaned_strings(df, ["id"], "t", table).collect())) == want
    for rule, asks in ((cascade.split_dashes, cascade.dash_parts), (cascade.keep_meaningful, cascade.spanned_words)):
        want = sorted(map(str, df.select("id", cascade.with_vocabulary(spark, words, rule)("t").alias("t")).collect()))
        assert sorted(map(str, cascade.by_vocabulary(df, ["id"], "t", table, rule, asks).collect())) == want


def test_queries_send_no_vocabulary(spark, monkeypatch):
    def sent(*_):
        raise AssertionError("the vocabulary is sent")

    monkeypatch.setattr(cascade, "with_vocabulary", sent)
    for name in ("c5_dashes", "c6_quoted", "c10_clean_string"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_few_tokens_are_objects_at_once(monkeypatch, spark):
    monkeypatch.setattr(tagging, "SLICE", 2)
    df = spark.range(7).select(F.col("id").alias("qid"), F.array(F.struct(*[F.lit(v).alias(k) for k, v in _token("the", known_lemma=True, best="", second="").items()])).alias("tokens"))
    assert {r.qid: r.words for r in tagging.rewritten(df).collect()} == {i: ["the"] for i in range(7)}


def _token(text, **more):
    return {"text": text, "lower": text.lower(), "lemma": text.lower(), "ent_type": "", "best": None, "second": None, "known_text": False, "known_lower": False, "known_lemma": False} | more


def test_tagger_rules(spark):
    tokens = [
        _token("Taiwan", ent_type="GPE", best="GPE"), _token("Island", ent_type="GPE", best=""), _token("is", known_lemma=True), _token("?"),
        _token("need"), _token("12"), _token("34"), _token("June", ent_type="DATE", best="DATE"), _token("I", lemma="-PRON-"), _token("Zed", second="PERSON"), _token("qqq"),
        _token("non_ascii_word", ent_type="ORG"), _token("runs", lemma="run", known_lower=True),
    ]
    want = ["country", "is", "need", "number", "i", "person", "something", "ORG", "runs"]
    assert tagging.rewritten_words(tokens) == want
    assert tagging.rewritten_words(tokens, frozenset({"is"}))[:2] == ["country", "need"]
    assert tagging.rewritten_words([]) == []
    df = spark.createDataFrame([(1, [_token("the", known_lemma=True)]), (2, None)], "qid long, tokens array<struct<text string, lower string, lemma string, ent_type string, best string, second string, known_text boolean, known_lower boolean, known_lemma boolean>>")
    assert {r.qid: r.words for r in tagging.rewritten(df).collect()} == {1: ["the"], 2: []}


def test_voted(spark):
    df = spark.createDataFrame([("a", "X", 5.0), ("a", "Y", 4.0), ("b", "", 9.9), ("b", "X", 2.0)], "word string, ent_type string, votes double")
    assert {r.word: (r.best, r.second) for r in tagging.voted(df).collect()} == {"a": ("X", "Y"), "b": ("", None)}


def test_transport_is_least():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        c, supply = rng.random((n, n)), rng.integers(1, 3, n)
        demand = rng.multinomial(supply.sum() - n, np.ones(n) / n) + 1
        if supply.sum() > 6:
            continue
        big = np.repeat(np.repeat(c, supply, 0), demand, 1)
        best = min(sum(big[i, p[i]] for i in range(len(big))) for p in permutations(range(len(big))))
        assert transport.least_cost(c, supply, demand) == pytest.approx(best)
    v = {"a": np.array([0.0, 0.0]), "b": np.array([3.0, 4.0]), "far": np.array([99.0, 0.0])}
    assert transport.word_mover(["a"], ["b"], v) == 5
    assert transport.word_mover(["a", "b"], ["a", "a"], v) == pytest.approx(2.5)
    assert transport.word_mover(["a"], ["a", "a"], v) == 0
    assert transport.word_mover(["a"], ["far"], v) == transport.word_mover(["a"], ["?"], v) == 10


def test_settings(tmp_path):
    text = """
a = { b = 1, c = "x # y" }   # comment
a.d : 2.5
list = [ { k = v w }, [1, 2], true ]
copy = ${a}
fill = nan
path = ../../x/y.csv
"""
    got = config.parse(text, {"a.b": "7"})
    assert got["copy"] == got["a"] == {"b": 7, "c": "x # y", "d": 2.5}
    assert got["list"] == [{"k": "v w"}, [1, 2], True] and got["fill"] == "nan" and got["path"] == "../../x/y.csv"
    (tmp_path / "s.conf").write_text("a { b = 1 }")
    assert config.from_arguments(["--conf", str(tmp_path / "s.conf"), "-Da.b=3"]) == {"a": {"b": 3}}
    assert config.dump({"a": 1}, str(tmp_path / "d.json")) == (tmp_path / "d.json").read_text()
    with pytest.raises(ValueError):
        config.parse("a = ${a}")


def test_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\ncat 1 2 3\ndog 4 5 6\n")
    assert {r.word: r.vec for r in files.read_word_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"cat": [1, 2, 3], "dog": [4, 5, 6]}
    with gzip.open(tmp_path / "v.gz", "wb") as f:
        f.write(b"2 2\n" + b"".join(w + b" " + np.array(x, "<f4").tobytes() + b"\n" for w, x in ((b"cat", [1, 2]), (b"dog", [3, 4]))))
    assert {r.word: r.vec for r in files.read_binary_vectors(spark, str(tmp_path / "v.gz")).collect()} == {"cat": [1, 2], "dog": [3, 4]}
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, f double")
    files.write_group(a, str(tmp_path), "one")
    files.write_group(a.filter("id = 1"), str(tmp_path), "two")
    got = files.read_groups(spark, str(tmp_path), {"one": ["f"], "two": ["f"]})
    assert {r.id: (r.one_f, r.two_f) for r in got.collect()} == {1: (0.5, 0.5), 2: (0.25, None)}
    with pytest.raises(ValueError):
        files.read_groups(spark, str(tmp_path), {"one": ["f"]}, enabled=())
    files.write_submission(a.select(F.col("id").alias("test_id"), F.col("f").alias("p")), str(tmp_path / "sub"))
    assert spark.read.csv(str(tmp_path / "sub"), header=True).columns == ["test_id", "is_duplicate"]
    errors = spark.createDataFrame([(1, 'a, "b"', 0.9)], "id long, question1 string, p double")
    files.write_errors(errors, str(tmp_path / "err"))
    assert spark.read.csv(str(tmp_path / "err"), header=True, escape='"').first().question1 == 'a, "b"'
    files.write_record(a, str(tmp_path / "rec"))
    assert spark.read.json(str(tmp_path / "rec")).count() == 2


def test_saved_model(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, 1.0, float(i % 2) + i / 100) for i in range(40)], "id long, y int, w double, f double")
    model = models.logistic(df, ["f"], weighted=True)
    files.save_model(model, str(tmp_path / "m"))
    again = models.logits(files.load_model(LogisticRegressionModel, str(tmp_path / "m")), df, ["f"])
    assert sorted(again.collect()) == sorted(models.logits(model, df, ["f"]).collect())


def test_factors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 6))
    df = spark.createDataFrame([(i, list(map(float, r)), list(map(float, r[::-1]))) for i, r in enumerate(x)] + [(99, None, None)], "id long, a array<double>, b array<double>")
    s, v = factors.directions(df, "a", 3)
    _, s2, v2 = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, s2[:3]) and np.allclose(np.abs(v), np.abs(v2[:3]))
    got = {r.id: r for r in factors.residual_features(df, "a", "b", v).collect()}
    rest = x - x @ v.T @ v
    assert got[4].norm1 == pytest.approx(np.linalg.norm(rest[4]) / np.linalg.norm(x[4])) and got[99].norm1 is None
    p = df.filter("id = 4").select(factors.projected(F.col("a"), s, v, 30)).first()[0]
    assert np.allclose(p, x[4] @ v.T / s * np.sqrt(30))


def test_many_directions_make_no_expressions(spark):
    x = np.random.default_rng(3).standard_normal((20, 300))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)] + [(99, None)], "id long, a array<double>")
    out = factors.projected_rows(df, "id", "a", np.eye(300)[::-1])
    got = {r.id: r.a for r in out.collect()}
    assert got.pop(99) is None and all(np.array_equal(got[i], x[i][::-1]) for i in range(20))
    plan = registry.queries()["s9_factor_cache"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


@pytest.mark.parametrize("held", [1 << 26, 100])
def test_sums_of_named_vectors(spark, monkeypatch, held):
    """In one part and in many; repeated uses, keys without and with two vectors; no row is made for each number."""
    monkeypatch.setattr(vectors, "HELD", held)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((9, 5))
    table = spark.createDataFrame([(min(i, 7), list(map(float, r))) for i, r in enumerate(x)] + [(None, [0.0] * 5)], "k long, vec array<double>")
    named = [(i, s, int(k)) for i in range(20) for s in (1, 2) for k in rng.integers(0, 12, i % 5)]
    out = vectors.summed(spark.createDataFrame(named, "id long, side int, k long"), table, ["id", "side"], "k")
    want = {}
    for i, s, k in named:
        if k < 8:
            want[i, s] = want.get((i, s), 0) + (x[7] + x[8] if k == 7 else x[k])
    got = {(r.id, r.side): r.v for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_transport_of_long_texts_in_little_time():
    """Against duality: prices that no way undercuts, whose worth is the cost; ties and equal amounts as well."""
    import time

    rng = np.random.default_rng(11)
    began, problems = time.process_time(), 0
    for k in range(30):
        n, m = (int(x) for x in rng.integers(40, 90, 2))
        x, y = rng.standard_normal((n, 64)), rng.standard_normal((m, 64))
        cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)) if k % 3 else rng.integers(0, 3, (n, m)).astype(float)
        supply, demand = np.full(n, m), np.full(m, n)
        got = transport.least_cost(cost, supply, demand)
        assert got >= (cost.min(1) * supply).sum() - 1e-6 and got >= (cost.min(0) * demand).sum() - 1e-6
        assert got == pytest.approx(transport.least_cost(cost.T, demand, supply), rel=1e-9)
        order = rng.permutation(n)
        assert got == pytest.approx(transport.least_cost(cost[order], supply[order], demand), rel=1e-9)
        problems += 3
    assert (time.process_time() - began) / problems < 0.1
