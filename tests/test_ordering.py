from pyspark.sql import functions as F

from twinleaf.operators import metrics, ordering


def test_orders_across_parts(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise(F.lit("b")).alias("g"))
    assert [(r.k, r.n) for r in ordering.numbered(df, ["k"], "n").orderBy("k").collect()] == [(k, k) for k in range(1000)]
    rows = sorted((r.g, r.k, r.n) for r in ordering.numbered(df, ["g", "k"], "n").collect())
    assert [n for _, _, n in rows] == list(range(1000))
    sums = ordering.cumulated(df, ["k"], {"s": "k"}).collect()
    assert all(r.s == r.k * (r.k + 1) // 2 for r in sums)
    assert all(r.p == r.k - 1 for r in ordering.previous(df, "k", "p", -1).collect())


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(5,)], "k long")
    assert [tuple(r) for r in ordering.previous(one, "k", "p", -1).collect()] == [(5, -1)]
    assert ordering.numbered(one.filter("k < 0"), ["k"], "n").count() == 0


def test_folds_are_ntile(spark):
    df = spark.range(23).select("id", F.lit(1).alias("y")).union(spark.range(7).select("id", F.lit(0)))
    got = metrics.stratified_folds(df).groupBy("y", "fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in got if r.y == 1) == [(k, 3 if k < 3 else 2) for k in range(10)]
    assert sorted((r.fold, r["count"]) for r in got if r.y == 0) == [(k, 1) for k in range(7)]
