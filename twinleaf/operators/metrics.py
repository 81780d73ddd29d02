"""Quality of scores: frames (id, y, p, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinleaf.operators import ordering
from twinleaf.operators.durable import durable


def log_loss(df: DataFrame, weight: str | None = None) -> DataFrame:
    p = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    w = F.col(weight) if weight else F.lit(1.0)
    return df.agg((F.sum(w * loss) / F.sum(w)).alias("log_loss"))


def _cumulated(df: DataFrame, weight: str | None) -> DataFrame:
    """One row for each score, from the highest, with weights of both classes at and above it."""
    w = F.col(weight) if weight else F.lit(1.0)
    ties = df.groupBy("p").agg(F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg"))
    return ordering.cumulated(ties.withColumn("down", -F.col("p")), ["down"], {"tp": "pos", "fp": "neg"}).drop("down")


def roc_curve(df: DataFrame, weight: str | None = None) -> DataFrame:
    c = durable(_cumulated(df, weight))
    totals = c.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return c.join(F.broadcast(totals)).select("p", F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"))


def auc(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half."""
    return _cumulated(df, weight).agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def reliability(df: DataFrame, bins: int = 20, weighted: bool = False) -> DataFrame:
    """Mean score and label in runs of floor(n / bins) + 1 rows by score; empty trailing bins don't appear."""
    df = durable(df)
    n = df.count() // bins
    w = F.col("w") if weighted else F.lit(1.0)
    b = ordering.numbered(df, ["p", "id"], "row").withColumn("bin", F.floor(F.col("row") / (n + 1)))
    return b.groupBy("bin").agg((F.sum(w * F.col("p")) / F.sum(w)).alias("mean_p"), (F.sum(w * F.col("y")) / F.sum(w)).alias("mean_y"), F.count("*").alias("rows"))


def top_errors(df: DataFrame, label: int, most: int = 100) -> DataFrame:
    """The negatives with the highest scores (label 0), or positives with the lowest (label 1)."""
    order = [F.desc("p"), F.desc("id")] if label == 0 else [F.asc("p"), F.asc("id")]
    return df.filter(F.col("y") == label).orderBy(*order).limit(most).select("id", "y", "p")


def stratified_folds(df: DataFrame, folds: int = 10) -> DataFrame:
    """Runs of nearly equal length by id within each label, the longer ones first."""
    labels = df.groupBy("y").agg(F.count("*").alias("of")).withColumn("start", F.coalesce(F.sum("of").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = ordering.numbered(df, ["y", "id"], "row").join(F.broadcast(labels), "y").withColumn("row", F.col("row") - F.col("start"))  # a row for each label
    short, longer = F.floor(F.col("of") / folds), F.col("of") % folds
    head = longer * (short + 1)
    fold = F.when(F.col("row") < head, F.floor(F.col("row") / (short + 1))).otherwise(longer + F.floor(F.try_divide(F.col("row") - head, short)))
    return r.withColumn("fold", fold.cast("int")).drop("row", "of", "start")
