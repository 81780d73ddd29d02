"""Text-pair inputs: readers with explicit nulls, and pairs derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRAIN_SCHEMA = "id LONG, qid1 LONG, qid2 LONG, question1 STRING, question2 STRING, is_duplicate INT"
TEST_SCHEMA = "test_id LONG, question1 STRING, question2 STRING"


def read_pairs_csv(spark: SparkSession, path: str, schema: str = TRAIN_SCHEMA, fill: str = "nan") -> DataFrame:
    """Quoted CSV with line breaks in fields; null texts become ``fill``."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    return fill_texts(df, fill)


def fill_texts(df: DataFrame, fill: str = "nan") -> DataFrame:
    return df.na.fill(fill, subset=[f.name for f in df.schema.fields if f.dataType.typeName() == "string"])


def write_pairs_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, "[^ -~]+", " ")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as question1 and question2."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", "role", _plain(F.col("text")).alias("question1"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), _plain(F.col("text")).alias("question2"))
    key = F.col("conv_id") * 100 + F.col("turn")
    return a.join(b, ["conv_id", "turn"]).select(key.alias("id"), key.alias("qid1"), (key + 1).alias("qid2"), "question1", "question2", (F.col("role") == "user").cast("int").alias("is_duplicate"))


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with case-preserving words w1, w2, lower-cased q1w, q2w, their sets s1, s2 and those without stop words n1, n2."""
    from twinleaf.functions.constants import STOP_WORDS

    df = pairs(spark, sf_dir)
    for k in "12":
        words = F.filter(F.split(f"question{k}", r"\s+"), lambda w: w != "")
        df = df.withColumn(f"w{k}", words).withColumn(f"q{k}w", F.transform(f"w{k}", F.lower)).withColumn(f"s{k}", F.array_distinct(f"q{k}w"))
        df = df.withColumn(f"n{k}", F.filter(f"s{k}", lambda w: ~w.isin(*STOP_WORDS)))
    return df


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, side, question): both questions of each pair."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"question{k}").alias("question")) for k in (1, 2)]))
    return pairs(spark, sf_dir).select("id", sides.alias("s")).select("id", "s.*")


def graph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, u, v): the parts of an order's first two lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("u"))
    b = li.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("v"))
    return a.join(b, "id").distinct()


#: Neighbouring documents whose words meet in one group of a window.
RUN = 64


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p, w): a score between 0.01 and 0.99 for neighbouring documents, label and class weight.

    Only labelled documents and those next to them are dealt, once each: runs of neighbours meet,
    and the first of a run goes to the one before as well.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    used = labels.select("doc_id").union(labels.select(F.col("doc_id") + 1)).distinct()
    words = F.array_distinct(F.filter(F.split(F.regexp_replace("text", "[^ -~]+", " "), " +"), lambda w: w != ""))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(used, "doc_id", "left_semi").select("doc_id", F.array_join(words, " ").alias("a"))
    run = F.floor(F.col("doc_id") / RUN)
    runs = F.when(F.pmod("doc_id", F.lit(RUN)) == 0, F.array(run, run - 1)).otherwise(F.array(run))
    after = F.collect_list(F.struct("a")).over(Window.partitionBy("run").orderBy("doc_id").rangeBetween(1, 1))
    # the join asks for as many tasks as shuffles have: long rows, costly to compare
    met = d.select("doc_id", "a", F.explode(runs).alias("run")).withColumn("after", after).filter(F.col("run") == run)
    both = met.select("doc_id", F.split("a", " ").alias("a"), F.explode("after").alias("b")).select("doc_id", F.filter("a", lambda w: w != "").alias("a"), F.filter(F.split("b.a", " "), lambda w: w != "").alias("b"))
    both = both.select("doc_id", F.size("a").alias("m"), F.size("b").alias("n"), F.size(F.array_intersect("a", "b")).alias("both"))
    p = F.col("both") / F.greatest(F.col("m") + F.col("n") - F.col("both"), F.lit(1))
    w = F.when(F.col("y") == 1, F.lit(0.472)).otherwise(F.lit(1.309))
    return both.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y"), F.round(F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99)), 6).alias("p"), w.alias("w"))
