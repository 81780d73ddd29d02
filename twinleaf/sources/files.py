"""Readers and writers of word vectors, feature groups, submissions, errors, quality records and models."""

from __future__ import annotations

import gzip
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) from lines of a word and its numbers; a head line of two numbers is left out."""
    parts = F.split(F.rtrim("value"), " ")
    df = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("vec"))
    return df.filter(F.size("vec") > 1)


def read_binary_vectors(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """(word, vec) from the binary format: a head line of count and length, then words and 32-bit numbers.

    The format can't be split, so one task streams it in batches of ``rows``; write the result as Parquet
    before use. ``path`` must be a file that executors can open.
    """
    schema = pa.schema([("word", pa.string()), ("vec", pa.list_(pa.float64()))])

    def each(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                with (gzip.open if p.endswith(".gz") else open)(p, "rb") as f:
                    n, d = map(int, f.readline().split())
                    words, vecs = [], []
                    for i in range(n):
                        word = bytearray()
                        while (c := f.read(1)) not in (b" ", b""):
                            word += c
                        words.append(word.decode("utf-8", "replace").lstrip("\n"))
                        vecs.append(np.frombuffer(f.read(4 * d), "<f4").astype(float))
                        if len(words) == rows or i == n - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(words, schema.field(0).type), pa.array(vecs, schema.field(1).type)], schema=schema)
                            words, vecs = [], []

    return spark.createDataFrame([(path,)], "path string").mapInArrow(each, "word string, vec array<double>")


def write_group(df: DataFrame, folder: str, group: str) -> None:
    """One keyed Parquet table for each feature group."""
    df.write.mode("overwrite").parquet(f"{folder}/{group}.parquet")


def read_groups(spark: SparkSession, folder: str, groups: dict[str, list[str]], key: str = "id", enabled=None) -> DataFrame:
    """The named features of each group (those ``enabled``, if given), joined by key; features are named group_feature."""
    parts = [spark.read.parquet(f"{folder}/{g}.parquet").select(key, *[F.col(f).alias(f"{g}_{f}") for f in fs]) for g, fs in groups.items() if enabled is None or g in enabled]
    if not parts:
        raise ValueError("no feature group is enabled")
    return reduce(lambda a, b: a.join(b, key, "left"), parts)


def read_kcores(spark: SparkSession, path: str) -> DataFrame:
    """(question, kcores) from CSV; of several lines of one question, in lower case, the last one counts."""
    df = spark.read.csv(path, schema="question string, kcores long", header=True, escape='"')
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return df.select(F.lower("question").alias("question"), "kcores", line.alias("line")).groupBy("question").agg(F.max_by("kcores", "line").alias("kcores"))


def with_kcores(pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """Both questions' core numbers, 0 where unknown."""
    for k in "12":
        one = cores.select(F.col("question").alias(f"_q{k}"), F.col("kcores").alias(f"kcores{k}"))
        pairs = pairs.withColumn(f"_q{k}", F.lower(f"question{k}")).join(one, f"_q{k}", "left").drop(f"_q{k}").withColumn(f"kcores{k}", F.coalesce(f"kcores{k}", F.lit(0)))
    return pairs


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; ``make()`` gives it where there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_feature_map(spark: SparkSession, names: list[str], path: str) -> None:
    """Number, name and kind (q: a quantity) of each feature, tab separated."""
    spark.createDataFrame([(f"{i}\t{n}\tq",) for i, n in enumerate(names)], "line string").coalesce(1).write.mode("overwrite").text(path)


def read_feature_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="at int, name string, kind string")


def write_model_dump(spark: SparkSession, model, path: str) -> None:
    """The trees of a model as lines of text."""
    spark.createDataFrame([(line,) for line in model.toDebugString.splitlines()], "line string").coalesce(1).write.mode("overwrite").text(path)


def write_submission(df: DataFrame, path: str, key: str = "test_id", score: str = "p") -> None:
    df.select(F.col(key).alias("test_id"), F.col(score).alias("is_duplicate")).write.mode("overwrite").csv(path, header=True)


def write_errors(df: DataFrame, path: str) -> None:
    """Scored rows with their texts; texts are quoted, so that commas don't break rows."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_record(df: DataFrame, path: str) -> None:
    """Quality or progress as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """``kind`` is the fitted model's class."""
    return kind.load(path)
