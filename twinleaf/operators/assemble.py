"""Assembly of feature tables by key, mirrored copies and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.functions.constants import CLASS_WEIGHTS


def attached(base: DataFrame, *groups: DataFrame, key: str = "id") -> DataFrame:
    """Left joins by key, never by position."""
    for g in groups:
        base = base.join(g, key, "left")
    return base


def flipped(df: DataFrame, swaps: list[tuple[str, str]]) -> DataFrame:
    """``df`` and its mirror image; ``swaps`` are checked against the columns. Split before this, lest mirrored rows leak."""
    to = {a: b for pair in swaps for a, b in (pair, pair[::-1])}
    if missing := sorted(set(to) - set(df.columns)):
        raise ValueError(f"no such columns: {missing}")
    mirror = df.select(*[F.col(to.get(c, c)).alias(c) for c in df.columns])
    return df.withColumn("mirrored", F.lit(0)).unionByName(mirror.withColumn("mirrored", F.lit(1)))


def class_weight(label: str = "is_duplicate"):
    w = F.lit(None).cast("double")
    for k, v in CLASS_WEIGHTS.items():
        w = F.when(F.col(label) == k, F.lit(v)).otherwise(w)
    return w
