"""Orders over a whole table without one task for all rows: numbers, running sums, previous values.

A bounded sample of keys gives splitters, rows fall into the parts between them, and what the
parts before hold (a row for each part) is added to a window inside each part. Keys are unique,
so that no part outgrows the others; nulls come first. The input is written once, as it is passed three times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinleaf.operators.durable import durable

#: Parts of an order, and keys sampled to find their splitters.
PARTS, SAMPLE = 64, 4096


def _part(df: DataFrame, key: list[str], parts: int) -> Column:
    """The number of the row's part."""
    kinds = dict(df.dtypes)
    found = df.select(*key).na.drop().orderBy(F.xxhash64(*key), *key).limit(SAMPLE).collect()  # bounded by SAMPLE
    found = sorted(tuple(r) for r in found)
    bounds = [found[i * len(found) // parts] for i in range(1, parts)] if len(found) >= parts else []
    if not bounds:
        return F.lit(0)
    own = F.struct(*[F.col(k).alias(k) for k in key])
    split = [F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(key, b)]) for b in bounds]

    def between(lo: int, hi: int) -> Column:
        """How many splitters are at most the key, known to be from lo to hi: halved at each step, within generated code."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(own < split[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(split))


def _by_part(df: DataFrame, *aggregates: Column) -> dict[int, tuple]:
    """What each part holds: at most as many rows as there are parts."""
    return {r[0]: tuple(r)[1:] for r in df.groupBy("_part").agg(*aggregates).collect()}


def _looked_up(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_part") + 1)


def cumulated(df: DataFrame, key: list[str], sums: dict[str, str | Column], parts: int = PARTS) -> DataFrame:
    """Add each sum of ``sums`` (name: value) over all rows up to this one, in the order of ``key``."""
    values = {f"_{name}": F.col(v) if isinstance(v, str) else v for name, v in sums.items()}
    df = durable(df)
    df = df.withColumns({"_part": _part(df, key, parts)} | values)
    held = _by_part(df, *[F.sum(v) for v in values])
    inside = Window.partitionBy("_part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({name: F.sum(f"_{name}").over(inside) for name in sums})
    kinds, added = dict(out.dtypes), {}
    for i, name in enumerate(sums):
        before = [sum(held[q][i] or 0 for q in held if q < p) for p in range(parts)]
        added[name] = F.col(name) + _looked_up(before, kinds[name])
    return out.withColumns(added).drop("_part", *values)


def numbered(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 in the order of ``key``."""
    return cumulated(df, key, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))


def previous(df: DataFrame, key: str, name: str, default, parts: int = PARTS) -> DataFrame:
    """Add the value of ``key`` in the row before, ``default`` in the first."""
    df = durable(df)
    df = df.withColumn("_part", _part(df, [key], parts))
    held = _by_part(df, F.max(key))
    last = [max((held[q][0] for q in held if q < p), default=None) for p in range(parts)]
    lag = F.lag(key).over(Window.partitionBy("_part").orderBy(key))
    return df.withColumn(name, F.coalesce(lag, _looked_up(last, dict(df.dtypes)[key]), F.lit(default))).drop("_part")
