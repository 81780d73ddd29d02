"""N-grams of pairs: counts, Jaccard variants, TF-IDF distances.

What is asked of each pair alone is computed from packed grams in batches: one pass counts the texts with each gram, a second one
holds the frequent grams and measures. Where those are too many to hold, and where counts themselves are asked for, grams are exploded and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.functions.constants import STOP_WORDS

#: Signs of a gram that are packed in one number, and bits of each: a code point has 21.
SIGNS, BITS = 3, 21
#: Most frequent grams that tasks hold, grams counted before they are handed on, and rows of texts that are Python objects at once.
MOST_HELD, COUNTED, SLICE = 4_000_000, 1 << 21, 256


def _dealt(df: DataFrame) -> DataFrame:
    """Texts dealt by their pair, so that what is counted for each text or pair needs no exchange of grams."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), "id")


def _texts(df: DataFrame) -> DataFrame:
    """(id, t1, t2) of lower-cased texts with single spaces, rows of an id together."""
    return _dealt(df.select("id", *[F.regexp_replace(F.lower(F.col(f"question{k}")), r"\s+", " ").alias(f"t{k}") for k in (1, 2)])).sortWithinPartitions("id")


def _by_id(batches):
    """(ids, number of each row's id, texts 1, texts 2) of some rows; an id's rows come at once."""
    ids, one, two = [], [], []
    for whole in batches:
        for b in (whole.slice(i, SLICE) for i in range(0, len(whole), SLICE)):
            ids += b.column("id").to_pylist()
            one += b.column("t1").to_pylist()
            two += b.column("t2").to_pylist()
            n = next((i for i in range(len(ids), 0, -1) if ids[i - 1] != ids[-1]), 0)  # the last id may go on
            if n:
                yield ids[:n], one[:n], two[:n]
                ids, one, two = ids[n:], one[n:], two[n:]
    if ids:
        yield ids, one, two


def _packed(texts: list, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, packed gram, count) of the grams of texts with these numbers, sorted."""
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    most = max(len(codes) - n + 1, 0)
    gram = np.zeros(most, np.int64)
    for k in range(n):
        gram = gram << BITS | codes[k:k + most]
    inside = text[:most] == text[n - 1:n - 1 + most]
    gram, row = gram[inside], number[text[:most][inside]]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    return row[starts], gram[starts], np.diff(starts, append=len(gram))


def _numbers(ids: list) -> tuple[list, np.ndarray]:
    """The distinct ids, and each row's place among them; equal ones stand together."""
    new = np.array([True] + [a != b for a, b in zip(ids, ids[1:])])
    return [i for i, first in zip(ids, new) if first], np.cumsum(new) - 1


def packed_frequent(df: DataFrame, n: int, least: int) -> DataFrame:
    """(gram, df): packed grams in at least ``least`` texts, each text once."""

    def each(batches):
        kept, size = [], 0

        def counted():
            gram, df = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(df.astype(np.int64))], names=["gram", "df"])

        for ids, *sides in _by_id(batches):
            _, number = _numbers(ids)
            for t in sides:
                kept.append(_packed(t, number, n)[1])
                size += len(kept[-1])
            if size >= COUNTED:
                yield counted()
                kept, size = [], 0
        if kept:
            yield counted()

    return _texts(df).mapInArrow(each, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).filter(F.col("df") >= least)


def _measured(df: DataFrame, n: int, least: int, schema: str, measure) -> DataFrame | None:
    """What ``measure(ids, (row, place, count) of both sides, df of each place)`` gives for pairs, by frequent grams; None if those are too many to hold."""
    if n > SIGNS:
        return None
    got = packed_frequent(df, n, least).limit(MOST_HELD + 1).toArrow()
    if len(got) > MOST_HELD:
        return None
    gram, times = got.column("gram").to_numpy(), got.column("df").to_numpy()
    order = np.argsort(gram)
    shared = df.sparkSession.sparkContext.broadcast((gram[order], times[order]))

    def each(batches):
        gram, times = shared.value
        for ids, *sides in _by_id(batches):
            ids, number = _numbers(ids)
            found = []
            for t in sides:
                row, own, count = _packed(t, number, n)
                at = np.minimum(np.searchsorted(gram, own), max(len(gram) - 1, 0))
                there = gram[at] == own if len(gram) else np.zeros(len(own), bool)
                found.append((row[there], at[there], count[there]))
            yield from measure(pa.array(ids, pa.int64()), found, times)

    return _texts(df.withColumn("id", F.col("id").cast("long"))).mapInArrow(each, schema)


def _both(found, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, a, b): both sides' counts of each gram that one of them has."""
    row, at = (np.concatenate([s[i] for s in found]) for i in (0, 1))
    key, places = np.unique(row * max(total, 1) + at, return_inverse=True)
    a, b = (np.zeros(len(key), np.int64) for _ in range(2))
    first = len(found[0][0])
    a[places[:first]], b[places[first:]] = found[0][2], found[1][2]
    return key // max(total, 1), key % max(total, 1), a, b


def pair_jaccards(df: DataFrame, n: int, least: int) -> DataFrame:
    """``jaccards`` of the pairs' grams of ``n`` signs in at least ``least`` texts."""

    def measure(ids, found, times):
        row, _, a, b = _both(found, len(times))
        k = np.unique(row)
        low, high, both = (np.bincount(row, x, len(ids))[k] for x in (np.minimum(a, b), np.maximum(a, b), a + b))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(low / both), pa.array(low / high)], names=["id", "all_jaccard", "jaccard_max"])

    out = _measured(df, n, least, "id long, all_jaccard double, jaccard_max double", measure)
    return jaccards(c := grams(df, n), frequent(c, least)) if out is None else out


def pair_tfidf_distances(df: DataFrame, n: int, least: int, texts: int) -> DataFrame:
    """``tfidf_distances`` of the pairs' grams of ``n`` signs in at least ``least`` texts."""

    def measure(ids, found, times):
        row, at, a, b = _both(found, len(times))
        idf = np.log((1 + texts) / (1 + times[at])) + 1
        k = np.unique(row)
        xy, xx, yy = (np.bincount(row, x, len(ids))[k] for x in (a * b * idf * idf, (a * idf) ** 2, (b * idf) ** 2))
        some = (xx > 0) & (yy > 0)
        cosine = np.divide(xy, np.sqrt(xx * yy), out=np.zeros(len(k)), where=some)
        far = np.sqrt(np.maximum(np.where(some, 2 - 2 * cosine, 1.0), 0.0))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(np.where(some, 1 - cosine, 0.0)), pa.array(far)], names=["id", "cosine", "euclidean"])

    out = _measured(df, n, least, "id long, cosine double, euclidean double", measure)
    return tfidf_distances(c := grams(df, n), frequent(c, least), texts) if out is None else out


def text_tfidf_norms(df: DataFrame, n: int, least: int, texts: int) -> DataFrame:
    """(id, side, norm): lengths of the texts' TF-IDF rows, of grams of ``n`` signs in at least ``least`` texts."""

    def measure(ids, found, times):
        for side, (row, at, count) in enumerate(found, 1):
            k = np.unique(row)
            norm = np.sqrt(np.bincount(row, (count * (np.log((1 + texts) / (1 + times[at])) + 1)) ** 2, len(ids))[k])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(np.full(len(k), side, np.int32)), pa.array(norm)], names=["id", "side", "norm"])

    out = _measured(df, n, least, "id long, side int, norm double", measure)
    if out is None:
        c = grams(df, n)
        x = c.join(frequent(c, least), "gram").withColumn("x", F.col("count") * (F.log((1 + F.lit(texts)) / (1 + F.col("df"))) + 1))
        out = x.groupBy("id", "side").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    return out


def grams(df: DataFrame, n: int) -> DataFrame:
    """(id, side, gram, count) of lower-cased texts with single spaces."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.regexp_replace(F.lower(F.col(f"question{k}")), r"\s+", " ").alias("text")) for k in (1, 2)]))
    chars = F.split("s.text", "(?s)(?<=.)(?=.)")
    one = _dealt(df).select("id", sides.alias("s")).filter(F.length("s.text") >= n).select("id", "s.side", chars.alias("chars"))
    runs, most = F.col("chars"), F.size("chars") - n + 1
    for k in range(2, n + 1):  # shifted copies side by side: linear in the text
        runs = F.zip_with(F.slice(runs, 1, most), F.slice("chars", k, most), lambda a, b: F.concat(a, b))
    return one.select("id", "side", F.explode(runs).alias("gram")).groupBy("id", "side", "gram").agg(F.count("*").alias("count"))


def word_grams(df: DataFrame, least: int, most: int, stop_words: bool = False, binary: bool = False) -> DataFrame:
    """(id, side, gram, count) of runs of ``least`` to ``most`` words of two letters, digits or underscores and more; ``binary`` counts a gram once."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.regexp_extract_all(F.lower(F.col(f"question{k}")), F.lit(r"\b\w\w+\b"), F.lit(0)).alias("words")) for k in (1, 2)]))
    words = F.filter("s.words", lambda w: ~w.isin(*STOP_WORDS)) if stop_words else F.col("s.words")
    one = _dealt(df).select("id", sides.alias("s")).select("id", "s.side", words.alias("words"))
    runs, every = F.col("words"), []
    for k in range(1, most + 1):
        if k > 1:
            room = F.greatest(F.size("words") - k + 1, F.lit(0))
            runs = F.zip_with(F.slice(runs, 1, room), F.slice("words", k, room), lambda a, b: F.concat_ws(" ", a, b))
        if k >= least:
            every.append(runs)
    c = one.select("id", "side", F.explode(F.concat(*every)).alias("gram")).groupBy("id", "side", "gram").agg(F.count("*").alias("count"))
    return c.withColumn("count", F.lit(1).cast("long")) if binary else c


def combined(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, gram, diff, both): absolute difference and product of the two sides' counts, where one of them has the gram."""
    return by_pair(counts, vocabulary).select("id", "gram", F.abs(F.col("a") - F.col("b")).cast("long").alias("diff"), (F.col("a") * F.col("b")).cast("long").alias("both"))


def frequent(counts: DataFrame, least: int) -> DataFrame:
    """Grams in at least ``least`` texts, each text once."""
    return counts.groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= least)


def by_pair(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, gram, a, b): both sides' counts, one pass without a self-join."""
    c = counts.join(vocabulary, "gram")
    return c.groupBy("id", "gram", "df").agg(F.sum(F.when(F.col("side") == 1, F.col("count")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 2, F.col("count")).otherwise(0)).alias("b"))


def jaccards(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """all_jaccard: sum of least over sum of both; jaccard_max: over sum of greatest."""
    low, high = F.sum(F.least("a", "b")), F.sum(F.greatest("a", "b"))
    return by_pair(counts, vocabulary).groupBy("id").agg(F.try_divide(low, F.sum(F.col("a") + F.col("b"))).alias("all_jaccard"), F.try_divide(low, high).alias("jaccard_max"))


def tfidf_distances(counts: DataFrame, vocabulary: DataFrame, texts: int) -> DataFrame:
    """Cosine distance and Euclidean distance of L2-normed TF-IDF rows, with smoothed idf."""
    idf = F.log((1 + F.lit(texts)) / (1 + F.col("df"))) + 1
    x = by_pair(counts, vocabulary).withColumn("x", F.col("a") * idf).withColumn("y", F.col("b") * idf)
    s = x.groupBy("id").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"))
    both = (F.col("xx") > 0) & (F.col("yy") > 0)
    cosine = F.when(both, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0)
    return s.select("id", F.when(both, 1 - cosine).otherwise(0.0).alias("cosine"), F.sqrt(F.greatest(F.when(both, 2 - 2 * cosine).otherwise(F.lit(1.0)), F.lit(0.0))).alias("euclidean"))
