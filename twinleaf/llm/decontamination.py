"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A fixed mask names the token positions that a hash covers and those that it ignores, so
a hit survives substitutions at ignored positions. Hashes of all training positions meet
those of the benchmark; around each hit, a window of ``WINDOW`` aligned tokens (the whole item
where it is shorter) must agree in at least ``SHARE`` of its tokens. The check is made
in the row of the hit, from its neighbouring tokens, so no text is shuffled.

No pair that the rule accepts is missed: for any two substitutions in a window, the mask has a
place in it that touches neither. Items shorter than a window are cut into one
part more than the substitutions allowed, so that one part at least is equal; seeds of
the parts' lengths are taken from texts only where the benchmark has such items.

A benchmark seed carries its neighbouring tokens only, and equal seeds with equal neighbours of one item are one, so that an item
of repeated tokens has few. They are broadcast while they take at most ``BROADCAST_BYTES``. Beyond
that, narrow (row, position, seed) rows are joined by shuffle, and tokens are fetched for the hits found.

Defined cases: tokens are runs of letters and digits of any script, in lower case; null and empty texts
have no hits; very long texts are taken whole; items of up to four tokens are found only whole; repeated rows, and tied windows, give the same pair once;
empty tables give no rows; other columns are kept by ``keep_clean`` and ignored by
``find``; rows without doc_id are found under a null doc_id, and ``keep_clean`` judges each of them by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinleaf.llm.common import spread, with_ids

#: 1 is a position that counts, 0 one that is ignored.
MASK = "11010011"
WINDOW, SHARE = 13, 80
REACH = WINDOW - len(MASK)
#: What parts tokens: all characters other than letters and digits; the ASCII ones are told first, as most are.
SEPARATORS = r"[\x00-/:-@\[-`{-\x7f[^\x00-\x7f\p{L}\p{N}]]+"
BROADCAST_BYTES = 64 << 20


def _tokens(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _parts(size: int) -> list[tuple[int, int]]:
    """(first token, length) of the parts of a short item: one more than the tokens that may differ."""
    n = size - -(-size * SHARE // 100) + 1
    ends = [k * size // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _seed(mask: str, at: Column) -> Column:
    """The mask's hash at ``at``, beginning with its number; null where it does not end within the text."""
    seed = F.xxhash64(F.lit(int(mask, 2)), *[F.get("hashes", at + i) for i, c in enumerate(mask) if c == "1"])
    return F.when(at + len(mask) <= F.size("hashes"), seed)


def _seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """Explode ``hashes`` to (at, seed) rows.

    Positions are exploded first and seeds taken after that, within generated code.
    """
    last = F.size("hashes") - min(map(len, masks))
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    one = df.select("*", F.explode(starts).alias("at"))
    if len(masks) == 1:
        return one.select("*", _seed(masks[0], F.col("at")).alias("seed"))
    return one.select("*", F.explode(F.array(*[_seed(m, F.col("at")) for m in masks])).alias("seed")).filter("seed IS NOT NULL")


def _hits(docs: DataFrame, items: DataFrame, masks: list[str], near: int) -> DataFrame:
    """Rows of ``docs`` at seeds of ``items`` (item_id, near, offset, width, seed): doc_id, hashes, at and the item's columns."""
    items = items.select("item_id", "near", "offset", "width", "seed").filter("seed IS NOT NULL").distinct()
    if items.count() * (8 * near + 64) <= BROADCAST_BYTES:
        return _seeds(docs, masks).join(F.broadcast(items), "seed")
    words = F.array_join(F.transform("hashes", lambda h: h.cast("string")), ",")
    row = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), words).cast("binary")))
    docs = docs.withColumn("row", row)
    found = _seeds(docs, masks).select("row", "at", "seed").join(items, "seed").drop("seed").distinct()
    return found.join(docs, "row")


def _matched(width: Column, starts: Column) -> Column:
    """The most tokens that agree in a window of ``width`` of the item's near tokens that begins at one of ``starts``.

    Higher-order functions run outside generated code, for the few hits alone: spelt out,
    they made the loop over all positions too large a method to be compiled.
    """
    first = F.col("at") - F.col("offset")
    outside = F.lit(-100)  # a token that the item doesn't have: no window may hold it
    same = F.transform("near", lambda t, k: F.when(t.isNull(), outside).otherwise(F.coalesce(F.get("hashes", first + k) == t, F.lit(False)).cast("int")))
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(same, s + 1, width), F.lit(0), lambda acc, v: acc + v)))


def _find_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hits in items of at least ``WINDOW`` tokens."""
    near = REACH + WINDOW  # tokens from REACH before the seed on, null outside the item
    around = F.array(*[F.get("hashes", F.col("at") + i) for i in range(-REACH, WINDOW)])
    items = _seeds(items, [MASK]).select("item_id", around.alias("near"), F.lit(REACH).alias("offset"), F.lit(WINDOW).alias("width"), "seed")
    return _hits(docs, items, [MASK], near).select("doc_id", "item_id", _matched(F.lit(WINDOW), F.sequence(F.lit(0), F.lit(REACH))).alias("matched"), "width")


def _find_whole(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Hits in items shorter than ``WINDOW``, which have one of ``sizes`` tokens."""
    lengths = sorted({n for size in sizes for _, n in _parts(size)})
    masks = {n: "1" * n for n in lengths}
    parts = [F.when(F.size("hashes") == size, F.array(*[F.struct(F.lit(a).alias("at"), _seed(masks[n], F.lit(a)).alias("seed")) for a, n in _parts(size)])) for size in sizes]
    items = items.select("item_id", "hashes", F.explode(F.coalesce(*parts)).alias("p")).select("item_id", F.col("hashes").alias("near"), F.col("p.at").alias("offset"), F.size("hashes").alias("width"), "p.seed")
    return _hits(docs, items, list(masks.values()), max(sizes)).select("doc_id", "item_id", _matched(F.col("width"), F.array(F.lit(0))).alias("matched"), "width")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, matched and width of the best window."""
    docs, items = spread(docs.select("doc_id", "text")).select("doc_id", _tokens(F.col("text")).alias("hashes")), benchmark.select("item_id", _tokens(F.col("text")).alias("hashes"))
    size = F.size("hashes")
    found = _find_windows(docs, items.filter(size >= WINDOW))
    short = items.filter((size > 0) & (size < WINDOW))
    sizes = sorted(r.n for r in short.select(size.alias("n")).distinct().collect())  # fewer than WINDOW
    if sizes:
        found = found.unionByName(_find_whole(docs, short, sizes))
    best = found.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("width").cast("long").alias("width"))
    # After the maximum: before it, the condition would move into the join and out of generated code.
    return best.filter(F.col("matched") * 100 >= F.col("width") * SHARE)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap any item."""
    named = with_ids(docs)
    rows, own = named or (docs, "doc_id")
    clean = rows.join(find(rows, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
    return clean.withColumn("doc_id", F.col(own)).select(docs.columns)
