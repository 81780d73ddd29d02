"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base detectors (``email``, ``ip``, ``card``, ``phone``) find leftmost matches and drop those that
fail their test. High-recall generators propose more spans, which may overlap; boosted trees score
each by format and context, and those above their kind's calibrated threshold that overlap no
base span are added.

What the trees learn is not the base detectors' verdict. At most ``SPANS`` base spans of the table (distinct ones, smallest
hashes first) are rewritten in forms that the base patterns miss (signs spelt out, a wrong digit, other separators,
no country code) and set between words from elsewhere in a document: these are the positives.
Look-alikes (dates, versions, amounts, book and order numbers, tokens, coordinates) set in the same places are the
negatives. Candidates that a base span overlaps take no part. Spans of one hash fifth are kept apart, and each kind's
threshold lies below the least margin from which on ``PRECISION`` of its candidates there are positives. The trees are grown on the driver and
applied as SQL expressions within the row: nothing is shuffled but the sampled spans.

Defined cases: null and empty texts have no spans; very long texts are scanned whole; repeated rows
are scanned each; ties of margin stand together; an empty table gives no rows, and a kind with fewer than ``ENOUGH`` positives kept apart gets
no span added; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinleaf.llm.common import spread

#: Spans that training rewrites, and how many of them one document gives at most.
SPANS, EACH = 1200, 8
PRECISION, ENOUGH = 0.99, 5
KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that a long run of their characters is passed once.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High-recall generators, by the kind that they propose.
GENERATORS = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,64}){0,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?<![0-9])[0-9]{1,4}(?:[.,][0-9]{1,4}){3}",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,22}",
    "phone": r"(?<![0-9])\(?[0-9]{2,4}\)?[ .-][0-9](?:[ ().-]{0,2}[0-9]){5,11}",
}
#: Words before a span that speak for its kind.
HINTS = {"email": "mail|contact|write", "ip": "address|host|server|ip", "card": "card|visa|credit|account|pay", "phone": "phone|tel|call|fax|mobile"}


EMPTY = "array<struct<s:int,e:int,m:string>>"


def _with_matches(df: DataFrame, patterns: dict[str, str], hold) -> DataFrame:
    """Add ``_m0``, ``_m1`` ...: array<struct<s,e,m>> of each kind's matches, in code points.

    What several expressions need is a column of an own projection, so that each pattern passes a text twice at most,
    and once where it has no match. Positions are summed up in blocks of about the root of their number, so that no long array is copied for each match.
    """
    empty = F.array().cast(EMPTY)

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + x.gap
        end = start + F.length(x.found)
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(F.struct(start.alias("s"), end.alias("e"), x.found.alias("m")))).alias("out"))

    def joined(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc.at.alias("at"), empty.alias("out")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r.at.alias("at"), F.concat(acc.out, r.out).alias("out")))[0]

    def blocks(pairs: str) -> Column:
        width = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / width).cast("int")), lambda i: F.slice(pairs, i * width + 1, width))

    def gaps(k: int, pattern: str) -> Column:
        found = f"_f{k}"
        return F.when(F.size(found) > 0, F.zip_with(F.slice(F.split("text", pattern, -1), 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("found"))))

    named = list(enumerate(patterns.items()))
    df = df.withColumns({f"_f{k}": F.when(hold(kind), F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, (kind, p) in named})
    df = df.withColumns({f"_p{k}": gaps(k, p) for k, (_, p) in named})
    df = df.withColumns({f"_m{k}": F.when(F.col(f"_p{k}").isNotNull(), F.aggregate(blocks(f"_p{k}"), F.struct(F.lit(0).alias("at"), empty.alias("out")), joined, lambda acc: acc.out)).otherwise(empty) for k, _ in named})
    return df.drop(*[f"_{x}{k}" for x in "fp" for k, _ in named])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def value(i: Column) -> Column:
        n = F.substring(d, i + 1, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _placed(k: int, x: Column, /) -> Column:
    return F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e"))


def _valid(kind: str, x: Column, /) -> Column:
    m = x.m
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _hold(kind: str) -> Column:
    """A cheap test that must hold for any match."""
    return F.contains("text", F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else F.col("text").rlike("[0-9]")


def _of(k: int, x: Column, /) -> Column:
    return x.k == k


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: array<struct<s,k,e>> by start, then kind."""
    out = _with_matches(docs, BASE, _hold)
    kept = [F.transform(F.filter(f"_m{k}", partial(_valid, kind)), partial(_placed, k)) for k, kind in enumerate(KINDS)]
    return out.withColumn("base", F.array_sort(F.concat(*kept))).drop(*[f"_m{k}" for k in range(len(KINDS))])


def _may_hold(kind: str) -> Column:
    """As ``_hold``, for the generators."""
    if kind != "email":
        return F.col("text").rlike("[0-9]")
    return F.contains("text", F.lit("@")) | F.contains("text", F.lit("(at)")) | F.contains("text", F.lit("[at]"))


#: Features of a candidate, in this order.
FEATURES = ("length", "digits", "spaces", "marks", "commas", "letters", "groups", "longest", "shortest_later", "repeats", "lead", "hint", "word_before", "word_after", *KINDS)


def with_candidates(df: DataFrame) -> DataFrame:
    """Add ``cand``: array<struct<s,k,e,f>> of the candidates that no base span overlaps; f holds FEATURES as doubles."""

    def described(k: int, kind: str, x: Column, /) -> Column:
        before = F.lower(F.substring(F.col("text"), F.greatest(x.s - 23, F.lit(1)), F.least(x.s, F.lit(24))))
        after = F.substring(F.col("text"), x.e + 1, F.lit(1))
        digits = _digits(x.m)
        words = F.split(x.m, r"[^A-Za-z0-9]+")
        f = [F.length(x.m), F.length(digits), F.length(F.regexp_replace(x.m, "[^ ]", "")), F.length(F.regexp_replace(x.m, r"[A-Za-z0-9 ]", "")), F.length(F.regexp_replace(x.m, "[^,:]", "")), F.length(F.regexp_replace(x.m, "[^A-Za-z]", "")),
             F.size(words), F.array_max(F.transform(words, F.length)), F.coalesce(F.array_min(F.transform(F.slice(words, 2, 100), F.length)), F.lit(0)), F.length(digits) - F.size(F.array_distinct(F.split(digits, ""))), F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(-1)),
             before.rlike(HINTS[kind]).cast("int"), before.rlike(r"[\p{L}\p{N}_=\"]$").cast("int"), after.rlike(r"[\p{L}\p{N}_\"]").cast("int"),
             *[F.lit(int(k == j)) for j in range(len(KINDS))]]
        return F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e"), F.array(*[v.cast("double") for v in f]).alias("f"))

    out = _with_matches(df, GENERATORS, _may_hold)
    free = [F.filter(f"_m{k}", lambda x: ~F.exists("base", lambda b: _overlaps(b, x))) for k in range(len(KINDS))]
    every = [F.transform(m, partial(described, k, kind)) for (k, kind), m in zip(enumerate(KINDS), free)]
    return out.withColumn("cand", F.concat(*every)).drop(*[f"_m{k}" for k in range(len(KINDS))])


def _overlaps(x: Column, y: Column) -> Column:
    return (x.s < y.e) & (y.s < x.e)


@dataclass
class Boosted:
    """Trees of depth three as (feature, cut, left, right), whose leaves are values; and a threshold for each kind."""

    first: float
    trees: list[tuple]
    thresholds: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.first + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def expression(self, f: Column) -> Column:
        return sum((_column(t, f) for t in self.trees), F.lit(self.first))

    def accepts(self, c: Column) -> Column:
        return self.expression(c.f) >= F.get(F.array(*[F.lit(float(t)) for t in self.thresholds]), c.k)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    feature, cut, left, right = tree
    return np.where(x[:, feature] <= cut, _apply(left, x), _apply(right, x))


def _column(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, cut, left, right = tree
    return F.when(F.get(f, F.lit(feature)) <= cut, _column(left, f)).otherwise(_column(right, f))


def _grow(values: list[np.ndarray], codes: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, shrink: float = 0.3, ridge: float = 1.0):
    """A tree on gradients and curvatures of ``rows``, by exact greedy splits; ``codes`` number each feature's distinct ``values``."""
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    for j, v in enumerate(values if depth else []):
        c = codes[rows, j]
        a, b = np.cumsum(np.bincount(c, g[rows], len(v)))[:-1], np.cumsum(np.bincount(c, h[rows], len(v)))[:-1]
        if len(a):
            gain = a**2 / (b + ridge) + (gs - a) ** 2 / (hs - b + ridge) - gs**2 / (hs + ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] is None:
        return float(-shrink * gs / (hs + ridge))
    low = codes[rows, best[1]] <= best[2]
    return best[1], float(values[best[1]][best[2]]), *(_grow(values, codes, part, g, h, depth - 1, shrink, ridge) for part in (rows[low], rows[~low]))


def boost(x: np.ndarray, y: np.ndarray, kind: np.ndarray, apart: np.ndarray, rounds: int = 30) -> Boosted | None:
    """Train on the rows not ``apart``; those set each kind's threshold. None without both labels."""
    fx, fy = x[~apart], y[~apart]
    if not len(fy) or fy.min() == fy.max():
        return None
    model = Boosted(float(np.log(fy.mean() / (1 - fy.mean()))), [], [np.inf] * len(KINDS))
    margin = np.full(len(fy), model.first)
    parts = [np.unique(column, return_inverse=True) for column in fx.T]
    values, codes = [v for v, _ in parts], np.stack([c for _, c in parts], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(values, codes, np.arange(len(fy)), p - fy, p * (1 - p), 3)
        model.trees.append(tree)
        margin += _apply(tree, fx)
    scores = model.margin(x)
    for k in range(len(KINDS)):
        s, truth = scores[apart & (kind == k)], y[apart & (kind == k)]
        if truth.sum() < ENOUGH:
            continue
        order = np.argsort(-s)
        good = np.cumsum(truth[order]) / np.arange(1, len(order) + 1) >= PRECISION
        good &= np.append(np.diff(s[order]) < 0, True)  # ties stand together
        if good.any():
            last = np.flatnonzero(good)[-1]
            model.thresholds[k] = float(max(s[order][last:last + 2].mean(), 0.0))  # half way to the first one left out
    return model


def _rewritten(k: int, m: Column, n: Column) -> list[Column]:
    """Forms of a base span that the base patterns miss; ``n`` is a number of its own."""
    digits = _digits(m)
    at = F.pmod(n, F.length(digits)) + 1
    wrong = F.concat(F.substring(digits, F.lit(1), at - 1), ((F.substring(digits, at, F.lit(1)).cast("int") + 1 + F.pmod(n, F.lit(8))) % 10).cast("string"), F.substring(digits, at + 1, F.length(digits)))
    cut = lambda d, sign: F.regexp_replace(d, "(.{4})(?=.)", f"$1{sign}")
    plain = F.regexp_replace(m, r"^\+[0-9]{1,3}[ -]?", "")
    return {
        "email": [F.regexp_replace(m, "@", " (at) "), F.regexp_replace(F.regexp_replace(m, "@", "[at]"), r"(?<=\])([A-Za-z0-9-]+)\.", "$1[dot]"), F.regexp_replace(m, "@", " @ "), F.concat(F.regexp_extract(m, "^[^@]+", 0), F.lit("(at)"), F.regexp_replace(F.regexp_extract(m, "[^@]+$", 0), r"\.", " (dot) "))],
        "ip": [F.regexp_replace(m, r"\.", ","), F.regexp_replace(m, r"^([0-9]+)\.", "$1,"), F.concat_ws(":", *[F.lower(F.hex(F.pmod(F.xxhash64(m, F.lit(i)), F.lit(65536)))) for i in range(8)])],
        "card": [wrong, cut(digits, "."), cut(wrong, " "), cut(wrong, "-")],
        "phone": [F.substring(m, F.lit(2), F.length(m)), plain, F.concat(F.lit("00 "), F.substring(m, F.lit(2), F.length(m))), F.regexp_replace(digits, "^(.*)(.{3})(.{3})(.{4})$", "$1.$2.$3.$4")],
    }[KINDS[k]]


def _look_alikes(n: Column) -> list[Column]:
    """Spans of the same characters that are no personal data, by a number."""
    part = lambda i, low, high: (F.pmod(F.xxhash64(n, F.lit(i)), F.lit(high - low)) + low).cast("string")
    two = lambda i, low, high: F.lpad(part(i, low, high), 2, "0")
    year, month, day, hour, minute = part(0, 1950, 2040), two(1, 1, 13), two(2, 1, 29), two(3, 0, 24), two(4, 0, 60)
    many = F.concat(*[part(i, 10**8, 10**9) for i in (5, 6, 7)])
    three = [part(i, 100, 1000) for i in range(8, 12)]
    return [
        F.concat(F.concat_ws("-", year, month, day), F.lit(" "), F.concat_ws(":", hour, minute)), F.concat(F.concat_ws(".", day, month, year), F.lit(" "), hour, minute), F.concat(year, month, day, hour, minute, two(12, 0, 60)), F.concat(F.concat_ws("-", year, year), F.lit(" "), three[0]),
        F.concat_ws(".", part(13, 0, 30), part(14, 0, 100), part(15, 0, 20), part(16, 256, 9999)), F.concat_ws(".", year, month, day, part(17, 0, 100)), F.concat_ws(",", part(18, 1, 100), *three[:3]), F.concat_ws(" ", part(19, 1, 100), *three),
        F.concat_ws("-", F.lit("978"), part(20, 0, 10), two(21, 10, 99), part(22, 10**5, 10**6), part(23, 0, 10)), F.substring(many, 1, 12), F.substring(many, 1, 13), F.substring(many, 1, 21), F.substring(many, 1, 23),
        F.concat(F.lit("token=\""), F.substring(F.hex(n), 1, 7), F.substring(many, 1, 15), F.lit("f\"")), F.concat(F.lit("c"), F.substring(many, 1, 16), F.lit("e")), F.concat(F.concat_ws(".", two(24, 10, 90), part(25, 10**3, 10**4)), F.lit(" "), F.concat_ws(".", part(26, 1, 90), part(27, 10**3, 10**4))),
        F.concat(part(28, 1, 100), F.lit(" @ "), part(29, 1, 1000)), F.lit("seen @ noon"), F.concat(F.lit("at@"), part(30, 1, 100)), F.concat_ws(":", hour, minute, two(31, 0, 60), two(32, 0, 60), two(33, 0, 60)), F.concat_ws(":", *[F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(n, F.lit(i)), F.lit(256))), 2, "0")) for i in range(34, 40)]),
    ]


def planted(docs: DataFrame, spans: int = SPANS) -> DataFrame:
    """(text, lo, hi, kind, y, fold): rewritten base spans (y 1) and look-alikes (y 0) between words of documents; at most ``spans`` base spans give them."""
    # No filter on ``base`` here, nor a plain column to explode below: either would be pushed down with all patterns written out in it.
    rows = with_base(spread(docs.select("text").filter("text IS NOT NULL")))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - 80, F.lit(1))).cast("int") + 1
    each = F.transform(F.slice("base", 1, EACH), lambda b: F.struct(b.k.alias("k"), F.substring(F.col("text"), b.s + 1, b.e - b.s).alias("m")))
    found = rows.select(F.substring(F.col("text"), at, F.lit(80)).alias("around"), F.explode(each).alias("b")).groupBy("b.k", "b.m").agg(F.min("around").alias("around"))
    number = F.xxhash64("k", "m")
    some = found.withColumn("n", number).orderBy("n", "k", "m").limit(spans)
    hint = F.when(F.pmod(F.col("n"), F.lit(4)) == 0, F.get(F.array(*[F.lit(HINTS[kind].split("|")[0] + ": ") for kind in KINDS]), F.col("k"))).otherwise("")
    forms = [F.struct(F.lit(1).alias("y"), F.when(F.col("k") == k, f).alias("form"), hint.alias("hint")) for k in range(len(KINDS)) for f in _rewritten(k, F.col("m"), F.pmod(F.col("n"), F.lit(1 << 30)))]
    forms += [F.struct(F.lit(0).alias("y"), f.alias("form"), F.lit("").alias("hint")) for f in _look_alikes(F.col("n"))]
    x = some.select("k", "n", "around", F.explode(F.array(*forms)).alias("x")).filter("x.form IS NOT NULL")
    before = F.concat(F.substring("around", 1, 40), F.lit(" "), F.col("x.hint"))
    return x.select(F.concat(before, F.col("x.form"), F.lit(" "), F.substring("around", 41, 40)).alias("text"), F.length(before).alias("lo"), (F.length(before) + F.length("x.form")).alias("hi"), F.col("k").alias("kind"), "x.y", F.pmod("n", F.lit(5)).cast("int").alias("fold"))


def labelled(rows: DataFrame) -> DataFrame:
    """(k, f, y, fold) of the candidates of ``planted`` rows that base spans leave: 1 where one is just the rewritten span and of its kind."""
    c = with_candidates(with_base(rows)).select("lo", "hi", "kind", "y", "fold", F.explode(F.filter("cand", lambda c: (c.s < F.col("hi")) & (F.col("lo") < c.e))).alias("c"))
    just = (F.col("c.s") == F.col("lo")) & (F.col("c.e") == F.col("hi"))
    other = F.col("c.k") != F.col("kind")
    y = F.when(F.col("y") == 0, 0).when(other, 0).when(just, 1)  # a part of a rewritten span is neither
    return c.select(F.col("c.k").alias("k"), F.col("c.f").alias("f"), y.alias("y"), "fold").filter("y IS NOT NULL")


def fit(docs: DataFrame, spans: int = SPANS) -> Boosted | None:
    got = sorted((r.fold, r.k, r.y, r.f) for r in labelled(planted(docs, spans)).collect())  # bounded by ``spans``
    x = np.array([r[3] for r in got], float).reshape(-1, len(FEATURES))
    return boost(x, np.array([r[2] for r in got], float), np.array([r[1] for r in got]), np.array([r[0] == 0 for r in got], bool))


def find(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""
    df = with_base(spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    added = F.array().cast("array<struct<s:int,k:int,e:int>>")
    if model is not None and np.isfinite(model.thresholds).any():
        df = with_candidates(df)
        chosen = F.filter("cand", model.accepts)
        added = F.transform(chosen, lambda c: F.struct(c.s.alias("s"), c.k.alias("k"), c.e.alias("e")))
    df = df.select("doc_id", "base", added.alias("added"))

    def shown(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ",")

    counts = [F.size(F.filter("base", partial(_of, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.array_sort(F.array_distinct(F.concat("base", "added")))).alias("spans"))
