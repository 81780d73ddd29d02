"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed twice into one embedding table, and once each by their first six and eight letters, and the rows are added:
a rare word shares all rows with another one hardly ever, and words with one stem share some. Filters of several widths run over
the whole text; the largest response of each filter, over all positions, feeds a logistic unit.
Training takes every labelled row and whole texts. They are dealt by a hash of doc_id to parts of about ``PART_BYTES``, and encoded once.
In each of ``EPOCHS`` rounds every part trains a copy of the model on its rows, and the copies' moves are averaged: each row of the
embedding over the parts that moved it, all else over all parts. Moves are summed as whole numbers of ``UNIT``, so how parts share tasks
changes nothing. The driver holds the model, whose size is fixed, and no texts. A fifth of each part is kept apart; all rows apart set one
threshold for each language, a common one where a language has fewer than ``ENOUGH`` rows of a label there.
The language is guessed from the text's own function words: label, lang, source and
doc_id never enter a score. Scores are shifted so that the threshold stands at 0.5.

Defined cases: null and empty texts have no response and get the model's score of
that; very long texts are scored whole; ties of threshold go to the widest gap; of rows with one doc_id the least text is trained on; a doc_id labelled more than once counts as toxic if any of its labels says so;
null labels are left out; without both labels every score is 0.0;
an empty table gives no rows; repeated rows are scored each; other columns are kept by
``reject`` and ignored by ``score``.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.llm.common import durable, mapped, release, text_bytes
from twinleaf.operators.ordering import cumulated

#: Bytes of text in a part, about; rounds of training, and what its moves are rounded to.
PART_BYTES, EPOCHS, UNIT = 8 << 20, 12, 2.0**-20
#: Moves are summed by so many slices of the embedding.
SLICES = 16
#: Labelled ids that are broadcast; more are joined by an exchange.
IDS = 1 << 20
#: Rows of each label that a language needs for a threshold of its own.
ENOUGH = 20
BUCKETS, DIM, FILTERS, WIDTHS, STEMS = 1 << 18, 8, 8, (1, 2, 3), (6, 8)
#: Documents in a training step; words that are scored together.
BATCH, WORDS = 16, 1 << 16

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as by this be are at".split(),
    "fr": "le la les des du et est que qui pour dans un une sur par pas il elle".split(),
    "de": "der die das und ist nicht ein eine zu den mit von sich auf dem im".split(),
    "es": "el la los las de y que en un una por con para es su del se no".split(),
}
WORD = re.compile(r"[^\W_]+")


#: For each function word, a bit for each language that has it.
_LIKELY = {w: sum(1 << i for i, known in enumerate(FUNCTION_WORDS.values()) if w in known) for words in FUNCTION_WORDS.values() for w in words}


#: For each length of stems, what its name adds to a hash.
_NAMED = [(n, zlib.crc32(f"{n}:".encode())) for n in STEMS]


class _Words(dict):
    """Numbers of the words met; ``rows`` gives their rows of the embedding and their languages' bits. Emptied between texts once it holds ``most`` words."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.new, self.held, self.table = most, array("Q"), 0, np.zeros((1 << 10, 3 + len(STEMS)), np.int32)

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        stems = [raw[:n] for n in STEMS] if word.isascii() else [word[:n].encode("utf-8", "surrogatepass") for n in STEMS]
        self.new.extend((zlib.crc32(raw), zlib.crc32(raw, 0x9E3779B9), *[zlib.crc32(x, named) for x, (_, named) in zip(stems, _NAMED)], _LIKELY.get(word, 0)))
        self[word] = n = len(self)
        return n

    def rows(self) -> np.ndarray:
        if self.new:
            found = np.frombuffer(self.new, np.uint64).reshape(-1, self.table.shape[1]).copy()
            found[:, 1:-1] = found[:, 1:-1] * np.uint64(0x9E3779B1) % np.uint64(0xFFFFFFFF)
            found[:, :-1] %= np.uint64(BUCKETS)
            end = self.held + len(found)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(end, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.int32)])
            self.table[self.held:end] = found
            self.held, self.new = end, array("Q")
        return self.table


_WORDS = _Words()


def encoded(text: str | None) -> tuple[np.ndarray, str]:
    """A (words, slots) array, and the language guessed."""
    if len(_WORDS) > _WORDS.most:
        _WORDS.__init__()
        _WORDS.clear()
    words = WORD.findall((text or "").lower())
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    rows = _WORDS.rows().take(ids, axis=0)
    return rows[:, :-1], _language(rows)


def _language(rows: np.ndarray) -> str:
    """The language with the most function words among a text's words."""
    of_bits = np.bincount(rows[:, -1], minlength=1 << len(FUNCTION_WORDS))
    hits = [int(of_bits[np.arange(len(of_bits)) >> i & 1 == 1].sum()) for i in range(len(FUNCTION_WORDS))]
    return list(FUNCTION_WORDS)[int(np.argmax(hits))]


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float]

    def embedded(self, slots: np.ndarray) -> np.ndarray:
        x = self.embedding[slots[..., 0]]
        for k in range(1, slots.shape[-1]):
            x += self.embedding[slots[..., k]]
        return x

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """Every filter of one width at every place of ``x``, without the bias."""
        f = self.filters[WIDTHS.index(width)]
        n = max(len(x) - width + 1, 0)
        out = x[:n] @ f[:DIM]
        for k in range(1, width):
            out += x[k:k + n] @ f[k * DIM:(k + 1) * DIM]
        return out

    def pooled(self, coded: list[np.ndarray]) -> np.ndarray:
        """Each text's largest response of each filter, 0 at least."""
        sizes = np.array([len(c) for c in coded])
        starts = np.cumsum(sizes) - sizes
        x = self.embedded(np.concatenate(coded))
        parts = []
        for width, b in zip(WIDTHS, self.biases):
            best = np.zeros((len(coded), FILTERS), np.float32)
            on = np.flatnonzero(sizes >= width)
            if len(on):
                out = np.concatenate([self.responses(x, width), np.full((1, FILTERS), -np.inf, np.float32)])
                edges = np.stack([starts[on], starts[on] + sizes[on] - width + 1], 1).ravel()
                best[on] = np.maximum(np.maximum.reduceat(out, edges)[::2] + b, 0)
            parts.append(best)
        return np.concatenate(parts, axis=1)

    def logits(self, coded: list[np.ndarray]) -> np.ndarray:
        """In runs of about ``WORDS`` words; a longer text is a run of its own."""
        out, lo, held = [], 0, 0
        for i, c in enumerate(coded):
            held += len(c)
            if held >= WORDS or i + 1 == len(coded):
                out.append(self.pooled(coded[lo:i + 1]) @ self.weights + self.bias)
                lo, held = i + 1, 0
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> list[float]:
        coded = [encoded(t) for t in texts]
        margins = self.logits([c for c, _ in coded]) - np.array([self.thresholds.get(lang, 0.0) for _, lang in coded])
        return (1 / (1 + np.exp(-np.clip(margins, -30, 30)))).tolist()


def _fresh(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    filters = [(rng.standard_normal((w * DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
    return Model((rng.standard_normal((BUCKETS, DIM)) * 0.02).astype(np.float32), filters, [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS], (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), 0.0, {})


def _peaks(m: Model, table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each width, each text's largest response of each filter and its place in ``ids`` (-1: none), in runs of about ``WORDS`` words."""
    best = [np.full((len(sizes), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    at = [np.full((len(sizes), FILTERS), -1) for _ in WIDTHS]
    pieces = [(i, s + k, min(s + n, s + k + WORDS + max(WIDTHS) - 1)) for i, (s, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist())) for k in range(0, n, WORDS)]
    run, held, seen, number = [], 0, np.zeros(len(table), bool), np.empty(len(table), np.int32)
    for j, piece in enumerate(pieces):
        run.append(piece)
        held += piece[2] - piece[1]
        if held < WORDS and j + 1 < len(pieces):
            continue
        words, starts = np.concatenate([ids[lo:hi] for _, lo, hi in run]), np.cumsum([0] + [hi - lo for _, lo, hi in run]).tolist()
        seen[words] = True
        some = np.flatnonzero(seen)
        seen[some], number[some] = False, np.arange(len(some))
        x = m.embedded(table[some]).take(number[words], axis=0)  # each distinct word's rows are added once
        for k, width in enumerate(WIDTHS):
            out = m.responses(x, width)
            for (i, lo, hi), s in zip(run, starts):
                if hi - lo >= width:
                    found = out[s:s + hi - lo - width + 1]
                    place = found.argmax(0)
                    top = found[place, np.arange(FILTERS)]
                    at[k][i] = np.where(top > best[k][i], lo + place, at[k][i])
                    best[k][i] = np.maximum(top, best[k][i])
        run, held = [], 0
    return best, at


def _step(m: Model, table: np.ndarray, coded: list[np.ndarray], labels: np.ndarray, sums: dict, rate: float) -> None:
    """One Adagrad step on a few documents; only the places of the largest responses are touched."""
    sizes, ids = np.array([len(c) for c in coded]), np.concatenate(coded)
    best, at = _peaks(m, table, ids, sizes)
    pooled, where = np.zeros((len(coded), FILTERS * len(WIDTHS)), np.float32), []
    for k in range(len(WIDTHS)):
        top = best[k] + m.biases[k]
        pooled[:, k * FILTERS:(k + 1) * FILTERS] = np.maximum(top, 0)
        where.append(np.where(top > 0, at[k], -1))
    miss = (1 / (1 + np.exp(-np.clip(pooled @ m.weights + m.bias, -30, 30))) - labels).astype(np.float32)
    miss[np.abs(miss) < 0.02] = 0
    if not miss.any():
        return
    back = miss[:, None] * m.weights
    touched, pulls = [], []
    for k, width in enumerate(WIDTHS):
        doc, f = np.nonzero((where[k] >= 0) & (miss != 0)[:, None])
        if not len(doc):
            continue
        g, windows = back[doc, k * FILTERS + f], table[ids[where[k][doc, f][:, None] + np.arange(width)]]
        flat = m.embedded(windows).reshape(len(doc), -1)
        pull = (g[:, None] * m.filters[k][:, f].T).reshape(len(doc), width, DIM)
        touched.append(windows.reshape(-1, table.shape[1]))
        pulls.append(pull.reshape(-1, DIM))
        one = np.zeros((FILTERS, len(doc)), np.float32)
        one[f, np.arange(len(doc))] = g
        gf, gb = (one @ flat).T, one.sum(1)
        sums["f"][k] += gf**2
        m.filters[k] -= rate * gf / np.sqrt(sums["f"][k])
        sums["b"][k] += gb**2
        m.biases[k] -= rate * gb / np.sqrt(sums["b"][k])
    grad = miss @ pooled + 1e-4 * m.weights
    sums["w"] += grad**2
    m.weights -= rate * grad / np.sqrt(sums["w"])
    sums["c"] += float(miss.sum()) ** 2
    m.bias -= rate * float(miss.sum()) / np.sqrt(sums["c"])
    if touched:
        rows = np.concatenate(touched).T.ravel()
        one, to = np.unique(rows, return_inverse=True)
        pull = np.concatenate([np.concatenate(pulls)] * table.shape[1])
        total = np.stack([np.bincount(to, pull[:, d], len(one)) for d in range(DIM)], 1).astype(np.float32)
        sums["e"][one] += (total**2).mean(1)
        m.embedding[one] -= rate * total / np.sqrt(sums["e"][one])[:, None]


def _started(seed: int = 7) -> tuple[Model, dict]:
    """A fresh model and Adagrad's sums."""
    m = _fresh(seed)
    return m, {"e": np.full(BUCKETS, 1e-2, np.float32), "f": [np.full_like(f, 1e-2) for f in m.filters], "b": [np.full_like(b, 1e-2) for b in m.biases], "w": np.full_like(m.weights, 1e-2), "c": 1e-2}


def _small(m: Model, sums: dict) -> np.ndarray:
    """All numbers but the embedding's, in one row."""
    return np.concatenate([np.ravel(x).astype(np.float64) for x in (*m.filters, *m.biases, m.weights, m.bias, *sums["f"], *sums["b"], sums["w"], sums["c"])])


def _set_small(m: Model, sums: dict, row: np.ndarray) -> None:
    at = 0
    for x in (*m.filters, *m.biases, m.weights, None, *sums["f"], *sums["b"], sums["w"], None):
        if x is None:
            at += 1
        else:
            x[...] = row[at:at + x.size].reshape(x.shape)
            at += x.size
    n = sum(x.size for x in (*m.filters, *m.biases, m.weights))
    m.bias, sums["c"] = float(row[n]), float(row[-1])


def _rows(m: Model, sums: dict) -> np.ndarray:
    """The embedding's rows, each with its sum."""
    return np.concatenate([m.embedding, sums["e"][:, None]], 1)


def _encoded_part(key, t):
    """A part's words as numbers into a table of its distinct words' slots, in order of doc_id."""
    rows = sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["toxic"].to_pylist()), key=lambda r: r[0])
    known, coded, langs = _Words(), [], []
    for _, text, _ in rows:
        ids = np.fromiter(map(known.__getitem__, WORD.findall((text or "").lower())), np.int32)
        coded.append(ids)
        langs.append(_language(known.rows()[ids]))
    part = {"table": known.table[:max(len(known), 1), :-1].copy(), "ids": np.concatenate(coded), "sizes": np.array([len(c) for c in coded]), "y": np.array([r[2] for r in rows], np.float32), "langs": langs}
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([pickle.dumps(part)], pa.binary())], names=["part", "blob"])


def _opened(part: int, blob: bytes, seed: int = 7) -> tuple[dict, list[np.ndarray], np.ndarray, np.ndarray]:
    """The part, its texts' words, and which of them are apart and which are trained on."""
    x = pickle.loads(blob)
    coded = np.split(x["ids"], np.cumsum(x["sizes"])[:-1])
    kept = np.random.default_rng([seed, part]).permutation(len(coded))
    return x, coded, kept[:len(kept) // 5], kept[len(kept) // 5:]


def _each_part(batches):
    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob")):
            yield part, blob.as_py()


def _moves(shared, epoch: int, rate: float = 0.1, seed: int = 7):
    """A batch function: a task's parts train a copy of the model each, and it tells the sums of their moves by slice."""

    def each(batches):
        model, sums = shared.value
        base, small = _rows(model, sums), _small(model, sums)
        total, times = np.zeros(base.shape, np.int64), np.zeros(len(base), np.int32)
        rest, parts = np.zeros(len(small), np.int64), 0
        for part, blob in _each_part(batches):
            x, coded, _, fit = _opened(part, blob)
            m, s = pickle.loads(pickle.dumps((model, sums)))
            order = np.random.default_rng([seed, part, epoch]).permutation(fit)
            for k in range(0, len(order), BATCH):
                some = order[k:k + BATCH]
                _step(m, x["table"], [coded[i] for i in some], x["y"][some], s, rate)
            if len(order):
                moved = _rows(m, s) - base
                on = np.flatnonzero(moved.any(1))
                total[on] += np.rint(moved[on] / UNIT).astype(np.int64)
                times[on] += 1
                rest += np.rint((_small(m, s) - small) / UNIT).astype(np.int64)
                parts += 1
        if parts:
            yield _told([(SLICES, _packed(np.zeros(1, np.int32), np.array([parts], np.int32), rest[None]))] + [(k, _packed(on, times[on], total[on])) for k in range(SLICES) if len(on := np.flatnonzero(times[k::SLICES]) * SLICES + k)])

    return each


def _packed(at: np.ndarray, times: np.ndarray, total: np.ndarray) -> bytes:
    return b"".join([np.int64(len(at)).tobytes(), at.astype(np.int32).tobytes(), times.tobytes(), total.tobytes()])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.int32, n, 8), np.frombuffer(blob, np.int32, n, 8 + 4 * n), np.frombuffer(blob, np.int64, -1, 8 + 8 * n).reshape(n, -1)


def _told(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "blob"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean move of each row of a slice, one blob after the other."""
    sums = None
    for b in batches:
        for k, blob in zip(b.column("slice").to_pylist(), b.column("blob")):
            at, times, total = _unpacked(blob.as_py())
            if sums is None:
                width = 1 if k == SLICES else BUCKETS // SLICES
                sums, n = np.zeros((width, total.shape[1]), np.int64), np.zeros(width, np.int64)
            sums[at // SLICES] += total
            n[at // SLICES] += times
    on = np.flatnonzero(n)
    yield _told([(k, pickle.dumps((on, (sums[on] / n[on][:, None] * UNIT).astype(np.float32 if k < SLICES else np.float64))))])


def _apart(shared):
    """A batch function: language, label and logit of the rows kept apart."""

    def each(batches):
        for part, blob in _each_part(batches):
            x, coded, apart, _ = _opened(part, blob)
            for k in range(0, len(apart), BATCH):
                some = apart[k:k + BATCH]
                best, _ = _peaks(shared.value, x["table"], np.concatenate([coded[i] for i in some]), x["sizes"][some])
                pooled = np.concatenate([np.maximum(v + b, 0) for v, b in zip(best, shared.value.biases)], 1)
                yield pa.RecordBatch.from_arrays([pa.array([x["langs"][i] for i in some], pa.string()), pa.array(x["y"][some].astype(np.int64), pa.int64()), pa.array((pooled @ shared.value.weights + shared.value.bias).astype(np.float64), pa.float64())], names=["lang", "toxic", "logit"])

    return each


def thresholds(rows: DataFrame) -> dict[str, float]:
    """Of (lang, toxic, logit) rows, each language's logit where true and false positive rates differ most: the middle of the widest such gap.

    A common one ("" inside) serves where a language has too few rows; 0.0 where a label is missing from all.
    """
    values = durable(rows.select(F.explode(F.array("lang", F.lit(""))).alias("lang"), "toxic", "logit").groupBy("lang", "logit").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")))
    counts = {r.lang: (r.p, r.n) for r in values.groupBy("lang").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()}  # a row for each language
    wanted = sorted(lang for lang, have in counts.items() if min(have) >= (ENOUGH if lang else 1))
    found = {}
    if wanted:
        some = cumulated(values.filter(F.col("lang").isin(wanted)), ["lang", "logit"], {"below_pos": "pos", "below_neg": "neg", "number": F.lit(1)})
        ends, p, n = [], 0, 0
        for lang in wanted:
            ends.append((lang, p, n, *counts[lang]))
            p, n = p + counts[lang][0], n + counts[lang][1]
        ends = F.broadcast(rows.sparkSession.createDataFrame(ends, "lang string, before_pos long, before_neg long, p long, n long"))  # a row for each language
        some = durable(some.join(ends, "lang").select("lang", "logit", "number", ((F.col("below_neg") - F.col("before_neg")) / F.col("n") - (F.col("below_pos") - F.col("before_pos")) / F.col("p")).alias("gain")))
        after = some.select("lang", (F.col("number") - 1).alias("number"), F.col("logit").alias("next"))
        gaps = some.join(after, ["lang", "number"]).select("lang", "gain", F.struct((F.col("next") - F.col("logit")).alias("gap"), ((F.col("next") + F.col("logit")) / 2).alias("middle")).alias("at"))
        gaps = durable(gaps)
        most = F.broadcast(gaps.groupBy("lang").agg(F.max("gain").alias("most")))
        found = {r.lang: float(r.at.middle) for r in gaps.join(most, "lang").filter("gain >= most - 1e-9").groupBy("lang").agg(F.max("at").alias("at")).collect()}
        release(some, gaps)
    release(values)
    return {lang: found.get(lang, found.get("", 0.0)) for lang in FUNCTION_WORDS}


def fit(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> Model | None:
    """Train on every labelled row; ``held_out`` leaves out doc_ids whose crc32 is a multiple of 5."""
    spark = docs.sparkSession
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    if held_out:
        known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = durable(known)
    some = docs.select("doc_id", "text").join(F.broadcast(known) if known.count() <= IDS else known, "doc_id")
    if some.select("toxic").distinct().count() < 2:
        release(known)
        return None
    parts = max(1, -(-text_bytes(some) // PART_BYTES))
    dealt = some.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition(parts, "part").groupBy("part", "doc_id", "toxic").agg(F.min("text").alias("text"))
    coded = durable(dealt.groupBy("part").applyInArrow(_encoded_part, "part int, blob binary"))
    release(known)
    model, sums = _started()
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast((model, sums))
        moved = coded.mapInArrow(_moves(shared, epoch), "slice int, blob binary").groupBy("slice").applyInArrow(_averaged, "slice int, blob binary")
        for r in moved.collect():  # a model's size
            at, move = pickle.loads(r.blob)
            if r.slice == SLICES:
                _set_small(model, sums, _small(model, sums) + move[0])
            else:
                at = at * SLICES + r.slice
                model.embedding[at] += move[:, :DIM]
                sums["e"][at] += move[:, DIM]
        shared.destroy()
    shared = spark.sparkContext.broadcast(model)
    apart = durable(coded.mapInArrow(_apart(shared), "lang string, toxic long, logit double"))
    shared.destroy()
    model.thresholds = thresholds(apart)
    release(coded, apart)
    return model


def _scorer(docs: DataFrame, model: Model | None):
    """A batch function; the model's size is fixed by BUCKETS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: [0.0] * len(texts) if shared.value is None else shared.value.scores(texts)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    scores = _scorer(docs, fit(docs, labels))

    def rows(batch):
        return {"doc_id": batch["doc_id"], "score": scores(batch["text"])}

    out = mapped(docs.select("doc_id", "text"), rows, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` without those that the model calls toxic; ``known`` holds the labelled documents' texts."""
    scores = _scorer(docs, fit(known, labels))

    def rows(batch):
        kept = [s < 0.5 for s in scores(batch["text"])]
        return {c: [v for v, k in zip(values, kept) if k] for c, values in batch.items()}

    return mapped(docs, rows, docs._jdf.schema().toDDL())
