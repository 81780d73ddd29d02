"""LM scoring by cross-entropy difference of matched bigram models.

The target model counts the documents named as target, the background model all
documents; both use the vocabulary of the background and the same smoothing:

    p(w)      = (c(w) + MU * b(w)) / (T + MU)            b: share in the background
    p(w | v)  = (c(v, w) + LAMBDA * p(w)) / (c(v) + LAMBDA)

with a mark before each document's first word. A document's score is its mean loss per token
under the target model less that under the background model: low means target-like.

All counts cover all documents. Documents are dealt to chunks; each chunk asks the hash
buckets of its distinct words and pairs, which add up what all chunks bring and
send the totals back, so that a word in every document costs a row for each chunk,
not for each occurrence, and no task holds the whole model.

Defined cases: null and empty texts have no tokens, and null losses and score; very long texts are taken whole; repeated rows count as often as they occur
and get a row each; without target documents the target model is the background's shares;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.llm import sieve
from twinleaf.llm.common import Exchange, word_runs

MU, LAMBDA = 1000.0, 5.0
CHUNK_BYTES = 8 << 20
#: Odd multipliers that mix two words' hashes, and the hash of the mark before the first word.
MIX_A, MIX_B, MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (first * MIX_A + second) * MIX_B
        x ^= x >> np.uint64(29)
        return x * MIX_A ^ x >> np.uint64(32)


class _Chunk:
    """A chunk's tokens: hashes of words and pairs, each with its distinct keys in order."""

    def __init__(self, table: pa.Table):
        rows = table.sort_by([("doc_id", "ascending")]).to_pydict()
        chosen = {d for d, t in zip(rows["doc_id"], rows["is_target"]) if t}
        seen: dict[bytes, int] = {}
        self.doc_ids, sizes, ids, target = [], [], [np.zeros(0, np.int32)], []
        for doc, text, mark in zip(rows["doc_id"], rows["text"], rows["is_target"]):
            if mark:
                continue
            self.doc_ids.append(doc)
            target.append(doc is not None and doc in chosen)
            before = len(ids)
            ids += [np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)) for words in word_runs(text)]
            sizes.append(sum(map(len, ids[before:])))
        self.sizes = np.array(sizes, dtype=np.int64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
        word = hashes[np.concatenate(ids)]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        starts = np.cumsum(self.sizes) - self.sizes
        before[starts[self.sizes > 0]] = MARK
        self.starts, self.target = starts, np.repeat(np.array(target, dtype=bool), self.sizes)
        first = np.zeros(len(word), dtype=bool)
        first[starts[self.sizes > 0]] = True
        # Words and pairs share one key space; the mark counts once for each document.
        marks = np.full(int(first.sum()), MARK)
        self.keys, where = np.unique(np.concatenate([word, _mixed(before, word), marks]), return_inverse=True)
        n = len(word)
        self.word, self.pair, mark_at = where[:n], where[n:2 * n], where[2 * n:]
        self.before = np.empty(n, dtype=np.int64)
        self.before[1:] = self.word[:-1]
        if len(mark_at):
            self.before[first] = mark_at
        flags = np.concatenate([self.target, self.target, self.target[first]])
        self.background = np.bincount(where, minlength=len(self.keys))
        self.inside = np.bincount(where[flags], minlength=len(self.keys))


def _packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.asarray(a).astype("<u8").tobytes() for a in arrays), 1)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as the planes of their gaps' bytes: the high ones are nearly all zero."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    low, high = gaps[:5].tobytes(), zlib.compress(gaps[5:].tobytes(), 1)
    return np.array([len(keys), len(high)], "<u4").tobytes() + low + high


def _keys(blob: bytes) -> tuple[np.ndarray, int]:
    """The keys in front of a blob, and where they end."""
    n, size = np.frombuffer(blob, "<u4", 2).tolist()
    end = 8 + 5 * n + size
    planes = np.frombuffer(blob[8:8 + 5 * n] + zlib.decompress(blob[8 + 5 * n:end]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64), end


def _emit(buckets: int):
    def each(table: pa.Table):
        c = _Chunk(table)
        which, at = sieve.cells(c.keys, buckets)
        for b, lo, hi in zip(which.tolist(), at.tolist(), at[1:].tolist()):
            yield b, _planes(c.keys[lo:hi]) + _packed(c.background[lo:hi], c.inside[lo:hi])
    return each


def _reply(blobs: list[bytes]) -> list[bytes]:
    heads = [_keys(b) for b in blobs]
    sizes = [len(k) for k, _ in heads]
    counts = [np.frombuffer(zlib.decompress(memoryview(b)[end:]), "<u8").reshape(2, -1) for b, (_, end) in zip(blobs, heads)]
    one, where = np.unique(np.concatenate([k for k, _ in heads]), return_inverse=True)
    totals = np.zeros((2, len(one)), dtype=np.uint64)
    counts = np.concatenate(counts, axis=1)
    for k in range(2):
        np.add.at(totals[k], where, counts[k])
    ends = np.cumsum(sizes)
    return [_packed(totals[:, where[e - n:e]]) for n, e in zip(sizes, ends)]


def _losses(buckets: int, totals: tuple[int, int]):
    def each(table: pa.Table, got: dict[int, bytes]):
        c = _Chunk(table)
        parts = [np.frombuffer(zlib.decompress(got[b]), "<u8").reshape(2, -1) for b in sieve.cells(c.keys, buckets)[0].tolist()]
        counts = np.concatenate(parts, axis=1).astype(float) if parts else np.zeros((2, 0))
        share = counts[0] / max(totals[0], 1)
        means = []
        for k in range(2):
            p = (counts[k] + MU * share) / (totals[k] + MU)
            loss = -np.log((counts[k][c.pair] + LAMBDA * p[c.word]) / (counts[k][c.before] + LAMBDA))
            means.append([float(loss[s:s + n].sum() / n) if n else None for s, n in zip(c.starts, c.sizes)])
        return {"doc_id": c.doc_ids, "n_tokens": c.sizes, "loss_target": means[1], "loss_background": means[0], "score": [None if a is None else a - b for a, b in zip(means[1], means[0])]}
    return each


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Score every row of ``docs``; ``target`` has the doc_ids of the target corpus."""
    target = target.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    x = Exchange.of(docs, CHUNK_BYTES)
    size = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+")).alias("n"))
    marked = size.groupBy("doc_id").agg(F.sum("n").alias("n")).join(target.withColumn("t", F.lit(1)), "doc_id", "left")
    total = marked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("t")), F.lit(0))).first()
    chunk = F.pmod(F.coalesce(F.xxhash64(F.col("doc_id")), F.lit(0)) + F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0), F.lit(x.chunks)).cast("int")
    rows = docs.select("doc_id", "text", F.lit(False).alias("is_target"))
    marks = target.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("is_target"))
    dealt = x.dealt(rows.unionByName(marks), chunk, "doc_id", "text", "is_target")
    answers = x.answer(x.ask(dealt, _emit(x.buckets)), _reply)
    return x.finish(dealt, answers, _losses(x.buckets, (int(total[0]), int(total[1]))), "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
