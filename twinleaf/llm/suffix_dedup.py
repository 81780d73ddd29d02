"""Suffix-array deduplication by column-wise construction over many strings.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller
doc_id is removed.

Texts are cut to overlapping pieces of at most 2 * LENGTH - GRAM bytes: the maximal runs of windows of LENGTH bytes that
share one smallest GRAM-byte hash. Equal windows share it too, so they meet in one collection,
whatever their documents, and each window lies in exactly one piece. Pieces whose
hash occurs in one document only leave in a sieve that never drops a shared hash; equal pieces are joined, with their smallest doc_id, and a
hash of one distinct piece has nothing left to be compared with.

For each collection, ``collection`` inserts one symbol of each piece a round, from the last to the
first, and updates the Burrows-Wheeler transform of all suffixes so far and their longest common prefixes, each
passed from front to back and written anew. Neighbours with a common prefix of LENGTH or more hold one
string; the smallest doc_id among them goes back to the chunks that asked. A collection is
bounded (COLLECTION bytes, or one hash's pieces), so these sequential files are byte arrays in memory and no
machine-local folder is used; a hash that more than HOT chunks ask for is split by the hash of the whole window.

Defined cases: null texts are empty; rows with one doc_id don't remove each other's bytes; rows without doc_id lose and
give nothing; texts shorter than LENGTH stay whole, very long ones are taken whole, a few at a time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.llm import sieve
from twinleaf.llm.common import Exchange, durable

LENGTH, GRAM = 50, 20
CHUNK_BYTES, COLLECTION, HOT, STRIDE, PIECES = 4 << 20, 1 << 18, 512, 1 << 16, 1 << 13
#: An odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)
NONE = np.iinfo(np.int64).max


def collection(pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction over rows of ``pieces`` (symbols from 1, right aligned).

    Returns, in the order of all suffixes: the transform (0 before a piece's first symbol), the common
    prefix with the suffix before (up to LENGTH), the piece and the suffix's length.
    """
    n, width = pieces.shape
    # One word for each suffix: preceding symbol, common prefix, length (a byte each), piece.
    words = np.where(sizes > 0, pieces[:, width - 1] if width else 0, 0).astype(np.uint64) | np.arange(n, dtype=np.uint64) << np.uint64(24)
    who = np.flatnonzero(sizes > 0).astype(np.int32)
    at = who.astype(np.int64)  # where the suffix inserted last stands, for each active piece in ``who``
    for length in range(1, width + 1):
        if not len(who):
            break
        parts = words.view(np.uint8).reshape(-1, 8)
        before, common = np.ascontiguousarray(parts[:, 0]), np.append(parts[:, 1], np.uint8(0))
        # Suffixes preceded by a symbol keep their order behind it; the k-th of them in order is known by its rank.
        order = np.argsort(before, kind="stable")
        ends = np.cumsum(np.bincount(before, minlength=256))
        ended = int(ends[0])
        active = np.zeros(len(before), np.int32)
        active[at] = who + 1
        turn = active[order]
        new = np.flatnonzero(turn)
        who = turn[new] - 1
        # Common prefixes of a new suffix with its neighbours behind the same symbol: least over the range between, plus one.
        lows = np.concatenate([new, np.minimum(new + 1, len(order) - 1)])
        here, prior = order[lows], order[np.maximum(lows - 1, 0)]
        same = (before[here] == before[prior]) & (lows > ended)
        same[len(new):] &= new + 1 < len(order)
        least = np.zeros(len(lows), np.int64)
        if same.any():
            s, e = prior[same] + 1, here[same] + 1
            back = np.argsort(-s, kind="stable")
            edges = np.empty(2 * len(s), np.int64)
            edges[0::2], edges[1::2] = s[back], e[back]
            least[np.flatnonzero(same)[back]] = np.minimum.reduceat(common, edges)[0::2].astype(np.int64) + 1
        least = np.minimum(least, LENGTH)
        # Sequential pass: old entries move behind the new ones before them. Suffixes begin with the end mark (n of them) or with the symbol at rank - ended.
        position = n + new - ended
        left = sizes[who] - length
        ahead = np.where(left > 0, pieces[who, np.maximum(width - 1 - length, 0)], 0).astype(np.int64)
        merged = np.empty(len(words) + len(new), np.uint64)
        old = np.ones(len(merged), bool)
        old[position] = False
        merged[old] = words
        merged[position] = (ahead | least[:len(new)] << 8 | length << 16 | who.astype(np.int64) << 24).astype(np.uint64)
        follow = position + 1
        held = follow < len(merged)
        merged.view(np.uint8).reshape(-1, 8)[follow[held], 1] = np.where(same[len(new):], least[len(new):], 0)[held]
        words = merged
        at, who = position[left > 0], who[left > 0]
    parts = words.view(np.uint8).reshape(-1, 8)
    return parts[:, 0], parts[:, 1], (words >> np.uint64(24)).astype(np.int32), parts[:, 2]


def window_minima(texts: list[bytes], doc: np.ndarray) -> list[np.ndarray]:
    """For each piece and each of its windows, the smallest ``doc`` of any piece that holds the window."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    width = int(sizes.max())
    flat = np.frombuffer(b"".join(texts), np.uint8)
    symbols = np.zeros(256, np.uint8)
    present = np.unique(flat)
    wide = len(present) == 256  # no text in UTF-8 holds all byte values
    if wide:
        raise ValueError("pieces use every byte value")
    symbols[present] = np.arange(1, len(present) + 1)
    matrix = np.zeros((len(texts), width), np.uint8)
    matrix[np.arange(width) >= (width - sizes)[:, None]] = symbols[flat]
    _, common, owner, depth = collection(matrix, sizes)
    whole = depth >= LENGTH
    run = np.cumsum(common < LENGTH) - 1
    run, owner, depth = run[whole], owner[whole], depth[whole].astype(np.int64)
    _, run = np.unique(run, return_inverse=True)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    least = np.minimum.reduceat(doc[owner], first)[run]
    out = np.empty((len(texts), width - LENGTH + 1), np.int64)
    out[owner, sizes[owner] - depth] = least
    return [out[i, :s - LENGTH + 1] for i, s in enumerate(sizes)]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def _hashed(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, size) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes at ``at``, from sums of bytes times powers of the base."""
    x = (sums[at + size] - sums[at]) * inverse[at]
    x ^= x >> np.uint64(32)
    x *= sieve.MIX
    x ^= x >> np.uint64(29)
    return x


@lru_cache(2)
def _counting(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.uint64)


class _Pieces:
    """A chunk's texts in one array, and its pieces: start, windows, hash, hash of the whole, and document."""

    def __init__(self, table: pa.Table):
        rows = table.to_pydict()
        order = sorted(range(len(rows["doc_id"])), key=lambda i: (rows["doc_id"][i] is None, rows["doc_id"][i] or 0, rows["text"][i] or ""))
        self.doc_ids = [rows["doc_id"][i] for i in order]
        raw = [(rows["text"][i] or "").encode("utf-8", "surrogatepass") for i in order]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        ids = np.array([d if d is not None else NONE for d in self.doc_ids], np.int64)
        found = [self._cut(*part, ids) for part in self._parts()]
        self.start, self.windows, self.key, self.whole, self.doc = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64)]

    def _parts(self):
        """(first and last document, first and last byte): a few documents or a stretch of a long one at a time, so that the arrays stay small."""
        lo = 0
        for i, (s, e) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
            if e - s > 2 * STRIDE:
                if i > lo:
                    yield lo, i, int(self.starts[lo]), s
                for at in range(s, e - LENGTH + 1, STRIDE):  # stretches share LENGTH - 1 bytes, so each window lies in one
                    yield i, i + 1, at, min(e, at + STRIDE + LENGTH - 1)
                lo = i + 1
            elif e - self.starts[lo] > STRIDE:
                yield lo, i + 1, int(self.starts[lo]), e
                lo = i + 1
        if lo < len(self.ends):
            yield lo, len(self.ends), int(self.starts[lo]), int(self.ends[-1])

    def _cut(self, lo: int, hi: int, first: int, last: int, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        data, ends = self.data[first:last], np.minimum(self.ends[lo:hi], last) - first
        n = len(data)
        none = np.zeros(0, np.int64)
        if n < LENGTH:
            return none, none, none.astype(np.uint64), none.astype(np.uint64), none
        power, inverse = _powers(4 * STRIDE)  # no part is as long
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(data * power[:n], out=sums[1:])
        # As _hashed, for all positions in turn.
        value = sums[GRAM:] - sums[:n - GRAM + 1]
        value *= inverse[:len(value)]
        value ^= value >> np.uint64(32)
        value *= sieve.MIX
        value ^= value >> np.uint64(29)
        # The smallest hash among the grams of each window, the leftmost of equals; always in as many bits, so that equal windows choose alike.
        bits = np.uint64((4 * STRIDE).bit_length())
        low = value >> bits
        low <<= bits
        low |= _counting(len(power))[:len(value)]
        step, span = 1, LENGTH - GRAM + 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[:len(low) - (span - step)], low[span - step:])
        low &= (np.uint64(1) << bits) - np.uint64(1)
        # Windows that cross the end of a text, or whose text has no doc_id, don't count.
        fits = np.ones(len(low), bool)
        known = ids[lo:hi] != NONE
        begin = ends - np.diff(ends, prepend=0)
        for s, e, k in zip(begin.tolist(), ends.tolist(), known.tolist()):
            fits[max(s, e - LENGTH + 1) if k else s:e] = False
        turns = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=turns[1:])
        turns[1:] |= ~fits[:-1]
        turns &= fits
        start = np.flatnonzero(turns)
        # A run ends before the next start or the first window that doesn't fit.
        stops = np.flatnonzero(~fits)
        after = np.append(stops, len(low))[np.searchsorted(stops, start)]
        windows = np.minimum(np.append(start[1:], len(low)), after) - start
        key = value[low[start].astype(np.int64)] * sieve.MIX  # least hashes are small: spread them again
        key ^= key >> np.uint64(31)
        key *= sieve.MIX
        whole = _hashed(sums, inverse, start, LENGTH - 1 + windows) + windows.astype(np.uint64)
        return start + first, windows, key, whole, ids[lo + np.searchsorted(ends, start, side="right")]

    def sieved(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.key, kind="stable")
        return sieve.runs(self.key[order], self.doc[order])

    def kept(self, buckets: int, got: dict[int, bytes]) -> None:
        """Leave out pieces of one document's hashes; split those of hot ones to single windows."""
        tokens, _ = self.sieved()
        shared, hot = sieve.told(tokens, buckets, got)
        mine = np.searchsorted(tokens, self.key)
        stay = shared[mine] if len(mine) else np.zeros(0, bool)
        split = stay & hot[mine] if len(mine) else stay
        one = np.flatnonzero(stay & ~split)
        many = np.flatnonzero(split)
        counts = self.windows[many]
        singles = np.repeat(self.start[many], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        text = self.data.tobytes() if len(many) else b""
        prints = np.fromiter((xxhash.xxh64_intdigest(text[i:i + LENGTH]) for i in singles.tolist()), np.uint64, len(singles))
        self.key = np.concatenate([self.key[one], prints])
        self.whole = np.concatenate([self.whole[one], prints])
        self.doc = np.concatenate([self.doc[one], np.repeat(self.doc[many], counts)])
        self.start = np.concatenate([self.start[one], singles])
        self.windows = np.concatenate([self.windows[one], np.ones(len(singles), np.int64)])
        if not len(self.start):
            self.first = self.which = np.zeros(0, np.int64)
            return
        # Equal pieces once, in order of key: told apart by the hash of the whole and the length.
        order = np.lexsort((self.doc, self.whole, self.key))
        k, w = self.key[order], self.whole[order]
        new = np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1]))
        self.first = order[np.flatnonzero(new)]  # smallest doc of each
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1


def _ask_sieve(buckets: int):
    return lambda table: sieve.questions(*_Pieces(table).sieved(), buckets)


def _ask_pieces(buckets: int):
    def each(table: pa.Table, got: dict[int, bytes]):
        p = _Pieces(table)
        p.kept(buckets, got)
        which, at = sieve.cells(p.key[p.first], buckets)
        for b, lo, hi in zip(which.tolist(), at.tolist(), at[1:].tolist()):
            i = p.first[lo:hi]
            sizes = p.windows[i] + LENGTH - 1
            flat = np.repeat(p.start[i] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            yield buckets + b, np.uint32(len(i)).tobytes() + p.key[i].tobytes() + p.doc[i].tobytes() + sizes.astype(np.uint8).tobytes() + p.data[flat].tobytes()
    return each


def _reply_minima(blobs: list[bytes]) -> list[bytes]:
    keys, docs, texts, counts = [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.uint32, 1)[0])
        keys.append(np.frombuffer(blob, np.uint64, n, 4))
        docs.append(np.frombuffer(blob, np.int64, n, 4 + 8 * n))
        ends = np.cumsum(np.frombuffer(blob, np.uint8, n, 4 + 16 * n).astype(np.int64)) + 4 + 17 * n
        texts += [blob[s:e] for s, e in zip(np.append(4 + 17 * n, ends[:-1]).tolist(), ends.tolist())]
        counts.append(n)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    # Equal pieces of all chunks once, by their bytes, in order of key.
    one: dict[bytes, int] = {}
    which = np.fromiter((one.setdefault(t, len(one)) for t in texts), np.int64, len(texts))
    least = np.full(len(one), NONE)
    np.minimum.at(least, which, doc)
    of = np.empty(len(one), np.uint64)
    of[which] = key
    # Second sieve: a hash with one distinct piece left has nothing to meet in a collection.
    names, order = list(one), np.argsort(of, kind="stable")
    minima: list = [least[i:i + 1] for i in range(len(one))]
    edge = np.append(True, np.diff(of[order]) != 0)
    order = order[~(edge & np.append(edge[1:], True))]
    lo, held = 0, 0
    for i, j in enumerate(order):
        held += len(names[j])
        last = i + 1 == len(order)
        if last or held >= COLLECTION and of[order[i + 1]] != of[j]:
            part = order[lo:i + 1]
            for k, m in zip(part, window_minima([names[k] for k in part], least[part])):
                minima[k] = m
            lo, held = i + 1, 0
    flat = [m[:1] if (m == m[0]).all() else m for m in minima]
    out, at = [], 0
    for n in counts:
        part = [flat[k] for k in which[at:at + n]]
        out.append(zlib.compress(np.uint32(n).tobytes() + np.array([len(m) for m in part], np.uint8).tobytes() + np.concatenate(part).tobytes(), 1))
        at += n
    return out


def _removed(buckets: int):
    def each(table: pa.Table, got: dict[int, bytes]):
        p = _Pieces(table)
        p.kept(buckets, got)
        lengths, values = [], []
        for b in sieve.cells(p.key[p.first], buckets)[0].tolist():
            blob = zlib.decompress(got[buckets + b])
            n = int(np.frombuffer(blob, np.uint32, 1)[0])
            lengths.append(np.frombuffer(blob, np.uint8, n, 4).astype(np.int64))
            values.append(np.frombuffer(blob, np.int64, -1, 4 + n))
        dropped = np.zeros(len(p.data), bool)
        if lengths:
            length, value = np.concatenate(lengths), np.concatenate(values)
            begin = np.cumsum(length) - length
            for lo in range(0, len(p.which), PIECES):  # some pieces at a time: a text can be one long chunk
                part = slice(lo, lo + PIECES)
                counts, which = p.windows[part], p.which[part]
                inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                piece = np.repeat(which, counts)
                least = value[begin[piece] + np.where(length[piece] > 1, inside, 0)]
                gone = np.sort((np.repeat(p.start[part], counts) + inside)[least < np.repeat(p.doc[part], counts)])
                cut = np.flatnonzero(np.diff(gone) > LENGTH)
                for a, b in zip(gone[np.append(0, cut + 1)].tolist() if len(gone) else [], gone[np.append(cut, len(gone) - 1)].tolist() if len(gone) else []):
                    dropped[a:b + LENGTH] = True
        n_removed, n_spans, digests = [], [], []
        for s, e in zip(p.starts.tolist(), p.ends.tolist()):
            d = dropped[s:e]
            n = int(d.sum())
            n_removed.append(n)
            n_spans.append(int(d[0]) + int((d[1:] & ~d[:-1]).sum()) if n else 0)
            digests.append(hashlib.sha256((p.data[s:e][~d] if n else p.data[s:e]).tobytes()).hexdigest())
        return {"doc_id": p.doc_ids, "n_bytes": p.ends - p.starts, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": digests}
    return each


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row."""
    x = Exchange.of(docs, CHUNK_BYTES)
    b = x.buckets
    dealt = x.dealt(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(x.chunks)).cast("int"), "doc_id", "text")
    known = durable(x.answer(x.ask(dealt, _ask_sieve(b)), sieve.replies(HOT))).repartition(x.parts(x.chunks), "chunk")
    minima = x.answer(x.ask(dealt, _ask_pieces(b), known), _reply_minima)
    return x.finish(dealt, known.unionByName(minima), _removed(b), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
