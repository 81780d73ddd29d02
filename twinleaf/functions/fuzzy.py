"""Fuzzy ratios (0 to 100) and the alignment distance, as Arrow-batched functions.

Matching blocks are those of difflib's SequenceMatcher, with its rule for popular characters; the longest
one is found by substring search in place of a table of places.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normalized(s: str) -> str:
    return re.sub(r"\W+", " ", s).strip().lower()


#: Lone surrogates, for what can't begin a match; texts that hold them go to difflib itself.
_NOT_A, _NOT_B = "\ud800", "\udfff"


def _seeds(a: str, b: str) -> tuple[str, str]:
    """Both texts with what can't begin a match masked: in a long ``b``, characters in more than a hundredth of its places."""
    if len(b) < 200:
        return a, b
    most = len(b) // 100 + 1
    popular = {c for c, n in Counter(b).items() if n > most}
    return a.translate({ord(c): _NOT_A for c in popular}), b.translate({ord(c): _NOT_B for c in popular})


def matching_blocks(a: str, b: str, floor: int = -1) -> list[tuple[int, int, int]]:
    """(i, j, n) of the blocks that SequenceMatcher finds, in no order and not joined: the longest one, the first in a and then in b, and so on at both sides.

    Only some of them, once all together can't have more than ``floor`` characters.
    """
    if _NOT_A in a or _NOT_B in b:
        return [tuple(m) for m in SequenceMatcher(None, a, b).get_matching_blocks()[:-1]]
    x, y = _seeds(a, b)
    masked, out, todo, find = x is not a, [], [(0, len(a), 0, len(b))], y.find
    starts = [i for i, c in enumerate(x) if c != _NOT_A] if masked else []
    room = min(len(a), len(b))  # characters in blocks so far, and at most in what is to do
    while todo and room > floor:
        alo, ahi, blo, bhi = todo.pop()
        besti, bestj, size, more = alo, blo, 0, 1
        for i in starts[bisect_left(starts, alo):bisect_left(starts, ahi)] if masked else range(alo, ahi):
            end = i + more  # a match longer by one than the best
            if end > ahi:
                break
            j = find(x[i:end], blo, bhi)
            if j < 0:
                continue
            while end < ahi and (k := find(x[i:end + 1], j, bhi)) >= 0:
                j, end = k, end + 1
            besti, bestj, size, more = i, j, end - i, end - i + 1
        if masked:  # popular characters lengthen a match
            while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
                besti, bestj, size = besti - 1, bestj - 1, size + 1
            while besti + size < ahi and bestj + size < bhi and a[besti + size] == b[bestj + size]:
                size += 1
        room -= min(ahi - alo, bhi - blo)
        if size:
            out.append((besti, bestj, size))
            before, after = min(besti - alo, bestj - blo), min(ahi - besti, bhi - bestj) - size
            room += before + size + after
            if before:
                todo.append((alo, besti, blo, bestj))
            if after:
                todo.append((besti + size, ahi, bestj + size, bhi))
    return out


def _share(a: str, b: str, best: float = -1.0) -> float:
    """SequenceMatcher's ratio; something not above ``best`` where the ratio isn't either."""
    floor = int(best * (len(a) + len(b)) / 2) - 1
    return 2.0 * sum(n for _, _, n in matching_blocks(a, b, floor)) / (len(a) + len(b)) if a or b else 1.0


def ratio(a: str, b: str) -> int:
    return round(100 * _share(a, b)) if a and b else 0


def partial_ratio(a: str, b: str) -> int:
    """The shorter text against the best window of the longer one that begins where a matching block does."""
    if not a or not b:
        return 0
    short, long = sorted((a, b), key=len)
    best = 0.0
    starts = Counter({len(long) - len(short): 0})
    for i, j, n in matching_blocks(short, long):
        starts[max(j - i, 0)] += n
    for start, _ in starts.most_common():  # the likely ones first, so that others can end early
        r = _share(short, long[start:start + len(short)], best)
        if r > 0.995:
            return 100
        best = max(best, r)
    return round(100 * best)


def _token_sort(a: str, b: str, by) -> int:
    return by(*(" ".join(sorted(normalized(x).split())) for x in (a, b)))


def _token_set(a: str, b: str, by) -> int:
    x, y = set(normalized(a).split()), set(normalized(b).split())
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    return max(by(both, one), by(both, two), by(one, two))


def qratio(a: str, b: str) -> int:
    return ratio(normalized(a), normalized(b))


def wratio(a: str, b: str) -> int:
    x, y = normalized(a), normalized(b)
    if not x or not y:
        return 0
    base, share = ratio(x, y), max(len(x), len(y)) / min(len(x), len(y))
    if share < 1.5:
        return round(max(base, 0.95 * _token_sort(a, b, ratio), 0.95 * _token_set(a, b, ratio)))
    scale = 0.6 if share > 8 else 0.9
    return round(max(base, scale * partial_ratio(x, y), 0.95 * scale * _token_sort(a, b, partial_ratio), 0.95 * scale * _token_set(a, b, partial_ratio)))


#: Places of a table's rows that are filled at once.
CELLS = 1 << 14


def alignment_distances(pairs: list[tuple[str, str]]) -> list[float]:
    """Edit distance by the length of the longest alignment among those of least cost, for each pair.

    Cost and length share one integer, ``cost * unit - length``, so a row is a few array operations; pairs of
    like lengths share them. What stands beyond a pair's own end never reaches its result.
    """
    out = [0.0] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda p: (len(pairs[p][1]), len(pairs[p][0])))
    while order:
        wide = len(pairs[order[-1]][1]) + 1
        at, order = order[-max(1, CELLS // wide):], order[:-max(1, CELLS // wide)]
        at.sort(key=lambda p: -len(pairs[p][0]))
        high = np.array([len(pairs[p][0]) for p in at])
        total = high + [len(pairs[p][1]) for p in at]
        kind = np.int32 if int(total.max() + 2) ** 2 < 1 << 30 and (wide + int(high.max())) * int(total.max()) < 1 << 30 else np.int64
        gap = total.astype(kind)[:, None]
        x, y = (np.zeros((len(at), n), np.uint32) for n in (int(high.max()), wide - 1))
        for row, p in enumerate(at):
            for into, s in ((x, pairs[p][0]), (y, pairs[p][1])):
                codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
                into[row, :len(codes)] = codes
        steps = np.arange(wide, dtype=kind) * gap
        row = np.zeros_like(steps)  # less the steps to each place, so that the least so far is a running minimum
        last = np.zeros(len(at), kind)
        ends = np.array([len(pairs[p][1]) for p in at])
        for i in range(int(high.max()) + 1):
            n = int(np.searchsorted(-high, -i, side="right"))  # pairs whose first text goes on
            done = np.flatnonzero(high[:n] == i)
            last[done] = row[done, ends[done]]
            n = int(np.searchsorted(-high, -i, side="left"))
            if not n:
                break
            row, g = row[:n], gap[:n]
            new = row + g
            step = (y[:n] != x[:n, i, None]) * (g + 1)
            step -= 1 + g
            step += row[:, :-1]
            np.minimum(new[:, 1:], step, out=new[:, 1:])
            row = np.minimum.accumulate(new, axis=1)
        for p, value, whole, end in zip(at, last.tolist(), total.tolist(), ends.tolist()):
            value += whole * end
            cost = -(-value // (whole + 1))
            length = cost * (whole + 1) - value
            out[p] = cost / length if length else 0.0
    return out


def alignment_distance(a: str, b: str) -> float:
    return alignment_distances([(a, b)])[0]


@F.pandas_udf(DoubleType())
def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(alignment_distances([(x or "", y or "") for x, y in zip(a, b)]))


RATIOS = {
    "f1_qratio": qratio,
    "f2_wratio": wratio,
    "f3_partial_ratio": partial_ratio,
    "f4_partial_token_set_ratio": lambda a, b: _token_set(a, b, partial_ratio),
    "f5_partial_token_sort_ratio": lambda a, b: _token_sort(a, b, partial_ratio),
    "f6_token_set_ratio": lambda a, b: _token_set(a, b, ratio),
    "f7_token_sort_ratio": lambda a, b: _token_sort(a, b, ratio),
}


def batched(f, kind: str):
    @F.pandas_udf(kind)
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b)])

    return each
