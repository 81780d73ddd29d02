"""A sieve over the exchange: which keys occur with more than one owner?

No owner is sent. A chunk says which of its keys have several owners there; a key that two chunks ask counts
as shared. Within a bucket, 32 bits tell keys apart. So a key that has one owner can be kept (its owner has
rows in two chunks, or its 32 bits clash), but one with several owners never leaves.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: an odd multiplier that mixes hashes.
MIX = np.uint64(0x9E3779B97F4A7C15)


def cells(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted ``tokens`` that have any, and where each starts (and the last ends): ranges of the hash."""
    own = (tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[first].astype(np.int64), np.append(first, len(own))


def runs(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted tokens, and whether each has more than one owner."""
    if not len(tokens):
        return tokens, np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    return tokens[first], np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)


def questions(tokens: np.ndarray, more: np.ndarray, buckets: int):
    """(bucket, blob) for sorted distinct ``tokens``; ``more``: this chunk alone has two owners."""
    prints = (tokens * MIX >> np.uint64(32)).astype("<u4")
    which, at = cells(tokens, buckets)
    for b, lo, hi in zip(which.tolist(), at.tolist(), at[1:].tolist()):
        yield b, np.uint32(hi - lo).tobytes() + prints[lo:hi].tobytes() + np.packbits(more[lo:hi]).tobytes()


def replies(hot: int = 1 << 62):
    """Per key two bits: more than one owner, and asked by more than ``hot`` chunks."""

    def each(blobs: list[bytes]) -> list[bytes]:
        sizes = [int(np.frombuffer(b, "<u4", 1)[0]) for b in blobs]
        keys = np.concatenate([np.frombuffer(b, "<u4", n, 4) for b, n in zip(blobs, sizes)])
        more = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -1, 4 + 4 * n), count=n) for b, n in zip(blobs, sizes)])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        asked = np.diff(np.append(first, len(keys)))
        shared = (asked > 1) | (np.maximum.reduceat(more[order], first) > 0)
        out = np.zeros((2, len(keys)), bool)
        out[0, order], out[1, order] = np.repeat(shared, asked), np.repeat(asked > hot, asked)
        ends = np.cumsum(sizes)
        return [np.packbits(out[:, e - n:e]).tobytes() for n, e in zip(sizes, ends)]
    return each


def told(tokens: np.ndarray, buckets: int, got: dict[int, bytes]) -> np.ndarray:
    """The two bits of each of ``tokens``, as a (2, n) array."""
    which, at = cells(tokens, buckets)
    parts = [np.unpackbits(np.frombuffer(got[b], np.uint8), count=2 * (hi - lo)).reshape(2, -1) for b, lo, hi in zip(which.tolist(), at.tolist(), at[1:].tolist())]
    return np.concatenate(parts, axis=1).astype(bool) if parts else np.zeros((2, 0), bool)
