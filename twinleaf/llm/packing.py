"""Packing by power-of-two decomposition.

A document's ids (and the closing id) are cut into full sequences and the binary
parts of the rest, longest first. Each piece is a sequence of its own, so no sequence
crosses documents and none is padded. Sequences of equal length are numbered
together.

Defined cases: a null text counts as empty and gives one piece of one id; very long texts are encoded whole; repeated
rows, and those without doc_id, are packed separately; tied pieces are numbered in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.llm.common import durable, mapped, numbered

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _bytes_of() -> dict[str, int]:
    """Byte-level vocabularies spell bytes as printable characters: printable ones as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def tokenizer(path: str):
    """A function from texts to lists of ids, equal to the ``tokenizers`` file's own.

    Where the file's merges are in the order of its ids, a faster encoder over the same
    vocabulary gives the same ids (tests compare them); texts with added tokens' strings,
    and files of another kind, go to ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    added = [t["content"] for t in spec.get("added_tokens", [])]
    whole = lambda text: slow.encode(text, add_special_tokens=False).ids
    vocab, model = spec["model"].get("vocab"), spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    pre = json.dumps([spec.get("pre_tokenizer"), spec.get("normalizer")])
    ordered = [vocab.get(a + b) for a, b in merges] if merges else []
    if model.get("type") != "BPE" or '"ByteLevel"' not in pre or spec.get("normalizer") or '"add_prefix_space": true' in pre or '"use_regex": false' in pre or ordered != sorted(ordered) or None in ordered:
        return lambda texts: [whole(t) for t in texts]
    import public_tokenizers
    import tiktoken

    raw = _bytes_of()
    ranks = {bytes(raw[c] for c in token): i for token, i in vocab.items() if token not in added}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [whole(t) if any(a in t for a in added) else fast.encode_ordinary(t) for t in texts]


def lengths(n: int, most: int) -> list[int]:
    """Powers of two up to ``most`` that sum to n, longest first."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if (n % most) >> b & 1]


def pack(docs: DataFrame, path: str, most: int = 1024, end_id: int = 0) -> DataFrame:
    """Return one row for each piece, with sequence_id and offset. ``most`` is a power of two."""

    def pieces(batch):
        encode, rows = tokenizer(path), []
        for doc, text in zip(batch["doc_id"], batch["text"]):
            ids = np.array([*encode([text or ""])[0], end_id], dtype="<u4")
            at = 0
            for k in lengths(len(ids), most):
                rows.append((doc, at, k, zlib.crc32(ids[at:at + k].tobytes()), len(ids)))
                at += k
        return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows))) if rows else dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), [])

    cut = durable(mapped(docs.select("doc_id", "text"), pieces, PIECES))
    length_class = F.lit(most.bit_length()) - F.log2("length").cast("int")
    return numbered(cut, "sequence_id", "doc_id", ["doc_id", "start", "ids_crc32"], first=length_class, buckets=256).withColumn("offset", F.lit(0).cast("long"))
