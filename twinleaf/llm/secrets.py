"""Secret scans over documents; see ``automaton`` for the method.

Defined cases: a null or empty text has no spans; very long texts pass whole; spans that begin together go in order of kinds;
repeated rows are scanned each; an empty table gives no rows; other columns are
kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.llm.automaton import BASE, scan_text
from twinleaf.llm.common import mapped

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of the base kinds, and all spans."""

    def rows(batch):
        out = {f.split()[0]: [] for f in SPANS.split(", ")}
        for doc, text in zip(batch["doc_id"], batch["text"]):
            spans = scan_text(text)
            base = [x for x in spans if x[0] in BASE]
            out["doc_id"].append(doc)
            for kind in BASE:
                out[f"n_{kind}"].append(sum(x[0] == kind for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    return mapped(docs.select("doc_id", "text"), rows, SPANS)


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """Overlapping spans become one mark."""
    out, at, upto = [], 0, -1
    for _, start, end in scan_text(text):
        if start > upto:
            out += [text[at:start], mark]
        upto = at = max(end, upto)
    return text if upto < 0 else "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret replaced in ``text`` (and ``n_chars``, if there, counted anew); all other columns stay."""
    ddl = docs._jdf.schema().toDDL()

    def rows(batch):
        return batch | {"text": [redact_text(t) for t in batch["text"]]}

    out = mapped(docs, rows, ddl)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
