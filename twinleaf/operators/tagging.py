"""Questions rewritten from tagged tokens: names become their kinds, numbers one word, the rest known lemmas.

A token is a struct of text, lower, lemma, ent_type, best and second (the word's most and second most
voted kinds, null if none), known_text, known_lower and known_lemma (whether the vocabulary has it).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.functions.cascade import MARKS, UNDEFINED

#: Kinds of entities and the words that stand for them.
ENTITY_WORDS = {
    "": "",
    "PERSON": "person",
    "NORP": "nationality",
    "FAC": "facility",
    "ORG": "organization",
    "GPE": "country",
    "LOC": "location",
    "PRODUCT": "product",
    "EVENT": "event",
    "WORK_OF_ART": "artwork",
    "LANGUAGE": "language",
    "DATE": "date",
    "TIME": "time",
    "PERCENT": "number",
    "MONEY": "number",
    "QUANTITY": "number",
    "ORDINAL": "number",
    "CARDINAL": "number",
    "LAW": "law",
}
NUMERIC = {"DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL"}
#: Words kept as they are, and the lemma that stands for pronouns.
AS_IS, PRONOUN = {"need"}, "-PRON-"
#: Rows of tokens that are Python objects at once.
SLICE = 64


def entity_word(kind):
    """The word for a kind of entity; null for kinds not known."""
    pairs = [F.lit(x) for kv in ENTITY_WORDS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), kind)


def _plain_word(t: dict) -> tuple[str, str | None]:
    """A token without a kind of its own: its lemma, its second kind, or itself, whichever is known first."""
    if t["lemma"] == PRONOUN:
        return t["lower"], None
    if t["known_lemma"]:
        return t["lemma"], None
    if t["second"] is not None:
        return ENTITY_WORDS.get(t["second"], ""), t["second"]
    for form in ("lower", "text"):
        if t[f"known_{form}"]:
            return t[form], None
    return UNDEFINED, None


def _step(t: dict, last: str | None, stops: frozenset) -> tuple[str | None, str | None]:
    """The word that a token adds (or None), and the kind that the next token continues."""
    text, best, own = t["text"] or "", t["best"] or "", t["ent_type"] or ""
    if text in AS_IS:
        return text, None
    if text in MARKS:
        return (own, own) if own else (text, None)
    if not text[:1].isalnum() or text == "s" or t["lemma"] in stops:
        return None, None
    if last is not None and last in (best, own) or last in NUMERIC and (best in NUMERIC or own in NUMERIC):
        return None, last
    if text.isdigit():
        return (None, last) if last in NUMERIC else ("number", "CARDINAL")
    if best:
        return ENTITY_WORDS.get(best, ""), best
    name = t["lower"] == t["lemma"] and text[1:] != (t["lemma"] or "")[1:]
    if name and t["second"] is not None:
        return ENTITY_WORDS.get(t["second"], ""), t["second"]
    return _plain_word(t)


def rewritten_words(tokens: list[dict], stops: frozenset = frozenset()) -> list[str]:
    out, last = [], None
    for t in tokens or []:
        word, last = _step(t, last, stops)
        if word is not None:
            out.append(word)
    return out


def rewritten(df: DataFrame, key: str = "qid", stops=()) -> DataFrame:
    """(key, words) from (key, tokens); null and empty lists give no words."""
    stops, kind = frozenset(stops), dict(df.dtypes)[key]

    def each(batches):
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
            words = [rewritten_words(tokens, stops) for tokens in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(words, pa.list_(pa.string()))], names=[key, "words"])

    return df.select(key, "tokens").mapInArrow(each, f"{key} {kind}, words array<string>")


def voted(votes: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(word, best, second) from (word, ent_type, votes); a second kind needs more than ``threshold`` votes."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "ent_type")))  # as many as there are kinds
    v = votes.groupBy("word").agg(ranked.alias("r"))
    second = F.get("r", F.lit(1))
    return v.select("word", F.get("r", F.lit(0)).getField("ent_type").alias("best"), F.when(-second.getField("less") > threshold, second.getField("ent_type")).alias("second"))
