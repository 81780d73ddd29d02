"""English stemming by the published Porter2 algorithm, as an Arrow-batched function."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiouy"
#: Words with stems of their own.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words left alone once plurals are handled.
AFTER_PLURALS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Suffixes within R1 and what replaces them, longest first.
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None) or _after(word, 0)
    return r1, _after(word, r1)


def _ends_short(word: str) -> bool:
    """Whether the last syllable is short."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if w.endswith(suffix):
            return w[:-len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
    for suffix in ("ingly", "edly", "ing", "ed"):
        if not w.endswith(suffix):
            continue
        rest = w[:-len(suffix)]
        if not any(c in VOWELS for c in rest):
            return w
        if rest.endswith(("at", "bl", "iz")):
            return rest + "e"
        if rest.endswith(DOUBLES):
            return rest[:-1]
        return rest + "e" if r1 >= len(rest) and _ends_short(rest) else rest
    return w


def _derived(w: str, r1: int, r2: int) -> str:
    """Steps 2 to 4: derivational suffixes within the regions."""
    for suffix, to in STEP2:
        if w.endswith(suffix):
            fits = {"ogi": w[-4:-3] == "l", "li": w[-3:-2] != "" and w[-3:-2] in "cdeghkmnrt"}.get(suffix, True)
            if len(w) - len(suffix) >= r1 and fits:
                w = w[:-len(suffix)] + to
            break
    for suffix, to in STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
                w = w[:-len(suffix)] + to
            break
    for suffix in STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
                w = w[:-len(suffix)]
            break
    return w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) < 3:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w.removeprefix("'"))
    r1, r2 = _regions(w)
    w = _plural(next((w[:-len(s)] for s in ("'s'", "'s", "'") if w.endswith(s)), w))
    if w in AFTER_PLURALS:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _derived(w, r1, r2)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(StringType())
def stemmed(text: pd.Series) -> pd.Series:
    """Each word of a text replaced by its stem; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(map(stem, t.split())))
