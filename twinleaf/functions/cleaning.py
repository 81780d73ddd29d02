"""Text cleaning by the ordered rules of ``constants.CLEANING``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinleaf.functions.constants import CLEANING, STOP_WORDS


def clean(text: Column, remove_stop_words: bool = False) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    if remove_stop_words:
        words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1].replace("\\1", "$1")), CLEANING, F.array_join(words, " "))


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))
