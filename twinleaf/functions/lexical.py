"""Pair features over word arrays, as columns for a frame with the columns of ``fixtures.tokenized``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; null without a bottom."""
    return F.try_divide(top.cast("double"), bottom)


def second_to_first(first: Column, second: Column) -> Column:
    """second / first; 0 where first is 0, null where only second is 0."""
    return F.when(first == 0, F.lit(0.0)).when(second == 0, F.lit(None)).otherwise(second / first)


def overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def union_size(a: str, b: str) -> Column:
    return F.size(F.array_union(a, b))


def word_match(a: str, b: str) -> Column:
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * overlap(a, b) / (F.size(a) + F.size(b))), F.lit(0.0))


def jaccard(a: str, b: str) -> Column:
    return overlap(a, b) / F.greatest(union_size(a, b), F.lit(1))


def joined_length(words: str) -> Column:
    return F.length(F.array_join(words, ""))


def _diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def features() -> dict[str, Column]:
    """Each feature by name; floats are rounded to six digits."""
    size = F.size
    n = {
        "b1_word_match": word_match("n1", "n2"),
        "b2_jaccard": jaccard("q1w", "q2w"),
        "b3_common_words": overlap("q1w", "q2w"),
        "b4_total_unique_words": union_size("q1w", "q2w"),
        "b5_total_unq_words_stop": union_size("n1", "n2"),
        "b6_wc_diff": _diff(size("q1w"), size("q2w")),
        "b7_wc_ratio": second_to_first(size("q1w"), size("q2w")),
        "b8_wc_diff_unique": _diff(size("s1"), size("s2")),
        "b9_wc_ratio_unique": second_to_first(size("s1"), size("s2")),
        "b10_wc_diff_unq_stop": _diff(size("n1"), size("n2")),
        "b11_wc_ratio_unique_stop": second_to_first(size("n1"), size("n2")),
        "b12_same_start": F.when((size("q1w") > 0) & (size("q2w") > 0), F.get("q1w", F.lit(0)) == F.get("q2w", F.lit(0))).cast("int"),
        "b13_char_diff": _diff(joined_length("q1w"), joined_length("q2w")),
        "b14_char_ratio": second_to_first(joined_length("q1w"), joined_length("q2w")),
        "b15_char_diff_unq_stop": _diff(joined_length("n1"), joined_length("n2")),
        "l1_diff_len": _diff(F.length("question1"), F.length("question2")),
        "l2_diff_len_word": _diff(size("w1"), size("w2")),
        "l3_diff_len_char": _diff(F.length(F.regexp_replace("question1", r"\s.", "")), F.length(F.regexp_replace("question2", r"\s.", ""))),
        "e1_jaccard_distance": 1 - jaccard("w1", "w2"),
        "e2_levenshtein": F.coalesce(ratio(F.levenshtein("question1", "question2"), F.greatest(F.length("question1"), F.length("question2"))), F.lit(0.0)),
        "e4_sorensen": 1 - F.coalesce(ratio(2 * size(F.array_intersect(F.split("question1", ""), F.split("question2", ""))), size(F.array_distinct(F.split("question1", ""))) + size(F.array_distinct(F.split("question2", "")))), F.lit(0.0)),
        "u5_in_row_sets": size(F.array_except("q1w", "q2w")) * 10000 + overlap("q1w", "q2w"),
    }
    floats = {"b1", "b2", "b7", "b9", "b11", "b14", "e1", "e2", "e4"}
    return {k: F.round(v, 6) if k.split("_")[0] in floats else v.cast("long") for k, v in n.items()}
