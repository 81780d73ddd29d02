"""The long cleaning cascade: ordered rules as column expressions, then dashes and quotes by a vocabulary.

Rules run within the JVM. The two rules that ask a vocabulary are Arrow-batched functions. A vocabulary
in a table is joined to the words that a text asks for, so that no task holds more than those;
one given as words is sent to executors, and its size is checked.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from twinleaf.operators.durable import durable

#: Marks that stand for what is left out.
QUOTED, NON_ASCII, UNDEFINED = "quoted_item", "non_ascii_word", "something"
MARKS = (QUOTED, NON_ASCII, UNDEFINED)
#: Most words of a vocabulary sent to executors.
MOST_WORDS = 5_000_000

#: Patterns and what replaces them, in this order; a pattern that begins with (?i) ignores case.
RULES = [
    ("’", "'"),
    ("`", "'"),
    ("“", '"'),
    ("？", "?"),
    ("…", " "),
    ("é", "e"),
    ("'s", " "),
    ("(?i) whats ", " what is "),
    ("'ve", " have "),
    ("can't", "can not"),
    ("n't", " not "),
    ("(?i)i'm", "i am"),
    ("'re", " are "),
    ("'d", " would "),
    ("'ll", " will "),
    (r"(?i)e\.g\.", " eg "),
    (r"(?i)b\.g\.", " bg "),
    (r"(\d+)(kK)", " $1000 "),
    ("(?i)e-mail", " email "),
    (r"(?i)(the\s+|The\s+)?U\.S\.A\.", " America "),
    (r"(?i)(the\s+|The\s+)?United State(s)?", " America "),
    (r"(?i)\(s\)", " "),
    ("[c-fC-F]:/", " disk "),
    (r"[0-9]+\.[0-9]+", " 87 "),
    ("(?<=[0-9]),(?=[0-9])", ""),
    (r"\$", " dollar "),
    ("%", " percent "),
    ("&", " and "),
    (r"([!?@^+*/,~|`=:;.#\\])", " $1 "),
    (r"[^\x00-\x7F]+", " non_ascii_word "),
    ("(?i)(?<=[0-9])rs ", " rs "),
    ("(?i) rs(?=[0-9])", " rs "),
    (r" (the\s+|The\s+)?US(A)? ", " America "),
    ("(?i) UK ", " England "),
    (" india ", " India "),
    (" switzerland ", " Switzerland "),
    (" china ", " China "),
    (" chinese ", " Chinese "),
    ("(?i) imrovement ", " improvement "),
    ("(?i) intially ", " initially "),
    ("(?i) quora ", " Quora "),
    ("(?i) dms ", " direct messages "),
    ("(?i) demonitization ", " demonetization "),
    ("(?i) actived ", " active "),
    ("(?i) kms ", " kilometers "),
    ("(?i) cs ", " computer science "),
    ("(?i) upvote", " up vote"),
    ("(?i) iPhone ", " phone "),
    ("(?i) calender ", " calendar "),
    ("(?i) ios ", " operating system "),
    ("(?i) gps ", " GPS "),
    ("(?i) gst ", " GST "),
    ("(?i) programing ", " programming "),
    ("(?i) bestfriend ", " best friend "),
    ("(?i) dna ", " DNA "),
    (" III ", " 3 "),
    ("(?i) banglore ", " Banglore "),
    ("(?i) J K ", " JK "),
    (r"(?i) J\.K\. ", " JK "),
    (" quikly ", " quickly "),
    (" unseccessful ", " unsuccessful "),
    (r"(?i) demoniti\S+ ", " demonetization "),
    (r"(?i) demoneti\S+ ", " demonetization "),
    (" addmision ", " admission "),
    (" insititute ", " institute "),
    (" connectionn ", " connection "),
    (" permantley ", " permanently "),
    (" sylabus ", " syllabus "),
    (" sequrity ", " security "),
    (" undergraduation ", " undergraduate "),
    ("ig ", "ing "),
    (" latop", " laptop"),
    (" programmning ", " programming "),
    (" begineer ", " beginner "),
    (" qoura ", " Quora "),
    (" wtiter ", " writer "),
    (" litrate ", " literate "),
]
#: Fixed value: the rule that also hits words such as "big"; it can be left out.
GREEDY_RULE = ("ig ", "ing ")
#: Brackets and quotes, each from its first opening to its last closing sign.
SPANS = ('".*"', "'.*'", r"\(.*\)", r"\[.*\]", r"\{.*\}", "<.*>")


def lower_starts(text: Column) -> Column:
    """The first letter of the text, and of whatever follows a full stop, quote or closing bracket, in lower case."""
    pieces = F.split(text, r"(?<=[.?!)'\"])", -1)
    first = lambda p: F.regexp_extract(p, r"^\s*.", 0)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.lower(first(p)), F.substr(p, F.length(first(p)) + 1))), "")


def ruled(text: Column, greedy: bool = True) -> Column:
    """All rules in turn; ``greedy`` keeps ``GREEDY_RULE``. Words at both ends count as between spaces."""
    rules = [r for r in RULES if greedy or r != GREEDY_RULE]
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rules, F.concat(F.lit(" "), lower_starts(text), F.lit(" ")))


def split_dashes(text: str, known) -> str:
    """Words joined by dashes come apart where all parts are known, and are joined by underscores elsewhere."""

    def each(m: re.Match) -> str:
        parts = [p for p in m[0].split("-") if p]
        return " ".join(parts) if all(p in known and p not in MARKS for p in parts) else "_".join(parts)

    return re.sub(r"[a-zA-Z0-9-]*-[a-zA-Z0-9-]*", each, text)


def keep_meaningful(text: str, known) -> str:
    """A quoted or bracketed span without any known word of three letters or more becomes a mark."""

    def each(m: re.Match) -> str:
        words = re.findall(r"\w+|[^\w\s]", m[0][1:-1])
        if any(w in MARKS or len(w) > 2 and not w.isdigit() and w in known for w in words):
            return m[0]
        return f" {m[0][0]} {QUOTED} {m[0][-1]} "

    for span in SPANS:
        text = re.sub(span, each, text)
    return text


def dash_parts(text: str) -> list[str]:
    """The words that ``split_dashes`` asks for."""
    return [p for m in re.findall(r"[a-zA-Z0-9-]*-[a-zA-Z0-9-]*", text) for p in m.split("-") if p] if "-" in text else []


def spanned_words(text: str) -> list[str]:
    """The words that ``keep_meaningful`` may ask for: of texts with a span, those of three letters or more."""
    return [w for w in re.findall(r"\w+", text) if len(w) > 2 and not w.isdigit()] if any(re.search(s, text) for s in SPANS) else []


def by_vocabulary(df: DataFrame, key: list[str], column: str, words: DataFrame, rule, asks) -> DataFrame:
    """``df`` with ``rule(text, known)`` in ``column``; of what ``asks(text)`` gives, known has the words in the table ``words``."""

    @F.pandas_udf(ArrayType(StringType()))
    def asked(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else sorted(set(asks(t))))

    @F.pandas_udf(StringType())
    def each(text: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rule(t, frozenset(() if k is None else k)) for t, k in zip(text, known)], dtype=object)

    known = df.select(*key, F.explode(asked(column)).alias("word")).join(words.select("word"), "word", "left_semi").groupBy(*key).agg(F.collect_set("word").alias("_known"))
    return df.join(known, key, "left").withColumn(column, each(column, "_known")).drop("_known")


def with_vocabulary(spark: SparkSession, words, rule):
    """A column function that applies ``rule(text, words)``; ``words`` is an iterable, or a DataFrame with ``word``."""
    if isinstance(words, DataFrame):
        words = (r.word for r in words.select("word").limit(MOST_WORDS + 1).collect())
    known = frozenset(words)
    if len(known) > MOST_WORDS:
        raise ValueError(f"a vocabulary of {len(known)} words is more than {MOST_WORDS}")
    shared = spark.sparkContext.broadcast(known)

    @F.pandas_udf(StringType())
    def each(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else rule(t, shared.value))

    return each


def padded(text: Column) -> Column:
    """Spaces around brackets and quotes; lone ``s`` and runs of white space go."""
    for pattern, to in ((r"([()\[\]{}<>'\"])", " $1 "), (" s ", " "), (r"\s+", " ")):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return F.trim(text)


def clean_string(spark: SparkSession, text: Column, words, greedy: bool = True) -> Column:
    """The whole cascade; null and empty texts give an empty text."""
    named = with_vocabulary(spark, words, lambda t, known: keep_meaningful(split_dashes(t, known), known))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(padded(named(ruled(text, greedy))))


def cleaned_strings(df: DataFrame, key: list[str], column: str, words: DataFrame, greedy: bool = True) -> DataFrame:
    """As ``clean_string`` in ``column``, with the vocabulary in a table."""
    out = durable(df.withColumn(column, F.when(F.coalesce(column, F.lit("")) != "", ruled(F.col(column), greedy))))
    out = durable(by_vocabulary(out, key, column, words, split_dashes, dash_parts))
    out = by_vocabulary(out, key, column, words, keep_meaningful, spanned_words)
    return out.withColumn(column, F.coalesce(padded(F.col(column)), F.lit("")))
