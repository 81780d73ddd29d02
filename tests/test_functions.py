import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from twinleaf.functions import cleaning, fuzzy, lexical, vectors
from twinleaf.operators import assemble
from twinleaf.sources import fixtures


def test_edit_functions():
    assert fuzzy.alignment_distance("abc", "abc") == 0
    assert fuzzy.alignment_distance("", "") == 0
    assert fuzzy.alignment_distance("ab", "ba") == pytest.approx(2 / 3)  # the longest of the alignments of cost 2
    for f in fuzzy.RATIOS.values():
        assert f("new york mets", "new york mets") == 100
        assert f("", "a") == 0
        assert 0 <= f("a b c", "c d") <= 100


def test_ratio_edges(spark):
    df = spark.createDataFrame([(0, 3), (2, 0), (2, 3)], "a int, b int")
    assert [r[0] for r in df.select(lexical.second_to_first(F.col("a"), F.col("b"))).collect()] == [0.0, None, 1.5]


def test_clean(spark):
    df = spark.createDataFrame([("What's 10k,  i'm",)], "t string")
    assert df.select(cleaning.clean(F.col("t"))).first()[0] == "what is 10000 i am "


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "a array<double>")
    assert df.select(vectors.normalized(F.col("a"))).first()[0] is None


def test_flip_checks_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, a int, b int")
    assert sorted(tuple(r) for r in assemble.flipped(df, [("a", "b")]).collect()) == [(1, 2, 3, 0), (1, 3, 2, 1)]
    with pytest.raises(ValueError):
        assemble.flipped(df, [("a", "c")])


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 1, 2, 'a "b", c\nd', None, 0)]
    fixtures.write_pairs_csv(fixtures.fill_texts(spark.createDataFrame(rows, fixtures.TRAIN_SCHEMA)), str(tmp_path / "x"))
    assert [tuple(r) for r in fixtures.read_pairs_csv(spark, str(tmp_path / "x")).collect()] == [(1, 1, 2, 'a "b", c\nd', "nan", 0)]


def plain_alignment(a, b):
    row = [(j, -j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, -i)]
        for j, y in enumerate(b, 1):
            cost, length = min((row[j - 1][0] + (x != y), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1]))
            new.append((cost, length - 1))
        row = new
    return row[-1][0] / -row[-1][1] if row[-1][1] else 0.0


def test_alignment_against_pairs():
    def plain(a, b):
        row = [(j, -j) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [(i, -i)]
            for j, y in enumerate(b, 1):
                cost, length = min((row[j - 1][0] + (x != y), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1]))
                new.append((cost, length - 1))
            row = new
        return row[-1][0] / -row[-1][1] if row[-1][1] else 0.0

    for a, b in [("kitten", "sitting"), ("abc", ""), ("", "x"), ("aabba", "bab"), ("naïve", "naive"), ("abcdef", "fedcba")]:
        assert fuzzy.alignment_distance(a, b) == pytest.approx(plain(a, b))


def matched(a, b):
    """Characters in matching blocks: the longest one, the first in a and then in b, and so on at both sides of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n and n + matched(a[:i], b[:j]) + matched(a[i + n:], b[j + n:])


def blocks(a, b, i0=0, j0=0):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return blocks(a[:i], b[:j], i0, j0) + [(i0 + i, j0 + j)] + blocks(a[i + n:], b[j + n:], i0 + i + n, j0 + j + n) if n else []


def share(a, b):
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def plain_ratio(a, b):
    return round(100 * share(a, b)) if a and b else 0


def plain_partial(a, b):
    if not a or not b:
        return 0
    a, b = sorted((a, b), key=len)
    rs = [share(a, b[max(j - i, 0):max(j - i, 0) + len(a)]) for i, j in blocks(a, b) + [(len(a), len(b))]]
    return 100 if max(rs) > 0.995 else round(100 * max(rs))


def plain_sorted(a, b, by):
    return by(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def plain_sets(a, b, by):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    one, two = [(both + " " + " ".join(sorted(s))).strip() for s in (x - y, y - x)]
    return max(by(both, one), by(both, two), by(one, two))


def test_ratios_against_plain_blocks():
    """Texts of lower-case words, so that normalising leaves them; the parts of the weighted ratio follow from the lengths."""
    rng = random.Random(3)
    make = lambda: " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))
    for _ in range(250):
        a, b = make(), make()
        want = {
            "f1_qratio": plain_ratio(a, b),
            "f3_partial_ratio": plain_partial(a, b),
            "f4_partial_token_set_ratio": plain_sets(a, b, plain_partial),
            "f5_partial_token_sort_ratio": plain_sorted(a, b, plain_partial),
            "f6_token_set_ratio": plain_sets(a, b, plain_ratio),
            "f7_token_sort_ratio": plain_sorted(a, b, plain_ratio),
        }
        if a and b:
            far = max(len(a), len(b)) / min(len(a), len(b))
            scale = 1 if far < 1.5 else 0.6 if far > 8 else 0.9
            by = plain_ratio if far < 1.5 else plain_partial
            parts = [plain_ratio(a, b), 0.95 * scale * plain_sorted(a, b, by), 0.95 * scale * plain_sets(a, b, by)] + ([scale * plain_partial(a, b)] if far >= 1.5 else [])
            want["f2_wratio"] = round(max(parts))
        for name, value in want.items():
            assert fuzzy.RATIOS[name](a, b) == value, (name, a, b)


def test_blocks_are_difflibs():
    """Short and long texts, where popular characters begin no match, and texts with the signs that mask them."""
    rng = random.Random(8)
    for k in range(400):
        letters = "ab" if k % 4 == 0 else "abcdefgh " if k % 4 == 1 else "abcdefghijklmnopqrstuvwxyz     eeeetttaaa.,'-0123456789"
        make = lambda: "".join(rng.choice(letters) for _ in range(rng.choice((0, 5, 60, 199, 200, 450))))  # noqa: E731,B023
        a, b = make(), make()
        if k % 3 == 0:
            b = a[len(a) // 3:] + b[:100] + a[:50]
        if k % 50 == 0:
            a += "\ud800"
        want = SequenceMatcher(None, a, b)
        assert fuzzy._share(a, b) == want.ratio()
        joined = [tuple(m) for m in want.get_matching_blocks()[:-1]]
        got = sorted(fuzzy.matching_blocks(a, b))
        assert {(i - j, i + n) for i, j, m in got for n in range(m)} == {(i - j, i + n) for i, j, m in joined for n in range(m)}


def test_long_texts_take_little_time():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    pairs = [(" ".join(rng.choices(words, k=30)), " ".join(rng.choices(words, k=100))) for _ in range(20)]
    began = time.process_time()
    want = [max(SequenceMatcher(None, a, b[max(j - i, 0):max(j - i, 0) + len(a)]).ratio() for i, j, _ in SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs]
    plain, began = time.process_time() - began, time.process_time()
    assert [fuzzy.partial_ratio(a, b) for a, b in pairs] == [round(100 * w) for w in want]
    assert time.process_time() - began < plain / 2


def test_alignments_in_batches():
    rng = random.Random(10)
    pairs = [tuple("".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(2)) for _ in range(200)] + [("a" * 3000, "ab" * 1500), ("é😀", "e😀")]
    assert fuzzy.alignment_distances(pairs) == [plain_alignment(a, b) for a, b in pairs]
