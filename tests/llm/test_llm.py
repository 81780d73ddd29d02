"""The operators against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinleaf.llm import automaton, common, decontamination, jaccard_join, kmeans_tree, lm_scoring, packing, pii, secrets, sharding, sieve, suffix_dedup, toxicity
from twinleaf.llm import queries
from twinleaf.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, chunk string, shard string, n_chars long"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, ids=None):
    """Documents with column names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 0) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Alpha", "beta", "gamma,", "delta.", "épée", "zeta", "eta", "theta"]) + rng.choice(["", "", "x", "y", "z"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(25)]
    texts = base + base[:10] + [" ".join(w if rng.random() > 0.01 else "odd" for w in b.split()) for b in base for _ in range(3)]
    return texts + [prose(rng, 20) + base[3][:150] + prose(rng, 20) for _ in range(5)] + [None, None, "", "", "a b", "A  B", " \t ", "word " * 3000, None, "x"]


@pytest.fixture(params=["one chunk", "chunks", "groups of buckets"])
def dealt(request, monkeypatch):
    """The exchange in one chunk, in many, and with tasks between chunks and buckets."""
    if request.param != "one chunk":
        for m in (jaccard_join, suffix_dedup, lm_scoring):
            monkeypatch.setattr(m, "CHUNK_BYTES", 12_000)
    if request.param == "groups of buckets":
        monkeypatch.setattr(common, "FAN", 3)
        monkeypatch.setattr(common, "LEAST_BUCKETS", 8)


def empty(spark):
    return frame(spark, [])


def words(t):
    return re.findall(r"[^ \t-\r]+", (t or "").translate(LETTERS))


def test_exchange_returns_each_reply():
    """Blobs go to their buckets and replies come back to the chunk that asked."""
    blobs = [(3, b"abc"), (70000, b""), (5, b"x" * 300)]
    assert common.opened(common.packed(blobs)) == blobs and common.opened(common.packed([])) == []
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    found, end = lm_scoring._keys(lm_scoring._planes(keys) + b"tail")
    assert (found == keys).all() and end == len(lm_scoring._planes(keys))


def test_words_in_runs():
    rng = random.Random(18)
    for _ in range(300):
        text = "".join(rng.choice("ab É\t\n\x0b\r é") for _ in range(rng.randint(0, 40)))
        for run in (1, 3, 1000):
            assert [w for ws in common.word_runs(text, run) for w in ws] == text.encode().lower().split()
    assert list(common.word_runs(None)) == []


def test_sieve_keeps_all_shared_keys():
    """Keys of two chunks stay, whatever their owners; so do those with two owners in one chunk."""
    rng = np.random.default_rng(2)
    tokens = [np.unique(rng.choice(5000, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(4)]
    tokens = [np.sort(t) for t in tokens]
    more = [rng.random(len(t)) < 0.05 for t in tokens]
    asked = [dict(sieve.questions(t, m, 7)) for t, m in zip(tokens, more)]
    got = [{} for _ in tokens]
    for b in range(7):
        who = [i for i, a in enumerate(asked) if b in a]
        for i, blob in zip(who, sieve.replies(2)([asked[i][b] for i in who])):
            got[i][b] = blob
    times = Counter(int(x) for t in tokens for x in t)
    several = {int(x) for t, m in zip(tokens, more) for x in t[m]}
    for t, g in zip(tokens, got):
        shared, hot = sieve.told(t, 7, g)
        assert shared.tolist() == [times[int(x)] > 1 or int(x) in several for x in t]
        assert hot.tolist() == [times[int(x)] > 2 for x in t]


@pytest.mark.parametrize("ids", [(0, -1018231460777725123), (0, 5)])
def test_suffix_dedup_of_any_two_ids(spark, ids, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 200)
    passage = "".join(chr(97 + k * k % 26) + chr(97 + k % 23) for k in range(60))
    docs = frame(spark, [passage, "x" + passage], ids)
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicate(docs).collect()}
    assert removed == {min(ids): 0, max(ids): len(passage)}


def test_connected_with_hubs(spark):
    """A star, a path and pairs: each class gets the smallest of its component."""
    edges = [(5000, k) for k in range(5001, 5400)] + [(k, k + 1) for k in range(100, 160)] + [(k, k + 1) for k in range(0, 80, 2)]
    got = dict(map(tuple, jaccard_join.connected(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{k: 5000 for k in range(5000, 5400)}, **{k: 100 for k in range(100, 161)}, **{k: k - k % 2 for k in range(80)}}


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard_components(spark, corpus, dealt, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    sets = []
    for t in corpus:
        w = words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(frame(spark, corpus)).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}
    kept = {r.doc_id for r in jaccard_join.keep_first(frame(spark, corpus)).collect()}
    assert kept == {i for i in range(len(sets)) if not sets[i] or root(i) == i}


@pytest.mark.parametrize("hot", [512, 0])
def test_suffix_dedup(spark, corpus, dealt, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    seen, want = set(), {}
    for i, t in enumerate(corpus):
        b = (t or "").encode()
        own = [b[k:k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, s in enumerate(own):
            if s in seen:
                gone[k:k + 50] = b"\1" * 50
        seen |= set(own)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.deduplicate(frame(spark, corpus)).collect()} == want


def test_long_texts_in_stretches(monkeypatch):
    """Every window of 50 bytes lies in one piece, under the same key as where texts are not cut."""
    import pyarrow as pa

    rng = random.Random(17)
    texts = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (10, 49, 50, 700, 130, 128, 3000, 1, 177)] + [None, "é" * 400]
    table = pa.table({"doc_id": pa.array([*range(10), None], pa.int64()), "text": pa.array(texts)})
    seen = []
    for stride in (1 << 16, 64, 100):
        monkeypatch.setattr(suffix_dedup, "STRIDE", stride)
        p = suffix_dedup._Pieces(table)
        windows = [(s + k, key, d) for s, n, key, d in zip(p.start.tolist(), p.windows.tolist(), p.key.tolist(), p.doc.tolist()) for k in range(n)]
        assert len(windows) == len({w[0] for w in windows}) == sum(max(len(t or "") - 49, 0) for t in texts[:10])
        assert p.windows.max() <= suffix_dedup.LENGTH - suffix_dedup.GRAM + 1
        seen.append(sorted(windows))
    assert seen[0] == seen[1] == seen[2]


def test_column_wise_construction():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(20)]
    width = max(map(len, texts))
    m = np.zeros((20, width), np.uint8)
    for i, t in enumerate(texts):
        m[i, width - len(t):] = [ord(c) - 96 for c in t]
    before, common, owner, depth = suffix_dedup.collection(m, np.array([len(t) for t in texts]))
    order = sorted((t[k:], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
    assert [(int(o), len(texts[o]) - int(d)) for o, d in zip(owner, depth)] == [(i, k) for _, i, k in order]
    assert [int(b) for b in before] == [ord(texts[i][k - 1]) - 96 if k else 0 for _, i, k in order]
    lcp = [0] + [len(re.match(r"(.*)\n", a + "\n").group(1)) if a == b[:len(a)] else next(k for k in range(len(a)) if a[k:k + 1] != b[k:k + 1]) for (a, *_), (b, *_) in zip(order, order[1:])]
    assert [int(c) for c in common] == lcp


def test_lm_scoring(spark, corpus, dealt):
    chosen = {1, 2, 3, 30}
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(frame(spark, corpus), spark.createDataFrame([(i,) for i in chosen | {10**6}], "doc_id long")).collect()}
    tok = [(t or "").encode().lower().split() for t in corpus]
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in enumerate(tok):
        for k in (0, 1) if i in chosen else (0,):
            uni[k].update(w)
            uni[k]["^"] += bool(w)
            bi[k].update(zip(["^", *w], w))
    n = [sum(u.values()) - u["^"] for u in uni]
    for i, w in enumerate(tok):
        means = []
        for k in (0, 1):
            p = lambda x: (uni[k][x] + 1000 * uni[0][x] / n[0]) / (n[k] + 1000)
            means.append(np.mean([-np.log((bi[k][a, b] + 5 * p(b)) / (uni[k][a] + 5)) for a, b in zip(["^", *w], w)]) if w else None)
        assert got[i].n_tokens == len(w)
        if w:
            assert got[i].loss_background == pytest.approx(means[0]) and got[i].loss_target == pytest.approx(means[1])
        else:
            assert got[i].score is None


def test_sharding(spark, corpus):
    rows = sharding.balanced_label_propagation(frame(spark, corpus), 4).collect()
    assert len(rows) == len(corpus)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    group = defaultdict(set)
    for r in rows:
        assert r.text_crc32 == zlib.crc32((corpus[r.doc_id] or "").encode()) and r.size == 8 + len((corpus[r.doc_id] or "").encode())
        group[corpus[r.doc_id] or ""].add(r.shard)
    assert sum(len(g) > 1 for g in group.values()) <= 1


@pytest.mark.parametrize("groups", [[40], [10, 10, 10, 10], [13, 9, 8, 1, 1], [2] * 21])
def test_sharding_without_slack(spark, groups):
    texts = [f"g{i}" for i, n in enumerate(groups) for _ in range(n)]
    rows = sharding.balanced_label_propagation(frame(spark, texts), 4).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("groups", [[800] + [2] * 60 + [30] * 10, [790, 150] + [60] * 9, [70] * 12 + [20] * 30])
def test_sharding_of_large_groups(spark, groups):
    texts = [f"g{i}" for i, n in enumerate(groups) for _ in range(n)]
    texts += [f"single {i}" for i in range(2400 - len(texts))]
    rows = sharding.balanced_label_propagation(frame(spark, texts), 24).collect()
    assert set(Counter(r.shard for r in rows).values()) == {100}
    held = defaultdict(set)
    for r in rows:
        held[texts[r.doc_id]].add(r.shard)
    assert [len(held[f"g{i}"]) for i in range(len(groups))] == [-(-n // 100) for n in groups]


def test_allowed_moves_fill_the_room():
    flows = {(s, 23): 3044 for s in range(23)}
    allowed = sharding._allowed(flows, [0] * 23 + [20])
    assert sum(allowed.values()) == 20 and all(allowed[k] <= n for k, n in flows.items())


def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary())
    texts = [*corpus, "a<|endoftext|>b", "  \n\n x 　 é😀", "don't DON'T 12345 ###"]
    rows = packing.pack(frame(spark, texts), vocabulary()).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by = defaultdict(list)
    for r in rows:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids, at = [*slow.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


FORMS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def test_secret_automaton():
    rng = random.Random(2)
    bits = ["password", "SECRET", "token", "api_key", "=", ":", " ", '"', "AKIA", "A1B2C3D4E5F6G7", "0123456789abcdef", "ab12", "é", "passwd", "secret=token :abcdefghijklmnop"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        want = []
        for kind, form in FORMS.items():
            for m in re.finditer(form, t, re.A):
                if (len(m[2]) >= 12 if kind == "assign" else m.end() - m.start() >= {"access": 18, "hex": 16}[kind]):
                    want.append((m.start(), automaton.KINDS.index(kind), m.end(), kind))
        assert [x for x in automaton.scan_text(t) if x[0] in FORMS] == [(k, s, e) for s, _, e, k in sorted(want)]


def test_secret_redaction(spark):
    docs = frame(spark, ["a password=abcdefghijklmnop b", None, ""])
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert got[0].text == "a [SECRET] b" and got[0].n_chars == 12 and got[1].text is None and got[0].chunk == "x"


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(t):
    found = []
    for k, (kind, form) in enumerate(PERSONAL.items()):
        for m in re.finditer(form, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            twice = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
            if {"email": True, "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255 if kind == "ip" else False, "card": 14 <= len(d) <= 19 and twice % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]:
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in sorted(found))


def test_pii_base(spark):
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "x-y.com", "_", "1", "456", "255", "256", ".", ".", "0001", " ", "-", "+", "(", "é", "4539578763621486", "+1 (376) 555-9077", "42.1.2.3", "a@b.co", "😀", "79927398713"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["1 2 3 4 " * 1000, "9" * 3000, "a" * 3000 + "@b", None, ""]
    for r in pii.find(frame(spark, texts)).collect():
        want = personal(texts[r.doc_id])
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want.split(",")) for k in PERSONAL]


def test_boosting_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    kind, apart = np.zeros(400, int), np.arange(400) % 5 == 0
    m = pii.boost(x, y, kind, apart)
    picked = m.margin(x) >= m.thresholds[0]
    assert (y[picked] == 1).mean() > 0.95 and picked.sum() > 0.7 * y.sum() and m.thresholds[1] == np.inf
    assert pii.boost(x, np.zeros(400), kind, apart) is None


@pytest.fixture(scope="module")
def private(spark):
    """Documents with base spans, and the model fitted on them."""
    rng = random.Random(8)
    card = lambda: next(c for c in iter(lambda: "".join(rng.choice("0123456789") for _ in range(16)), "") if personal(c))
    make = {"email": lambda: f"{rng.choice('abc')}{rng.choice('xyz')}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": card, "phone": lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"}
    texts = [f"{prose(rng, 20)} {make[k]()} {prose(rng, 12)}" for k in make for _ in range(60)]
    return pii.fit(frame(spark, texts)), make, rng


def test_pii_margins_in_sql(spark, private):
    model = private[0]
    rows = pii.labelled(pii.planted(frame(spark, ["write to a.b@c.example.com or call +1 (376) 555-9077 from 10.0.0.1 " + "word " * 40]))).withColumn("margin", model.expression(F.col("f"))).collect()
    assert len(rows) > 20 and {r.y for r in rows} == {0, 1}
    assert model.margin(np.array([r.f for r in rows], float)) == pytest.approx([r.margin for r in rows])


def test_pii_adds_what_base_patterns_miss(spark, private):
    model, make, rng = private
    assert np.isfinite(model.thresholds).all()
    hidden = {"email": make["email"]().replace("@", " (at) "), "ip": "10,7,44,203", "phone": make["phone"]()[3:]}
    card = make["card"]()
    hidden["card"] = card[:-1] + str((int(card[-1]) + 3) % 10)
    clean = ["on 2024-05-17 10:30 it was", "release 12.4.0.3391 of it", "about 12,345,678,901 in all", "isbn 978-3-16-148410-0 here", "order 123456789012 came", "they met @ noon there", 'token="ab12345678901234567f" is set']
    texts, want = [], []
    for kind, form in hidden.items():
        a = prose(rng, 9)
        texts.append(f"{a} {form} {prose(rng, 9)}")
        want.append(f"{kind}:{len(a) + 1}:{len(a) + 1 + len(form)}")
    rows = sorted(pii.find(frame(spark, texts + clean), model).collect(), key=lambda r: r.doc_id)
    assert [r.spans for r in rows] == want + [""] * len(clean)
    assert {(r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows} == {(0, 0, 0, 0, hashlib.sha256(b"").hexdigest())}


def test_decontamination(spark):
    rng = random.Random(4)
    item = [f"w{i}q" for i in range(40)]
    noisy = list(item)
    noisy[4] = noisy[17] = "odd"
    filler = lambda n: [f"f{rng.randint(0, 9**6)}" for _ in range(n)]
    texts = [" ".join(filler(30) + item + filler(9)), " ".join(filler(5) + noisy), " ".join(filler(60)), None, "", " ".join(item[:13]), " ".join(filler(3) + item[:8])]
    bench = spark.createDataFrame([(7, ", ".join(item)), (8, None), (9, "short one")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find(frame(spark, texts), bench).collect()) == [(0, 7), (1, 7), (5, 7)]
    assert {r.doc_id for r in decontamination.keep_clean(frame(spark, texts), bench).collect()} == {2, 3, 4, 6}


def test_decontamination_parts_at_all_signs(spark):
    item = [f"é{i}q" for i in range(13)]
    marks = ["\u201c", "\u201d", "\u2019", "\u2013", "\u2014", "\u2026", "\u00ab", "\u00bb", "\u00bf", "\u00a0", "\u3000", "\u3002", "\uff0c"]
    texts = ["".join(m + w for m, w in zip(marks, item)), *[m.join(item) for m in marks], "\u3000".join(item) + "\u3002", "".join(item)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "\u2026")], "item_id long, text string")
    found = decontamination.find(frame(spark, texts), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.matched) for r in found) == [(i, 7, 13) for i in range(len(texts) - 1)]


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_decontamination_of_all_substitutions(spark, most, monkeypatch):
    """Every placement of up to three substitutions, with the benchmark broadcast and shuffled."""
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in range(1, 15)}
    texts, want = [], set()
    for n, item in items.items():
        for places in [(), *combinations(range(n), 1), *combinations(range(n), 2), *(combinations(range(n), 3) if n == 13 else ())]:
            w = ["odd" if k in places else x for k, x in enumerate(item)]
            width = min(n, 13)
            if any(100 * sum(a == b for a, b in zip(w[k:k + width], item[k:k + width])) >= 80 * width for k in range(n - width + 1)):
                want |= {(len(texts), n), (len(texts) + 1, n)}
            texts += [" ".join(w), " ".join(["before", "it", *w, "after", "it"])]
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find(frame(spark, texts), bench).collect()}
    assert got == want


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_decontamination_against_all_alignments(spark, most, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
    rng = random.Random(9)
    few = lambda n: [rng.choice("abcd") for _ in range(n)]
    items = {1: few(20), 2: few(14), 3: ["a"] * 30, 4: few(9), 5: few(3)}
    texts = [few(rng.randint(5, 60)) for _ in range(60)] + [["a"] * 200, items[1][2:18], []]
    want = set()
    for d, t in enumerate(texts):
        for i, item in items.items():
            width, best = min(13, len(item)), 0
            for lag in range(-len(item) + 1, len(t)):
                same = [0 <= k + lag < len(t) and t[k + lag] == item[k] for k in range(len(item))]
                best = max(best, *(sum(same[k:k + width]) for k in range(len(item) - width + 1)))
            if 100 * best >= 80 * width:
                want.add((d, i, best, width))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    docs = frame(spark, [" ".join(t) for t in texts])
    assert {tuple(r) for r in decontamination.find(docs, bench).collect()} == want
    kept = [r.doc_id for r in decontamination.keep_clean(docs.withColumn("doc_id", F.expr("if(doc_id < 62, doc_id, null)")), bench).collect()]
    assert sorted(x for x in kept if x is not None) == [d for d in range(62) if d not in {w[0] for w in want}] and kept.count(None) == 1


def test_kmeans_tree(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out, told = kmeans_tree.nearest(df, df.filter("vec_id % 50 = 0"))
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        hit += len(set(got[q]) & set(np.lexsort((np.arange(600), -s))[:5].tolist()))
    assert hit >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert got[100] == [5, 101, 102, 103, 104]


def test_toxicity(spark):
    rng = random.Random(6)
    texts = [prose(rng, 40) + (" vile" if i % 3 == 0 else "") + prose(rng, 10) for i in range(900)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    rows = toxicity.score(frame(spark, texts), labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.9
    assert {r.predicted for r in toxicity.score(frame(spark, texts), labels.limit(0)).collect()} == {0}


def test_empty_tables(spark):
    docs = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (jaccard_join.components(docs), suffix_dedup.deduplicate(docs), lm_scoring.cross_entropy_difference(docs, labels), sharding.balanced_label_propagation(docs), packing.pack(docs, vocabulary()), secrets.scan(docs), secrets.redact(docs), pii.find(docs, pii.fit(docs)), decontamination.find(docs, bench), toxicity.score(docs, labels), kmeans_tree.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "vec_id long, embedding array<float>"))[0]):
        assert df.count() == 0


def test_null_ids_and_repeats(spark, corpus):
    docs = frame(spark, [*corpus[:4], corpus[0], corpus[0]], [None, 1, 1, 2, None, 2])
    for df in (jaccard_join.components(docs), suffix_dedup.deduplicate(docs), lm_scoring.cross_entropy_difference(docs, docs.select("doc_id")), sharding.balanced_label_propagation(docs, 3), secrets.scan(docs), pii.find(docs)):
        assert df.count() == 6


def test_rows_without_id_take_part_in_filters(spark, corpus):
    a, b = corpus[0], corpus[1]
    docs = frame(spark, [a, a, b, b, None, None, a], [None, 4, None, None, None, None, 5])
    rows = [(r.doc_id, r.text) for r in jaccard_join.keep_first(docs).collect()]
    assert sorted(rows, key=str) == sorted([(4, a), (None, b), (None, None), (None, None)], key=str)


def first_of_each_group(texts):
    """Indices of one text for each component of near-duplicates, by comparing all pairs."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i for i in range(len(sets)) if not sets[i] or root(i) == i}


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    """Every stage on what the one before kept: nulls, empty texts, repeated rows, rows without id and an extra column."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from twinleaf.llm.common import durable

    rng = random.Random(14)
    item = [f"q{k}z" for k in range(20)]
    texts = corpus[:40] + [prose(rng, 30) + " vile " + prose(rng, 5) for _ in range(150)] + [prose(rng, 35) for _ in range(300)]
    texts += [prose(rng, 9) + " " + " ".join(item) + " " + prose(rng, 9), prose(rng, 12) + " password=abcdefghijklmnop " + prose(rng, 3), None, "", "word " * 9000]
    ids = list(range(len(texts)))
    docs = frame(spark, texts + [texts[0], texts[41], texts[60], "only here " + prose(rng, 20)], ids + [0, 41, None, None])
    sf = str(tmp_path)
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(t is not None and "vile" in t)) for i, t in enumerate(texts[:480])], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable(stage(spark, docs, sf))
        kept[name] = docs
        assert name == "packing" or docs.columns == before.columns
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    all_rows = rows(spark.read.parquet(f"{sf}/documents.parquet"))
    scores = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    toxic = Counter(r.doc_id for r in scores if r.predicted)
    sane = rows(kept["toxicity"])
    assert Counter(d for d, _ in all_rows) - Counter(d for d, _ in sane) == toxic
    order = sorted(range(len(sane)), key=lambda i: (sane[i][0] is None, sane[i][0] or 0))
    first = first_of_each_group([sane[i][1] for i in order])
    unique = rows(kept["jaccard_join"])
    keep = lambda x: {r for r in x if words(r[1])}
    assert keep(unique) == keep(sane[order[i]] for i in first) and len(keep(unique)) == sum(bool(words(t)) for _, t in unique)
    clean = rows(kept["decontamination"])
    assert clean == [r for r in unique if " ".join(item) not in (r[1] or "")]
    safe = rows(kept["secret_scans"])
    assert safe == sorted(((d, secrets.redact_text(t)) for d, t in clean), key=str) and not any("password=" in (t or "") for _, t in safe)
    slow = Tokenizer.from_file(vocabulary())
    sizes = Counter()
    for r in docs.collect():
        sizes[r.doc_id] += r.length
    want = Counter()
    for d, t in safe:
        want[d] += len(slow.encode(t or "", add_special_tokens=False).ids) + 1
    assert sizes == want
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = durable(stage(spark, none, sf))
    assert none.count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    from twinleaf.llm.common import durable

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert docs.agg(F.sum("length")).first()[0] > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_in_sql(spark, name):
    import duckdb

    duck, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "labels"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = duck.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, cur.fetchall())) == sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


FORMS_ADDED = {"github": (r"gh[pousr]_[A-Za-z0-9]+", 40), "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 15), "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40), "pem": (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0)}


def test_added_secret_kinds():
    rng = random.Random(12)
    bits = ["ghp_", "gho_", "xoxb-", "xoxp-1", "eyJ", ".eyJ", ".", "abcDEF0123456789", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", " ", "é", "_", "-"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = [(m.start(), automaton.KINDS.index(k), m.end(), k) for k, (form, least) in FORMS_ADDED.items() for m in re.finditer(form, t, re.A) if m.end() - m.start() >= least]
        assert [x for x in automaton.scan_text(t) if x[0] in FORMS_ADDED] == [(k, s, e) for s, _, e, k in sorted(want)]
