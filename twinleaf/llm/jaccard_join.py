"""N-gram Jaccard join by signature trees.

A document's set is its distinct five-word shingles. Documents with equal sets form a class.

1. Sieve: every chunk asks the hash buckets which of its shingles occur in another class or chunk. A set
   in which fewer than 80 % are shared can have no partner and leaves.
2. Coarse clusters: partners share one of the first (shared - needed + 1) shingles in hash order; the
   connected components over those shingles hold every link.
3. Within a cluster's blocks, signature trees: leaves of token bitmaps, nodes with the bitmaps
   combined by OR, size ranges and slack; a dual traversal drops node pairs whose largest
   possible overlap is too small or whose members are linked already, and the rest is compared exactly.
   Clusters over one block first link one member for each block and component found, then
   only those pairs of blocks that still hold more than one component.

Links are judged exactly: SHARE of the union at least, on 64-bit shingle hashes; classes are told apart by 128 bits. Only membership is
returned, so no group of copies is expanded to pairs. Keys with many rows (a hub, a giant component, a frequent
shingle) are joined by broadcasting their one partner; large clusters are numbered in salted runs.

Defined cases: fewer than five words are one shingle; null and empty texts, and those without words, have none and are
linked with nothing; very long texts are taken whole; repeated rows are links of one class; ties of size go by class; rows without
doc_id are linked like others, their component has the smallest doc_id there is (null without any), and ``keep_first`` keeps one of them only where no
row of their group has a doc_id; an empty table gives no rows; other columns are kept by ``keep_first`` and ignored by ``components``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinleaf.llm import sieve
from twinleaf.llm.common import Exchange, arrow_schema, durable, hot_join, hot_keys, partitions, release, running, with_ids, word_runs

WORDS, SHARE = 5, 80
CHUNK_BYTES = 4 << 20
#: A block has at most BLOCK members, and at most BLOCK * SHORT shingles (and one member): a member counts as SHORT shingles at least.
BLOCK, SHORT, LEAF, FANOUT, BITS = 2048, 512, 16, 8, 4096
#: Fixed value: an odd multiplier that mixes word hashes.
MIX = 0x9E3779B97F4A7C15


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    seen: dict[bytes, int] = {}
    runs = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)) for words in word_runs(text)]
    ids = np.concatenate(runs) if runs else np.zeros(0, np.int32)
    if not len(ids):
        return np.zeros(0, np.uint64)
    if len(ids) < WORDS:
        names = list(seen)
        return np.array([xxhash.xxh64_intdigest(b" ".join([names[i] for i in ids]), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))[ids]
    out = np.zeros(len(h) - WORDS + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            out = (out + h[k:k + len(out)]) * np.uint64(MIX)
            out ^= out >> np.uint64(31)
    return np.unique(out)


def class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sets(table: pa.Table) -> tuple[list, list[np.ndarray], list[bytes]]:
    rows = table.to_pydict()
    sets = [shingles(t) for t in rows["text"]]
    return rows["doc_id"], sets, [class_of(s) for s in sets]


def _distinct(sets: list[np.ndarray], classes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a chunk's classes, in order, with the number of their class there."""
    one = list(dict(zip(classes, sets)).values())
    if not one:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens = np.concatenate(one)
    owner = np.repeat(np.arange(len(one)), [len(s) for s in one])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order]


def _emit(buckets: int):
    def each(table: pa.Table):
        _, sets, classes = _sets(table)
        return sieve.questions(*sieve.runs(*_distinct(sets, classes)), buckets)
    return each


SETS = "doc_id long, n_shingles long, class binary, tokens binary"


def _survivors(buckets: int):
    """A row for each document; tokens (its shared shingles) once for each class that can have partners."""

    def each(table: pa.Table, got: dict[int, bytes]):
        doc_ids, sets, classes = _sets(table)
        tokens, _ = sieve.runs(*_distinct(sets, classes))
        shared = tokens[sieve.told(tokens, buckets, got)[0]]
        told, out = set(), []
        for s, c in zip(sets, classes):
            blob = None
            if c not in told:
                told.add(c)
                i = np.searchsorted(shared, s)
                kept = s[shared[np.minimum(i, len(shared) - 1)] == s] if len(shared) else s[:0]
                if len(kept) and 100 * len(kept) >= SHARE * len(s):
                    blob = kept.tobytes()
            out.append(blob)
        return {"doc_id": doc_ids, "n_shingles": [len(s) for s in sets], "class": classes, "tokens": out}
    return each


def _prefixes(batches):
    """(token, class) rows: any partner shares one of these tokens."""
    for batch in batches:
        rows = batch.to_pydict()
        tokens, owners = [], []
        for n, c, blob in zip(rows["n_shingles"], rows["class"], rows["tokens"]):
            t = np.frombuffer(blob, np.uint64)
            t = t[:len(t) - -(-SHARE * n // 100) + 1]
            tokens.append(t.view(np.int64))
            owners.append(np.full(len(t), c))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), pa.array(np.concatenate(owners) if owners else [], pa.int64())], names=["token", "class"])


#: Rows of edges, each in both directions, that one task links: some MB, and one job in place of rounds of many.
EDGES = 1 << 17


def _rooted(batches):
    """The components of all edges of the task, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], names=["class", "root"])


def connected(edges: DataFrame) -> DataFrame:
    """(class, root) for each class of ``edges`` (u, v): its component's smallest class.

    At most ``EDGES`` rows are linked by one task, more in rounds: each hangs every class and its neighbours on the smallest root seen and then
    shortens the paths; rounds end when nothing changes. A hub with many neighbours and a root with many
    members are hot keys; what is joined with them is one row each.
    """
    both = durable(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    if both.count() <= EDGES:
        few = durable(both.repartition(1).mapInArrow(_rooted, "class long, root long"))
        release(both)
        return few
    hubs = hot_keys(both, "v")
    last = durable(both.groupBy(F.col("u").alias("class")).agg(F.least(F.min("v"), F.col("u")).alias("root")))
    while True:
        roots = last.select("class", "root")
        near = hot_join(both, roots.select(F.col("class").alias("v"), F.col("root").alias("seen")), "v", hubs).groupBy(F.col("u").alias("class")).agg(F.min("seen").alias("seen"))
        moved = durable(roots.join(near, "class").select("class", F.least("root", "seen").alias("root"), F.col("root").alias("old")))
        hung = moved.groupBy(F.col("old").alias("class")).agg(F.min("root").alias("jump"))  # an old root follows its members
        best = durable(moved.join(hung, "class", "left").select("class", F.least("root", F.coalesce("jump", "root")).alias("root"), "old"))
        jump = best.select(F.col("class").alias("root"), F.col("root").alias("jump"))
        after = durable(hot_join(best, jump, "root", hot_keys(best, "root"), "left").select("class", F.least("root", F.coalesce("jump", "root")).alias("root"), "old"))
        release(last, moved, best)
        last = after
        if after.filter("root <> old").isEmpty():
            release(both)
            return after.select("class", "root")


class _Tree:
    """Nodes over documents in order of size: OR of bitmaps, size range, least (members - bits) slack, children."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray):
        n = len(tokens)
        self.bits = np.zeros((n, BITS // 64), np.uint64)
        for i, t in enumerate(tokens):
            bit = (t >> np.uint64(40)) % np.uint64(BITS)
            np.bitwise_or.at(self.bits[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        slack = np.array([len(t) for t in tokens]) - np.bitwise_count(self.bits).sum(1)
        self.nodes: list[tuple] = []
        level = []
        for s in range(0, n, LEAF):
            e = min(s + LEAF, n)
            level.append(self._node(np.bitwise_or.reduce(self.bits[s:e]), sizes[s:e].min(), sizes[s:e].max(), slack[s:e].max(), range(s, e), None))
        while len(level) > 1:
            up = []
            for s in range(0, len(level), FANOUT):
                kids = level[s:s + FANOUT]
                part = [self.nodes[k] for k in kids]
                up.append(self._node(np.bitwise_or.reduce([p[0] for p in part]), min(p[1] for p in part), max(p[2] for p in part), max(p[3] for p in part), None, kids))
            level = up
        self.root = level[0]

    def _node(self, *x) -> int:
        self.nodes.append(x)
        return len(self.nodes) - 1

    def possible(self, u: int, v: int) -> bool:
        """Whether any two members can overlap enough."""
        a, b = self.nodes[u], self.nodes[v]
        if 100 * a[2] < SHARE * b[1] or 100 * b[2] < SHARE * a[1]:
            return False
        most = int(np.bitwise_count(a[0] & b[0]).sum()) + min(a[3], b[3])
        return (100 + SHARE) * most >= SHARE * (a[1] + b[1])


def link_block(classes: list[int], sizes: list[int], tokens: list[np.ndarray], groups: list[int], skip: list[int] | None = None) -> dict[int, int]:
    """Components among the members: {group: root group}. ``groups`` says who is linked already; members of one ``skip`` value have been compared."""
    parent = {g: g for g in groups}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    order = sorted(range(len(classes)), key=lambda i: (sizes[i], classes[i]))
    size = np.array([sizes[i] for i in order], np.int64)
    token, group = [tokens[i] for i in order], [groups[i] for i in order]
    side = [skip[i] for i in order] if skip else None
    tree = _Tree(token, size)
    todo = [(tree.root, tree.root)]
    while todo:
        u, v = todo.pop()
        if not tree.possible(u, v):
            continue
        a, b = tree.nodes[u], tree.nodes[v]
        if a[5] is not None or b[5] is not None:
            if u == v:
                kids = a[5]
                todo += [(x, y) for i, x in enumerate(kids) for y in kids[i:]]
            elif b[5] is None or a[5] is not None and len(a[5]) >= len(b[5]):
                todo += [(x, v) for x in a[5]]
            else:
                todo += [(u, y) for y in b[5]]
            continue
        ra, rb = a[4], b[4]
        if len({root(group[i]) for r in (ra, rb) for i in r}) == 1:
            continue
        common = np.bitwise_count(tree.bits[ra.start:ra.stop, None] & tree.bits[None, rb.start:rb.stop]).sum(2)
        extra = np.array([len(t) for t in token[ra.start:ra.stop]]) - np.bitwise_count(tree.bits[ra.start:ra.stop]).sum(1)
        total = size[ra.start:ra.stop, None] + size[None, rb.start:rb.stop]
        for x, y in np.argwhere((100 + SHARE) * (common + extra[:, None]) >= SHARE * total):
            i, j = ra.start + int(x), rb.start + int(y)
            if i >= j and u == v or side and side[i] == side[j]:
                continue
            gi, gj = root(group[i]), root(group[j])
            if gi == gj:
                continue
            overlap = len(np.intersect1d(token[i], token[j], assume_unique=True))
            if (100 + SHARE) * overlap >= SHARE * int(size[i] + size[j]):
                parent[max(gi, gj)] = min(gi, gj)
    return {g: root(g) for g in parent}


LINKS = "u long, v long"


def _linked(rows: DataFrame, keys: list[str], paired: bool = False) -> DataFrame:
    """Link within each value of ``keys`` and, there, within each cluster; returns (group, root group) edges."""
    schema = arrow_schema(LINKS)

    def each(key, table):
        rows, by, edges = table.to_pydict(), {}, []
        for i, c in enumerate(rows["cluster"]):
            by.setdefault(c, []).append(i)
        for members in by.values():
            pick = lambda c: [rows[c][i] for i in members]
            found = link_block(pick("class"), pick("n_shingles"), [np.frombuffer(t, np.uint64) for t in pick("tokens")], pick("grp"), pick("block") if paired else None)
            edges += [(g, r) for g, r in found.items() if g != r]
        return pa.table([pa.array([e[k] for e in edges], f.type) for k, f in enumerate(schema)], schema=schema)

    return rows.groupBy(*keys).applyInArrow(each, LINKS)


def _with_groups(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``grp`` replaced by its root over ``links``."""
    roots = connected(links).select(F.col("class").alias("grp"), "root")
    return rows.join(roots, "grp", "left").withColumn("grp", F.coalesce("root", "grp")).drop("root")


def _in_blocks(rows: DataFrame, spread: int) -> DataFrame:
    """``block`` numbers runs of a cluster's members, by size within about 4 % and then by hash; ``spread`` hashes part a cluster of one size."""
    level = F.floor(F.log2(F.col("n_shingles")) * 16) * spread + F.pmod(F.xxhash64("class"), F.lit(spread))
    return running(rows, _weight(), ["cluster"], level, ["class"], "at", bounded=False).withColumn("block", F.floor(F.col("at") / (BLOCK * SHORT))).drop("at")


def _weight() -> Column:
    return F.greatest("n_shingles", F.lit(SHORT))


def similar_classes(sets: DataFrame) -> DataFrame:
    """(class, root) for the classes of ``sets`` (class, n_shingles, tokens) that are linked with another."""
    spark = sets.sparkSession
    pairs = durable(sets.mapInArrow(_prefixes, "token long, class long"))
    firsts = pairs.groupBy("token").agg(F.min("class").alias("v"), F.max("class").alias("w")).filter("v <> w").select("token", "v")
    near = durable(hot_join(pairs, firsts, "token", hot_keys(pairs, "token")).filter("class <> v").select(F.col("class").alias("u"), "v").distinct())
    clusters = durable(connected(near).select("class", F.col("root").alias("cluster")).join(sets.select("class", _weight().alias("own")), "class"))
    weights = durable(clusters.groupBy("cluster").agg(F.sum("own").alias("weight")))
    members = durable(hot_join(clusters, weights, "cluster", hot_keys(clusters, "cluster")))
    rows = durable(sets.join(members, "class"))
    # Small clusters share bins; large ones are cut to blocks in order of size.
    n = members.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0] // (BLOCK * SHORT) + 1
    bins, spread = max(partitions(spark), n), n // 4 + 1
    is_small = F.col("weight") <= BLOCK * SHORT
    small = rows.filter(is_small).withColumn("block", F.lit(0).cast("long")).withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)))
    large = _in_blocks(rows.filter(~is_small), spread).withColumn("bin", F.col("cluster"))
    blocks = durable(small.unionByName(large).withColumn("grp", F.col("class")))
    links = durable(_linked(blocks, ["bin", "block"]))
    split = blocks.filter(~is_small)
    if not split.isEmpty():
        # One member for each component of a block; these meet first.
        split = durable(_with_groups(split, links))
        heads = split.groupBy("cluster", "block", "grp").agg(F.min_by(F.struct("class", "n_shingles", "tokens"), "class").alias("h")).select("cluster", F.col("block").alias("was"), "grp", "h.*")
        heads = _in_blocks(durable(heads), spread)
        links = durable(links.unionByName(_linked(heads, ["cluster", "block"])))
        split = durable(_with_groups(split.withColumn("grp", F.col("class")), links))
        nodes = split.groupBy("cluster", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"), F.min("grp").alias("g0"), F.max("grp").alias("g1"))
        a, b = (nodes.select("cluster", *[F.col(c).alias(f"{c}{s}") for c in ("block", "lo", "hi", "g0", "g1")]) for s in "ab")
        open_pairs = a.join(b, "cluster").filter((F.col("blocka") < F.col("blockb")) & (F.col("hia") * 100 >= F.col("lob") * SHARE) & (F.col("hib") * 100 >= F.col("loa") * SHARE) & ((F.least("g0a", "g0b") != F.greatest("g1a", "g1b"))))
        sides = open_pairs.select("cluster", "blocka", "blockb", F.explode(F.array("blocka", "blockb")).alias("block"))
        links = durable(links.unionByName(_linked(split.join(sides, ["cluster", "block"]), ["cluster", "blocka", "blockb"], paired=True)))
    return connected(links)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row."""
    x = Exchange.of(docs, CHUNK_BYTES)
    dealt = x.dealt(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(x.chunks)).cast("int"), "doc_id", "text")
    answers = x.answer(x.ask(dealt, _emit(x.buckets)), sieve.replies())
    found = durable(x.finish(dealt, answers, _survivors(x.buckets), SETS))
    # Numbers of classes stand for their digests from here on; they are fixed once written.
    sets = found.filter("tokens IS NOT NULL").groupBy(F.col("class").alias("digest")).agg(F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
    sets = durable(sets.withColumn("class", F.monotonically_increasing_id()))
    roots = sets.select(F.col("digest").alias("class"), F.col("class").alias("number")).join(similar_classes(sets.drop("digest")).withColumnRenamed("class", "number"), "number").select("class", F.col("root").cast("string").alias("root"))
    least = durable(found.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least")))
    least = durable(least.join(roots, "class", "left").select("class", "least", F.coalesce("root", F.hex("class")).alias("root")))
    ids = hot_join(least, least.groupBy("root").agg(F.min("least").alias("component_id")), "root", hot_keys(least, "root")).select("class", "component_id")
    ids = durable(ids)
    out = hot_join(found, ids, "class", hot_keys(found.filter("n_shingles > 0"), "class"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; rows that repeat its doc_id and text go too."""
    named = with_ids(docs)
    if named:
        rows, own = named
        return _kept(rows).withColumn("doc_id", F.col(own)).select(docs.columns)
    return _kept(docs)


def _kept(docs: DataFrame) -> DataFrame:
    own = components(docs).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(own, "doc_id", "left_semi").select(docs.columns)
    twice = durable(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
