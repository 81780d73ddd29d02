"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on at most ``SAMPLE`` vectors (smallest hashes of vec_id); every vector is indexed in the leaf that it
descends to. A query walks the tree best bin first, by a priority queue of distances to centroids,
and the number of leaves it visits is widened by a quarter at a time until, over ``PROBES`` queries compared with all rows by
brute force, recall reaches ``RECALL``. Leaves are searched in blocks: those with many vectors or
many visitors are split, so a hot leaf is many tasks.

Equal vectors are indexed once, with their k + 1 smallest ids, which is all that k nearest can need.

Defined cases: vectors that are null, zero, of another length than the most frequent one, or hold
null or non-finite components take no part; long vectors are taken whole; ties go to the smaller vec_id; repeated rows with one
vec_id and vector are one row; fewer than k candidates give all; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinleaf.llm.common import arrow_schema, durable, partitions

SAMPLE, PROBES, RECALL = 20_000, 200, 0.96
BRANCH, LEAF, LEAVES = 8, 24, 192
BLOCK_ROWS, BLOCK_VISITS = 4096, 2048


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither vanish nor overflow.
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree:
    """centroids and children by node; leaf numbers by node (-1: inner)."""

    def __init__(self, x: np.ndarray, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.centroids, self.children, self.leaf, self.leaves = [], [], [], 0
        self.most = max(LEAF, -(-2 * len(x) // LEAVES))  # sample vectors in a leaf: the tree's size is fixed, not the input's
        self._grow(x)
        self.centroids = np.array(self.centroids)

    def _grow(self, x: np.ndarray) -> int:
        me = len(self.children)
        self.centroids.append(x.mean(0))
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(x) if len(x) > self.most else []
        if len(parts) < 2:
            self.leaf[me] = self.leaves
            self.leaves += 1
        else:
            self.children[me] = [self._grow(p) for p in parts]
        return me

    def _split(self, x: np.ndarray, rounds: int = 8) -> list[np.ndarray]:
        c = x[self.rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
        for _ in range(rounds):
            near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            c = np.array([x[near == k].mean(0) for k in range(len(c)) if (near == k).any()])
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        return [x[near == k] for k in range(len(c)) if (near == k).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centroids[kids]
            near = (x[rows] @ c.T - (c * c).sum(1) / 2).argmax(1)
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            for kid in self.children[node]:
                d = q - self.centroids[kid]
                heapq.heappush(queue, (float(d @ d), kid))
        return out


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their length."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(~bad & F.exists("embedding", lambda v: v != 0))
    sizes = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes.n if sizes else 0
    return good.filter(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"]), dim


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """One row for each vector: cid (its smallest vec_id), embedding and its k + 1 smallest ids."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "embedding", "ids")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _nearest(q: np.ndarray, x: np.ndarray, k: int, ties: np.ndarray) -> list[np.ndarray]:
    """Columns of the k best of each row, ties by ``ties``."""
    scores = q @ x.T
    out = []
    for row in scores:
        take = np.arange(len(row))
        if len(row) > k:
            cut = np.partition(row, len(row) - k)[len(row) - k]
            take = np.flatnonzero(row >= cut - 1e-12)
        out.append(take[np.lexsort((ties[take], -row[take]))][:k])
    return out


FOUND = "qid long, cid long, score double, ids array<long>"


def _score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum((q * x).sum(1), -1.0), 1.0)


def _brute(index: DataFrame, queries: tuple[np.ndarray, np.ndarray], dim: int, k: int) -> DataFrame:
    """The k nearest classes of a fixed number of queries among all rows, in blocks."""
    ids, q = queries

    def each(batches):
        for b in batches:
            x, cid, leaf = unit(_matrix(b.column("embedding"), dim)), b.column("cid").to_numpy(), b.column("leaf").to_numpy()
            if not len(x):
                continue
            best = _nearest(q, x, k, cid)
            qs = np.repeat(np.arange(len(ids)), [len(t) for t in best])
            xs = np.concatenate(best)
            yield pa.RecordBatch.from_arrays([pa.array(ids[qs], pa.int64()), pa.array(cid[xs], pa.int64()), pa.array(_score(q[qs], x[xs]), pa.float64()), pa.array(leaf[xs], pa.int32())], names=["qid", "cid", "score", "leaf"])

    return _top(index.select("cid", "embedding", "leaf").mapInArrow(each, "qid long, cid long, score double, leaf int"), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL) -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score), and what was calibrated: leaves, visits and recall."""
    spark = vectors.sparkSession
    good, dim = usable(vectors)
    asked, asked_dim = usable(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim or not asked_dim:
        return empty, {"leaves": 0, "visits": 0, "recall": 1.0}
    asked = asked.filter(F.size("embedding") == dim)
    classes = durable(_distinct(good, k))
    sample = classes.select("cid", "embedding").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()  # bounded by SAMPLE
    tree = Tree(unit(np.array([r.embedding for r in sample], np.float64)))
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches):
        for b in batches:
            leaf = shared.value.assign(unit(_matrix(b.column("embedding"), dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["cid", "embedding", "ids", "leaf"])

    index = durable(classes.mapInArrow(placed, "cid long, embedding array<float>, ids array<long>, leaf int"))
    named = durable(asked.groupBy("embedding").agg(F.min("vec_id").alias("qid")))
    # Calibration: where, in each probe's order of leaves, its true neighbours lie.
    probes = named.join(classes.select("embedding", F.col("cid").alias("own")), "embedding").orderBy(F.xxhash64("qid"), "qid").limit(PROBES).collect()
    vectors_of = unit(np.array([r.embedding for r in probes], np.float64))
    truth = _brute(index, (np.array([r.qid for r in probes]), vectors_of), dim, k + 1).collect()  # k + 1 rows for each probe
    own = {r.qid: r.own for r in probes}
    order = {r.qid: {leaf: i for i, leaf in enumerate(tree.visits(q, tree.leaves))} for r, q in zip(probes, vectors_of)}
    # A probe's own vector is always found and is no neighbour: it doesn't count.
    at = np.array([order[r.qid][r.leaf] for r in truth if r.cid != own[r.qid]])
    at = at if len(at) else np.zeros(1)
    most = 4
    while most < tree.leaves and (at < most).mean() < recall:
        most += max(1, most // 4)
    most = min(most, tree.leaves)

    def visiting(batches):
        for b in batches:
            q, qid = unit(_matrix(b.column("embedding"), dim)), b.column("qid").to_pylist()
            walks = [shared.value.visits(row, most) for row in q]
            i = np.repeat(np.arange(len(qid)), [len(w) for w in walks])
            leaf = np.array([x for w in walks for x in w], np.int32)
            yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(i)), b.column("embedding").take(pa.array(i)), pa.array(leaf, pa.int32())], names=["qid", "query", "leaf"])

    visits = durable(named.select("qid", "embedding").repartition(partitions(spark), "qid").mapInArrow(visiting, "qid long, query array<float>, leaf int"))
    # A row for each leaf: their number is bounded by SAMPLE.
    rows = index.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    seen = visits.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_VISITS).cast("int").alias("crowds"))
    cuts = F.broadcast(durable(rows.join(seen, "leaf")))
    left = index.join(cuts, "leaf").select("leaf", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), "cid", "embedding", "ids")
    right = visits.join(cuts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("qid"), F.col("crowds")).cast("int").alias("crowd"), "qid", "query")
    schema = arrow_schema(FOUND)

    def block(key, have, want):
        if not have.num_rows or not want.num_rows:
            return schema.empty_table()
        x, q = unit(_matrix(have["embedding"], dim)), unit(_matrix(want["query"], dim))
        best = _nearest(q, x, k + 1, have["cid"].to_numpy())
        qs, xs = np.repeat(np.arange(len(q)), [len(t) for t in best]), np.concatenate(best)
        return pa.table([want["qid"].take(pa.array(qs)), have["cid"].take(pa.array(xs)), pa.array(_score(q[qs], x[xs])), have["ids"].take(pa.array(xs))], schema=schema)

    keys = ["leaf", "part", "crowd"]
    found = _top(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, FOUND), k + 1)
    each_query = asked.join(named, "embedding").select(F.col("vec_id").alias("query_id"), "qid")
    rows = each_query.join(found, "qid").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("query_id <> vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out, {"leaves": tree.leaves, "visits": most, "recall": float((at < most).mean())}
