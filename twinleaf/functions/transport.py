"""Word-mover distance: the exact least cost of moving one text's words to another's in vector space."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa


#: Reduced costs down to this share of the largest cost count as none; rows that are Python objects at once.
NONE, SLICE = 1e-13, 64


def _first_tree(cost: np.ndarray, supply: list[int], demand: list[int]) -> list[tuple[int, int, int]]:
    """(supplier, taker, amount) of a basis: the cheapest ways first. Each exhausts one end only, but for the last."""
    out, (n, m) = [], cost.shape
    for cell in np.argsort(cost, axis=None, kind="stable").tolist():
        i, j = divmod(cell, m)
        if supply[i] and demand[j]:
            x = min(supply[i], demand[j])
            supply[i] -= x
            demand[j] -= x
            out.append((i, j, x))
            if len(out) == n + m - 1:
                break
    return out


def least_cost(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float:
    """Cost of the best transport of integer amounts above 0, of equal sum, by the simplex method on spanning trees.

    Amounts are scaled and shifted by less than a half, so that no sum of some suppliers equals one of some takers:
    every step moves something, costs fall each time, and the search ends.
    """
    n, m = cost.shape
    scale = 2 * n + 2
    give, take = [int(x) * scale + 1 for x in supply], [int(x) * scale for x in demand]
    take[-1] += n
    parent, flow, near = [-1] * (n + m), [0] * (n + m), [set() for _ in range(n + m)]  # takers are n, n + 1, ...; flow: on the way to the parent
    ways = {}
    for i, j, x in _first_tree(cost, give, take):
        ways[i, n + j] = ways[n + j, i] = x
        near[i].add(n + j)
        near[n + j].add(i)
    u, v, todo = np.zeros(n), np.zeros(m), [0]
    for a in todo:
        for b in near[a]:
            if b != parent[a]:
                parent[b], flow[b] = a, ways[a, b]
                if b < n:
                    u[b] = cost[b, a - n] - v[a - n]
                else:
                    v[b - n] = cost[a, b - n] - u[a]
                todo.append(b)
    least = -NONE * float(cost.max())
    while True:
        rest = cost - u[:, None]
        rest -= v
        i, j = divmod(int(rest.argmin()), m)
        r = float(rest[i, j])
        if r >= least:
            break
        j += n
        ups, seen, a = [i], {i: 0}, i
        while (a := parent[a]) >= 0:
            seen[a] = len(ups)
            ups.append(a)
        downs, a = [], j
        while a not in seen:
            downs.append(a)
            a = parent[a]
        ups = ups[:seen[a]]
        # what goes from i to j comes off the ways to parents of suppliers above i and of takers above j
        out = min([x for x in ups if x < n] + [x for x in downs if x >= n], key=flow.__getitem__)
        moved = flow[out]
        for x in ups:
            flow[x] += -moved if x < n else moved
        for x in downs:
            flow[x] += moved if x < n else -moved
        near[out].discard(parent[out])
        near[parent[out]].discard(out)
        a, b = (i, j) if out in ups else (j, i)  # a: the end in the part that comes off
        part = [a]
        before, x, y, amount = b, a, parent[a], moved
        while True:  # turn the ways from a up to where the tree was cut
            parent[x], flow[x], amount = before, amount, flow[x]
            if x == out:
                break
            before, x, y = x, y, parent[y]
        for x in part:
            part += near[x] - {parent[x]}
        near[a].add(b)
        near[b].add(a)
        rows, columns = [x for x in part if x < n], [x - n for x in part if x >= n]
        r = r if a < n else -r
        u[rows] += r
        v[columns] -= r
    total = 0.0
    for x, to in enumerate(parent):
        if to >= 0:
            i, j = (x, to - n) if x < n else (to, x - n)
            total += (flow[x] + scale // 2) // scale * float(cost[i, j])
    return total


def word_mover(one: list[str], two: list[str], vectors: dict[str, np.ndarray], most: float = 10.0) -> float:
    """Distance of two texts' known words, at most ``most``; ``most`` where either has none."""
    a, b = (Counter(w for w in ws or [] if w in vectors) for ws in (one, two))
    na, nb = sum(a.values()), sum(b.values())
    if not na or not nb:
        return most
    # Amounts in units of 1 / (na * nb). What both share stays: distances obey the triangle inequality.
    rest = Counter({w: n * nb for w, n in a.items()})
    rest.subtract({w: n * na for w, n in b.items()})
    give, take = [w for w, n in rest.items() if n > 0], [w for w, n in rest.items() if n < 0]
    if not give:
        return 0.0
    x, y = np.array([vectors[w] for w in give]), np.array([vectors[w] for w in take])
    cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    total = least_cost(cost, np.array([rest[w] for w in give]), np.array([-rest[w] for w in take]))
    return min(float(total / (na * nb)), most)


def distances(batches):
    """(id, raw, normed) from (id, q1w, q2w, known): on the vectors as they are, and on vectors of length one."""
    for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
        out = []
        for r in b.to_pylist():
            raw = {k["word"]: np.array(k["vec"]) for k in r["known"] or []}
            normed = {w: v / n for w, v in raw.items() if (n := np.linalg.norm(v)) > 0}
            out.append((r["id"], word_mover(r["q1w"], r["q2w"], raw), word_mover(r["q1w"], r["q2w"], normed)))
        ids, one, two = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.float64()), pa.array(two, pa.float64())], names=["id", "raw", "normed"])
