"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Members of a group that sit in the same
shard are alike, so the state is one row for each (group, shard) with a count:
a group of a third of all rows has at most as many rows as there are shards.
Each round joins every group with its best shard (most neighbours, free room first),
proposes moves, and accepts them under quotas: exchanges between two shards
in equal number, and the rest within free room, largest gain first. When no move is
left, groups still in several shards move as a whole into one with room for all of
their members, and rounds go on. Each accepted move raises the sum of squared counts,
so rounds end by themselves. Documents without links fill the room left. Law ``rows``:
shard sizes differ by one at most.

Defined cases: a null text counts as empty text; very long texts count by their digest; repeated rows, and those without doc_id, are separate
members; tied shards and groups go by a hash; an empty table gives no rows; other columns are ignored; a group
as large as a shard's quota fills whole shards first, and only its rest takes part in rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinleaf.llm.common import durable, numbered, release, running

#: Parts of a group, at least; and rows of a part about which more parts are made, so that none outgrows a task.
SALTS, PART_ROWS = 64, 1 << 17


def _quota(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _allowed(flows: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Moves from s to t that keep every shard within its quota."""
    out = {(s, t): min(n, flows.get((t, s), 0)) for (s, t), n in flows.items()}
    for t, room in enumerate(free):
        rest = {k: n - out[k] for k, n in flows.items() if k[1] == t and n > out[k]}
        total = sum(rest.values())
        if total <= room:
            out |= {k: out[k] + n for k, n in rest.items()}
            continue
        shares = {k: n * room // total for k, n in rest.items()}
        over = room - sum(shares.values())  # what flooring left: largest remainders first, so the room is filled
        for i, k in enumerate(sorted(rest, key=lambda k: (-(rest[k] * room % total), k))):
            out[k] += shares[k] + (i < over)
    return out


def _whole_shards(groups: DataFrame, quota: list[int]) -> tuple[list[tuple[bytes, int, int]], int]:
    """(grp, shard, n) of the shards that large groups fill, from the last one on, and how many shards are left."""
    taken, left = [], len(quota)
    # At most as many groups as there are shards.
    for r in groups.filter(F.col("total") >= max(quota[0], 1)).orderBy(F.desc("total"), "grp").collect():
        rest = r.total
        while left and rest >= quota[left - 1]:
            left -= 1
            rest -= quota[left]
            if quota[left]:
                taken.append((bytes(r.grp), left, quota[left]))
    return taken, left


def _initial(groups: DataFrame, shards: int) -> DataFrame:
    """Deal linked documents in turn: every shard within its quota."""
    dealt = running(groups, F.col("total"), [], F.pmod(F.xxhash64("grp"), F.lit(512)), ["grp"], "at", bounded=True)
    n = F.floor(F.col("total") / shards) + F.when(F.pmod(F.col("shard") - F.col("at"), F.lit(shards)) < F.col("total") % shards, 1).otherwise(0)
    return dealt.select("grp", "total", "at", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).select("grp", "shard", n.cast("long").alias("n")).filter("n > 0")


def _start(groups: DataFrame, quota: list[int]) -> DataFrame:
    """Large groups fill whole shards; all other linked documents are dealt to the shards left."""
    taken, left = _whole_shards(groups, quota)
    if not taken:
        return _initial(groups, len(quota))
    full = groups.sparkSession.createDataFrame(taken, "grp binary, shard int, n long")
    rest = groups.join(F.broadcast(full.groupBy("grp").agg(F.sum("n").alias("gone"))), "grp", "left")
    rest = rest.select("grp", (F.col("total") - F.coalesce("gone", F.lit(0))).alias("total")).filter("total > 0")
    return full.unionByName(_initial(durable(rest), left)) if left else full


def _free(state: DataFrame, quota: list[int]) -> list[int]:
    load = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    return [q - load.get(s, 0) for s, q in enumerate(quota)]


def _at(values: list, shard: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), F.col(shard) + 1)


def _gather(state: DataFrame, quota: list[int]) -> DataFrame | None:
    """Move split groups as a whole to the shard with most neighbours of those with room for all; None when none fits."""
    free = _free(state, quota)
    if not any(free):
        return None
    loose = F.col("n") < _at(quota, "shard")  # shards that one group fills stay
    split = state.filter(loose).groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("parts"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held")).filter("parts > 1")
    fits = split.select("grp", "total", "held", F.explode(F.sequence(F.lit(0), F.lit(len(quota) - 1))).alias("target"))
    fits = fits.withColumn("there", F.coalesce(F.col("held")[F.col("target")], F.lit(0))).withColumn("need", F.col("total") - F.col("there")).filter(F.col("need") <= _at(free, "target"))
    best = durable(fits.groupBy("grp").agg(F.max_by(F.struct("target", "need"), F.struct("there", F.xxhash64("grp", "target"))).alias("b")).select("grp", "b.target", "b.need"))
    level = F.lit(63) - F.floor(F.log2("need")).cast("long")
    best = running(best, F.col("need"), ["target"], level * 16 + F.pmod(F.xxhash64("grp"), F.lit(16)), ["grp"], "before", bounded=True)
    moved = durable(best.filter(F.col("before") + F.col("need") <= _at(free, "target")).select("grp", "target"))
    if moved.isEmpty():
        return None
    shard = F.when(loose & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("shard"))
    return durable(state.join(moved, "grp", "left").select("grp", shard.alias("shard"), "n").groupBy("grp", "shard").agg(F.sum("n").alias("n")))


def _round(state: DataFrame, quota: list[int]) -> DataFrame | None:
    """One round of propagation; None when no document wants to move."""
    shards = len(quota)
    free = _free(state, quota)
    room = _at([x > 0 for x in free], "shard")
    best = state.groupBy("grp").agg(F.max_by(F.struct(F.col("shard").alias("target"), F.col("n").alias("there")), F.struct(room, "n", F.xxhash64("grp", "shard"))).alias("b"))
    moves = state.join(best.select("grp", "b.target", "b.there"), "grp").withColumn("gain", F.col("there") - F.col("n"))
    wants = (F.col("shard") != F.col("target")) & (F.col("gain") >= 0)
    flows = {(r.shard, r.target): r.n for r in moves.filter(wants).groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}  # shards squared rows
    if not flows:
        return None
    allowed = _allowed(flows, free)
    if not any(allowed.values()):
        return None
    stay, go = moves.filter(~wants).select("grp", "shard", "n"), moves.filter(wants)
    if allowed == flows:
        went = go.withColumn("ok", F.col("n"))
    else:
        by = go.withColumn("most", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for (s, t), n in allowed.items() for x in (s * shards + t, n)]), F.col("shard") * shards + F.col("target")), F.lit(0)))
        level = F.lit(63) - F.floor(F.log2(F.col("gain") + 1)).cast("long")
        by = running(by, F.col("n"), ["shard", "target"], level * 16 + F.pmod(F.xxhash64("grp"), F.lit(16)), ["grp"], "before", bounded=True)
        went = by.withColumn("ok", F.greatest(F.lit(0), F.least(F.col("n"), F.col("most") - F.col("before"))))
    moved = went.select("grp", F.explode(F.array(F.struct(F.col("shard"), (F.col("n") - F.col("ok")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("ok").alias("n")))).alias("m")).select("grp", "m.shard", "m.n")
    return durable(stay.unionByName(moved).filter("n > 0").groupBy("grp", "shard").agg(F.sum("n").alias("n")))


def balanced_label_propagation(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Return doc_id, size, text_crc32, shard and slot for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = durable(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("grp")))
    n = rows.count()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(max(SALTS, n // PART_ROWS))))
    quota = _quota(n, shards)
    parts = durable(rows.groupBy("grp", "salt").agg(F.count("*").alias("part")))
    state = durable(_start(durable(parts.groupBy("grp").agg(F.sum("part").alias("total")).filter("total > 1")), quota))
    while (after := _round(state, quota) or _gather(state, quota)) is not None:
        release(state)
        state = after
    free = _free(state, quota)
    # Where each linked group's members go: at most one entry for each shard.
    upto = Window.partitionBy("grp").orderBy(F.desc("n"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = state.withColumn("lo", F.coalesce(F.sum("n").over(upto), F.lit(0))).groupBy("grp").agg(F.collect_list(F.struct("lo", (F.col("lo") + F.col("n")).alias("hi"), "shard")).alias("spans"))
    salted = Window.partitionBy("grp").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.join(spans, "grp").select("grp", "salt", "spans", F.coalesce(F.sum("part").over(salted), F.lit(0)).alias("first"))
    linked = F.col("spans").isNotNull()
    wide = durable(rows.join(places, ["grp", "salt"], "left"))
    own = Window.partitionBy("grp", "salt").orderBy("doc_id", "size")
    paired = wide.filter(linked).withColumn("rank", F.col("first") + F.row_number().over(own) - 1)
    paired = paired.withColumn("shard", F.filter("spans", lambda x: (F.col("rank") >= x.lo) & (F.col("rank") < x.hi))[0].shard)
    ends, end = [], 0
    for s in range(shards):
        ends.append(end := end + free[s])
    single = numbered(wide.filter(~linked), "rank", "doc_id", ["doc_id", "grp"])
    single = single.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank"))))
    cols = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")]
    placed = durable(paired.select(*cols).unionByName(single.select(*cols)))
    return numbered(placed, "slot", "doc_id", ["doc_id", "text_crc32"], by=["shard"])


def cut(placed: DataFrame) -> DataFrame:
    """One row: the links (pairs of equal texts) in all and across shards, linked groups, and groups in more than one shard."""
    parts = placed.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    groups = parts.groupBy("text_crc32", "size").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("shards")).filter("total > 1")
    return groups.agg(F.coalesce(F.sum(F.expr("total * (total - 1) div 2")), F.lit(0)).alias("links"), F.coalesce(F.sum(F.expr("(total * total - same) div 2")), F.lit(0)).alias("cut"), F.count("*").alias("groups"), F.count(F.when(F.col("shards") > 1, 1)).alias("split"))
