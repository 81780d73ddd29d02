"""Shared pieces: durable tables, gapless numbering, joins with hot keys and the exchange between chunks and buckets."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from twinleaf.operators.durable import durable, remove

#: Rows that a batch function takes at once: whole texts can be long. Spark bounds a batch in bytes.
ARROW_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release(*tables: DataFrame) -> None:
    """Remove tables of ``durable`` that no later step reads."""
    for df in tables:
        if path := getattr(df, "_durable_at", None):
            remove(df.sparkSession, path)


#: Bytes of a text that are parted to words at once.
RUN = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def word_runs(text: str | None, run: int = RUN):
    """The words of a text, with A to Z in lower case, some at a time: a long text's words would be many small objects."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
    while at < len(raw):
        end = at + run
        space = _SPACE.search(raw, end) if end < len(raw) else None
        end = space.start() if space else len(raw)
        yield raw[at:end].split()
        at = end


#: A table under so many bytes may be one row group, and so one task.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores before costly functions of each row; larger ones are read in many tasks and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, weight: Column, by: list[str], bucket: Column, order: list, name: str, bounded: bool) -> DataFrame:
    """Add ``name``: the sum of ``weight`` before each row within ``by``, ordered by ``bucket`` then ``order``.

    Works in two levels, so that no task holds all rows of one ``by`` value: sums per
    bucket give offsets, and a window inside the bucket adds the rest. ``bounded``
    says that (by, bucket) has a fixed number of values, so offsets can be broadcast.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_weight", weight)
    sums = df.groupBy(*by, "_bucket").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    out = out.join(F.broadcast(offsets) if bounded else offsets, [*by, "_bucket"])
    return out.withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_bucket", "_weight", "_offset", "_inside")


#: Rows of a bucket about which more buckets are made.
BUCKET_ROWS = 1 << 17


def numbered(df: DataFrame, name: str, key: str, order: list, by: list[str] | None = None, first: Column | None = None, buckets: int = 512) -> DataFrame:
    """Gapless numbers from 0 within ``by`` (whose values are few), without one task for all rows.

    ``first`` orders whole buckets before the hash of ``key`` does. df is read three times: pass a durable table.
    Buckets grow in number with the rows; their offsets are broadcast while there are few.
    """
    buckets = max(buckets, df.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)) + (F.lit(0) if first is None else first * buckets)
    return running(df, F.lit(1), by or [], bucket, order, name, bounded=buckets <= 8 * 512)


#: A key with more than one in HOT_SHARE of the rows is hot: there are fewer than HOT_SHARE of them.
HOT_SHARE = 256


def hot_keys(df: DataFrame, key: str) -> list:
    """The values of ``key`` that hold more than one in HOT_SHARE of the rows: a bounded list."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    least = max(df.count() // HOT_SHARE, 1)
    return [r[0] for r in counts.filter((F.col("_n") > least) & F.col(key).isNotNull()).select(key).collect()]


def hot_join(big: DataFrame, small: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Join with ``small``, which has one row for each ``key``. Rows of ``hot`` keys stay where they are: their few partners are broadcast."""
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    cold = big.filter(~is_hot | F.col(key).isNull()).join(small.filter(~is_hot), key, how)
    return cold.unionByName(big.filter(is_hot).join(F.broadcast(small.filter(is_hot)), key, how))


def with_ids(docs: DataFrame) -> tuple[DataFrame, str] | None:
    """``docs`` with numbers above all others where doc_id is null, and the column that keeps the old ids; None if no id is null."""
    if docs.filter("doc_id IS NULL").isEmpty():
        return None
    own = "_own"
    while own in docs.columns:
        own += "_"
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    return durable(docs.withColumn(own, F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.monotonically_increasing_id() + (top + 1)))), own


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


#: One exchange row goes to a bucket; beyond FAN buckets, rows go to groups of buckets first.
FAN, BUCKET_BYTES, LEAST_BUCKETS = 4096, 16 << 20, 64
ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
ANSWER_DDL = "chunk int, bucket int, blob binary"


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


@dataclass(frozen=True)
class Exchange:
    """How many chunks ask how many buckets, and by which partitions.

    Buckets are fewer than chunks and no chunk sends more than about ``fan`` rows: with more buckets than
    that, a chunk sends one row to each of at most ``fan`` groups of buckets, and a task in between deals
    what a block of chunks sent there to the group's buckets. Replies go back the same way. So rows
    between stages grow with the chunks, up to ``fan`` squared buckets.
    """

    chunks: int
    buckets: int
    fan: int = FAN

    @classmethod
    def of(cls, docs: DataFrame, chunk_bytes: int) -> Exchange:
        size = text_bytes(docs)
        return cls(max(1, -(-size // chunk_bytes)), max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), FAN)

    @property
    def group(self) -> int:
        """Buckets in a group; 1 where rows go to buckets at once."""
        return -(-self.buckets // self.fan)

    @staticmethod
    def parts(n: int, share: int = 4) -> int:
        """Partitions for n keys: one each up to 32, ``share`` in each up to 4,096 partitions, and then up to 64 in each; a task takes them in turn."""
        return max(min(n, 32), min(-(-n // share), max(4096, -(-n // 64))), 1)

    def dealt(self, docs: DataFrame, chunk: Column, *cols) -> DataFrame:
        """``docs`` by chunk; the same form each time, so one query's rounds share the shuffle."""
        return docs.select(chunk.alias("chunk"), *cols).repartition(self.parts(self.chunks), "chunk")

    def ask(self, dealt: DataFrame, emit, answers: DataFrame | None = None) -> DataFrame:
        """``emit(table[, blobs])`` yields (bucket, blob) in order of buckets, at most one blob for each bucket."""
        group = self.group

        def rows(key, pairs):
            by: dict[int, list] = {}
            for b, x in pairs:
                by.setdefault(b // group, []).append((b, x))
            return _rows([(key[0].as_py(), g, packed(parts)) for g, parts in by.items()])

        if answers is None:
            return dealt.groupBy("chunk").applyInArrow(lambda key, t: rows(key, emit(t)), ANSWER_DDL)
        return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda key, t, got: rows(key, emit(t, _blobs(got))), ANSWER_DDL)

    def answer(self, asked: DataFrame, reply) -> DataFrame:
        """``reply(blobs)`` gives as many blobs back, one to each chunk that asked this bucket."""

        def each(key, t):
            t = t.sort_by("chunk")
            parts = [opened(x) for x in t["blob"].to_pylist()]
            told = iter(reply([x for p in parts for _, x in p]))
            return _rows([(c, key[0].as_py(), packed([(i, next(told)) for i, _ in p])) for c, p in zip(t["chunk"].to_pylist(), parts)])

        group, fan = self.group, self.fan
        if group > 1:
            # Blocks of ``fan`` chunks: (group of buckets, block) tasks deal to (block, bucket) rows.
            asked = self._turned(asked, F.floor(F.col("chunk") / fan).cast("int"), F.col("bucket"), lambda c, b, i: (c // fan, i, c))
        said = asked.repartition(self.parts(self.buckets, 1), "bucket").groupBy("bucket").applyInArrow(each, ANSWER_DDL)
        if group > 1:
            said = self._turned(said, F.col("chunk"), F.floor(F.col("bucket") / group).cast("int"), lambda c, b, i: (i, b // group, b))
        return said.repartition(self.parts(self.chunks), "chunk")

    def _turned(self, rows: DataFrame, block: Column, group: Column, to) -> DataFrame:
        """Deal the parts within each (block, group) to other rows: ``to(chunk, bucket, part id)`` names row and part."""

        def each(key, t):
            t, out = t.sort_by([("chunk", "ascending"), ("bucket", "ascending")]), {}
            for c, b, x in zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(), t["blob"].to_pylist()):
                for i, part in opened(x):
                    c2, b2, i2 = to(c, b, i)
                    out.setdefault((c2, b2), []).append((i2, part))
            return _rows([(c, b, packed(parts)) for (c, b), parts in out.items()])

        tasks = self.parts(-(-self.chunks // self.fan) * min(self.buckets, self.fan))
        rows = rows.withColumns({"_block": block, "_group": group}).repartition(tasks, "_block", "_group")
        return rows.groupBy("_block", "_group").applyInArrow(lambda key, t: each(key, t.select(ANSWER.names)), ANSWER_DDL)

    def finish(self, dealt: DataFrame, answers: DataFrame, done, ddl: str) -> DataFrame:
        """``done(table, {bucket: blob})`` gives the chunk's rows as a dict of columns."""
        schema = arrow_schema(ddl)

        def each(key, t, got):
            found = done(t, _blobs(got))
            return pa.table([pa.array(found[f.name], f.type) for f in schema], schema=schema)

        return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(each, ddl)


def packed(parts: list[tuple[int, bytes]]) -> bytes:
    """Numbered blobs in one."""
    head = np.array([[i, len(x)] for i, x in parts], "<u4")
    return b"".join([np.uint32(len(parts)).tobytes(), head.tobytes(), *[x for _, x in parts]])


def opened(blob: bytes) -> list[tuple[int, bytes]]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    head = np.frombuffer(blob, "<u4", 2 * n, 4).reshape(n, 2).astype(np.int64)
    ends = 4 + 8 * n + np.cumsum(head[:, 1])
    return [(int(i), blob[e - s:e]) for (i, s), e in zip(head.tolist(), ends.tolist())]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ANSWER)], schema=ANSWER)


def _blobs(got: pa.Table) -> dict[int, bytes]:
    return {i: x for blob in got["blob"].to_pylist() for i, x in opened(blob)}


def mapped(df: DataFrame, rows, ddl: str) -> DataFrame:
    """``rows(dict of lists)`` gives a dict of lists, batch by batch."""
    schema = arrow_schema(ddl)

    def each(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ARROW_ROWS):
                found = rows(batch.slice(k, ARROW_ROWS).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    return spread(df).mapInArrow(each, ddl)
