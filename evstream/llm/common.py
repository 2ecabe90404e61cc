"""Helpers the operators of this subpackage share: shared scratch tables, Arrow batches, word memos, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def materialize_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As materialize, written in buckets by column: to group by it, no row of the table that is read back needs a shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    named = "evstream_" + path.rpartition("-")[2]
    df.write.format("parquet").bucketBy(buckets, column).option("compression", "zstd").option("path", path).saveAsTable(named)
    table = spark.table(named)
    table._scratch, table._named = path, named
    return table


TASK_ROWS = 1 << 16


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many small rows, in no more partitions than TASK_ROWS each ask for: a small table is written in few files. Nothing is shuffled for it."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no plan still to run reads."""
    for table in tables:
        if named := getattr(table, "_named", None):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {named}")
        delete(table.sparkSession, table._scratch)


def small_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Bound what one Arrow batch may hold, so that very long texts do not fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def text_bytes(name: str = "text") -> Column:
    """The whole text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_kept: dict[str, object] = {}


def kept_alone(name: str, make: Callable = lambda: None):
    """What a Python worker keeps from task to task, made when it is first asked for. Workers outlive their stages, so what
    another operator kept in this one goes first: no worker holds the memory of two."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


class WordMemo:
    """Values by white-space-delimited chunk, kept between batches in two generations of bounded size.

    When the young generation is full it becomes the old one, and what is met again moves back. A chunk
    that went is computed again, so the bound costs time only. Chunks of over LONG bytes are kept for their
    batch alone, so that the bound is one on bytes too. compute gets the chunks that are missing and a function
    that gives what is known of another chunk, or None.
    """

    LONG = 256

    def __init__(self, compute: Callable[[list[bytes], Callable], Iterable], bound: int = 400_000) -> None:
        self.compute, self.bound, self.young, self.old = compute, bound, {}, {}

    def known(self, chunk: bytes):
        return self.young.get(chunk) or self.old.get(chunk)

    def load(self, docs: list[list[bytes]]) -> Callable:
        """Make all chunks of docs known and return the lookup."""
        distinct: set[bytes] = set()
        for words in docs:
            distinct.update(words)
        large = [chunk for chunk in distinct if len(chunk) > self.LONG]
        distinct.difference_update(large)
        if len(self.young) > self.bound:
            self.young, self.old = {}, self.young
        distinct -= self.young.keys()
        again = distinct & self.old.keys()
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        if missing := list(distinct - again):
            self.young.update(zip(missing, self.compute(missing, self.known)))
        if large:
            own = dict(zip(large, self.compute(large, self.known)))
            return lambda chunk: self.young[chunk] if len(chunk) <= self.LONG else own[chunk]
        return self.young.__getitem__


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that links reach.

    Alternates hooking on the smallest neighbour with pointer jumping over written tables until the
    edges are stars. No task and no driver ever holds more than its share of the edges.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = materialize(ordered(edges), name)
    seen = digest(now)
    while True:
        low = materialize(in_few(now.groupBy("a").agg(F.min("b").alias("low")), seen[0]), f"{name}-low")
        # smaller neighbours of a node meet at its smallest one
        hooked = now.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        star = low.select("a", F.col("low").alias("b")).unionByName(hooked)
        jump = low.select(F.col("a").alias("b"), F.col("low").alias("next"))
        after = ordered(star.join(jump, "b", "left").select("a", F.coalesce("next", "b").alias("b")))
        after = materialize(in_few(after, 2 * seen[0]), name)  # an edge to the low one for each node, and for each edge
        discard(now, low)
        if (digested := digest(after)) == seen:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now, seen = after, digested


class UnionFind:
    """Smallest-root union over arbitrary integers, for the links one task has verified."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root and above != x:
            up[x], x = root, above
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
