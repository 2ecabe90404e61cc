"""Sharding by extendible hashing: a directory of hash-prefix bits in which only oversized buckets split.

Every row has 60 hash bits of its key. A bucket is a prefix; one whose rows exceed the byte limit splits
on the next bit, others stay as they are. Sums by prefix come from one histogram that is a few bits finer
than the mean shard, so the directory grows with the number of shards, not of rows; cells still oversized
at its finest bits are opened again with more bits.

A row larger than the limit gets a shard of its own, named by its key. Rows that share all 60 bits (one hot
key) cannot be told apart by hashing: they are dealt by their running bytes, from counts by partition, so
that each part fits the limit. Null text has no bytes; null keys hash alike and are dealt if need be. An
empty table gives an empty table. Other columns are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, spare

LIMIT_BYTES = 16 << 20
BITS = 60
FINER_BITS = 6
BROADCAST_ROWS = 500_000


def key_hash(key: str) -> Column:
    """The first 60 bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("hash", BITS - bits)


def directory(rows: DataFrame, limit: int, bits: int) -> DataFrame:
    """(cell, depth) over the finest bits: how many leading bits the bucket of each cell has; null where bits more are needed."""
    cells = rows.groupBy(_prefix(bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
    cells = materialize(cells, "cells")
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("depth", "prefix")
    found = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(found, "cell", "left")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES, row: str | None = None) -> DataFrame:
    """One row per document: key, n_bytes, depth (bits of the bucket; null outside the directory), shard_id and, if it is named, the column row."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rows = docs.select(F.col(key).alias("__key"), size.alias("n_bytes"), key_hash(key).alias("hash"), *[F.col(c).alias("__row") for c in [row] if c])
    rows = materialize(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "keys")
    normal = rows.where(F.col("n_bytes") <= limit)
    total = normal.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINER_BITS)
    done, todo, least = [], normal, 0
    while True:
        found = materialize(directory(todo, limit, bits), "directory")
        small = found.count() <= BROADCAST_ROWS
        placed = todo.withColumn("cell", _prefix(bits)).join(F.broadcast(found) if small else found, "cell").drop("cell")
        done.append(placed.where("depth is not null"))
        if not found.where("depth is null").take(1):
            break
        todo = materialize(placed.where("depth is null").drop("depth"), "deeper")
        if bits == BITS:
            done.append(_deal(todo, limit))
            break
        bits = min(BITS, bits + 12)
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin(F.expr(f"shiftright(hash, {BITS} - depth)")), F.col("depth"), F.lit("0")))
    out = [d if "shard_id" in d.columns else d.withColumn("shard_id", F.concat(F.lit("b"), name)) for d in done]
    large = rows.where(F.col("n_bytes") > limit).withColumns({"depth": F.lit(None).cast("int"), "shard_id": F.concat(F.lit("single-"), F.coalesce(F.col("__key").cast("string"), F.lit("null")), F.lit("-"), F.col("at"))})
    result = large
    for d in out:
        result = result.unionByName(d)
    return result.select(F.col("__key").alias(key), "n_bytes", "depth", "shard_id", *[F.col("__row").alias(c) for c in [row] if c])


def _deal(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash, dealt by running bytes: every part starts within a unit that leaves room for the largest row."""
    per_part = rows.groupBy("hash", "part").agg(F.sum("n_bytes").alias("bytes"), F.max("n_bytes").alias("most"))
    before = Window.partitionBy("hash").orderBy("part")
    base = per_part.select("hash", "part", F.coalesce(F.sum("bytes").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.max("most").over(Window.partitionBy("hash")).alias("most"))
    inside = Window.partitionBy("hash", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))
    rows = rows.withColumn("start", start).join(materialize(base, "base"), ["hash", "part"])
    unit = F.greatest(F.lit(1), F.lit(limit) - F.col("most"))
    deal = F.floor((F.col("base") + F.col("start")) / unit).cast("string")
    return rows.withColumns({"depth": F.lit(None).cast("int"), "shard_id": F.concat(F.lit("key-"), F.col("hash").cast("string"), F.lit("-"), deal)}).drop("start", "base", "most")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write docs as Parquet with a folder for each shard, named by a column shard_id. Every row goes to its own shard, so no
    folder holds more than limit bytes of texts, unless it is one row's."""
    row = spare(docs, "__rid")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "to-shard")  # rows keep their numbers if a task is run again
    shards = materialize(assign_shards(docs, key, text, limit, row).select(row, F.col("shard_id")), "shards")
    joined = docs.drop("shard_id").join(shards, row).drop(row)
    joined.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    discard(docs, shards)
