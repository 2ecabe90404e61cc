"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Every text is fingerprinted (white-space runs made one space), and the fingerprints are written in as many
   buckets as the session has shuffle partitions, or more so that a bucket has no more than SENDER_ROWS rows on
   average, whole partitions to a bucket. A bucket is a sender: it sends
   each owner of a hash range its sorted, distinct fingerprints as Golomb-Rice codes.
2. An owner tells each sender, as a bitmap in the order sent, which fingerprints others have too.
3. Rows whose fingerprint is marked, or repeats inside its bucket, are suspects. Only their texts
   are shuffled, and grouped by the bytes themselves.

A text that very many rows share is one fingerprint a bucket in step 1 and one partial group a
task in step 3, so no task sees its copies together.

Null text counts as empty. Of equal texts the row with the smallest doc_id stays (a null doc_id
comes last); where that doc_id repeats with the same text, one of the repeated rows stays. An empty
table gives an empty table. A very long text is hashed whole where it is read, and shuffled only if its fingerprint
is met twice. Other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, materialize_buckets
from .keep import keep_rows, row_key

FINGERPRINT_BITS = 48
OWNER_ROWS = 1 << 16
BROADCAST_ROWS = 500_000
SENDER_ROWS = 1_000_000
MOST_SENDERS = 100_000  # Spark's own bound on buckets


def normalized(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprint(norm: Column, bits: int = FINGERPRINT_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - bits)


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct non-negative values below span: the divisor's bits, unary quotients of the gaps, remainders."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(span / max(1, len(values))).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    return np.cumsum(gaps + (bits << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64), dtype=np.uint64)


def _suspects(rows: DataFrame, bits: int, owner_rows: int, senders: int) -> DataFrame:
    """rows (src, rid, fp, ...; bucketed by src) with suspect: whether another row may have the same text."""
    owner_bits = min(bits, (rows.count() // owner_rows).bit_length(), senders.bit_length())
    span = 1 << (bits - owner_bits)
    starts = np.arange((1 << owner_bits) + 1, dtype=np.uint64) * np.uint64(span)

    def send(table: pa.Table) -> pa.Table:
        sent = np.unique(table["fp"].to_numpy()).astype(np.uint64)
        at = np.searchsorted(sent, starts)
        owners = np.flatnonzero(np.diff(at))
        codes = [(int(at[k + 1] - at[k]), *golomb_encode(sent[at[k] : at[k + 1]] - starts[k], span)) for k in owners]
        src = table["src"][0].as_py()
        columns = [[src] * len(owners), owners.tolist(), *map(list, zip(*codes))]
        return pa.table(columns, names=["src", "owner", "n", "k", "unary", "rest"])

    def own(table: pa.Table) -> pa.Table:
        sent = [golomb_decode(m["n"], m["k"], m["unary"], m["rest"]) for m in table.select(["n", "k", "unary", "rest"]).to_pylist()]
        values, times = np.unique(np.concatenate(sent), return_counts=True)
        shared = values[times > 1]
        marks = [np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in sent]
        return pa.table({"src": table["src"], "owner": table["owner"], "marks": pa.array(marks, pa.binary())})

    def mark(table: pa.Table, maps: pa.Table) -> pa.Table:
        sent, place, times = np.unique(table["fp"].to_numpy(), return_inverse=True, return_counts=True)
        many = times > 1
        at = np.searchsorted(sent.astype(np.uint64), starts)
        for owner, marks in zip(maps["owner"].to_pylist(), maps["marks"].to_pylist()):
            a, b = at[owner], at[owner + 1]
            many[a:b] |= np.unpackbits(np.frombuffer(marks, np.uint8), count=b - a).astype(bool)
        return table.append_column("suspect", pa.array(many[place]))

    messages = rows.select("src", "fp").groupBy("src").applyInArrow(send, "src long, owner long, n long, k long, unary binary, rest binary")
    maps = messages.groupBy("owner").applyInArrow(own, "src long, owner long, marks binary")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", suspect boolean"
    return rows.groupBy("src").cogroup(maps.groupBy("src")).applyInArrow(mark, schema)


def exact_duplicates(docs: DataFrame, text: str = "text", bits: int = FINGERPRINT_BITS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One row per document: doc_id, key (of the row for keep_rows), keep_id, group_size, kept, text_sha256."""
    norm, wanted = normalized(text), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SENDER_ROWS))
    senders = min(wanted, MOST_SENDERS)
    rows = docs.select("doc_id", row_key(text).alias("key"), fingerprint(norm, bits).alias("fp"), F.sha2(norm, 256).alias("text_sha256"))
    rows = rows.withColumns({"src": (F.spark_partition_id() % senders).cast("long"), "rid": F.monotonically_increasing_id()})
    prints = materialize_buckets(rows, "prints", "src", senders)  # what a sender has is in one bucket: neither sending nor marking shuffles rows
    rows = materialize(_suspects(prints, bits, owner_rows, senders).drop("src"), "suspects")
    discard(prints)

    again = materialize(rows.where("suspect").select("key").distinct(), "again")
    few = again.count() <= BROADCAST_ROWS
    texts = docs.select(row_key(text).alias("raw"), F.col(text).alias("body"))
    texts = texts.join(F.broadcast(again) if few else again, F.col("raw") == again.key, "left_semi").select(F.lit(1).alias("one"), normalized("body").alias("norm"))
    verified = texts.groupBy("norm").agg(F.count("one").alias("bytes_equal")).select(F.sha2("norm", 256).alias("text_sha256"), "bytes_equal")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    groups = rows.where("suspect").groupBy("text_sha256").agg(first, F.count("*").alias("group_size"))
    groups = groups.join(verified, "text_sha256", "left")
    same = F.when(F.col("bytes_equal") == F.col("group_size"), F.col("group_size"))
    checked = F.coalesce(same, F.raise_error(F.lit("texts with one SHA-256 differ in their bytes")).cast("long"))
    groups = materialize(groups.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), checked.alias("group_size")), "groups")
    discard(again)

    columns = ["doc_id", "key", "keep_id", "group_size", "kept", "text_sha256"]
    alone = rows.where("not suspect").select("doc_id", "key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shared = rows.where("suspect").join(groups, "text_sha256").withColumn("kept", F.col("rid") == F.col("keep_rid"))
    return alone.unionByName(shared.select(columns))


def drop_exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without all but one row of equal texts, all columns as they were."""
    return keep_rows(docs, exact_duplicates(docs, text).select("doc_id", "key", "kept"), text)
