"""Apply a decision about every row to the rows themselves, whatever their columns are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spare

BROADCAST_ROWS = 500_000


def row_key(text: str = "text") -> Column:
    """With doc_id, what tells a row from others that are not its repetition."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_rows(docs: DataFrame, decisions: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that decisions (doc_id, key, kept: one row for each of docs) keep.

    Rows that repeat doc_id and text count as one: where a decision keeps one of them, one stays.
    """
    keys = decisions.groupBy("doc_id", "key").agg(F.max("kept").alias("any"), F.count("*").alias("rows"))
    keys = materialize(keys.where("not any or rows > 1"), "decided")
    dropped, repeated = keys.where("not any").count(), keys.where("any").count()
    key, doc, of = (spare(docs, n) for n in ("__key", "__doc", "__of"))
    out = keyed = docs.withColumn(key, row_key(text))

    def matched(rows: DataFrame, side: DataFrame, n: int, how: str) -> DataFrame:
        side = side.select(F.col("doc_id").alias(doc), F.col("key").alias(of))
        return rows.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(of)), how)

    if dropped or repeated:
        out = matched(keyed, keys, dropped + repeated, "left_anti")
    if repeated:
        out = out.unionByName(matched(keyed, keys.where("any"), repeated, "left_semi").dropDuplicates(["doc_id", key]))
    return out.drop(key)
