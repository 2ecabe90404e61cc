"""A corpus from raw documents to packed sequences: toxic documents out, one of equal texts, one of near-duplicates, best-fit packing.

Null text counts as empty in every stage; an empty text has the score of no evidence, equals other empty texts, has the
fingerprint zero and is packed as its end mark. Of equal texts and of near copies the row with the smallest doc_id stays
(a row without one only where no other is there); of repeated rows, one. Very long texts are taken whole, and packing cuts
them into pieces. Columns beside doc_id and text are carried along as they are, whatever their names, up to packing,
which returns its own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evstream.llm import exact_dedup, packing, simhash, toxicity
from evstream.llm.common import discard, materialize, table

#: The stages are a trained model, hashes of shingles and a tokenizer's ids: no SQL can state their rows.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_duplicates), ("simhash", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*held)  # nothing reads the stage before any more
        held = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(*held)  # packing reads the pieces that it has written
    return packed
