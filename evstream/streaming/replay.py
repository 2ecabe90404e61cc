"""Captures run as streams to their end, and what came out as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import running_offsets
from ..scratch import scratch_path
from ..sources.packets import capture_files, read_packets, stream_packets

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all that its sources have, a micro-batch at a time, with a checkpoint in the shared folder."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", scratch_path(spark, "replay")).start()
        try:
            query.processAllAvailable()  # availableNow would take one micro-batch of a source in Python
        finally:
            query.stop()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives, with the number of their batch. A batch that runs again replaces its rows."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "replayed")
    run_to_end(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}"), mode)
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)


def replayed_packets(spark: SparkSession, path: str, batches: int = 4) -> DataFrame:
    """A folder's captures as a stream of about so many micro-batches, in the order of their names, packets numbered through."""
    files = capture_files(path)
    heads = read_packets(spark, path).groupBy(F.shiftright("packet_id", 32).alias("file_number")).agg(F.count("*").alias("n"))
    running_offsets(heads, "file_number", "n").select("file_number", F.col("start_event_idx").alias("first")).write.parquet(at := scratch_path(spark, "firsts"))
    firsts = spark.read.schema("file_number long, first long").parquet(at)  # not counted again in every micro-batch
    packets = stream_packets(spark, path, files_per_trigger=-(-len(files) // batches), order="name").withColumn("file_number", F.shiftright("packet_id", 32))
    numbered = packets.join(F.broadcast(firsts), "file_number")  # a row a file
    return numbered.withColumn("packet_id", F.col("first") + F.col("packet_id").bitwiseAND(0xFFFFFFFF)).drop("file_number", "first")
