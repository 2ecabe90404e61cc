"""The trailing window of a stream: the events of the latest time up to each micro-batch, and the epochs of a stream's starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import trailing_window
from ..scratch import delete, exists, make_folder, names


class Epochs:
    """Numbers the starts of a stream, in a folder that all machines share. What state carries an older number is outdated by one step, and not visited."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def current(self, spark: SparkSession) -> int:
        return max((int(n[6:]) for n in names(spark, self.path) if n.startswith("epoch-")), default=0)

    def begin(self, spark: SparkSession) -> int:
        epoch = self.current(spark) + 1
        make_folder(spark, f"{self.path}/epoch-{epoch}")
        return epoch


class TrailingWindow:
    """Events of the last window_ms by event time, as a small table that each micro-batch replaces.

    Batch n's table is the window over batch n - 1's table and the batch's own events; nothing older is read, so a batch costs
    what it and the window hold. The table before is kept, so a batch that runs again finds what it found. A batch without events
    keeps the window before. The first batch of an epoch finds an empty window; that a later one misses its table is an error.
    """

    def __init__(self, path: str, window_ms: float) -> None:
        self.path, self.window_ms = path.rstrip("/"), window_ms

    def clear(self, spark: SparkSession) -> None:
        """Begin a new epoch: the next batch finds nothing."""
        Epochs(self.path).begin(spark)

    def advance(self, events: DataFrame, batch: int) -> DataFrame:
        """The window after a batch of event rows."""
        spark, epoch = events.sparkSession, Epochs(self.path).current(events.sparkSession)
        folder = f"{self.path}/epoch-{epoch}" if epoch else self.path
        first = [int(n[6:]) for n in names(spark, folder) if n.startswith("first-")]
        if not first:
            make_folder(spark, f"{folder}/first-{batch}")
        before = f"{folder}/batch-{batch - 1}"
        if not first or batch <= first[0]:
            held = events.limit(0)
        elif exists(spark, before):
            held = spark.read.schema(events.schema).parquet(before)
        else:
            raise FileNotFoundError(f"{before}: the window after the batch before is not there")
        now = trailing_window(held.unionByName(events), self.window_ms)
        now.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
        delete(spark, f"{folder}/batch-{batch - 2}")
        return spark.read.schema(events.schema).parquet(f"{folder}/batch-{batch}")
