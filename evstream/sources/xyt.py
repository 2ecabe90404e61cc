"""Point files: tab-separated x, y, t without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, t and ord, the order of lines; lines from # on are comments. A row without exactly three integers fails the read.

    ord follows the lines of a file without a sort: it is the partition's number and the place in it, and the parts of a
    file are partitions in order. Files of a folder follow one another as Spark deals them out.
    """
    raw = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    line = F.trim(F.split("value", "#")[0])
    rows = raw.withColumn("line", line).where("line <> ''").withColumn("cells", F.split("line", "\t"))
    wrong = F.raise_error(F.concat(F.lit("not three tab-separated integers: "), F.col("line"))).cast("long")
    cell = lambda k: F.when((F.size("cells") == 3) & F.trim(F.col("cells")[k]).rlike(r"^[+-]?\d+$"), F.trim(F.col("cells")[k]).cast("long")).otherwise(wrong)
    return rows.select(cell(0).alias("x"), cell(1).alias("y"), cell(2).alias("t"), "ord")
