"""Row numbers over a total order without a single task: range partitions, then offsets by partition."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Sees that there is a folder for checkpoints: the one that the session names, or one of this machine if there is no other."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "plumbline-shared")
    sc.setCheckpointDir(at)


def with_row_number(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with its place from 1. Rows are dealt out by ranges of the order once, with a number of their own at its end, so that rows of one key can be
    dealt to several partitions; the rows are numbered in each partition and shifted by the counts of those before. Rows that are equal
    in the order may change places."""
    checkpoint_dir(df.sparkSession)
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order, "__tie").withColumn("__p", F.spark_partition_id())
    # checkpointed, as a second run of the range exchange may sample other bounds
    ranged = dealt.checkpoint()
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order, "__tie"))
    return ranged.withColumn(into, place).join(F.broadcast(before), "__p").withColumn(into, (F.col(into) + F.col("__before")).cast("long")).drop("__p", "__tie", "__before")
