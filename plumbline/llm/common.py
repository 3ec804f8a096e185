"""What the operators of this subpackage share: tables, the shared folder, ranks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same for Java's regular expressions.
JAVA_WORD = r"[^\x20\x09-\x0D]+"
ANY_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text is a multiple of 5; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine serves only where the
    session names none and has no executors on other machines, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "plumbline-shared")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_folders: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of this application, which is deleted when the application's JVM ends."""
    folder = f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the rows of a batch that a Python worker gets: texts are long, and a batch is held in several copies."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends here and lost executors
    cost no recomputation of what stands above. discard() deletes it; what is left goes with the application."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote; df must not be read again."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def with_rank(df: DataFrame, order: list[Column], rank: str, sums: dict[str, str] | None = None) -> tuple[DataFrame, int]:
    """df (small rows) with its rank from 0 in a total order, and the number of rows. sums: of each column of whole numbers the
    name of another that gets its sum over the rows before.

    Range partitions are written once, as the sampled bounds may differ in a second run; then
    rows are numbered in each and shifted by the counts of the earlier ones. One row for each
    partition is all that meets in one task.
    """
    sums = sums or {}
    pid = fresh_name(df, "pid")
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(df.repartitionByRange(n, *order).withColumn(pid, F.spark_partition_id()), "ranged")
    here = ranged.groupBy(pid).agg(F.count(F.lit(1)).alias("rows_here"), *(F.sum(c).alias(f"here_{i}") for i, c in enumerate(sums)))
    earlier = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    before = here.select(pid, ahead("rows_here").alias("rows_before"), *(ahead(f"here_{i}").alias(f"before_{i}") for i in range(len(sums))))
    total = here.agg(F.sum("rows_here")).first()[0] or 0
    within = Window.partitionBy(pid).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn(rank, F.row_number().over(within))
    out = out.withColumns({into: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c, into in sums.items()}) if sums else out
    out = out.join(F.broadcast(before), pid).withColumn(rank, (F.col(rank) - 1 + F.col("rows_before")).cast("long"))
    out = out.withColumns({into: F.col(into) + F.col(f"before_{i}") for i, into in enumerate(sums.values())}) if sums else out
    return out.drop(pid, "rows_before", *(f"before_{i}" for i in range(len(sums)))), total
