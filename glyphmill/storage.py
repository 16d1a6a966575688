"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves, but only in local mode;
    on a cluster the executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="glyphmill-"))
        atexit.register(shutil.rmtree, _local[0].removeprefix("file://"), ignore_errors=True)
    return _local[0]


#: Arrow batches of whole texts hold so many bytes, unless the session sets a bound of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bound on the bytes of an Arrow batch, if it is the default of 64 MB.

    Every operator that takes whole texts calls it, so what a task holds doesn't depend on
    which of them ran before.  The setting stays: plans that are returned are run
    later, by the caller.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{64 << 20}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Workspace:
    """Intermediate tables in the shared folder.

    A written table cuts the lineage: an executor that is lost later takes
    nothing of it along.  `drop` removes a table that no later plan reads; the
    tables that a returned plan still reads stay until the folder is emptied.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._glyphmill_path = path
        # shuffle files of a finished job stay on disk until the driver collects what refers to them
        self.spark._jvm.System.gc()
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._glyphmill_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """`df` with the rank of each row in the order of a column, from 0, as column `name`.

    The rows are sorted in parallel and written once; the sizes of the sorted
    partitions before a row's own are added to its place there.
    """
    ws = Workspace(df.sparkSession, "numbered")
    place = F.monotonically_increasing_id()
    rows = ws.save(df.sort(order).withColumn("gm_place", place), "sorted")
    part = F.shiftright("gm_place", 33)
    sizes = rows.groupBy(part.alias("gm_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("gm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("gm_part", before.alias("gm_before"))
    inside = F.col("gm_place").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.join(offsets, part == F.col("gm_part"))
    return out.withColumn(name, F.col("gm_before") + inside).select(*[F.col(f"`{c}`") for c in df.columns], name)
