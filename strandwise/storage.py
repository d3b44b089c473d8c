"""The cluster's shared folder: checkpoints, and files that tasks write for one another.

`spark.checkpoint.dir` names it. Checkpoints go by themselves once nothing refers to them if the session has
`spark.cleaner.referenceTracking.cleanCheckpoints` (a static setting), and stay in that folder otherwise.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is set only where none is named and there is no cluster (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = "file://" + os.path.join(tempfile.gettempdir(), "strandwise-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder, of which every executor can read it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """`ordered` with the numbers of its rows, from 1 in their order, as `name`.

    The rows are kept before they are counted: a sort that runs twice may cut its ranges at other places the second time,
    and the numbers of one run don't fit the sizes of another.
    """
    kept = checkpoint(ordered.withColumn("_place", F.monotonically_increasing_id()))  # partition and row of it, in one number
    part = F.shiftright("_place", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + row).drop("_part", "_place", "_before")


def release(spark: SparkSession) -> None:
    """Has Spark's cleaner look now for shuffle files of plans that nothing refers to; it looks every half hour otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Folder:
    """A folder of files in the shared folder, for tasks that write blocks. Writes replace whole files."""

    def __init__(self, uri: str):
        self.uri = uri

    @classmethod
    def new(cls, spark: SparkSession, kind: str) -> Folder:
        return cls(f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri if "://" in self.uri else "file://" + self.uri)

    def write(self, name: str, data: bytes) -> None:
        system, root = self._fs()
        system.create_dir(root, recursive=True)
        own = f"{root}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(own, compression=None) as out:
            out.write(data)
        system.move(own, f"{root}/{name}")

    def read(self, name: str) -> bytes:
        system, root = self._fs()
        with system.open_input_stream(f"{root}/{name}", compression=None) as src:
            return src.read()

    def drop(self) -> None:
        from pyarrow import fs

        system, root = self._fs()
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)
