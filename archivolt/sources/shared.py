"""Tables in the folder that driver and executors share.

A written table cuts the lineage, and losing an executor does not lose it. The folder is
``spark.checkpoint.dir`` of the session. Where that is unset, it is the session's
checkpoint folder, else one in the warehouse; a temporary one only where driver and
executors are one process, as in tests.

What a result reads stays until the driver's process ends, and goes then.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _top(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="archivolt-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_archivolt"


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    # The session may have ended before its process: then there is no one left to delete by.
    with contextlib.suppress(Exception):
        _delete(spark, path)


class Shared:
    def __init__(self, spark: SparkSession):
        self.spark, self.dir, self.n = spark, f"{_top(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", 0
        atexit.register(_at_exit, spark, self.dir)

    def path(self) -> str:
        """A new place in the folder."""
        self.n += 1
        return f"{self.dir}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.shared_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables of ``keep`` that nothing reads any more."""
        for df in kept:
            _delete(self.spark, df.shared_path)
