"""Reading with a declared schema, and reading what may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of a file's row group, which one task reads: a file below it cannot be split.
ROW_GROUP = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *, spread: bool = False) -> DataFrame:
    """A table by name. spread: for work that is heavy by row, a few small files are dealt out evenly.

    Files are split among tasks by row groups, without a shuffle. Only files below a row
    group, fewer than the cores, would leave cores idle; their rows are dealt out, at most
    a row group for each core.
    """
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not spread:
        return out
    cores = spark.sparkContext.defaultParallelism
    files = out.inputFiles()
    if len(files) >= cores or any(file_bytes(spark, f) >= ROW_GROUP for f in files):
        return out
    return out.repartition(cores)


def file_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the fields of ``schema``; absent ones are typed nulls."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(
        (F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one of ``schema`` where nothing lies there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return conformed(spark.read.parquet(path), schema)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool) -> DataFrame:
    """One object a line; blank lines go. strict: a bad line fails, else it is skipped."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)
