"""Sinks: versioned tables with an atomic switch, archives named by content, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_hash(df: DataFrame, *cols: str) -> Column:
    """sha256 of the row as JSON with sorted keys; null fields count too."""
    names = sorted(cols or df.columns)
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in names)), {"ignoreNullFields": "false"}), 256)


def changed_rows(new: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Rows whose (key, hash) has not been sent; rows that are gone stay where they are."""
    return new.withColumn("hash", row_hash(new)).join(sent.select(key, "hash"), [key, "hash"], "left_anti")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Writes all tables as a new version, then switches ``current`` to it in one rename.

    A failure before the switch leaves the old version in place.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    text = json.dumps({"version": version, "tables": sorted(tables)})
    tmp, fs = _fs(spark, f"{root}/current.{version}")
    out = fs.create(tmp, True)
    out.write(text.encode())
    out.close()
    target, _ = _fs(spark, f"{root}/current")
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    context.rename(tmp, target, options)
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = json.loads(spark.read.text(f"{root}/current", wholetext=True).first()[0])["version"]
    return spark.read.parquet(f"{root}/versions/{version}/{name}")


def archive_identity(files: DataFrame, group: str) -> DataFrame:
    """Per group: files, bytes, and a name from the content of all (file name and sha256), in order of name."""
    line = F.concat_ws(" ", "name", "sha256")
    return files.groupBy(group).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("identity"),
    )


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for every rule that a row breaks; one scan."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def require_none(found: DataFrame) -> None:
    first = found.limit(1).collect()
    if first:
        raise ValueError(f"not eligible: {first[0].asDict()}")


def verify_report(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Counts of files that are fine, missing, extra, of another size or of another hash."""
    both = expected.select(key, F.col("bytes").alias("e"), F.col("sha256").alias("eh")).join(actual.select(key, F.col("bytes").alias("a"), F.col("sha256").alias("ah")), key, "full")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e") != F.col("a"), "size").when(~F.col("eh").eqNullSafe(F.col("ah")), "hash").otherwise("ok")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def geojson(places: DataFrame) -> DataFrame:
    """One Feature a row of places with a position; (lon, lat) order."""
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(*(c for c in places.columns if c not in ("lat", "lon"))).alias("properties"),
    ))
    return places.where("lat is not null and lon is not null").select(feature.alias("feature"))


def retry_seconds(attempt: Column) -> Column:
    """Backoff before an attempt: 5 s, three times as long each time, 300 s at most."""
    return F.least(F.lit(300.0), 5 * F.pow(F.lit(3.0), attempt - 1))


def changed_files(files: DataFrame, packed: DataFrame) -> DataFrame:
    """Files whose path, size or time differ from what was packed."""
    return files.join(packed.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
