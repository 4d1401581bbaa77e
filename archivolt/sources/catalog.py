"""Catalog snapshots: CSV in and out, typed parse, append with content dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes that a file name may carry; the first that fits goes.
SUFFIXES = (".pdf_MD", ".pdf.md", "_MD", ".pdf")
NUMBERS = ("page_count", "pdf_size")


def read_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Any delimiter, doubled quotes, line ends inside quotes, a byte-order mark; all strings."""
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", nullValue="\0", emptyValue="")
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """Quotes only where a value needs them; no byte-order mark, line feeds alone."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue="")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def document_key(name: Column, pattern: str = r"^[A-Z0-9_-]*[0-9]+$") -> Column:
    """Last path segment less the first fitting suffix; anything else than ``pattern`` is an error."""
    last = F.element_at(F.split(F.trim(name), "/"), -1)
    out = last
    for suffix in reversed(SUFFIXES):
        out = F.when(last.endswith(suffix), F.substring(last, F.lit(1), F.length(last) - len(suffix))).otherwise(out)
    return F.when(out.rlike(pattern), out).otherwise(F.raise_error(F.concat(F.lit("not a document key: "), F.coalesce(name, F.lit("null")))))


def serial(key: Column) -> Column:
    """The digits at the end of a key, as a number."""
    return F.nullif(F.regexp_extract(key, r"(\d+)$", 1), F.lit("")).cast("long")


def page_key(key: Column, page: Column) -> Column:
    """The stamp of a page: that of the document's first page moved on, in the same width."""
    digits = F.regexp_extract(key, r"(\d+)$", 1)
    return F.concat(F.regexp_replace(key, r"\d+$", ""), F.lpad((digits.cast("long") + page - 1).cast("string"), F.length(digits), F.lit("0")))


def typed(raw: DataFrame, required: tuple[str, ...], key: str) -> DataFrame:
    """Trimmed texts with blanks as null, numbers as long; rows that are all blank go."""
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"the catalog lacks column {missing[0]}")
    cols = [blank_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns]
    out = raw.select(*cols)
    out = out.where(F.coalesce(*(F.col(f"`{c}`") for c in out.columns)).isNotNull())
    numbers = {c: F.expr(f"try_cast(`{c}` as bigint)") for c in NUMBERS if c in out.columns}
    return out.withColumns({**numbers, "document": document_key(F.col(f"`{key}`"))})


def local_day(ts: Column, zone: str = "America/New_York") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def snapshot_names(new: DataFrame, known: DataFrame) -> DataFrame:
    """What to call snapshots (day, sha256, fetched_at), given those there are (name, day, sha256).

    Equal content of the same day keeps the name it has (reused); other content of a
    day that has a snapshot gets the time of day into its name.
    """
    same = known.groupBy("day", "sha256").agg(F.min("name").alias("old"))
    days = known.select("day").distinct().withColumn("taken", F.lit(True))
    stamp = F.date_format(F.from_utc_timestamp("fetched_at", "America/New_York"), "HHmmss")
    out = new.join(same, ["day", "sha256"], "left").join(days, "day", "left")
    fresh = F.when(F.col("taken"), F.concat("day", F.lit("T"), stamp)).otherwise(F.col("day"))
    return out.select("day", "sha256", F.coalesce("old", F.concat(fresh, F.lit(".csv"))).alias("name"), F.col("old").isNotNull().alias("reused"))


def snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names that start with a date, in order, with their content's hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256")).where(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}.*\.csv$")).withColumn("day", F.substring("name", 1, 10)).orderBy("name")


def current_files(files: DataFrame, manifest: DataFrame | None, key: str = "document") -> DataFrame:
    """The current text file of each document.

    The manifest (document, path) decides; a document that it lists twice is an error, and
    one whose current file is missing is left out, not replaced by another copy. Without a
    manifest a document with several files is an error.
    """
    authority = manifest.select(key, "path") if manifest is not None else files.select(key, "path")
    n = F.count("*").over(Window.partitionBy(key))
    checked = authority.withColumn("path", F.when(n > 1, F.raise_error(F.concat(F.lit("listed more than once: "), F.col(key)))).otherwise(F.col("path")))
    return checked if manifest is None else checked.join(files.select("path").distinct(), "path", "left_semi")
