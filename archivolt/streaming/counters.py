"""Daily counters with a watermark (O9, A34) and upserts by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, at: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Events a day and key. Batch and stream give the same rows; a stream drops what is later than ``late``."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, "1 day"), *by).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *by, "n")


def trailing(counts: DataFrame, by: list[str], today: str, days: int = 7) -> DataFrame:
    """Sums of the last days up to ``today``."""
    first = F.date_format(F.date_sub(F.lit(today).cast("date"), days - 1), "yyyy-MM-dd")
    return counts.where((F.col("day") >= first) & (F.col("day") <= today)).groupBy(*by).agg(F.sum("n").alias("n"))


def upsert(key: str, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps per key the row of the latest batch; a repeated batch changes nothing.

    Batches are folders by number, so a batch that runs again overwrites its own folder.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The current row of each key in the folders of ``upsert``."""
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in cols))
