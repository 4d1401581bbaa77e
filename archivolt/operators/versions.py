"""Versions of a catalog: diff, quarantine, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A snapshot with fewer than (1 - DROP) of the documents of the last good one is not trusted.
DROP = 0.05


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], printable: list[str] = ()) -> DataFrame:
    """Rows that were added, removed or changed, in one full join.

    fields: the names of changed fields in the order given, null equal to null.
    values: from and to of changed ``printable`` fields; of others only the name is told.
    """
    o = old.select(F.col(key), F.struct(*fields).alias("o"))
    n = new.select(F.col(key), F.struct(*fields).alias("n"))
    both = o.join(n, key, "full")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(differs) > 0, "changed")
    shown = F.array_compact(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.struct(F.lit(f).alias("key"), F.struct(F.col(f"o.{f}").cast("string").alias("from"), F.col(f"n.{f}").cast("string").alias("to")).alias("value"))) for f in printable))) if printable else None
    out = both.withColumn("kind", kind).where("kind is not null").withColumn("fields", F.when(F.col("kind") == "changed", differs))
    if shown is not None:
        out = out.withColumn("values", F.when(F.col("kind") == "changed", F.map_from_entries(shown)))
    return out


def diff_counts(changes: DataFrame, **deltas: str) -> DataFrame:
    """Rows by kind, and for each name the change of a field (null as 0)."""
    delta = lambda f: F.coalesce(F.sum(F.coalesce(F.col(f"n.{f}"), F.lit(0)) - F.coalesce(F.col(f"o.{f}"), F.lit(0))), F.lit(0))
    return changes.groupBy("kind").agg(F.count("*").alias("n"), *(delta(f).cast("long").alias(name) for name, f in deltas.items()))


def quarantine(stats: DataFrame) -> DataFrame:
    """O3: stats (snapshot in order, documents, duplicates) with reasons; none: accepted.

    The fall is against the last accepted snapshot, so it is a fold in order. There are as
    many rows as snapshots.
    """
    row = F.struct("snapshot", "documents", "duplicates")
    rows = stats.agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<snapshot:string,documents:bigint,duplicates:bigint,reasons:array<string>>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fell = F.coalesce((acc["last"] > 0) & (x["documents"] < acc["last"] * (1 - DROP)), F.lit(False))
        reasons = F.array_compact(F.array(
            F.when(x["documents"] == 0, F.lit("zero rows")), F.when(x["duplicates"] > 0, F.concat(x["duplicates"].cast("string"), F.lit(" duplicates"))),
            F.when(fell, F.concat(F.lit("fell from "), acc["last"].cast("string"), F.lit(" to "), x["documents"].cast("string"))),
        ))
        return F.struct(
            F.when(F.size(reasons) == 0, x["documents"]).otherwise(acc["last"]).alias("last"),
            F.array_append(acc["out"], F.struct(x["snapshot"].cast("string").alias("snapshot"), x["documents"].cast("long").alias("documents"), x["duplicates"].cast("long").alias("duplicates"), reasons.alias("reasons"))).alias("out"),
        )

    return rows.select(F.explode(F.aggregate("rows", start, step)["out"]).alias("x")).select("x.*")


HISTORY = ("status", "first_seen", "last_seen", "removed_at", "reappeared_at", "previously_removed_at", "changed_at", "changed_fields")


def merged_history(history: DataFrame | None, snapshot: DataFrame, key: str, fields: list[str], day: str) -> DataFrame:
    """The history after a snapshot of ``day``.

    Present rows keep first_seen; back from removal they get reappeared_at. changed_at and
    changed_fields stay until the next change. Absent rows stay, with removed_at of the first
    time that they were absent.
    """
    d = F.lit(day)
    if history is None:
        none = {"removed_at": "string", "reappeared_at": "string", "previously_removed_at": "string", "changed_at": "string", "changed_fields": "array<string>"}
        return snapshot.select(key, *fields, F.lit("present").alias("status"), d.alias("first_seen"), d.alias("last_seen"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    old = history.select(key, F.struct(*fields, *HISTORY).alias("p"))
    new = snapshot.select(key, F.struct(*fields).alias("m"))
    both = old.join(new, key, "full")
    here, known = F.col("m").isNotNull(), F.col("p").isNotNull()
    differs = F.array_compact(F.array(*(F.when(~F.col(f"p.{f}").eqNullSafe(F.col(f"m.{f}")), F.lit(f)) for f in fields)))
    changed = here & known & (F.size(differs) > 0)
    back = here & known & (F.col("p.status") == "removed")
    p = lambda c: F.col(f"p.{c}")
    keep = here & known
    return both.select(
        key, *(F.when(here, F.col(f"m.{f}")).otherwise(p(f)).alias(f) for f in fields),
        F.when(here, "present").otherwise("removed").alias("status"),
        F.coalesce(p("first_seen"), d).alias("first_seen"),
        F.when(here, d).otherwise(p("last_seen")).alias("last_seen"),
        F.when(~here, F.coalesce(p("removed_at"), d)).alias("removed_at"),
        F.when(back, d).when(~here, p("reappeared_at")).alias("reappeared_at"),
        F.when(back, p("removed_at")).when(~here, p("previously_removed_at")).alias("previously_removed_at"),
        F.when(changed, d).when(keep | ~here, p("changed_at")).alias("changed_at"),
        F.when(changed, differs).when(keep | ~here, p("changed_fields")).alias("changed_fields"),
    )


def change_kinds(changes: DataFrame, history: DataFrame, key: str, day: str) -> DataFrame:
    """An added row that the history has as come back on ``day`` is ``reappeared``."""
    back = history.where(F.col("reappeared_at") == day).select(key, F.lit(True).alias("_back"))
    return changes.join(back, key, "left").withColumn("kind", F.when((F.col("kind") == "added") & F.col("_back"), "reappeared").otherwise(F.col("kind"))).drop("_back")


def accepted_snapshots(snapshots: DataFrame) -> DataFrame:
    """Of each day the accepted snapshot of the last name."""
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("name")))
    return snapshots.where("accepted").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def since(changes: DataFrame, day: str | None, limit: int, offset: int = 0) -> DataFrame:
    """The change feed from a day on, newest first."""
    rows = changes if day is None else changes.where(F.col("day") >= day)
    return rows.orderBy(F.desc("day"), "kind", "document").offset(offset).limit(limit)
