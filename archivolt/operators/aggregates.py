"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(df: DataFrame, by: str, **sums: str) -> DataFrame:
    """A2: rows and sums by a dimension; null is the bucket ``(null)``."""
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("(null)")).alias(by)).agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()))


def order_statistics(df: DataFrame, value: str, at: dict[str, object]) -> DataFrame:
    """The values at given 0-based ranks of all rows in ascending order; one row.

    at: name to a function of the number of rows. Null counts as 0. A histogram of
    distinct values takes partial sums before its shuffle; ranks are then found by
    range: tasks' totals pick the task that has a rank, and no task sorts all rows.
    """
    n = df.count()
    ranks = {name: int(rank(n)) for name, rank in at.items()}
    hist = df.groupBy(F.coalesce(F.col(value), F.lit(0)).alias("v")).agg(F.count("*").alias("n"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = hist.repartitionByRange(parts, "v").withColumn("task", F.spark_partition_id())
    totals = sorted((r["low"], r["task"], r["n"]) for r in dealt.groupBy("task").agg(F.min("v").alias("low"), F.sum("n").alias("n")).collect())
    out, before = {}, 0
    for i, (low, _, count) in enumerate(totals):
        high = totals[i + 1][0] if i + 1 < len(totals) else None
        own = {k: r for k, r in ranks.items() if before <= r < before + count}
        if own:
            rows = hist.where((F.col("v") >= low) & (F.lit(True) if high is None else F.col("v") < high))
            upto = rows.withColumn("upto", before + F.sum("n").over(Window.orderBy("v")))
            got = upto.agg(*(F.min(F.when(F.col("upto") > r, F.col("v"))).alias(k) for k, r in own.items())).first()
            out.update(got.asDict())
        before += count
    kind = df.schema[value].dataType
    return df.sparkSession.createDataFrame([tuple(out.get(k) for k in at)], ", ".join(f"{k} {kind.simpleString()}" for k in at))


def lower_neighbour(p: float):
    """A3: index floor(p * (n - 1))."""
    return lambda n: int(p * (n - 1)) if n else 0


def nearest_index(p: float):
    """A4: index floor(p / 100 * n), within the rows."""
    return lambda n: min(n - 1, int(p / 100 * n))


def interval_steps(df: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """After each interval but the first, start less the end before less 1: above 0 a gap, below an overlap."""
    prev = F.lag(end).over(Window.partitionBy(*by).orderBy(start, end))
    return df.withColumn("step", F.col(start) - prev - 1).where("step is not null")


def gap_summary(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.groupBy(*by).agg(F.count_if(F.col("step") > 0).alias("gaps"), F.coalesce(F.sum(F.when(F.col("step") > 0, F.col("step"))), F.lit(0)).cast("long").alias("gap_numbers"), F.count_if(F.col("step") < 0).alias("overlaps"))


def best(value: Column, *order: Column) -> Column:
    """The value of the row that comes first; numbers descend by their negative, null last."""
    return F.min_by(value, F.struct(*order))


def descending(c: Column) -> Column:
    """For ``best``: larger numbers first, nulls last."""
    return F.coalesce(-c.cast("double"), F.lit(float("inf")))


def modal(df: DataFrame, by: list[str], value: str, first: str) -> DataFrame:
    """The most frequent value of each group, of equals the one seen first by ``first``; with its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    rank = F.struct((-F.col("n")).alias("n"), "_first", F.col(value).alias("value"))
    return counts.groupBy(*by).agg(F.min(rank).alias("x")).select(*by, F.col("x.value").alias(value), (-F.col("x.n")).alias("n"))


def greatest_modal(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The value of the largest total, of equals the lexically greatest."""
    totals = df.groupBy(*by, value).agg(F.sum(weight).alias("n"))
    return totals.groupBy(*by).agg(F.max(F.struct("n", value)).alias("x")).select(*by, F.col(f"x.{value}").alias(value), F.col("x.n").alias("n"))


def top_values(df: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """The most frequent values of each group, ties by value, with counts and rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def strongest(method: Column, order: list[str]) -> Column:
    """Of the methods of a group the one that stands first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), method)
    return F.min(F.when(rank > 0, F.struct(rank.alias("r"), method.alias("m"))))["m"]


def first_known(value: Column, *order: Column) -> Column:
    """The first value that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def majority(flag: Column, share: float = 0.5) -> Column:
    """At least this share of the rows has the flag; null counts as not."""
    return F.avg(F.coalesce(flag.cast("int"), F.lit(0))) >= share


def measured_rollup(df: DataFrame, by: list[str], *, page: Column, value: str, unit: str, day: str, above: str, first: str) -> DataFrame:
    """Pages, readings, first and last day, any above, and the largest value in the most frequent unit."""
    units = modal(df, by, unit, first).select(*by, F.col(unit).alias("_unit"))
    joined = df.join(units, by, "left")
    return joined.groupBy(*by).agg(
        F.countDistinct(page).alias("pages"), F.count("*").alias("readings"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.max(F.when(F.col(unit) == F.col("_unit"), F.col(value))).alias("max_value"), F.max("_unit").alias("unit"), F.coalesce(F.bool_or(above), F.lit(False)).alias("any_above"),
    )


def sorted_set(value: Column) -> Column:
    """Distinct values in order."""
    return F.sort_array(F.collect_set(value))


def residual(total: DataFrame, removed: DataFrame, key: str, *names: str) -> DataFrame:
    """Totals less what was removed, 0 at least."""
    gone = removed.select(key, *(F.col(n).alias(f"_{n}") for n in names))
    return total.join(gone, key, "left").select(key, *(F.greatest(F.lit(0), F.col(n) - F.coalesce(f"_{n}", F.lit(0))).cast("long").alias(n) for n in names))


def first_seen(df: DataFrame, key: str, at: str, unit: str) -> DataFrame:
    """How many keys are new in each period, and how many there are by then."""
    new = df.groupBy(key).agg(F.min(at).alias("_at")).groupBy(F.date_trunc(unit, "_at").alias("period")).agg(F.count("*").alias("n_new"))
    return new.withColumn("n_total", F.sum("n_new").over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))


def top_crosstab(df: DataFrame, period: str, key: str, most: int) -> DataFrame:
    """Counts by period and key for the most frequent keys, ties by key."""
    top = df.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(most).select(key)
    return df.join(top, key, "left_semi").groupBy(period, key).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, *fields: str) -> DataFrame:
    """(field, n_known) of each field; an empty array is not known."""
    def known(f: str) -> Column:
        array = df.schema[f].dataType.typeName() == "array"
        return F.count_if(F.col(f).isNotNull() & (F.size(f) > 0 if array else F.lit(True)))
    counts = df.agg(*(known(f).alias(f) for f in fields))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_known")) for f in fields))).alias("x")).select("x.field", "x.n_known")


def mean_vector(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The L2-normalised mean of each group; sums combine before the shuffle."""
    flat = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = flat.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return mean.withColumn("norm", norm).select(*by, F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias(vector))


def reconciled(listed: DataFrame, actual: DataFrame, totals: DataFrame) -> DataFrame:
    """(field, key, listed, actual, differs); the blank bucket of a field is its total less what is listed."""
    blank = totals.join(listed.groupBy("field").agg(F.sum("n").alias("s")), "field", "left").select("field", F.lit("").alias("key"), (F.col("n") - F.coalesce("s", F.lit(0))).alias("n")).where("n <> 0")
    left = listed.select("field", "key", F.col("n").alias("listed")).union(blank)
    both = left.join(actual.select("field", F.coalesce("key", F.lit("")).alias("key"), F.col("n").alias("actual")), ["field", "key"], "full")
    return both.withColumn("differs", ~F.col("listed").eqNullSafe(F.col("actual")))


def text_layer(pages: DataFrame, doc: str, chars: str) -> DataFrame:
    """Documents without text, with under 50 characters a page, and blank pages; one row."""
    docs = pages.groupBy(doc).agg(F.sum(chars).alias("chars"), F.count("*").alias("pages"), F.count_if(F.col(chars) == 0).alias("blank"))
    return docs.agg(F.count("*").alias("documents"), F.count_if(F.col("chars") == 0).alias("no_text"), F.count_if(F.col("chars") < 50 * F.col("pages")).alias("thin"), F.sum("blank").alias("blank_pages"))
