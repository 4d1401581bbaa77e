"""Windows, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Shared


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """Every row with the number of all rows; a count and a one-row broadcast instead of one window."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def running_total(df: DataFrame, order: list[str], value: str, name: str = "upto") -> DataFrame:
    """W5 over all rows, nulls of the order first: every row with the sum up to it.

    Rows are dealt by ranges of the order, written once, and summed within their task; the
    totals of the tasks, one number each, give what came before. No task has all rows.
    Equal rows of the order get their sums in any order.
    """
    shared = Shared(df.sparkSession)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    task = F.shiftright("_at", 33)  # the task in the high bits, the row within it in the low
    dealt = shared.keep(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_task", task)
    before, total = [], 0
    for t, s in sorted((r["_task"], r["s"] or 0) for r in dealt.groupBy("_task").agg(F.sum(value).alias("s")).collect()):
        before.append((t, total))
        total += s
    kind = dealt.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    offsets = df.sparkSession.createDataFrame(before, f"_task long, _before {kind}")
    own = F.sum(value).over(Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_task").withColumn(name, F.col("_own") + F.col("_before")).drop("_at", "_task", "_own", "_before")


def next_in_group(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """The next key of the group; null is a group value like others. Drop removed rows before."""
    return df.withColumn("next", F.lead(key).over(Window.partitionBy(*group).orderBy(key)))


def month_series(months: DataFrame, by: list[str], longest: int = 12) -> DataFrame:
    """Months with a count each, gaps filled with 0; more than ``longest`` empty ones become one break row.

    months: by, month (date, first of month), n. A break row has n null and the first empty month.
    """
    prev = F.lag("month").over(Window.partitionBy(*by).orderBy("month"))
    gap = months.withColumn("_from", F.add_months(prev, 1)).withColumn("_empty", F.when(F.col("_from") < F.col("month"), F.months_between("month", "_from").cast("int")).otherwise(0))
    fill = gap.where(F.col("_empty").between(1, longest)).select(*by, F.explode(F.expr("sequence(_from, add_months(month, -1), interval 1 month)")).alias("month"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("is_break"))
    cut = gap.where(F.col("_empty") > longest).select(*by, F.col("_from").alias("month"), F.lit(None).cast("long").alias("n"), F.lit(True).alias("is_break"))
    return months.select(*by, "month", F.col("n").cast("long").alias("n"), F.lit(False).alias("is_break")).union(fill).union(cut)


def slugs(df: DataFrame, label: str, key: str) -> DataFrame:
    """A slug for each row, numbered from 2 within equal ones in order of key.

    A number that would make another row's own slug is passed over: own slugs come first.
    """
    base = F.trim(F.regexp_replace(F.lower(F.col(label)), "[^a-z0-9]+", "-"), F.lit("-"))
    named = df.withColumn("_base", F.when(base == "", "x").otherwise(base))
    rank = F.row_number().over(Window.partitionBy("_base").orderBy(key))
    ranked = named.withColumn("_rank", rank)
    # Numbered slugs that exist as somebody's own: base and number taken.
    own = named.select("_base").distinct().select(F.regexp_extract("_base", r"^(.*)-(\d+)$", 1).alias("_base"), F.expr("try_cast(regexp_extract(_base, '-([0-9]+)$', 1) as int)").alias("_n")).where("_base <> '' and _n >= 2")
    taken = own.groupBy("_base").agg(F.sort_array(F.collect_set("_n")).alias("_taken"))
    joined = ranked.join(taken, "_base", "left")
    number = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_rank"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return joined.withColumn("slug", F.when(F.col("_rank") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", number.cast("string")))).drop("_base", "_rank", "_taken")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows of a total order; write nulls-last into the order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, after: object, limit: int) -> DataFrame:
    """The rows after a key; one more than ``limit`` says that there are more."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(limit + 1)


def truncated(df: DataFrame, order: list[Column], most: int = 500) -> DataFrame:
    """The first rows, each with whether the list was cut."""
    head = df.orderBy(*order).limit(most + 1)
    return head.crossJoin(F.broadcast(head.agg((F.count("*") > most).alias("truncated")))).orderBy(*order).limit(most)


def best_per(df: DataFrame, group: list[str], score: Column, tie: list[Column], most: int) -> DataFrame:
    """The best row of each group, then the best groups; exact, without fetching more and cutting."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(score.desc_nulls_last(), *tie))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank").orderBy(score.desc_nulls_last(), *tie).limit(most)


def blended(views: Column, rank: Column) -> Column:
    """T8."""
    return F.coalesce(views, F.lit(0)) + F.greatest(F.lit(0), 200 - F.coalesce(rank, F.lit(200)))


def shuffled_head(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """A fixed order that looks random, and its head."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most)


def by_latest(df: DataFrame, dates: str, key: str) -> DataFrame:
    """Rows by the last of their dates, newest first, rows without one at the end."""
    return df.orderBy(F.array_max(dates).desc_nulls_last(), key)


def middle_of_strata(df: DataFrame, stratum: str, size: str, key: str, each: int = 1) -> DataFrame:
    """Of each stratum, in order of size, the rows around the middle one."""
    own = Window.partitionBy(stratum)
    ranked = df.withColumns({"_i": F.row_number().over(own.orderBy(size, key)) - 1, "_n": F.count("*").over(own)})
    off = F.abs(F.col("_i") - F.floor(F.col("_n") / 2))
    return ranked.withColumn("_pick", F.row_number().over(own.orderBy(off, "_i"))).where(F.col("_pick") <= each).drop("_i", "_n", "_pick")


def first_wins(arms: list[DataFrame], key: str, order: str, most: int) -> DataFrame:
    """A union in which an earlier arm wins a key; out by arm, then by the arm's own order."""
    out = None
    for i, df in enumerate(arms):
        arm = df.select(key, order, F.lit(i).alias("arm"))
        out = arm if out is None else out.union(arm)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("arm", order))
    return out.withColumn("_rank", rank).where("_rank = 1").drop("_rank").orderBy("arm", order, key).limit(most)


def multiset_overlap(left: Column, right: Column) -> Column:
    """U4: size of the intersection of two arrays as multisets."""
    count = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    return F.aggregate(F.array_intersect(left, right), F.lit(0), lambda n, v: n + F.least(count(left, v), count(right, v)))


def corroborated(left: Column, right: Column, least: int = 10) -> Column:
    """U5."""
    return F.size(F.array_intersect(left, right)) >= least
