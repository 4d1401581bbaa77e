"""Joins (J1-J24). Disjunctions become unions of equal keys; no join here compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either_key(left: DataFrame, right: DataFrame, kind: str, key: str, kinds: dict[str, str], keep: list[str]) -> DataFrame:
    """Left join on ``kind = k and right[kinds[k]] = key`` for any k, as one equi-join.

    A key that several rows of the right side have matches the smallest of ``keep``
    only, so that a left row stays one row.
    """
    arms = None
    for k, column in kinds.items():
        arm = right.where(F.col(column).isNotNull()).groupBy(F.lit(k).alias("_kind"), F.col(column).cast("string").alias("_key")).agg(F.min(F.struct(*keep)).alias("_right"))
        arms = arm if arms is None else arms.union(arm)
    out = left.join(arms, (F.col(kind) == F.col("_kind")) & (F.col(key).cast("string") == F.col("_key")), "left")
    return out.select(*left.columns, *(F.col("_right")[c].alias(c) for c in keep))


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group. Spark keeps one row a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_first(parents: DataFrame, children: DataFrame, on: str, order: list[Column], *, keep_childless: bool) -> DataFrame:
    """Each parent with its first child; childless ones stay or go."""
    return parents.join(first_by(children, [on], order), on, "left" if keep_childless else "inner")


def cooccurring(rows: DataFrame, entity: str, place: list[str], of: object) -> DataFrame:
    """Entities on the pages of one entity: distinct pages and documents shared.

    place: document first, page after it.
    """
    pages = rows.where(F.col(entity) == of).select(*place).distinct()
    return (
        rows.join(pages, place, "left_semi").where(F.col(entity) != of).groupBy(entity)
        .agg(F.countDistinct(F.struct(*place)).alias("n_pages"), F.countDistinct(place[0]).alias("n_docs"))
    )


def cocited(lists: DataFrame, owner: str, item: str, of: object) -> DataFrame:
    """Items in the lists of an item, with the number of lists that have both."""
    own = lists.where(F.col(item) == of).select(owner).distinct()
    return lists.join(own, owner, "left_semi").where(F.col(item) != of).groupBy(item).agg(F.countDistinct(owner).alias("n_lists"))


def in_range(points: DataFrame, value: str, ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Points with the first range that holds them (by start, then end), as an equi-join on cells.

    A range lies in the cells of ``width`` that it touches; so ranges far wider than
    ``width`` cost as many rows. Points without a range go.
    """
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    hit = points.withColumn("_cell", F.floor(F.col(value) / width)).join(cells, "_cell").where(F.col(value).between(F.col(start), F.col(end))).drop("_cell")
    return first_by(hit, points.columns, [F.col(start), F.col(end)])


def any_close(left: Column, right: Column, within: int) -> Column:
    """Some pair of two arrays of positions is at most ``within`` apart."""
    return F.exists(left, lambda a: F.exists(right, lambda b: F.abs(a - b) <= within))


def nearest(position: Column, others: Column, within: int, at: str = "start") -> Column:
    """Of an array of structs the one nearest to ``position``, the earlier of equals; null beyond ``within``."""
    near = F.transform(others, lambda x: F.struct(F.abs(x[at] - position).alias("gap"), x[at].alias(at), x.alias("item")))
    return F.array_min(F.filter(near, lambda x: x["gap"] <= within))["item"]


def first_tier(tiers: list[DataFrame], key: list[str]) -> DataFrame:
    """For each key the rows of the first lookup that has any; tiers have equal columns."""
    arms = None
    for i, df in enumerate(tiers):
        arm = df.withColumn("tier", F.lit(i))
        arms = arm if arms is None else arms.unionByName(arm)
    least = F.min("tier").over(Window.partitionBy(*key))
    return arms.withColumn("_least", least).where("tier = _least").drop("_least")


def expanded(rows: DataFrame, a: str, b: str, footprint: DataFrame) -> DataFrame:
    """Rows of lots and rows of buildings, each with all partners of the footprint; pairs once."""
    by_a = rows.where(F.col(a).isNotNull()).drop(b).join(footprint, a)
    by_b = rows.where(F.col(b).isNotNull()).drop(a).join(footprint, b)
    return by_a.unionByName(by_b).dropDuplicates()


def both_ways(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Every pair from both of its ends, at its best score; none with itself."""
    turned = pairs.select(F.col(b).alias(a), F.col(a).alias(b), score)
    return pairs.select(a, b, score).union(turned).where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.max(score).alias(score))


def shared_counts(rows: DataFrame, owner: str, item: str, of: object) -> DataFrame:
    """Per other owner, how many distinct items it shares with one owner."""
    own = rows.where(F.col(owner) == of).select(item).distinct()
    return rows.where(F.col(owner) != of).join(own, item, "left_semi").groupBy(owner).agg(F.countDistinct(item).alias("n_shared"))


def siblings(rows: DataFrame, key: list[str], of: DataFrame) -> DataFrame:
    """Rows of equal key; null in any column matches nothing."""
    return rows.join(of.select(*key).distinct(), key, "left_semi")


def same_value(rows: DataFrame, owner: str, value: str, of: object) -> DataFrame:
    """Every other owner and whether it has the value of one owner; null is like nothing."""
    own = rows.where(F.col(owner) == of).select(F.col(value).alias("_own")).limit(1)
    return rows.where(F.col(owner) != of).crossJoin(F.broadcast(own)).select(owner, F.coalesce(F.col(value) == F.col("_own"), F.lit(False)).alias("same"))


def cited(rows: DataFrame, citations: list[tuple[int, int]], doc: str, page: str) -> DataFrame:
    """The rows of a batch of citations (document, page), each once."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (doc, page))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(sorted(set(citations)), kinds)), [doc, page], "left_semi")
