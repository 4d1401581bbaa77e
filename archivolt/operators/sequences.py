"""Folds in order, recursion, queues and budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..sources.shared import Shared
from .windows import running_total


def folded(df: DataFrame, group: str, order: list[str], step: Callable[[Any, dict], tuple[Any, tuple]], schema: str) -> DataFrame:
    """The rows of each group in order through ``step(state, row) -> (state, output row)``; the state is None at first.

    Groups are what runs in parallel. A task reads its sorted rows as a stream and holds one
    state, so a group of any size needs no more memory than another.
    """
    names = [f.strip().split(" ")[0].strip("`") for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[group] != now:
                    now, state = row[group], None
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=kinds)

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def rate_limited(hits: DataFrame, key: str, at: str, most: int, seconds: int) -> DataFrame:
    """(key, at, ok, retry_after) of each hit; windows start at a key's first hit and restart once over. For streams see ``streaming.limits``."""
    span = seconds * 1_000_000

    def step(state: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int], tuple]:
        t = row["_us"]
        reset, n = state if state and state[0] > t else (t + span, 0)
        n = min(n + 1, most + 1)
        wait = 0 if n <= most else max(1, -(-(reset - t) // 1_000_000))
        return (reset, n), (row[key], t, n <= most, wait)

    kind = hits.schema[key].dataType.simpleString()
    rows = hits.select(key, F.unix_micros(F.col(at)).alias("_us"))
    return folded(rows, key, ["_us"], step, f"`{key}` {kind}, _us bigint, ok boolean, retry_after bigint").select(key, F.timestamp_micros("_us").alias(at), "ok", "retry_after")


def packed(items: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """First fit in order: a new shard when the next item would go over ``limit`` and the shard has any."""
    def step(state: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int], tuple]:
        held, shard = state or (0, 0)
        if held > 0 and held + row["_size"] > limit:
            held, shard = 0, shard + 1
        return (held + row["_size"], shard), (row[group], row[order], row["_size"], shard)

    kinds = {c: items.schema[c].dataType.simpleString() for c in (group, order)}
    rows = items.select(group, order, F.col(size).cast("long").alias("_size"))
    return folded(rows, group, [order], step, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, size bigint, shard int")


def within_budget(rows: DataFrame, order: list[str], cost: str, budget: int) -> DataFrame:
    """The rows in order while their costs add up to the budget at most."""
    return running_total(rows, order, cost, "_upto").where(F.col("_upto") <= budget).drop("_upto")


def roots(edges: DataFrame, node: str, parent: str, depth: int = 25, *, capped: bool = False) -> DataFrame:
    """(node, root, depth) by pointer doubling until nothing moves: about log2 of the longest chain joins.

    edges: node and parent, null for a root. A parent that is no node is the root. No chain
    is longer than there are nodes; what moves beyond is on a cycle or leads to one, and gets
    a node of the cycle and ``depth``. capped: O15, no depth above ``depth``.
    """
    shared = Shared(edges.sparkSession)
    now = shared.keep(edges.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"), F.lit(True).alias("moves")))
    n, reach = now.count(), 1
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        more = F.coalesce("more", F.lit(0))
        # A row that did not move has its root.
        moved = now.where("moves").join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("depth") + more).alias("depth"), (more > 0).alias("moves"))
        last, now = now, shared.keep(now.where("not moves").unionByName(moved))
        shared.drop(last)
        if reach >= n or now.where("moves").isEmpty():
            break
        reach *= 2
    own = F.least("depth", F.lit(depth)) if capped else F.col("depth")
    return now.select("node", F.col("up").alias("root"), F.when(F.col("moves"), depth).otherwise(own).alias("depth"))


def claimed(candidates: DataFrame, key: str, group: str, rank: str, quota: int) -> DataFrame:
    """Each key to the first group that lists it, then the best ``quota`` of each group.

    Equal to filling the groups one after another where no key that a full group passed
    over is listed by a later one; such keys do not move on here.
    """
    own = F.row_number().over(Window.partitionBy(key).orderBy(group, rank))
    best = F.row_number().over(Window.partitionBy(group).orderBy(rank, key))
    return candidates.withColumn("_own", own).where("_own = 1").drop("_own").withColumn("_best", best).where(F.col("_best") <= quota).drop("_best")


def newest_answer(answers: DataFrame, question: Column, now: Column, days: int = 30) -> DataFrame:
    """The newest root answer to the same question (case and blanks aside) that is not superseded."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    live = answers.where((norm(F.col("question")) == norm(question)) & F.col("parent_id").isNull() & F.col("superseded_by").isNull() & (F.col("created_at") >= now - F.make_dt_interval(F.lit(days))))
    return live.orderBy(F.desc("created_at"), "id").limit(1)


def merged_pages(boost: DataFrame, found: DataFrame, key: list[str], most: int = 12) -> DataFrame:
    """Boosted pages that were found, then boosted ones that were not, then the rest; each by its rank."""
    b = boost.select(*key, F.col("rank").alias("b"))
    f = found.select(*key, F.col("rank").alias("f"))
    both = b.join(f, key, "full")
    tier = F.when(F.col("b").isNotNull() & F.col("f").isNotNull(), 0).when(F.col("b").isNotNull(), 1).otherwise(2)
    return both.select(*key, tier.alias("tier"), F.coalesce("b", "f").alias("rank")).orderBy("tier", "rank", *key).limit(most)


def queue_state(work: DataFrame, done: DataFrame, key: str, now: Column) -> DataFrame:
    """Each item as done, deferred, error or due: done counts only for the same fingerprint."""
    d = done.select(key, F.col("fingerprint").alias("_f"), F.col("state").alias("_s"), F.col("retry_at").alias("_r"))
    state = F.when(~F.col("_f").eqNullSafe(F.col("fingerprint")), "due").when(F.col("_s") == "done", "done").when(F.col("_r") > now, "deferred").when(F.col("_s") == "error", "error").otherwise("due")
    return work.join(d, key, "left").select(key, "fingerprint", state.alias("state"))


def reused(work: DataFrame, previous: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(key, hash, result, source): kept if the hash is the same and there is a result, else from the cache by hash, else to compute; an older result is not blanked."""
    p = previous.select(key, F.col("hash").alias("_h"), F.col("result").alias("_p"))
    c = cache.where("result is not null").groupBy("hash").agg(F.min("result").alias("_c"))
    out = work.join(p, key, "left").join(c, "hash", "left")
    same = F.col("_h").eqNullSafe(F.col("hash")) & F.col("_p").isNotNull()
    source = F.when(same, "kept").when(F.col("_c").isNotNull(), "cache").when(F.col("_h").isNull(), "new").otherwise("again")
    return out.select(key, "hash", F.when(same, F.col("_p")).otherwise(F.coalesce("_c", "_p")).alias("result"), source.alias("source"))


def page_universe(docs: DataFrame, pages: DataFrame, doc: str, n: str) -> DataFrame:
    """Pages 1..n of every document and those with a status; image_ready says that a page is within n."""
    made = docs.where(F.col(n) > 0).select(doc, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("page"))
    every = made.union(pages.select(doc, F.col("page").cast("int"))).distinct()
    return every.join(docs.select(doc, n), doc, "left").join(pages, [doc, "page"], "left").select(doc, "page", "status", F.coalesce(F.col("page") <= F.col(n), F.lit(False)).alias("image_ready"))


def stored_once(rows: DataFrame, known: DataFrame, content: str) -> DataFrame:
    """New contents, one row each, with a code of their hash."""
    return rows.select(content, F.substring(F.sha2(content, 256), 1, 16).alias("code")).dropDuplicates(["code"]).join(known.select("code"), "code", "left_anti")


def staged(changes: DataFrame, source: DataFrame, key: str, policy: str) -> DataFrame:
    """Refuses the whole stage if a change is incomplete, of another policy, or of a text that has moved on; those applied before go."""
    s = source.select(key, F.col("text_hash").alias("_now"))
    both = changes.join(s, key, "left")
    applied = F.col("_now") == F.col("new_hash")
    bad = F.when(F.col("new_text").isNull(), "incomplete").when(F.col("policy") != policy, "policy").when(~applied & ~F.col("_now").eqNullSafe(F.col("old_hash")), "changed")
    checked = both.withColumn("_bad", bad)
    first = checked.where("_bad is not null").select(key, "_bad").limit(1).collect()
    if first:
        raise ValueError(f"stage refused: {first[0].asDict()}")
    return checked.where(~applied).drop("_bad", "_now")


def current(inventory: DataFrame, build: str) -> DataFrame:
    """An inventory counts only for the build that is published."""
    return inventory.where(F.col("build_id") == build)


def by_release(rows: DataFrame, published: DataFrame, key: str, release: str) -> DataFrame:
    """Rows of a published subset by release; releases without rows have no line."""
    return rows.join(published.select(key), key, "left_semi").groupBy(release).agg(F.countDistinct(key).alias("keys"), F.count("*").alias("n"))


def scoped_pages(arms: list[DataFrame], every: DataFrame, key: list[str], most: int = 12) -> DataFrame:
    """Pages of a place: by the search whose hits they are first (added terms, question, all terms), each by its score; with no hit at all, tested pages first, then by confidence.

    arms: key and score, in order of precedence. every: key, has_test, confidence.
    """
    hits = None
    for i, arm in enumerate(arms):
        one = arm.join(every.select(*key), key, "left_semi").select(*key, F.lit(i).alias("arm"), "score")
        hits = one if hits is None else hits.union(one)
    best = hits.groupBy(*key).agg(F.min(F.struct("arm", (-F.col("score")).alias("s"))).alias("x"))
    found = best.select(*key, F.col("x.arm").alias("arm"), (-F.col("x.s")).alias("score"))
    n = found.agg(F.count("*").alias("_n"))
    rest = every.crossJoin(F.broadcast(n)).where("_n = 0").select(*key, (F.lit(len(arms)) + (~F.coalesce("has_test", F.lit(False))).cast("int")).alias("arm"), F.coalesce("confidence", F.lit(0.0)).alias("score"))
    return found.union(rest).orderBy("arm", F.desc("score"), *key).limit(most)
