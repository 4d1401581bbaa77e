"""Sharding: vector bin packing of bytes, tokens and rows.

Items are groups of equal texts; only a group above a shard's even share is split, by rows.
Packing has two steps of one kind. Tasks that each have some of the items, dealt by hash,
put every item into the task's own bin where the dot product of its vector with the
residual capacity is highest. Then the driver puts the bins of all tasks and the few items
that are large against a shard, a bounded number whatever the input, into shards by the
same rule, the largest first. Bins are of falling capacity, so the small ones even out at
the end what the large ones leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Shared, columns

#: What counts as a token: a run without white space, or a letter of a script that is written without blanks.
_SOLID = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
WORD = rf"[{_SOLID}]|[^\p{{IsWhite_Space}}{_SOLID}]+"
#: Tasks that pack at most. Bins of a task: for each shard one of each level, a level's having 1/FALL of the capacity of one of the level before.
PACKERS, LEVELS, FALL = 512, 6, 3.0
#: An item above 1/LARGE_PARTS of a shard in some dimension is placed by the driver; there are fewer than 3 * shards * LARGE_PARTS.
LARGE_PARTS = 16
#: Items that a task sorts and packs at a time.
BATCH = 1 << 16
DIMS = ("bytes", "tokens", "rows")
#: Weight of each dimension in the dot product: the law is about bytes, the others follow where they can.
WEIGHTS = (16.0, 1.0, 1.0)


def place(items: np.ndarray, left: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The bin of each item (rows, in shares); ``left`` (bins by dimension) is the residual capacity and is brought down.

    The largest item first, by its largest dimension; each into the bin where the weighted
    dot product with the residual is highest, the lower bin among equals. Residuals may
    fall below 0.
    """
    out = np.empty(len(items), np.int64)
    weighted = items * np.array(weights)
    for i in np.argsort(-items.max(axis=1, initial=0), kind="stable").tolist():
        best = int((left @ weighted[i]).argmax())
        left[best] -= items[i]
        out[i] = best
    return out


def pack(items: list[tuple[int, tuple[float, ...]]], shards: int, weights: tuple[float, ...] = WEIGHTS) -> dict[int, int]:
    """Shard of each item (key, vector); among items of one size the lower key first.

    Capacity is the even share of each dimension; vectors are measured in shares, so
    no dimension outweighs another by its unit.
    """
    if not items:
        return {}
    items = sorted(items)
    v = np.array([x for _, x in items], float)
    share = v.sum(axis=0) / shards
    where = place(v / np.where(share > 0, share, 1.0), np.ones((shards, v.shape[1])), weights)
    return dict(zip((k for k, _ in items), where.tolist(), strict=True))


def packed(items: DataFrame, shards: int, totals: tuple[int, ...]) -> DataFrame:
    """The items (h, part and DIMS) with their task and bin, packed where they lie.

    A task takes BATCH items at a time, and its bins' capacity grows by what these have in
    all; so its memory is bounded, and bins are full whatever the number of items.
    """
    sizes = np.repeat(FALL ** -np.arange(LEVELS), shards)
    sizes /= sizes.sum()
    share = np.array([t / shards or 1.0 for t in totals])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        left = np.zeros((len(sizes), len(DIMS)))
        for batch in _batches(batches):
            v = np.stack([batch.column(d).to_numpy() for d in DIMS], axis=1) / share
            left += sizes[:, None] * v.sum(axis=0)
            n = len(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "part", *DIMS)), pa.array(np.full(n, task), pa.int32()), pa.array(place(v, left), pa.int32())], names=["h", "part", *DIMS, "task", "bin"])

    return items.select("h", "part", *DIMS).mapInArrow(run, "h long, part int, bytes long, tokens long, rows long, task int, bin int")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shard(docs: DataFrame, *, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size: UTF-8 bytes of the text (null: none) plus overhead. The law is ``bytes``:
    sizes of shards are near equal; so are tokens (words by ``WORD``, none in an empty text) and rows, as far
    as the groups allow. Equal texts share a shard, but a group above a shard's even
    share in some dimension is split by rows into as many parts for every shard. slot
    counts the rows of a shard from 0 by doc_id, nulls first; repeated ids get
    neighbouring slots. A null text is a group with the empty text. An empty table gives
    an empty table. grown_shard is null: another number of shards packs anew.

    Texts are read once; what is shuffled is a row per group, and the digest columns, once
    to meet the group's bin and once for the slots. A hot shard or group is dealt to many
    tasks: rows meet bins in a join that splits skewed keys, order is by (shard, doc_id)
    over all, and slots come from counts per task.
    """
    spark = docs.sparkSession
    shared = Shared(spark)
    text = F.coalesce("text", F.lit(""))
    rows = shared.keep(
        columns(docs, "doc_id", "text").select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        )
    )
    sums = (F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = shared.keep(rows.groupBy("h").agg(*sums))
    totals = tuple(groups.agg(*(F.coalesce(F.sum(d), F.lit(0)) for d in DIMS)).first())
    share = F.greatest(*(F.col(d) * F.lit(float(shards)) / F.lit(float(t or 1)) for d, t in zip(DIMS, totals, strict=True)))
    # Groups above a share: fewer than 3 * shards. As many parts for every shard, of at most half a share.
    split = spark.createDataFrame([(r["h"], shards * (int(2 * r["share"] / shards) + 1)) for r in groups.select("h", share.alias("share")).where("share > 1").collect()], "h long, parts int")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).cast("int"), F.lit(0))
    placed = rows.join(F.broadcast(split), "h", "left").withColumn("part", part).drop("parts")
    some = rows.join(F.broadcast(split), "h").withColumn("part", part).groupBy("h", "part").agg(*sums)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = groups.join(F.broadcast(split), "h", "left_anti").select("h", F.lit(0).alias("part"), *DIMS).unionByName(some)
    items = shared.keep(items.withColumn("large", share > 1 / LARGE_PARTS))
    bins = shared.keep(packed(items.where("not large").repartition(min(n, PACKERS), "h", "part"), shards, totals))
    large = items.where("large").sort("h", "part").collect()
    full = bins.groupBy("task", "bin").agg(*(F.sum(d).alias(d) for d in DIMS)).collect()
    per = shards * LEVELS
    where = pack([(-1 - i, tuple(float(r[d]) for d in DIMS)) for i, r in enumerate(large)] + [(r["task"] * per + r["bin"], tuple(float(r[d]) for d in DIMS)) for r in full], shards)
    target = spark.createDataFrame([(k // per, k % per, s) for k, s in sorted(where.items()) if k >= 0], "task int, bin int, shard int")
    alone = spark.createDataFrame([(r["h"], r["part"], where[-1 - i]) for i, r in enumerate(large)], "h long, part int, shard int")
    of = bins.join(F.broadcast(target), ["task", "bin"]).select("h", "part", "shard").unionByName(alone)
    dealt = placed.join(of, ["h", "part"]).select("doc_id", "size", "text_crc32", "shard")
    dealt = shared.keep(dealt.repartitionByRange(n, "shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32").withColumn("at", F.monotonically_increasing_id()))
    shared.drop(rows, groups, items, bins)
    # at: task in the high bits, row within it in the low; tasks follow the order.
    task = F.shiftright("at", 33)
    runs = sorted(tuple(r) for r in dealt.groupBy("shard", task.alias("task")).agg(F.min("at").alias("low"), F.count("*").alias("n")).collect())
    before, at = [], {}
    for s, t, low, count in runs:
        before.append((s, t, at.get(s, 0) - low))
        at[s] = at.get(s, 0) + count
    offsets = spark.createDataFrame(before, "shard int, task long, offset long")
    return dealt.withColumn("task", task).join(F.broadcast(offsets), ["shard", "task"], "left").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("offset")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
