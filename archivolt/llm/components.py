"""Connected components by alternating large and small stars.

A large star links every larger neighbour of a node to the smallest node it sees; a small
star does so with the node itself and its smaller neighbours. Both keep components, and
after a number of rounds that grows with the square of the logarithm of the nodes at
most, every node is linked to the smallest of its component and to nothing else.

Stars join on a node. The centre of a star is a hot key of the side of the links, which
adaptive execution splits: both sides are written tables behind plain exchanges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Shared

LINK = "a long, b long"
#: Nodes that a task's union-find holds, about.
ROOM = 1 << 20


class Union:
    """Union-find over any integers; the root is the smallest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x] = top
            x = nxt
        return top

    def link(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def forest(links: DataFrame, room: int = ROOM) -> DataFrame:
    """Fewer links with the same components: each task replaces its own by stars, some ``room`` nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Union()
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                own.link(x, y)
            if len(own.up) >= room:
                yield _stars(own)
                own = Union()
        yield _stars(own)

    return links.select("a", "b").mapInArrow(run, LINK)


def _stars(own: Union) -> pa.RecordBatch:
    nodes = list(own.up)
    return pa.RecordBatch.from_arrays([pa.array([own.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def contracted(shared: Shared, links: DataFrame, room: int = ROOM) -> DataFrame:
    """The forests of the tasks, and forests of these, some ``room`` links to a task: what fits into one is settled.

    So the number of tasks follows the links that are left and not the partitions before, and few links need no rounds.
    """
    own = shared.keep(forest(links))
    tasks = max(1, -(-own.count() // room))
    out = forest(own.coalesce(tasks))
    out = shared.keep(out.distinct() if tasks > 1 else out)
    shared.drop(own)
    return out


def _least(near: DataFrame) -> DataFrame:
    """near: node u and neighbour v, the same ones any number of times. Of every u the smallest m of itself and its neighbours; loose, if it is not yet the top of a star or linked to one alone."""
    less = F.when(F.col("v") < F.col("u"), F.col("v"))
    loose = (F.min(less) < F.max(less)) | (F.min(less).isNotNull() & (F.max("v") > F.col("u")))
    return near.groupBy("u").agg(F.min("v").alias("m"), loose.alias("loose")).select("u", F.least("u", "m").alias("m"), "loose")


def components(shared: Shared, links: DataFrame, room: int = ROOM) -> DataFrame:
    """node and component (the smallest node) of every node in links a, b; links to itself count for nothing.

    A round is a large star, a small star, and forests of what tasks hold after each: these
    keep components too and only lower a node's smallest neighbour, so paths whose links
    meet in a task are contracted at once.
    """
    now = contracted(shared, links.where("a <> b"), room)
    while True:
        near = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = shared.keep(_least(near))
        if least.where("loose").isEmpty():
            break
        big = shared.keep(forest(near.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))))
        shared.drop(now, least)
        near = big.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = shared.keep(near.groupBy("u").agg(F.min("v").alias("m")))
        small = near.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("u")))
        now = contracted(shared, small, room)
        shared.drop(big, least)
    # Settled: the smallest of a component is the only neighbour of all its others.
    out = least.select(F.col("u").alias("node"), F.col("m").alias("component"))
    shared.drop(now)
    return out


def as_links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])
