"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

1. One scan makes each text's set of word shingles and its sketch. Texts of equal sets
   become one node, named by their smallest doc_id.
2. Bands of the sketch are keys; nodes of equal keys are candidates. All (key, node) rows
   are sorted by range, so that a hot key is dealt to many tasks, and neighbours in the
   order are tied. The components of these ties are clusters: candidates share one.
3. Candidates are verified on full sets inside jobs of at most about BLOCK nodes and ELEMENTS
   shingles, which return only links that join something (fewer than their nodes), never
   pairs. A cluster beyond that is dealt to half blocks by hash, and each job has two
   neighbouring ones, so the work is linear and a group of true copies grows together. Only
   nodes that are still outside the largest component of such a cluster are then held
   against others of it, block by block: this loses no link, as links inside a component
   add nothing. A node goes to a block of outside nodes only if the two share a shingle of
   their prefixes, the shingles that are rarest in the cluster: of two sets as similar as
   asked, both prefixes have one in common. So in a large loose cluster, whose texts share
   a frame and no more, the work stays near linear.
4. Components of the links name the documents to keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Shared, columns, slices, texts
from .components import Union, as_links, components
from .sketch import band_keys, shingles, sketches

#: A pair of similarity 0.8 shares none of 40 bands of 6 coordinates with probability 6e-6, one of 0.85 with 6e-9.
BANDS, ROWS = 40, 6
#: Nodes of a job, and shingles of all its sets, about. A single larger set is a job's as well.
BLOCK, ELEMENTS = 1024, 8 << 20


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (a 128-bit hash of the set) and keys (one per band) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, k) for t in texts(batch)]
            keys = band_keys(sketches(sets, BANDS * ROWS), BANDS, ROWS)
            names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            halves = np.array([(x >> 64, x & 0xFFFFFFFFFFFFFFFF) for x in names], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([row.tobytes() for row in keys], pa.binary())],
                names=["doc_id", "n", "s1", "s2", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys binary")


def ties(shared: Shared, nodes: DataFrame) -> DataFrame:
    """Links a, b that put all nodes of a band key into one component.

    Rows are in order of (key, node) over all tasks. A task ties neighbours of equal key;
    its first and last row, two per task, go over the driver to tie across tasks.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            for i in range(0, len(node), 4096):
                part = keys[i * BANDS : (i + 4096) * BANDS]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.repeat(node[i : i + 4096], BANDS))], names=["key", "node"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        own = Union()
        first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if last is not None and last[0] == key[0]:
                own.link(last[1], int(node[0]))
            at = np.flatnonzero(key[1:] == key[:-1])
            for x, y in zip(node[at].tolist(), node[at + 1].tolist(), strict=True):
                own.link(x, y)
            first = first or (int(key[0]), int(node[0]))
            last = (int(key[-1]), int(node[-1]))
        rows = [(own.root(x), x, None, None) for x in own.up]
        if first:
            rows += [(first[1], last[1], first[0], last[0])]
        a, b, k1, k2 = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(rows), pa.int64()), *(pa.array(x, pa.int64()) for x in (a, b, k1, k2))], names=["task", "a", "b", "k1", "k2"])

    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", "keys").mapInArrow(spread, "key long, node long")
    found = shared.keep(rows.repartitionByRange(n, "key", "node").sortWithinPartitions("key", "node").mapInArrow(neighbours, "task long, a long, b long, k1 long, k2 long"))
    ends = sorted((r["task"], r["a"], r["b"], r["k1"], r["k2"]) for r in found.where("k1 is not null").collect())
    over = [(x[2], y[1]) for x, y in zip(ends, ends[1:], strict=False) if x[4] == y[3]]
    across = spark.createDataFrame(over, "a long, b long")
    return found.where("k1 is null").select("a", "b").union(across).where("a <> b")


def _similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union; exact, for all pairs at once.

    Only shingles of both sides and of two sets at least count; they are columns of 0/1
    matrices, taken some thousands at a time, and the product of these has the sizes of
    all intersections of different sets.
    """
    a, b = np.concatenate(left), np.concatenate(right)
    found, times = np.unique(np.concatenate(list({id(x): x for x in (*left, *right)}.values())), return_counts=True)
    both = np.intersect1d(np.intersect1d(a, b), found[times > 1])
    inter = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets, flat in ((left, a), (right, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))  # the last, where it is none of them
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        sides.append((row[order], at[order]))
    for start in range(0, len(both), 4096):
        part = []
        for (row, at), n in zip(sides, (len(left), len(right)), strict=True):
            lo, hi = np.searchsorted(at, (start, start + 4096))
            m = np.zeros((n, min(4096, len(both) - start)), np.float32)
            m[row[lo:hi], at[lo:hi] - start] = 1
            part.append(m)
        inter += part[0] @ part[1].T
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    inter = inter.astype(np.int64)
    return 100 * inter >= percent * (sizes - inter)


def _pair(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def joined(names: list[int], sets: list[np.ndarray], keys: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of candidates between the rows of left and right that connect something.

    A candidate pair shares a band key and has sizes that allow the similarity.
    """
    n = np.array([len(s) for s in sets], np.int64)
    near = np.zeros((len(left), len(right)), bool)
    for band in range(keys.shape[1]):
        near |= keys[left, band][:, None] == keys[right, band][None, :]
    small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    near &= (100 * small >= percent * large) & (left[:, None] != right[None, :])
    i, j = np.nonzero(near)
    union, out = Union(), []
    some = len(i) > 4 * (len(left) + len(right))
    # Where many pairs are candidates, the rows that have any go into one product.
    if some:
        rows, cols = np.unique(i), np.unique(j)
        yes = _similar([sets[x] for x in left[rows]], [sets[x] for x in right[cols]], percent)
        keep = yes[np.searchsorted(rows, i), np.searchsorted(cols, j)]
        i, j = i[keep], j[keep]
    for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
        a, b = names[x], names[y]
        if a != b and union.root(a) != union.root(b) and (some or _pair(sets[x], sets[y], percent)):
            union.link(a, b)
            out.append((min(a, b), max(a, b)))
    return out


def _jobs(rows: DataFrame, percent: int) -> DataFrame:
    """Links of the jobs; rows: job, side (0 all against all, 1 left, 2 right), node, set and keys."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("node").to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        keys = np.frombuffer(b"".join(x.as_py() for x in table.column("keys")), np.int64).reshape(-1, BANDS)
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        return pa.Table.from_batches([as_links(joined(names, sets, keys, left, right, percent) if len(left) and len(right) else [])])

    return rows.groupBy("job").applyInArrow(run, "a long, b long")


def _prefixes(rest: DataFrame, percent: int) -> DataFrame:
    """cluster, node, mine, out, n (size of the set) and t: of each node the shingles t of its prefix that another node of the cluster has.

    Shingles are in order of their number of nodes in the cluster. A set of n shingles
    shares ceil(percent * n / 100) with one as similar as asked, so the first of these is
    among its first n - ceil(percent * n / 100) + 1. Those that no other node has come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("set")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(c)[i].as_py())) for c in ("cluster", "node")] + [pa.array(own)], names=["cluster", "node", "t"])

    every = rest.select("cluster", "node", "set").mapInArrow(run, "cluster long, node long, t long")
    often = every.groupBy("cluster", "t").agg(F.count("*").alias("f")).where("f > 1")
    shared = every.join(often, ["cluster", "t"]).groupBy("cluster", "node").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("ts"))
    n = (F.length("set") / 8).cast("int")
    length = n - F.ceil(n * F.lit(percent) / 100).cast("int") + 1
    lone = n - F.size("ts")
    prefix = F.slice("ts", 1, F.greatest(length - lone, F.lit(0)))
    return rest.join(shared, ["cluster", "node"]).select("cluster", "node", "mine", "out", n.alias("n"), F.explode(prefix).alias("x")).select("cluster", "node", "mine", "out", "n", "x.t")


def links(shared: Shared, docs: DataFrame, nodes: DataFrame, percent: int, k: int, block: int, elements: int) -> DataFrame:
    """Verified links between nodes; their components are those of all links."""
    cluster = shared.keep(components(shared, ties(shared, nodes)))
    known = cluster.join(nodes.select("node", "n", "keys"), "node")
    sizes = known.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    # Half blocks of a cluster: one if it fits a job.
    jobs = F.greatest(F.col("m") / block, F.col("w") / elements)
    own = known.join(sizes, "component").select("node", "keys", F.col("component").alias("cluster"), F.when(jobs <= 1, 1).otherwise(F.ceil(jobs * 2)).cast("int").alias("parts"))
    own = own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            sets = [shingles(t, k).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "cluster", "parts", "part", "keys")), pa.array(sets, pa.binary())], names=["node", "cluster", "parts", "part", "keys", "set"])

    full = docs.join(own, F.col("doc_id") == F.col("node")).select("node", "cluster", "parts", "part", "keys", "text")
    full = shared.keep(full.mapInArrow(run, "node long, cluster long, parts int, part int, keys binary, set binary"))
    job = lambda *c: F.struct(F.col("cluster"), *c)
    # A half block goes to its own job and to the one before, which has both.
    before = F.when(F.col("parts") > 2, F.array(F.col("part"), F.pmod(F.col("part") - 1, F.col("parts")))).otherwise(F.array(F.lit(0)))
    near = full.withColumn("at", F.explode(before)).select(job("at").alias("job"), F.lit(0).alias("side"), "node", "set", "keys")
    found = shared.keep(_jobs(near, percent))
    big = full.where("parts > 2")
    if big.isEmpty():
        return found
    # Nodes outside the largest component of a large cluster, against others of it.
    now = shared.keep(components(shared, found))
    placed = big.select("node", "cluster").join(now, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))
    largest = placed.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("x"), F.sum("n").alias("m"))
    largest = largest.select("cluster", (-F.col("x.c")).alias("main"), F.col("m"), F.col("x.n").alias("inside"))
    out = placed.join(largest, "cluster").where("m > inside").select("node", "m", "inside", (F.col("component") != F.col("main")).alias("out"))
    # Blocks of outside nodes are as large, on average, as the half blocks are.
    apart = F.ceil((F.col("m") - F.col("inside")) * F.col("parts") / F.col("m")).cast("int")
    rest = shared.keep(big.join(out, "node").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), apart).cast("int")).drop("m", "inside"))
    prefixes = shared.keep(_prefixes(rest, percent))
    asked = prefixes.where("out").select("cluster", "t", F.col("mine").alias("at")).distinct()
    meets = shared.keep(prefixes.select("cluster", "node", "n", "t").join(asked, ["cluster", "t"]).select("cluster", "node", "n", "at").distinct())
    # What meets a block of outside nodes is dealt to jobs of half a block, and the block goes to each of these.
    deal = meets.groupBy("cluster", "at").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / elements) * 2).cast("int").alias("others"))
    every = rest.join(meets.join(deal, ["cluster", "at"]).drop("n"), ["cluster", "node"]).withColumn("other", F.pmod(F.xxhash64("node", F.lit(2)), F.col("others")).cast("int"))
    every = every.select(job(F.col("at").alias("mine"), "other").alias("job"), F.lit(2).alias("side"), "node", "set", "keys")
    lone = rest.where("out").join(deal.withColumnRenamed("at", "mine"), ["cluster", "mine"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return found.union(_jobs(lone.select(job("mine", "other").alias("job"), F.lit(1).alias("side"), "node", "set", "keys").union(every), percent))


def near_dedup(docs: DataFrame, *, percent: int = 80, k: int = 5, block: int = BLOCK, elements: int = ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked if 100 * |A and B| >= percent * |A or B| of their sets of k-word
    shingles (A-Z lower-cased, words parted by ASCII blanks; a text of fewer words is one
    shingle). component_id is the smallest doc_id reachable, kept says that it is the own.
    Texts without words, null among them, have empty sets and are linked with nothing.
    Rows of one doc_id are one document; each keeps its own n_shingles. Rows without
    doc_id link nothing: component_id null, kept. An empty table gives an empty table.
    """
    shared = Shared(docs.sparkSession)
    src = columns(docs, "doc_id", "text")
    rows = shared.keep(signatures(src, k))
    named = rows.where("doc_id is not null and n > 0")
    nodes = shared.keep(named.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "keys", "n")).alias("x"), F.count("*").alias("copies")).select("s1", "s2", F.col("x.doc_id").alias("node"), F.col("x.keys").alias("keys"), F.col("x.n").alias("n"), "copies"))
    # Sets of one doc_id belong together: the id is linked with the node of each.
    several = named.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).where("lo <> hi").select("doc_id")
    tied = named.join(several, "doc_id").join(nodes.select("s1", "s2", "node"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = links(shared, src.where("doc_id is not null"), nodes, percent, k, block, elements).union(tied)
    comps = shared.keep(components(shared, found))
    # Only sets with copies or links differ from their own doc_id.
    moved = shared.keep(nodes.select("s1", "s2", "node", "copies").join(comps, "node", "left").where("copies > 1 or component is not null").select("s1", "s2", F.coalesce("component", "node").alias("component")))
    out = rows.select("doc_id", "n", "s1", "s2").join(moved, ["s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
