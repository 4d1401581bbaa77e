"""Vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.mapped import Mapped, deliver, mapped, pack
from ..sources.shared import Shared

#: Rows of a task, and of a block of the product.
BLOCK = 2048
#: Vectors of a run of the other side, of a file of runs, and pairs whose scores are summed at a time.
RUN, FILE, PAIRS = 4096, 1 << 18, 1 << 18


def chunks(df: DataFrame, text: str, size: int = 3000, overlap: int = 300) -> DataFrame:
    """V1: chunk, start, end and piece: one chunk up to ``size`` characters, else overlapping ones; the last ends the text."""
    step = size - overlap
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(step)) * step)
    out = df.withColumn("start", F.explode(F.sequence(F.lit(0), last.cast("int"), F.lit(step)))).withColumn("end", F.least(F.col("start") + size, n))
    return out.withColumn("chunk", (F.col("start") / step).cast("int")).withColumn("piece", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column, dim: int) -> Column:
    """V2: unit length; another dimension, a non-finite number or length 0 is an error."""
    bad = (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(dot(v, v))
    return F.when(bad | (norm == 0), F.raise_error(F.lit("not a vector of finite numbers"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def nearest_to(df: DataFrame, vector: str, query: list[float], most: int, key: str) -> DataFrame:
    """V3: exact: the highest dot products with one vector, ties by key."""
    score = dot(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return df.withColumn("score", score).orderBy(F.desc("score"), key).limit(most)


def related(df: DataFrame, key: str, vector: str, most: int = 20, block: int = BLOCK) -> DataFrame:
    """For every row the ``most`` others of highest dot product: (key, other, score, rank from 0); exact.

    All vectors are files that executors map, fetched once a machine. The rows are dealt to
    tasks of about ``block`` rows by hash of the key; a task multiplies its rows with one run of
    the files after the other, and holds the best so far. So the work is that of the exact
    all-pairs product, rows are shuffled once, and no pair leaves a task that is not in the result.
    Rows without key have no neighbours and are none; a vector that is null, not finite or of another
    dimension is an error.
    """
    shared = Shared(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    own = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"))
    n, width = own.agg(F.count("*"), F.max(F.length(F.col("k").cast("string")))).first()
    arrow = to_arrow_type(df.schema[key].dataType)
    held = {"string": f"<U{width or 1}", "float": "<f8", "double": "<f8"}.get(kind, "<i8")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                v = _matrix(part.column("v"))
                k = np.array(part.column("k").to_pylist(), held)
                keep = _first_copies(k, v, most + 1)
                raw = pack(k=k[keep], v=v[keep].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([raw], pa.binary())], names=["key", "bytes"])

    names = deliver(shared, own.mapInArrow(packed, "key int, bytes binary"), -(-n // FILE))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        rows = pa.Table.from_batches(some)
        files = mapped(names)
        k = np.array(rows.column("k").to_pylist(), held)
        # All rows of a key are here; those of one key are neighbours in the order.
        order = np.argsort(k, kind="stable")
        k, v = k[order], _matrix(rows.column("v"))[order].astype(np.float64)
        # A key's rows stay in one block: the key's list is taken from all of them.
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + 2 * block, "right")) - 1) if starts[-1] - starts[i] >= 2 * block else len(starts)
            lo, hi = starts[i], starts[j] if j < len(starts) else len(k)
            at, other, score, rank = _best(k[lo:hi], v[lo:hi], files, most)
            yield pa.RecordBatch.from_arrays([pa.array(at.tolist(), arrow), pa.array(other.tolist(), arrow), pa.array(score), pa.array(rank.astype(np.int32))], names=[key, "other", "score", "rank"])
            i = j

    return own.repartition(max(1, -(-n // block)), "k").mapInArrow(best, f"`{key}` {kind}, other {kind}, score double, rank int")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of float32."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths()
    flat = column.flatten()
    dim = sizes[0].as_py() if len(sizes) else 0
    out = flat.to_numpy(zero_copy_only=False)
    if column.null_count or flat.null_count or len(flat) != len(column) * dim or (sizes.to_numpy(zero_copy_only=False) != dim).any() or not np.isfinite(out).all():
        raise ValueError("not vectors of finite numbers and one dimension")
    return out.astype(np.float32, copy=False).reshape(len(column), dim)


def _first_copies(k: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """The rows without those whose vector has ``most`` smaller keys already: they are nobody's neighbours, but for ties that smaller keys win."""
    if len(k) <= most or not v.shape[1]:
        return np.arange(len(k))
    same = np.unique(np.ascontiguousarray(v).view(np.void(b"\0" * (4 * v.shape[1])).dtype).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((k, same))
    g, x = same[order], k[order]
    new = np.append(True, g[1:] != g[:-1])
    step = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])))
    nth = step - np.maximum.accumulate(np.where(new, step, 0))
    return np.sort(order[nth < most])


def _rounded(x: np.ndarray) -> np.ndarray:
    """To nine digits, halves away from zero."""
    v = x * 1e9
    r = np.trunc(v)
    return (r + np.where(np.abs(v - r) >= 0.5, np.sign(v), 0.0)) / 1e9


def _best(ka: np.ndarray, x: np.ndarray, files: list[Mapped], most: int) -> tuple[np.ndarray, ...]:
    """key, other, score and rank of the best of each key; equal keys are neighbours in ka.

    The product, in single precision, tells which pairs may be among the best: all that are not below the last so
    far by more than its error. Their scores are summed in order of the elements, so they depend on the two vectors alone.
    """
    dim = x.shape[1]
    new = np.append(True, ka[1:] != ka[:-1])
    group = np.cumsum(new) - 1
    names = ka[new]
    last = np.full(len(names), -np.inf)
    g, s, o = np.empty(0, np.int64), np.empty(0), np.empty(0, ka.dtype)
    norm, single = np.sqrt((x * x).sum(1)), x.astype(np.float32)
    for f in files:
        k, v = f.arrays["k"], f.arrays["v"]
        if len(v) != len(k) * dim:
            raise ValueError("not vectors of one dimension")
        for at in range(0, len(k), RUN):
            kb = np.asarray(k[at : at + RUN])
            y = np.asarray(v[at * dim : (at + len(kb)) * dim]).reshape(len(kb), dim)
            length = float(np.sqrt(np.einsum("ij,ij->i", y, y, dtype=np.float64).max()))
            # Numbers beyond single precision's range are multiplied in double.
            p = single @ y.T if norm.max() * length < 1e30 else x @ y.T.astype(np.float64)
            by = np.argsort(kb, kind="stable")
            lo, hi = (np.searchsorted(kb, ka, side, sorter=by) for side in ("left", "right"))
            for r in np.flatnonzero(lo < hi).tolist():
                p[r, by[lo[r] : hi[r]]] = -np.inf
            slack = 2e-9 + (dim + 2) * 2.0**-23 * norm * length
            low = last[group]
            new_rows = np.flatnonzero(np.isneginf(low)) if len(kb) > most else []
            if len(new_rows):  # at least so many are as good as the one at that place
                low[new_rows] = np.maximum(low[new_rows], np.partition(p[new_rows], -most, axis=1)[:, -most] - slack[new_rows])
            i, j = np.divmod(np.flatnonzero(p >= (low - slack).astype(p.dtype)[:, None]), len(kb))
            keep = p[i, j] > -np.inf
            i, j = i[keep], j[keep]
            for part in range(0, len(i), PAIRS):
                a, b = i[part : part + PAIRS], j[part : part + PAIRS]
                score = np.zeros(len(a))
                for d in range(dim):
                    score += x[a, d] * y[b, d]
                g, s, o = np.concatenate([g, group[a]]), np.concatenate([s, _rounded(score)]), np.concatenate([o, kb[b]])
                order = np.lexsort((o, -s, g))
                g, s, o = g[order], s[order], o[order]
                keep = np.arange(len(g)) - np.searchsorted(g, g) < most
                g, s, o = g[keep], s[keep], o[keep]
                size = np.bincount(g, minlength=len(names))
                full = np.flatnonzero(size == most)
                last[full] = s[np.cumsum(size)[full] - 1]
    return names[g], o, s, np.arange(len(g)) - np.searchsorted(g, g)


def near_within_top(pairs: DataFrame, key: str, least: float = 0.97) -> DataFrame:
    """V5: pairs of V4 at ``least`` or more, the smaller key first; only from that one's list."""
    return pairs.where((F.col("score") >= least) & (F.col(key) < F.col("other"))).select(key, "other", "score")


def probability(distance: Column, by: list[str]) -> Column:
    """1 less the share of the group's largest distance, from .05 to 1."""
    most = F.max(distance).over(Window.partitionBy(*by))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.when(most > 0, 1 - distance / most).otherwise(1.0)))


def central(df: DataFrame, by: str, vector: str, key: str, most: int) -> DataFrame:
    """Of each group the rows most like its normalised centroid."""
    from .aggregates import mean_vector

    mean = mean_vector(df, [by], vector).withColumnRenamed(vector, "_mean")
    scored = df.join(mean, by).withColumn("score", F.round(dot(F.col(vector), F.col("_mean")), 9)).drop("_mean")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def neighbours_of(df: DataFrame, key: str, vector: str, of: list[object], most: int = 20) -> DataFrame:
    """As ``related``, for some rows alone: their vectors are broadcast, and the table is read once more, whatever their neighbours."""
    own = df.where(F.col(key).isin(of)).select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    scored = df.crossJoin(F.broadcast(own)).where(F.col(key) != F.col("_k")).select(F.col("_k"), F.col(key).alias("other"), F.round(dot(F.col(vector), F.col("_v")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("score"), "other"))
    return scored.withColumn("rank", rank - 1).where(F.col("rank") < most).withColumnRenamed("_k", key)


def pooled_suggestions(saved: DataFrame, pairs: DataFrame, key: str, most: int = 8) -> DataFrame:
    """V8: neighbours of the saved rows (key, place in order), best score first, the earlier saved one on ties; none that is saved."""
    out = pairs.join(saved, key).select(F.col("other").alias("item"), "score", "place")
    out = out.join(saved.select(F.col(key).alias("item")), "item", "left_anti")
    return out.groupBy("item").agg(F.max(F.struct("score", (-F.col("place")).alias("p"))).alias("x")).select("item", F.col("x.score").alias("score"), (-F.col("x.p")).alias("place")).orderBy(F.desc("score"), "place", "item").limit(most)


def clusters(df: DataFrame, vector: str, key: str, k: int | None = None, seed: int = 911, *, held_out: Column | None = None) -> tuple[DataFrame, list[list[float]]]:
    """V9: k-means on the raw vectors: (key, cluster, distance), and the centroids; k from the number of rows.

    held_out: rows that stay out of k-means and are a leaf of their own, with the last number and centroid.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    apart = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    held, df = df.where(apart), df.where(~apart)
    n = df.count() if k is None else 0
    k = k or min(80, max(40, n // 150))
    vectors = lambda x: x.select(key, F.col(vector).cast("array<double>").alias("_v")).withColumn("features", array_to_vector("_v"))
    data = vectors(df)
    model = KMeans(k=k, seed=seed).fit(data)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    made = model.transform(data).withColumnRenamed("prediction", "cluster")
    if held_out is not None and not held.isEmpty():
        from pyspark.ml.stat import Summarizer

        rest = vectors(held)
        made = made.unionByName(rest.withColumn("cluster", F.lit(len(centres))))
        centres.append(list(map(float, rest.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"])))
    table = F.array(*(F.array(*map(F.lit, c)) for c in centres))
    gap = F.zip_with("_v", table[F.col("cluster")], lambda a, b: (a - b) * (a - b))
    return made.select(key, "cluster", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)).alias("distance")), centres


def parents(centres: list[list[float]], most: int = 10, *, held_out: bool = False) -> list[int]:
    """Agglomerative parents of at most 81 centroids, by average linkage of cosine; on the driver.

    held_out: the last centroid joins the parent with the nearest centroid.
    """
    if held_out:
        own, last = np.array(centres[:-1]), np.array(centres[-1])
        out = parents(centres[:-1], most)
        gaps = [float(np.linalg.norm(own[np.array(out) == p].mean(axis=0) - last)) for p in range(max(out) + 1)]
        return [*out, int(np.argmin(gaps))]
    x = np.array(centres)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    groups = [[i] for i in range(len(x))]
    sim = x @ x.T
    while len(groups) > max(1, min(most, max(6, len(x) // 8))):
        best = max(((float(np.mean(sim[np.ix_(a, b)])), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    out = [0] * len(x)
    for g, members in enumerate(groups):
        for m in members:
            out[m] = g
    return out


def more_like_page(pages: DataFrame, vector: str, key: list[str], of: dict[str, object], allowed: DataFrame, pool: int = 50, checked: int = 30, most: int = 6) -> DataFrame:
    """V7: the nearest pages of other documents; the best ``checked`` of the pool that are still allowed, then the first ``most``.

    key: document first. allowed: the keys that may be shown.
    """
    own = pages.where(" and ".join(f"`{k}` = {v!r}" for k, v in of.items())).select(F.col(vector).alias("_q")).limit(1)
    other = pages.where(F.col(key[0]) != of[key[0]]).crossJoin(F.broadcast(own))
    score = F.round(dot(F.col(vector), F.col("_q")), 9)
    near = other.select(*key, score.alias("score")).orderBy(F.desc("score"), *key).limit(pool)
    return near.orderBy(F.desc("score"), *key).limit(checked).join(allowed.select(*key), key, "left_semi").orderBy(F.desc("score"), *key).limit(most)
