"""Near-duplicate vectors by a robust-pruned flat graph.

Different vectors are dealt into overlapping shards around sampled centroids. In each shard
every vector keeps, of its nearest ones, those that no kept one is much closer to (robust
pruning); the shards' adjacency lists are united. Each vector is then a query in its shards:
greedy search from the shard's medoid and from the vector's own place, which goes on
expanding for as long as it finds vectors in range. What is found is verified in double
precision. A shard too large for one task is dealt into blocks, and each pair of blocks is
a task of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, durable
from .textgrid import tidy

#: Vectors the centroids are fitted on, at most.
SAMPLE = 20_000
SHARD, CAP, MAX_SHARDS = 1000, 8000, 4096
OVERLAP, MARGIN = 4, 0.3
NEAR, CLOSE, DEGREE, BACK, ALPHA, BEAM = 48, 14, 26, 4, 1.2, 24


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose rows have one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def centroids(sample: np.ndarray, k: int, turns: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    x = unit(sample)
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(turns):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = (total * total).sum(1) > 1e-12
        c[some] = unit(total[some])
    return c


@tidy
def _assign(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), 4096):
            part = b.slice(lo, 4096)
            sims = unit(matrix(part.column(1))) @ c.T
            k = min(OVERLAP, sims.shape[1])
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(sims, best, 1)
            row, j = np.nonzero(near >= near[:, :1] - MARGIN)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(best[row, j], pa.int32())], ["node", "shard"])


def robust_prune(x: np.ndarray, i: int, near: np.ndarray) -> list[int]:
    """Of ``near`` (nearest first), those to which no kept one is ALPHA times closer than ``i`` is.

    At most CLOSE of the NEAR nearest are kept, so that some edges always lead further off.
    """
    kept: list[int] = []
    mine = 1 - x[near] @ x[i]
    between = 1 - x[near] @ x[near].T
    open_ = np.ones(len(near), bool)
    for j in range(len(near)):
        if j < NEAR and len(kept) >= CLOSE:
            continue
        if open_[j]:
            kept.append(int(near[j]))
            if len(kept) == DEGREE:
                break
            open_ &= ALPHA * between[j] > mine
    return kept


def build(x: np.ndarray) -> list[list[int]]:
    """Adjacency lists of unit vectors, with an edge back for each."""
    n = len(x)
    out: list[list[int]] = [[] for _ in range(n)]
    if n < 2:
        return out
    # the nearest, and then ever sparser ranks
    ranks = np.unique(np.concatenate([np.arange(min(NEAR, n - 1)), np.minimum((NEAR * 1.25 ** np.arange(1, 30)).astype(int), n - 2)]))
    for lo in range(0, n, 1024):
        sims = x[lo : lo + 1024] @ x.T
        sims[np.arange(len(sims)), lo + np.arange(len(sims))] = -2
        best = np.argsort(-sims, axis=1, kind="stable")[:, ranks]
        for i, near in enumerate(best):
            out[lo + i] = robust_prune(x, lo + i, near)
    # an edge back from each one's first neighbours, or vectors that are nobody's nearest could not be reached
    back: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(out):
        for rank, j in enumerate(near):
            if rank < BACK or len(back[j]) < DEGREE:
                back[j].append(i)
    return [sorted(set(out[i]) | set(back[i])) for i in range(n)]


def range_search(x: np.ndarray, near: list[np.ndarray], i: int, starts: list[int], least: float) -> list[int]:
    """Vectors whose cosine with ``i`` is ``least`` or more, as far as the graph leads to them."""
    q = x[i]
    seen = np.zeros(len(x), bool)
    starts = sorted(set(starts))
    seen[starts] = True
    heap = [(-float(x[s] @ q), s) for s in starts]
    heapq.heapify(heap)
    beam: list[float] = []  # the best similarities so far, least first
    found = []
    for s, j in heap:
        heapq.heappush(beam, -s)
        if -s >= least and j != i:
            found.append(j)
    while heap:
        s, j = heapq.heappop(heap)
        if -s < least and len(beam) >= BEAM and -s < beam[0]:
            break
        new = near[j][~seen[near[j]]]
        if not len(new):
            continue
        seen[new] = True
        for t, v in zip((x[new] @ q).tolist(), new.tolist(), strict=True):
            if t >= least and v != i:
                found.append(v)
            if t >= least or len(beam) < BEAM or t > beam[0]:
                heapq.heappush(heap, (-t, v))
                if len(beam) < BEAM:
                    heapq.heappush(beam, t)
                elif t > beam[0]:
                    heapq.heapreplace(beam, t)
    return found


def _built(table: pa.Table) -> pa.Table:
    node = table.column("node").to_numpy()
    order = np.argsort(node)
    node, x = node[order], unit(matrix(table.column("e")))[order]
    lists = build(x)
    return pa.table({"node": pa.array(node), "near": pa.array([node[a].tolist() for a in lists], pa.list_(pa.int64()))})


def _searched(table: pa.Table, least: float) -> pa.Table:
    node = table.column("node").to_numpy()
    order = np.argsort(node)
    node, raw = node[order], matrix(table.column("e"))[order]
    x = unit(raw)
    lists = table.column("near").combine_chunks()
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    near = []
    for i in order:
        a = flat[ends[i] : ends[i + 1]]
        at = np.minimum(np.searchsorted(node, a), len(node) - 1)
        near.append(at[node[at] == a])
    medoid = int((x @ x.mean(0)).argmax())
    a, b = [], []
    norm = np.sqrt((raw * raw).sum(1))
    for i in range(len(x)):
        # the search's own rounding is allowed for, and what it finds is computed anew
        got = np.array(range_search(x, near, i, [medoid, i], least - 1e-9), int)
        if len(got):
            got = got[(raw[got] @ raw[i]) / (norm[got] * norm[i]) >= least]
            a += [int(node[i])] * len(got)
            b += node[got].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def valid(e):
    """Vectors that can link: not null, no null or non-finite component, not all zero."""
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(e, lambda v: v != 0), F.lit(False))


def scaled(e):
    """The vector times a power of two that keeps its squares and products within a double's range; no cosine changes."""
    top = F.array_max(F.transform(e, F.abs))
    factor = F.when(top < 1e-100, 2.0**600).when(top > 1e100, 2.0**-600).otherwise(1.0)
    return F.transform(e, lambda v: v * factor)


def _block_pairs(block, m: int):
    """Numbers of the tasks in which a block meets each other one."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda o: o != block), lambda o: F.least(o, block) * m + F.greatest(o, block))


def links(vectors: DataFrame, least: float) -> DataFrame:
    """Found links (a, b), a < b, between rows of ``vectors(node, e)``; nodes are unique, vectors differ and have one length."""
    total = vectors.count()
    if not total:
        return vectors.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, total)).select("e").collect()  # a bounded sample
    sample = np.array([r.e for r in sample], float)
    c = centroids(sample, max(1, min(MAX_SHARDS, len(sample), total // SHARD)))
    assigned = vectors.select("node", "e").mapInArrow(lambda it: _assign(it, c), "node long, shard int")
    sizes = assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CAP)
    parts = {r.shard: -(-2 * r.n // CAP) for r in sizes.collect()}  # at most MAX_SHARDS rows
    task = F.array(F.lit(-1))
    for shard, m in parts.items():
        block = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(m)).cast("int")
        task = F.when(F.col("shard") == shard, _block_pairs(block, m)).otherwise(task)
    assigned = durable(assigned.select("node", "shard", F.explode(task).alias("task")))
    placed = assigned.join(vectors.select("node", "e"), "node")
    lists = placed.groupBy("shard", "task").applyInArrow(_built, "node long, near array<bigint>")
    union = durable(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    found = placed.join(union, "node").groupBy("shard", "task").applyInArrow(lambda t: _searched(t, least), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """Every row of ``vectors(vec_id, embedding)`` with its links by cosine of ``least`` or more.

    Equal vectors are searched for once and link with each other. Null or zero vectors, and
    those with null or non-finite components, link with nothing; vectors of any other size,
    near the ends of a double's range too, link by their direction; vectors of different
    lengths do not link with each other. Repeated ids count as vectors of their own; null
    ids stay null and give no component id unless there is no other; an empty table gives no
    rows.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    base = base.select("vec_id", F.when(valid(F.col("e")), scaled(F.col("e"))).alias("e"))
    base = base.withColumn("h", F.when(F.col("e").isNotNull(), F.xxhash64("e")))
    groups = base.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("e").alias("e"))
    groups = durable(groups)
    lengths = [r.d for r in groups.groupBy(F.size("e").alias("d")).count().where("count > 1").orderBy("d").collect()]
    # only vectors of one length can have a cosine; a table has few lengths
    found = durable(reduce(DataFrame.unionByName, [links(groups.where(F.size("e") == d).select(F.col("h").alias("node"), "e"), least) for d in lengths or [0]]))
    root = components(found).dropDuplicates(["node"])
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = ends.join(groups.select(F.col("h").alias("b"), "copies"), "b").groupBy(F.col("a").alias("h")).agg(F.sum("copies").alias("more"))
    known = groups.drop("e").join(root, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h")).drop("node")
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(more, "h", "left")
    known = known.select("h", "component_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = base.select("vec_id", "h").join(known, "h", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def recall(vectors: DataFrame, found: DataFrame, least: float = 0.95, every: int = 100) -> float:
    """Share of true link ends that ``found(vec_id, n_links)`` has, for ids divisible by ``every`` against all rows, in blocks."""
    queries = vectors.where((F.col("vec_id") % every == 0) & valid(F.col("embedding"))).select("vec_id", scaled(F.col("embedding").cast("array<double>")).alias("e"))
    rows = queries.collect()  # the audit's query set
    ids, q = [r.vec_id for r in rows], unit(np.array([r.e for r in rows], float))

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            x = unit(matrix(b.column(0)))
            total += (q @ x.T >= least).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["vec_id", "n"])

    true = vectors.where(valid(F.col("embedding"))).select(scaled(F.col("embedding").cast("array<double>")).alias("e")).mapInArrow(count, "vec_id long, n long")
    true = true.groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    r = true.join(found, "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return 1.0 if not r[0] else r[1] / r[0]
