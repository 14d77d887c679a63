"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. MinHash bands deal them into buckets. Pairs in small
buckets are all candidates. For the classes, a large bucket is compared with pivots, one
after the other, and only across the components found so far, so a group of n near copies
costs about n comparisons a round. For the number of links, all pairs of the texts that
large buckets connect are compared in pairs of blocks, which give counts and no pair rows.
A candidate pair's MinHash values are compared a block at a time and it is dropped when the
posterior probability of reaching the threshold is below the tolerance; what is left is
verified on the exact shingle sets.

Texts are told apart by a 64-bit hash: with n different texts some two are confused with
probability n^2 / 2^65 (1e-9 for a hundred thousand).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import PART_ROWS, components, durable, split_by_keys, stored
from .textgrid import Words, chunks, mix, tidy

BANDS, ROWS = 36, 7
HASHES = BANDS * ROWS
#: Largest bucket whose pairs are all candidates; larger ones go by pivots, so many times beyond the first.
SMALL, PIVOTS = 8, 1
#: Texts of a block, and bytes of their shingle sets; a task takes one block or two.
TASK, TASK_BYTES = 2048, 1 << 26
BLOCK = 36
_rng = np.random.default_rng(90210)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their MinHash values)."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), HASHES), np.uint32)
    if len(full):
        x = (grams >> np.uint64(32)).astype(np.uint32)
        buffer = np.empty_like(x)
        for i in range(HASHES):
            np.bitwise_xor(x, _XOR[i], out=buffer)
            np.multiply(buffer, _MUL[i], out=buffer)
            out[:, i] = np.minimum.reduceat(buffer, bounds[full])
    return full, out


def _low(sigs: np.ndarray) -> np.ndarray:
    """A byte of each MinHash value: equal ones stay equal, and one in 256 of the others become so, which prunes a little less."""
    return (sigs & np.uint32(0xFF)).astype(np.uint8)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text and band; its last six bits are the band's number."""
    s = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
    return (key & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)


@tidy
def _bands(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node = b.column(0).to_numpy()
        for lo, hi in chunks(b.column(1)):
            full, sigs = signatures(*Words(b.column(1).slice(lo, hi - lo)).grams(shingle))
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sigs).view(np.int64).ravel()), pa.array(np.repeat(node[lo:hi][full], BANDS))], ["band", "node"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node = b.column(0).to_numpy()
        for lo, hi in chunks(b.column(1)):
            grams, bounds = Words(b.column(1).slice(lo, hi - lo)).grams(shingle)
            full, sigs = signatures(grams, bounds)
            sets = [np.unique(grams[bounds[i] : bounds[i + 1]]).tobytes() for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][full]), pa.array([s.tobytes() for s in _low(sigs)], pa.binary()), pa.array(sets, pa.binary())], ["node", "sig", "grams"])


@lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For 1, 2 ... blocks: the fewest matches at which a pair stays.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BLOCK, HASHES + 1, BLOCK):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Rows at which two matrices of MinHash values stay candidates, a block of values at a time."""
    open_, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(k * BLOCK, (k + 1) * BLOCK)
        matches = matches + (a[open_, part] == b[open_, part]).sum(1)
        open_, matches = open_[matches >= least], matches[matches >= least]
    return open_


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(len(sigs), HASHES)


@tidy
def _prune(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["a", "b"]).take(pa.array(survivors(_matrix(b.column(2)), _matrix(b.column(3)), threshold, tolerance)))


def _cross(table: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """Links across components in one block; minor members are in every block, and meet each other in the first.

    Only pairs that share a bucket are looked at, each once.
    """
    node, comp, major = (table.column(c).to_numpy() for c in ("node", "comp", "major"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(node), HASHES)
    sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in table.column("grams").combine_chunks()]
    least = least_matches(threshold, tolerance)
    own_block = table.column("block")[0].as_py() == 0
    a, b, j = [], [], []
    for i in np.flatnonzero(comp != major):
        others = np.flatnonzero((comp == major) | ((node > node[i]) & (comp != comp[i]) if own_block else False))
        same = sig[others] == sig[i]
        meet = same.reshape(len(others), BANDS, ROWS).all(2).any(1)
        others, same = others[meet], same[meet]
        matches = np.zeros(len(others), np.int64)
        for k, need in enumerate(least):
            matches += same[:, k * BLOCK : (k + 1) * BLOCK].sum(1)
            others, same, matches = (v[matches >= need] for v in (others, same, matches))
        for o in others:
            similarity = jaccard(sets[i], sets[o])
            if similarity >= threshold:
                a.append(min(node[i], node[o]))
                b.append(max(node[i], node[o]))
                j.append(similarity)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "jaccard": pa.array(j, pa.float64())})


def _degrees(table: pa.Table, threshold: float, tolerance: float) -> pa.Table:
    """(node, more): copies of the texts that each one links with, within one block or between the sides of two.

    Only pairs that share a bucket are looked at, each once.
    """
    node, side, copies = (table.column(c).to_numpy() for c in ("node", "side", "copies"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(node), HASHES)
    bands = np.zeros((len(node), BANDS, 8), np.uint8)
    bands[:, :, :ROWS] = sig.reshape(len(node), BANDS, ROWS)
    bands = bands.view(np.uint64)[:, :, 0]
    sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in table.column("grams").combine_chunks()]
    sizes = np.array([len(g) for g in sets])
    all_grams, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(ids.astype(np.int32), np.cumsum(sizes)[:-1])
    own = np.zeros(len(all_grams), np.int32)
    least = least_matches(threshold, tolerance)
    two = table.column("x")[0].as_py() != table.column("y")[0].as_py()
    more = np.zeros(len(node), np.int64)
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        others = right if two else np.arange(i + 1, len(node))
        others = others[(bands[others] == bands[i]).any(1)]
        if not len(others):
            continue
        same = sig[others] == sig[i]
        matches = np.zeros(len(others), np.int64)
        for k, need in enumerate(least):
            matches += same[:, k * BLOCK : (k + 1) * BLOCK].sum(1)
            others, same, matches = (v[matches >= need] for v in (others, same, matches))
        if not len(others):
            continue
        own[sets[i]] = 1
        at = np.cumsum(sizes[others]) - sizes[others]
        both = np.add.reduceat(own[np.concatenate([sets[o] for o in others])], at)
        own[sets[i]] = 0
        linked = others[both / (sizes[i] + sizes[others] - both) >= threshold]
        more[i] += copies[linked].sum()
        more[linked] += copies[i]
    return pa.table({"node": pa.array(node, pa.int64()), "more": pa.array(more, pa.int64())})


def jaccard(p: np.ndarray, q: np.ndarray) -> float:
    """Of two sets as sorted arrays."""
    if len(p) > len(q):
        p, q = q, p
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return both / (len(p) + len(q) - both)


@tidy
def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, j = [], [], []
        x, y, ga, gb = (batch.column(i) for i in range(4))
        for i in range(len(batch)):
            p, q = np.frombuffer(ga[i].as_buffer(), np.uint64), np.frombuffer(gb[i].as_buffer(), np.uint64)
            similarity = jaccard(p, q)
            if similarity >= threshold:
                a.append(x[i].as_py())
                b.append(y[i].as_py())
                j.append(similarity)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j, pa.float64())], ["a", "b", "jaccard"])


def node_of(text="text"):
    """A text's identity; null for a null text."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def text_links(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, jaccard) between different texts, a < b, by node_of(text), and large groups (node, root, sig, grams).

    Links are complete but for pairs within one large group (texts that buckets of more than
    SMALL connect), where they are enough to connect what is connected. A text of fewer words
    than a shingle, but not none, is one shingle.
    """
    texts = docs.where("text is not null").select(node_of().alias("node"), "doc_id", F.col("text").cast("string").alias("text"))
    bands = stored(texts.select("node", "text").mapInArrow(lambda it: _bands(it, shingle), "band long, node long"))
    shared = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band")
    members = durable(bands.join(shared, "band").distinct())
    rows = members.count()
    members = members.coalesce(rows // PART_ROWS + 4)
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"))
    # buckets with the same members give the same pairs: one of each will do
    need = members.select("node").distinct()
    one = texts.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    need = need.join(one, "node")
    wanted = need.withColumnsRenamed({"node": "_n", "doc_id": "_d"})
    likely, _ = split_by_keys(texts, "node", wanted, "_n")
    sets = likely.join(wanted, (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    sets = stored(sets.select("node", "text").mapInArrow(lambda it: _sets(it, shingle), "node long, sig binary, grams binary").dropDuplicates(["node"]))

    def both(pairs: DataFrame, column: str, alias: str) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col(column).alias(f"{alias}a"))
        right = sets.select(F.col("node").alias("b"), F.col(column).alias(f"{alias}b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", f"{alias}a", f"{alias}b")

    def exact(pairs: DataFrame) -> DataFrame:
        return both(pairs, "grams", "g").mapInArrow(lambda it: _verify(it, threshold), "a long, b long, jaccard double")

    def verified(pairs: DataFrame) -> DataFrame:
        return exact(both(pairs, "sig", "s").mapInArrow(lambda it: _prune(it, threshold, tolerance), "a long, b long"))

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    few = members.join(sizes.where(F.col("n") <= SMALL).select("band"), "band")
    many = members.join(sizes.where(F.col("n") > SMALL).select("band", "pivot"), "band")
    mates = few.join(few.withColumnRenamed("node", "other"), "band").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    tested = durable(mates.unionByName(many.where("node <> pivot").select(*pair("node", "pivot"))).distinct(), rows)
    links = durable(verified(tested), 25 * rows)  # its tasks hold sets, so they get fewer rows
    large = durable(many.where("node <> pivot").select("band", "node"), rows)  # a pivot has met all of its bucket

    def parted(large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of the buckets that hold several components, and those buckets' sizes and largest component."""
        comp = components(links).dropDuplicates(["node"]).withColumnsRenamed({"node": "_n", "root": "_r"})
        labelled = durable(large.join(comp, F.col("node") == F.col("_n"), "left").select("band", "node", F.coalesce("_r", "node").alias("comp")), rows)
        parts = labelled.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
        parts = parts.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "comp"))["comp"].alias("major")).where("parts > 1")
        return labelled.join(parts.select("band", "n", "major"), "band").drop("parts"), parts

    for turn in range(PIVOTS):
        open_, _ = parted(large)
        chosen = open_.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp")).alias("p")).select("band", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pc"))
        meet = durable(open_.join(chosen, "band"), rows)
        pairs = durable(meet.where("comp <> pc").select(*pair("node", "pivot")).distinct().join(tested, ["a", "b"], "left_anti"), rows)
        links = durable(links.unionByName(verified(pairs)), 25 * rows)
        tested = tested.unionByName(pairs)
        large = meet.where("node <> pivot").select("band", "node")  # a pivot has met all of its bucket

    # the rest: whatever is not in the largest component of the texts that buckets connect meets all others there
    open_, _ = parted(large)
    heads = open_.groupBy("band").agg(F.min("node").alias("head"))
    reach = components(open_.join(heads, "band").select("node", "head").distinct(), "node", "head").dropDuplicates(["node"]).withColumnsRenamed({"node": "_n"})
    nodes = durable(open_.select("node", "comp").distinct().join(reach, F.col("node") == F.col("_n"), "left").select("node", "comp", F.coalesce("root", "node").alias("root")), rows)
    parts = nodes.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("root").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp"))["comp"].alias("major"))
    m = F.ceil(F.col("n") / TASK).cast("int")
    block = F.when(F.col("comp") == F.col("major"), F.array(F.pmod(F.xxhash64("node"), m).cast("int"))).otherwise(F.sequence(F.lit(0), m - 1))
    dealt = nodes.join(parts, "root").select("root", "node", "comp", "major", F.explode(block).alias("block")).join(sets, "node")
    rest = dealt.groupBy("root", "block").applyInArrow(lambda t: _cross(t, threshold, tolerance), "a long, b long, jaccard double")
    links = durable(links.unionByName(rest).distinct(), rows)
    group = components(many.where("node <> pivot").select("node", "pivot").distinct(), "node", "pivot").dropDuplicates(["node"])
    return links, durable(group, rows).join(sets, "node")


def group_degrees(groups: DataFrame, copies: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, more): copies of the other texts of its large group that each one links with."""
    rows = groups.join(copies.select("node", "copies"), "node")
    m = F.ceil(F.greatest(F.count(F.lit(1)) / TASK, F.sum(F.length("grams")) / TASK_BYTES)).cast("int").alias("m")
    own, other = F.col("own"), F.col("other")
    rows = rows.join(groups.groupBy("root").agg(m), "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("root", F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), (own > other).cast("int").alias("side"), "node", "copies", "sig", "grams")
    found = dealt.groupBy("root", "x", "y").applyInArrow(lambda t: _degrees(t, threshold, tolerance), "node long, more long")
    return found.groupBy("node").agg(F.sum("more").alias("more"))


def classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, tolerance: float = 1e-4, count_links: bool = True) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its class and links (``count_links=False``: without n_links, which takes no part in the classes).

    class_id is the smallest doc_id connected by links, n_links the number of other documents
    linked directly: those with the same text and, by verified similarity, with another, in
    groups of every size. Null texts link with nothing; equal texts link with each other, empty ones too; repeated rows are documents of their
    own; null ids stay null and give no class id unless a class has no other.
    """
    links, groups = text_links(docs, threshold, shingle, tolerance)
    base = docs.select("doc_id", node_of().alias("node"))
    known = base.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    root = components(links).dropDuplicates(["node"])
    known = durable(known.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = known.groupBy("root").agg(F.min("least").alias("class_id"))
    own = F.coalesce("class_id", "doc_id")
    if not count_links:
        out = base.join(known.join(smallest, "root").select("node", "class_id"), "node", "left")
        return out.select("doc_id", own.alias("class_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
    # pairs within one large group are counted there
    of = groups.select("node", "root")
    apart = links.join(of.toDF("a", "ra"), "a", "left").join(of.toDF("b", "rb"), "b", "left").where(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)))
    ends = apart.select("a", "b").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = ends.join(known.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("more"))
    degree = degree.unionByName(durable(group_degrees(groups, known, threshold, tolerance))).groupBy("node").agg(F.sum("more").alias("more"))
    known = known.join(smallest, "root").join(degree, "node", "left").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = base.join(known, "node", "left")
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("doc_id").eqNullSafe(own).alias("kept"))
