"""Exact substring removal by grouping of content-anchored strings, in place of prefix doubling.

A suffix array of every byte needs a row for each, doubled round after round. Here nothing is
doubled or sorted: the suffixes are sampled by content first: of each window of SPAN byte positions the one whose
gram hash is least is an anchor, so equal strings of ``length`` bytes have an anchor at the
same place, and a position without an equal anchor is unique at once. The (position, rank)
table then goes through three fixed rounds of growing length, each taking a hash of the longer
string from the text itself, grouping equal ones and dropping positions that became unique:

1. the slice of an anchor, all strings of ``length`` bytes whose anchor it is: they share the
   ``length - SPAN + 1`` bytes from the anchor on, whose rank drops slices that are unique;
2. of slices that share that rank but differ, the strings that start in the same WIDTH
   places before the anchor, which share ``length - WIDTH + 1`` bytes;
3. of those, the single strings.

In each round, pieces whose whole texts are equal too are settled: all but the first repeat.
Ranks are 64-bit hashes; a piece is known by the pair of its common and its whole text's rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, keyed, split_by_keys, stored, without_copies
from .textgrid import chunks, mix, powers, raw, tidy

GRAM = 16
#: Starts that are one piece in round 2.
WIDTH = 8
_A = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_B = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
U = np.uint64


def span_of(length: int) -> int:
    """Positions per anchor window: anchors must lie inside every string of ``length`` bytes."""
    return max(1, (length - GRAM) * 6 // 7)


class Hashes:
    """Rank of any substring of a chunk's bytes, from a prefix sum."""

    def __init__(self, data: np.ndarray, byte: np.ndarray):
        n = len(data)
        p, self.inverse = powers(1 << max(19, int(n).bit_length()))
        self.run = np.zeros(n + 1, U)
        np.cumsum(byte[data] * p[:n], out=self.run[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.run[hi] - self.run[lo]) * self.inverse[lo])

    def all(self, length: int) -> np.ndarray:
        n = len(self.run) - length
        return mix((self.run[length:] - self.run[:n]) * self.inverse[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width], by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def slices(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, starts * span + anchor's place, rank, whole rank) of each anchor's slice in a chunk of texts."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    span = span_of(length)
    h = Hashes(data, _A)
    grams = h.all(GRAM)
    order = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    anchor = (sliding_least(order, span)[: len(data) - length + 1] & U(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    own = np.maximum(0, sizes - length + 1)
    text = np.repeat(np.arange(len(sizes)), own)
    start = np.arange(int(own.sum())) + np.repeat(offsets[:-1] - (np.cumsum(own) - own), own)
    anchor = anchor[start]
    head = np.ones(len(start), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(head)
    lo, a = start[at], anchor[at]
    n = np.diff(np.append(at, len(start)))
    first = h.of(a, a + (length - span + 1))
    second = mix(h.of(lo, lo + n - 1 + length) ^ (n.astype(U) << U(20)) ^ (a - lo).astype(U))
    return text[at], lo - offsets[text[at]], n * span + (a - lo), first, second


@tidy
def _rows(batches: Iterator[pa.RecordBatch], length: int, bits: int, only_rank: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = b.column(0).to_numpy()
        for lo, hi in chunks(b.column(1), 1 << 19):
            text, start, n, first, second = slices(*raw(b.column(1).slice(lo, hi - lo)), length)
            rank = pa.array(first.view(np.int64))
            if only_rank:
                yield pa.RecordBatch.from_arrays([rank], ["k"])
            else:
                yield pa.RecordBatch.from_arrays([rank, pa.array(second.view(np.int64)), pa.array((key[lo:hi][text] << bits) | start), pa.array(n, pa.int32())], ["k", "s", "pos", "nd"])


def pieces(h: Hashes, g: Hashes, at: np.ndarray, nd: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(first start, starts * span + anchor's place, rank, whole rank) of a text's slices cut every ``width`` places before the anchor."""
    span = span_of(length)
    n, d = nd // span, nd % span
    p = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    a = np.repeat(at + d, n)
    q = (a - p) // width
    own = np.repeat(np.arange(len(at)), n)
    head = np.ones(len(p), bool)
    head[1:] = (q[1:] != q[:-1]) | (own[1:] != own[:-1])
    i = np.flatnonzero(head)
    lo, a, q, n = p[i], a[i], q[i], np.diff(np.append(i, len(p)))
    core = a - q * width
    first = mix(h.of(core, core - (width - 1) + length) ^ q.astype(U))
    second = mix(g.of(lo, lo + n - 1 + length) ^ (n.astype(U) << U(20)) ^ (a - lo).astype(U))
    return lo, n * span + (a - lo), first, second


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], length: int, bits: int, width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = b.column(0).to_numpy()
        for i in range(len(b)):
            data, _ = raw(b.column(1).slice(i, 1))
            at = b.column(2).slice(i, 1).flatten().to_numpy().astype(np.int64)
            nd = b.column(3).slice(i, 1).flatten().to_numpy().astype(np.int64)
            lo, more, first, second = pieces(Hashes(data, _A), Hashes(data, _B), at, nd, length, width)
            yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array((int(key[i]) << bits) | lo), pa.array(more, pa.int32())], ["k", "s", "pos", "nd"])


def repeated(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Runs (pos, n) of starts of ``length``-byte strings that also start earlier; pos is key << bits | byte.

    ``docs(key, text)`` with a unique key whose order is the documents'.
    """
    span = span_of(length)
    texts = docs.where(F.octet_length("text") >= length).select("key", "text")
    ranks = texts.mapInArrow(lambda it: _rows(it, length, bits, True), "k long")
    shared = ranks.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    rows = texts.mapInArrow(lambda it: _rows(it, length, bits, False), "k long, s long, pos long, nd int")
    rows = stored(rows.join(shared.hint("shuffle_hash"), "k"))
    found = None
    for width in (WIDTH, 1, 0):
        groups = rows.groupBy("k", "s").agg(F.min("pos").alias("first"), F.min("nd").alias("nd"), F.count(F.lit(1)).alias("c"))
        groups = stored(groups)
        later = rows.join(groups.where("c > 1").select("k", "s", "first"), ["k", "s"]).where("pos <> first").select("pos", (F.col("nd") / span).cast("int").alias("n"))
        found = later if found is None else found.unionByName(later)
        if not width:
            break
        # what shares the common text but not the whole goes on in smaller pieces
        mixed = groups.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("k")
        open_ = groups.join(mixed, "k").select(F.shiftright("first", bits).alias("_key"), F.col("first").bitwiseAND((1 << bits) - 1).alias("at"), "nd")
        lists = durable(open_.groupBy("_key").agg(F.collect_list(F.struct("at", "nd")).alias("l")))  # at most a text's own pieces
        likely, _ = split_by_keys(texts, "key", lists, "_key")
        marked = likely.join(lists, F.col("key") == F.col("_key")).select("key", "text", F.col("l.at").alias("at"), F.col("l.nd").alias("nd"))
        rows = stored(marked.mapInArrow(lambda it, width=width: _pieces(it, length, bits, width), "k long, s long, pos long, nd int"))
    return found


@tidy
def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [[], [], []]
        for i in range(len(b)):
            data, _ = raw(b.column(1).slice(i, 1))
            at = b.column(2).slice(i, 1).flatten().to_numpy()
            n = b.column(3).slice(i, 1).flatten().to_numpy().astype(np.int64)
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n - 1 + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = data[~gone]
            for col, v in zip(out, (len(data) - len(kept), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["_key", "removed", "spans", "sha"])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with the bytes that strings of ``length`` bytes seen earlier cover.

    Earlier is a smaller doc_id, or the same document and an earlier start; null ids come
    first, and rows with equal ids in any one order. Null and empty texts have no bytes.
    Later copies of equal texts of at least ``length`` bytes go whole and are not searched.
    Further columns are ignored.
    """
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    bits = max(1, int(longest).bit_length())
    base = keyed(docs, ["doc_id", "text"], most=1 << (62 - bits))
    texts, copies = without_copies(base)
    runs = repeated(texts, length, bits)
    lists = durable(runs.groupBy(F.shiftright("pos", bits).alias("_key")).agg(F.collect_list(F.struct(F.col("pos").bitwiseAND((1 << bits) - 1).alias("at"), "n")).alias("l")))
    likely, _ = split_by_keys(base.select("key", "text"), "key", lists, "_key")
    cut = likely.join(lists, F.col("key") == F.col("_key")).select("key", "text", F.col("l.at").alias("at"), F.col("l.n").alias("n"))
    cut = cut.mapInArrow(lambda it: _cut(it, length), "_key long, removed long, spans long, sha string")
    text = F.coalesce("text", F.lit(""))
    out = base.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"))
    out = out.join(cut, F.col("key") == F.col("_key"), "left").join(copies.select("copy"), F.col("key") == F.col("copy"), "left")
    whole = F.col("copy").isNotNull() & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    )
