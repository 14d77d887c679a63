"""Quality classification by a factorisation machine.

A text's features are hashed words (their shares of the text), and statistics of its
structure and size. Pairwise interactions have low rank, so a score takes time linear in the
features: sum over factors of ((sum v x)^2 - sum v^2 x^2) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import packed, unpacked
from .textgrid import Words, chunks, tidy

HASH_BITS = 16
STATS = 20
#: At most so many labelled rows are learnt from.
TRAIN_ROWS = 3000


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray


#: Bytes counted for the structure statistics: name and members.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?", b".,", b"|", b"#$%&*", b"-_=+/\\<>", b"@:;'\"()[]{}~^`",
    b" ", b"\n",
)
_LUTS = [np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in CLASSES]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return (run[offsets[1:]] - run[offsets[:-1]]).astype(float)


def featurize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (text, feature, value) of a chunk, and its dense statistics.

    Words' values are 4 sqrt(count / words); statistics are scaled to about 0 to 1.
    """
    g = Words(texts)
    n = len(g.offsets) - 1
    counts = np.diff(g.at)
    row = np.repeat(np.arange(n), counts)
    key, times = np.unique((row << HASH_BITS) | (g.hash >> np.uint64(64 - HASH_BITS)).astype(np.int64), return_counts=True)
    row, feature = key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)
    value = np.sqrt(times / counts[row]) if len(row) else np.zeros(0)
    size = np.maximum(1, np.diff(g.offsets)).astype(float)
    words = np.maximum(1, counts).astype(float)
    distinct = np.bincount(row, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, times.astype(float))
    length = np.bincount(np.repeat(np.arange(n), counts), (g.end - g.start).astype(float), n) / words
    runs = np.zeros(len(g.data), bool)
    runs[1:] = g.data[1:] == g.data[:-1]
    dense = np.stack(
        [
            *(np.sqrt(_per_text(lut[g.data], g.offsets) / size) for lut in _LUTS),
            np.sqrt(_per_text(g.data >= 128, g.offsets) / size),
            np.sqrt(_per_text(runs, g.offsets) / size),
            distinct / words,
            top / words,
            np.log1p(words) / 10,
            np.log1p(size) / 12,
            np.minimum(length, 20) / 20,
            (words < 5).astype(float),
            np.ones(n),
        ],
        axis=1,
    )
    return row, feature, value, dense


def raw_scores(model: Model, row, feature, value, dense) -> np.ndarray:
    """Log odds of label 1 for each text of a chunk."""
    n, d = len(dense), 1 << HASH_BITS
    w, v = model.weight, model.factor
    linear = np.bincount(row, w[feature] * value, n) + dense @ w[d:]
    pair = np.zeros(n)
    for f in range(v.shape[1]):
        x = v[feature, f] * value
        total = np.bincount(row, x, n) + dense @ v[d:, f]
        square = np.bincount(row, x * x, n) + (dense * dense) @ (v[d:, f] ** 2)
        pair += total * total - square
    return model.bias + linear + pair / 2


def fit(parts: list[tuple], labels: np.ndarray, rank: int = 4, epochs: int = 30, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> Model:
    """Adaptive gradient descent on logistic loss; ``parts`` holds each row's (features, values, statistics)."""
    rng = np.random.default_rng(seed)
    d = (1 << HASH_BITS) + STATS
    params = [np.zeros(d), rng.normal(0, 0.02, (d, rank))]
    bias, bias_sum = 0.0, 1e-8
    sums = [np.full(d, 1e-2), np.full((d, rank), 1e-2)]
    tail = np.arange(1 << HASH_BITS, d)
    rows = [(np.concatenate([f, tail]), np.concatenate([v, s])) for f, v, s in parts]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w, v = params[0][at], params[1][at]
            total = x @ v
            z = bias + x @ w + 0.5 * float((total * total - (x * x) @ (v * v)).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            gw = g * x + decay * w
            gv = g * (x[:, None] * total - (x * x)[:, None] * v) + decay * v
            for p, s, grad in zip(params, sums, (gw, gv), strict=True):
                s[at] += grad * grad
                p[at] -= rate * grad / np.sqrt(s[at])
            bias_sum += g * g
            bias -= rate * g / np.sqrt(bias_sum)
    return Model(float(bias), params[0].astype(np.float32), params[1].astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@tidy
def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in chunks(b.column("text")):
            row, feature, value, dense = featurize(b.column("text").slice(lo, hi - lo))
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("label").slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value, pa.float32())),
                    pa.array(list(dense), pa.list_(pa.float64())),
                ],
                ["label", "f", "v", "s"],
            )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``most`` labelled documents that are not held out, taken by a hash of their id.

    Both classes get up to half of the rows. Rows with a null id, label or text are passed
    over; without any rows the model scores every text 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # at most ``most`` rows, so it may be broadcast
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text").mapInArrow(_sparse, "label int, f array<int>, v array<float>, s array<double>")
    parts, y = [], []
    for r in rows.toLocalIterator():
        parts.append((np.array(r.f, np.int64), np.array(r.v, float), np.array(r.s, float)))
        y.append(r.label)
    order = sorted(range(len(parts)), key=lambda i: (y[i], parts[i][2].tolist(), len(parts[i][0])))
    parts, y = [parts[i] for i in order], np.array([y[i] for i in order], float)
    if not parts:
        d = (1 << HASH_BITS) + STATS
        return Model(0.0, np.zeros(d, np.float32), np.zeros((d, 1), np.float32))
    return fit(parts, y)


@tidy
def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.schema.names.index("text"))
        out = [np.zeros(0)]
        for lo, hi in chunks(texts):
            z = raw_scores(model, *featurize(texts.slice(lo, hi - lo)))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.concatenate(out))], [*names, "score"])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` for every row; whole texts, a null one as empty."""
    cols = docs.select(*(docs[c] for c in keep), docs["text"].cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by HASH_BITS and the rank
    return cols.mapInArrow(lambda it: _score(it, held.value), f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Every row of ``docs`` with held_out, score (0 to 1, higher: better) and predicted.

    Only the text is an input of the score. Null and empty texts get a score too; repeated
    rows get equal scores; a null id is not held out; further columns are ignored.
    """
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that the classifier does not reject, with all their columns.

    Null and empty texts are scored as empty ones, very long texts whole; repeated rows share
    their fate; an empty table gives no rows; columns may have any names.
    """
    model = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs).select("text", "rest")

    def good(batches):
        for b in batches:
            for lo, hi in chunks(b.column(0)):
                part = b.slice(lo, hi - lo)
                z = raw_scores(held.value, *featurize(part.column(0)))
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold))

    return unpacked(rows.mapInArrow(good, rows.schema), docs.columns)
