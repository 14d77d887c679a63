"""Packing of token sequences by non-negative least squares over length combinations.

A document's ids are cut into whole windows and one remainder. Only the histogram of the
remainders' lengths (at most one count per length) reaches the driver; there, shallow
combinations of lengths that nearly fill a window get repeat counts by non-negative least
squares, are rounded down, and what is left is packed greedily. The plan is a table of
ranges "the pieces of length L numbered lo to hi start sequences s.. at offset o", joined
to the numbered pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, gapless
from .textgrid import ALNUM, FOLDED_BYTE, NOT_SPACE, PLAIN_BYTE, PUNCT, Words, chunks, tidy

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"



class WordEncoder:
    """Ids of a text as its words' ids in a row, each word encoded once.

    Words are what stands between blanks: sound for tokenizers whose splitting drops white
    space and never crosses it. Where PROBES show that the tokenizer also splits between
    letters or digits and punctuation, or ignores case, words are cut and folded likewise;
    ``agrees`` tests the whole on given texts. Known words are kept by 64-bit hash in flat
    arrays; when there are more than ``most`` of them, the table starts anew.
    """

    PROBES = (("word.", "word", "."), ("a,b", "a", ",", "b"), ("(x)", "(", "x", ")"), ("it's!", "it's", "!"), ("9%", "9", "%"), ("q...r", "q", "...", "r"), ("don't-go", "don't", "-", "go"), ("x_y", "x", "_", "y"), ("#&*z", "#&*", "z"))

    MARK = "\x01"

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = self.tok.encode(self.MARK, add_special_tokens=False).ids
        self.most = most
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.sides = (ALNUM, PUNCT) if all(ids(p[0]) == [i for w in p[1:] for i in ids(w)] for p in self.PROBES) else None
        folds = all(ids(t) == ids(t.lower()) for t in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "The", "xYz", "RE'S", *map(chr, range(65, 91))))
        self.byte = FOLDED_BYTE if folds else PLAIN_BYTE
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has: many words at a time, with a mark between."""
        plain = [w for w in words if self.MARK not in w] if len(self.mark) == 1 else []
        ids, counts = {}, {}
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        text = f" {self.MARK} "
        for g, e in zip(groups, self.tok.encode_batch_fast([text.join([*g, ""]) for g in groups], add_special_tokens=False), strict=True):
            flat = np.array(e.ids, np.uint32)
            stop = np.flatnonzero(flat == self.mark[0])
            for w, lo, hi in zip(g, np.concatenate([[0], stop[:-1] + 1]).tolist(), stop.tolist(), strict=True):
                ids[w] = flat[lo:hi]
        rest = [w for w in words if w not in ids]
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            ids[w] = np.array(e.ids, np.uint32)
        parts = [ids[w] for w in words]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins in them."""
        g = Words(texts, NOT_SPACE, self.byte, self.sides)
        each, at, back = np.unique(g.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        place = np.searchsorted(self.known, each)
        new = np.ones(len(each), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != each[inside]
        if new.any():
            data = g.data.tobytes()
            words = [data[lo:hi].decode() for lo, hi in zip(g.start[at[new]].tolist(), g.end[at[new]].tolist(), strict=True)]
            ids, count = self._encode_words(words)
            self.known = np.insert(self.known, place[new], each[new])
            self.first = np.insert(self.first, place[new], len(self.flat) + np.cumsum(count) - count)
            self.count = np.insert(self.count, place[new], count)
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.known, each)
        n, first = self.count[place][back], self.first[place][back]
        stop = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[np.repeat(first - stop[:-1], n) + np.arange(stop[-1])]
        return flat, stop[g.at]

    def agrees(self, texts: list[str]) -> bool:
        whole = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        flat, at = self.encode(pa.array(texts, pa.string()))
        return all(list(e.ids) == flat[lo:hi].tolist() for e, lo, hi in zip(whole, at[:-1], at[1:], strict=True))


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if not os.path.exists(tokenizer):
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    coder = WordEncoder(tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    try:
        yield from _cut(batches, coder, end, window)
    finally:  # workers are reused: leave them no larger than they were
        coder._clear()


def _cut(batches: Iterator[pa.RecordBatch], coder: WordEncoder, end: bytes, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for lo, hi in chunks(texts, 1 << 19):
            rows = [[], [], [], [], []]
            flat, at = coder.encode(texts.slice(lo, hi - lo))
            flat = flat.astype("<u4")
            for doc, a, b in zip(doc_ids[lo:hi], at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = b - a + 1
                for s in range(0, n, window):
                    part = flat[a + s : min(b, a + s + window)].tobytes()
                    if s + window >= n:
                        part += end
                    for col, v in zip(rows, (doc, s, len(part) // 4, zlib.crc32(part), n), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def combinations(lengths: np.ndarray, window: int, depth: int = 4, choices: int = 6) -> list[tuple[int, ...]]:
    """Combinations of up to ``depth`` present lengths that nearly fill a window.

    For every length, the best few partners below the space left are tried at each level.
    """
    present = np.sort(lengths)
    out: set[tuple[int, ...]] = set()

    def fill(head: tuple[int, ...], left: int, level: int) -> None:
        k = int(np.searchsorted(present, left, "right"))
        if level == 1 or not k:
            out.add(tuple(sorted((*head, int(present[k - 1])) if k else head, reverse=True)))
            return
        # the last partner should fill the window; the ones before are spread over what fits
        picks = {k - 1} | {int(k * q) for q in np.linspace(0.15, 0.95, choices if level == depth - 1 else 2)}
        for i in sorted(picks):
            fill((*head, int(present[min(i, k - 1)])), left - int(present[min(i, k - 1)]), level - 1)

    for n in present:
        fill((int(n),), window - int(n), depth - 1)
    return sorted(c for c in out if sum(c) <= window)


def non_negative_least_squares(columns: list[tuple[int, ...]], want: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """min |A x - want| with x >= 0 by projected coordinate descent; column j of A counts its lengths."""
    rows = [np.unique(c, return_counts=True) for c in columns]
    norm = [float((n * n).sum()) for _, n in rows]
    rows = [list(zip(v.tolist(), n.tolist(), strict=True)) for v, n in rows]
    x, rest = [0.0] * len(columns), want.astype(float).tolist()
    for _ in range(sweeps):
        for j, entries in enumerate(rows):
            step = max(-x[j], sum(n * rest[v] for v, n in entries) / norm[j])
            if step:
                x[j] += step
                for v, n in entries:
                    rest[v] -= n * step
    return np.array(x)


def plan(hist: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, lo, hi, first sequence, offset) that place every piece of the histogram."""
    left = np.zeros(window + 1, np.int64)
    for n, count in hist.items():
        left[n] = count
    used = np.zeros(window + 1, np.int64)
    ranges: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def lay(combo, times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in combo:
            ranges.append((n, int(used[n]), int(used[n]) + times, sequence, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times

    if left[window]:
        lay((window,), int(left[window]))
    lengths = np.flatnonzero(left)
    if len(lengths):
        combos = combinations(lengths, window)
        x = non_negative_least_squares(combos, left)
        # full windows first, so that rounding never spends a length on a poorer combination
        for j in sorted(range(len(combos)), key=lambda j: (sum(combos[j]) < window - 8, -x[j], combos[j])):
            need = np.unique(combos[j], return_counts=True)
            times = int(min(np.floor(x[j]), (left[need[0]] // need[1]).min()))
            if times > 0 and sum(combos[j]) >= window - window // 64:
                lay(combos[j], times)
    while left.any():
        combo, space, spare = [], window, left.copy()
        while space > 0:
            k = np.flatnonzero(spare[: space + 1])
            if not len(k):
                break
            combo.append(int(k[-1]))
            spare[k[-1]] -= 1
            space -= int(k[-1])
        need = np.unique(combo, return_counts=True)
        lay(combo, int((left[need[0]] // need[1]).min()))
    return ranges


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = 4096) -> DataFrame:
    """Pack every row of ``docs(doc_id, text)`` into sequences of at most ``window`` tokens.

    ``tokenizer`` is a file of the tokenizers library, or a name known to
    ``public_tokenizers``. A null text is empty: its one token is ``end_id``. Repeated rows
    are pieces of their own; null ids stay null; an empty table gives no rows.
    """
    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _pieces(it, tokenizer, end_id, window), PIECES)
    parts = durable(parts.withColumn("uid", F.monotonically_increasing_id()))
    hist = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    # at most a few ranges for each of the window's lengths, however many the pieces
    ranges = spark.createDataFrame(plan(hist, window), "length int, lo long, hi long, first long, offset long")
    placed = gapless(parts, ["length"], "uid", "_rank", sum(hist.values())).join(F.broadcast(ranges), "length").where("_rank >= lo and _rank < hi")
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("_rank") - F.col("lo")).alias("sequence_id"), "offset")
