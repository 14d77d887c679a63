"""Runs (maximal periodicities) of words, after Kolpakov and Kucherov.

The text is factorised from its suffix automaton: each factor is the longest piece that also
begins earlier, or one new word. A run either touches the beginning of a factor, and Main's
algorithm finds it there from common extensions on both sides; or it lies strictly inside a
factor and is copied from the factor's earlier occurrence.

A run of at least four periods and six words repeats each of its five-word pieces one period
on. Words that no repeated five-word piece covers are therefore in no run, and texts are first
cut down to the stretches that such pieces cover; that loses nothing, at whatever size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textgrid import NOT_SPACE, PLAIN_BYTE, U64, Words, chunks, mix, tidy

#: Words of the pieces that a run of LEAST words and PERIODS periods must repeat.
PIECE, LEAST, PERIODS = 5, 6, 4


def factors(w: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, end, shift) of each factor of ``w``, from its suffix automaton; shift 0: a new word, else the distance to the first earlier occurrence."""
    edges: list[dict[int, int]] = [{}]
    link, length, seen = [-1], [0], [-1]  # seen: where a state's strings end first
    last = 0
    for i, c in enumerate(w):
        new = len(length)
        edges.append({})
        length.append(length[last] + 1)
        seen.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                edges.append(edges[q].copy())
                length.append(length[p] + 1)
                seen.append(seen[q])
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    i, n = 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n and seen[then := edges[state][w[j]]] < j:
            state, j = then, j + 1
        if j == i:
            yield i, i + 1, 0
            i += 1
        else:
            yield i, j, j - 1 - seen[state]
            i = j


def common_prefixes(x: list[int]) -> list[int]:
    """Length of the longest common prefix of ``x`` and each of its suffixes."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        if i + k >= hi:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            lo, hi = i, i + k
        z[i] = k
    return z


def runs_at(w: list[int], lo: int, at: int, end: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Main's step: runs (first, last, period) within ``w[lo:end]`` that touch the place ``at``, of periods up to ``most``."""
    t, u = w[lo:at][::-1], w[at:end]
    right, left = min(most, len(u)), min(most, len(t))
    gap = [-1]
    ahead, behind = common_prefixes(u), common_prefixes(t)
    over_left = common_prefixes(u + gap + w[at - left : at] + u)  # of u with what begins q before it
    over_right = common_prefixes(t + gap + u[:right][::-1] + t)  # of t, backwards, with what ends q after it
    found: dict[tuple[int, int], int] = {}
    for q in range(1, max(left, right) + 1):
        spans = []
        if q <= right:
            before = over_right[len(t) + 1 + right - q]
            spans.append((at - before, at + q - 1 + (ahead[q] if q < len(u) else 0)))
        if q <= left:
            after = over_left[len(u) + 1 + left - q]
            spans.append((at - q - (behind[q] if q < len(t) else 0), at - 1 + after))
        for first, last in spans:
            if last - first + 1 < max(LEAST, PERIODS * q) or (first, last) in found:
                continue  # too short, or of a smaller period
            if (first > 0 and w[first - 1] == w[first - 1 + q]) or (last + 1 < len(w) and w[last + 1] == w[last + 1 - q]):
                continue  # it goes on beyond this piece, and is found elsewhere
            found[first, last] = q
            yield first, last, q


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """All runs (first, length, period) of at least PERIODS periods and LEAST words, in order."""
    found: dict[int, dict[int, int]] = {}  # by first word: last word -> period
    before = 0  # where the factor before this one began
    for first, end, shift in factors(w):
        size = end - before
        # a run that touches this place begins less than a period before the last factor, or that factor would be longer
        most = size // (PERIODS - 1) + 1
        for a, b, q in runs_at(w, max(0, before - most), first, end, most):
            own = found.setdefault(a, {})
            own[b] = min(q, own.get(b, q))
        if shift and end - first > LEAST:
            for a in range(first - shift + 1, end - shift):
                for b, q in list(found.get(a, {}).items()):
                    if b + shift < end - 1:
                        found.setdefault(a + shift, {}).setdefault(b + shift, q)
        before = first
    most = (len(w) - before) // (PERIODS - 1) + 1
    for a, b, q in runs_at(w, max(0, before - most), len(w), len(w), most):  # those that end with the text
        own = found.setdefault(a, {})
        own[b] = min(q, own.get(b, q))
    return [(a, b - a + 1, q) for a in sorted(found) for b, q in sorted(found[a].items(), key=lambda x: x[1])]


def covered(g: Words) -> list[tuple[int, int]]:
    """Stretches (first, end) of words, within a text each, that repeated pieces of PIECE words cover."""
    grams, bounds = g.grams(PIECE)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    counts = np.diff(g.at)
    full = (counts >= PIECE)[text]
    grams, text = grams[full], text[full]
    place = np.arange(len(grams)) + (g.at[:-1] - np.concatenate([[0], np.cumsum(np.maximum(0, counts - PIECE + 1))[:-1]]))[text] if len(grams) else np.zeros(0, np.int64)
    key = mix(grams ^ mix(text.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    place = np.sort(place[again])
    if not len(place):
        return []
    owner = np.searchsorted(g.at, place, "right")
    new = np.append(True, (place[1:] >= place[:-1] + PIECE) | (owner[1:] != owner[:-1]))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(place)) - 1
    return [(a, b + PIECE) for a, b in zip(place[heads].tolist(), place[tails].tolist(), strict=True) if b + PIECE - a >= LEAST]


class _Spaced(Words):
    """Words that are whatever stands between blanks."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, NOT_SPACE, PLAIN_BYTE)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@tidy
def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in chunks(b.column(1)):
            g = _Spaced(b.column(1).slice(lo, hi - lo))
            drop = np.zeros(len(g.start), bool)
            rows: list[list[dict]] = [[] for _ in range(hi - lo)]
            for first, end in covered(g):
                numbers: dict[bytes, int] = {}
                w = [numbers.setdefault(g.data[x:y].tobytes(), len(numbers)) for x, y in zip(g.start[first:end].tolist(), g.end[first:end].tolist(), strict=True)]
                own = int(np.searchsorted(g.at, first, "right")) - 1
                for start, length, period in runs(w):
                    drop[first + start + period : first + start + length] = True
                    rows[own].append({"start": first + start - int(g.at[own]), "length": length, "period": period})
            # kept words, each with one blank behind it but the last of a text
            kept = np.flatnonzero(~drop)
            size = (g.end - g.start)[kept] + 1
            to = np.concatenate([[0], np.cumsum(size)])
            text = np.full(int(to[-1]), 32, np.uint8)
            inside = np.zeros(len(g.data) + 1, np.int8)
            inside[g.start[kept]] += 1
            inside[g.end[kept]] -= 1
            place = np.ones(len(text), bool)
            place[to[1:] - 1] = False
            text[place] = g.data[np.cumsum(inside[:-1]).astype(bool)]
            ends = to[np.searchsorted(kept, g.at)]
            text = text.tobytes()
            n = np.diff(g.at)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(lo, hi - lo),
                    pa.array(n, pa.int64()),
                    pa.array(rows, RUNS),
                    pa.array([text[x : max(x, y - 1)].decode() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def find_runs(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with n_words, its ``runs`` and the ``collapsed`` text.

    Words are what stands between blanks (space, tab, line feed, vertical tab, form feed,
    carriage return). A run is a stretch of words with smallest period q, at least four times
    as long and of at least six words, that no neighbouring word extends; runs are in order of
    start, then period. In the collapsed text each run keeps its first period only, and one
    space stands between words. A null or empty text has no words; very long texts are taken
    whole, one at a time; repeated rows get equal results; null ids stay null; further columns
    are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_found, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


@tidy
def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, texts = b.column(2).to_numpy(zero_copy_only=False), b.column(1)
        out: list[pa.Array] = []
        done = 0
        for i in np.flatnonzero(h % 10 == 0).tolist():
            g = _Spaced(texts.slice(i, 1))
            n = len(g.start)
            if not n:
                continue
            group = int(h[i]) // 10
            a = group % n
            p = 1 + (n - a) // (3 + group % 8)
            at = np.arange(n)
            at[a:] = a + (at[a:] - a) % p
            words = [g.data[x:y].tobytes() for x, y in zip(g.start[at].tolist(), g.end[at].tolist(), strict=True)]
            out += [texts.slice(done, i - done), pa.array([b" ".join(words).decode()], texts.type)]
            done = i + 1
        out.append(texts.slice(done))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.concat_arrays(out)], ["doc_id", "text"])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic ending in every text whose id's crc32 is divisible by 10.

    From word ``a`` on the words repeat with period ``p``, where both follow from the crc32;
    most such texts then have a run of a long period. A null id counts as an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"), F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).alias("h"))
    return rows.mapInArrow(_planted, f"doc_id {kind}, text string")


def run_report(docs: DataFrame) -> DataFrame:
    """For each document its number of runs, the longest one, and sha256 of all runs and of the collapsed text."""
    out = find_runs(docs)
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best"))
    length, period = -F.col("best.l"), F.col("best.period")
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("(-best.l * 1000) div best.period").alias("exponent_milli"),
        F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
