"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed forms of emails, IP addresses, card and phone numbers find. The words
around a seed are its lexical patterns: the two words before it, and the word before with the
word behind. Spark counts what else stands in the same contexts all over the corpus and
scores the graph of patterns and their fillers in rounds: a pattern is as good as what stands
at its places is on average, an unseen filler of an identifier's shape as good as its patterns together.
Patterns that end well mark the identifiers they introduce whose form no rule knows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, keyed
from .textgrid import FOLDED_BYTE, NOT_SPACE, U64, Words, chunks, mix, raw, tidy

KINDS = ("email", "ip", "card", "phone")
#: Fixed forms that must match; an email is found from its @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What an identifier that a pattern introduces may look like: wider than the fixed forms.
AT = re.compile(r"@|\s?(?:\(at\)|\[at\]|\{at\})\s?")
WIDE_LOCAL = frozenset("!#$%&'*+-./=?^_`{|}~") | LOCAL
WIDE_DOMAIN = re.compile(r"[\w-]+(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\.)\s?[\w-]+)*", re.A)
WIDE = {
    1: re.compile(r"(?<![\w.:])(?:[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}|[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3})(?![\w:])", re.A),
    2: re.compile(r"(?<![\w+])[0-9](?:[\x20.-]?[0-9]){11,18}(?!\w)", re.A),
    3: re.compile(r"(?<![\w+])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?!\w)", re.A),
}
#: Different seeds that a pattern needs, the share of its places with seeds that makes it worth scoring, the score that makes it good, and rounds of scoring.
SEEDS, WORTH, GOOD, ROUNDS = 3, 0.5, 0.8, 3
#: Bits of the bitmaps of patterns that go to all tasks, whatever the size of the data; a full one only lets more rows through to the exact join.
BITS = 1 << 22


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(c) if i % 2 == 0 else twice[int(c)] for i, c in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str, at: re.Pattern, local: frozenset, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Matches around each place of ``at``, leftmost first; a long word costs no more than its length."""
    done = 0
    for m in at.finditer(text):
        if m.start() < done:
            continue
        after = domain.match(text, m.end())
        first = m.start()
        while first > done and text[first - 1] in local:
            first -= 1
        if after and first < m.start():
            done = after.end()
            yield first, done


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of what the fixed forms find, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text, re.compile("@"), LOCAL, DOMAIN)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of identifier-shaped stretches that touch no span of the base."""
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = np.array([a for a, _ in taken], np.int64), np.maximum.accumulate(np.array([b for _, b in taken], np.int64))
    out = [(0, a, b) for a, b in _emails(text, AT, WIDE_LOCAL, WIDE_DOMAIN)]
    for kind, shape in WIDE.items():
        out += [(kind, m.start(), m.end()) for m in shape.finditer(text)]

    def free(a, b):
        before = int(np.searchsorted(starts, b, "left"))
        return not before or ends[before - 1] <= a

    return [s for s in out if free(*s[1:])]


@lru_cache(8192)
def instance(value: str) -> int:
    """An identifier's number, whatever its case, blanks and punctuation."""
    data = re.sub(r"[\s().-]", "", value).lower().encode()
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


_PUNCT = np.isin(np.arange(256), np.frombuffer(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", np.uint8))
_CONTEXT_BYTE = np.where(_PUNCT, U64(0), FOLDED_BYTE)
#: A text without these bytes holds no identifier.
_HINT = np.isin(np.arange(256), np.frombuffer(b"0123456789@[({", np.uint8))


class Places:
    """The words of a chunk of texts as places of fillers, with the patterns around them (case and punctuation behind words aside)."""

    def __init__(self, texts: pa.Array):
        self.g = g = Words(texts, NOT_SPACE, _CONTEXT_BYTE)
        n = len(g.hash)
        self.nth = np.arange(n)
        text = np.repeat(np.arange(len(g.at) - 1), np.diff(g.at))
        first, end = g.at[:-1][text], g.at[1:][text]
        h = np.concatenate([g.hash, np.zeros(2, U64)])
        back = [np.where(self.nth - k >= first, h[self.nth - k], U64(k)) for k in range(1, 5)]
        one = back[0]
        self.before = mix(mix(back[1] + U64(11)) + one)
        #: The words around a place, wider than its patterns: places of copies of a text count as one.
        self.around = mix(self.before + mix(mix(back[3] + U64(13)) + back[2] + h[self.nth + 1]))
        self.one, self.behind = mix(one + U64(12)), np.where(self.nth + 1 < end, h[self.nth + 1], U64(3))
        data, offsets = raw(texts)
        run = np.concatenate([[0], np.cumsum(_HINT[data])])
        self.hinted = np.flatnonzero(run[offsets[1:]] > run[offsets[:-1]]).tolist()

    def patterns(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both patterns around the fillers from word ``first`` to word ``last``."""
        return self.before[first], mix(self.one[first] + self.behind[last])

    def words(self, i: int, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of spans (kind, start, end in code points) of text i."""
        g = self.g
        lo, hi, base = int(g.at[i]), int(g.at[i + 1]), int(g.offsets[i])
        data, starts = g.data[base : int(g.offsets[i + 1])], g.start[lo:hi] - base
        if (data >= 128).any():
            starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
        at = np.array([s[1:] for s in spans], np.int64).reshape(-1, 2)
        return (lo + np.searchsorted(starts, at[:, 0], "right") - 1, lo + np.searchsorted(starts, at[:, 1] - 1, "right") - 1)


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, pa.Array]]:
    for lo, hi in chunks(b.column(column)):
        yield lo, hi, b.column(column).slice(lo, hi - lo)


@tidy
def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, pattern, filler, held, places): seeds and their patterns; of the different places of the chunk with the pattern, ``held`` hold a seed.

    The counts stand in one row of each kind and pattern of a chunk.
    """
    for b in batches:
        for _, _, texts in _chunks(b, 0):
            places, seeds = Places(texts), []
            for i in places.hinted:
                text = texts[i].as_py()
                if spans := base_spans(text):
                    seeds += zip((k for k, _, _ in spans), (instance(text[a:e]) for _, a, e in spans), *(w.tolist() for w in places.words(i, spans)), strict=True)
            rows = []
            first, last = (np.array([x[j] for x in seeds], np.int64) for j in (2, 3))
            for p, every in zip(places.patterns(first, last), places.patterns(places.nth, places.nth), strict=True):
                here = np.isin(every, p)
                total = np.unique(np.stack([np.append(every[here], p), np.append(places.around[here], places.around[first])]), axis=1)[0]
                pattern, n = np.unique(total, return_counts=True)
                n = dict(zip(pattern.tolist(), n.tolist(), strict=True))
                held: dict[tuple[int, int], tuple[set, set]] = {}
                for (kind, filler, _, _), h, at in zip(seeds, p.tolist(), places.around[first].tolist(), strict=True):
                    own = held.setdefault((kind, h), (set(), set()))
                    own[0].add(filler)
                    own[1].add(at)
                for (kind, h), (fillers, at) in held.items():
                    rows += [(kind, h, f, 0 if j else len(at), 0 if j else n[h]) for j, f in enumerate(fillers)]
            kinds = (pa.int32(), pa.uint64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            columns[1] = columns[1].view(pa.int64())
            yield pa.RecordBatch.from_arrays(columns, ["kind", "pattern", "filler", "held", "places"])


def _in(bitmap: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    at = pattern & U64(BITS - 1)
    return (bitmap[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """Patterns as a bitmap of BITS bits: at most BITS / 64 rows reach the driver, however many patterns there are."""
    at = F.col("pattern").bitwiseAND(BITS - 1)
    rows = patterns.groupBy(F.shiftright(at, 6).alias("row")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((pattern & {BITS - 1}) & 63 as int))")).alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for r in rows.toLocalIterator():
        out[r.row] = r.bits
    return out.view(U64)


@tidy
def _fillers(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(pattern, filler, shapes, place): what stands in the contexts; ``shapes`` has a bit for each kind it looks like."""
    for b in batches:
        for _, _, texts in _chunks(b, 0):
            places = Places(texts)
            last, filler, shapes = places.nth.copy(), places.g.hash.view(np.int64).copy(), np.zeros(len(places.nth), np.int32)
            for i in places.hinted:
                text = texts[i].as_py()
                base = base_spans(text)
                spans = wide_spans(text, base) + base  # where both begin in a word, the base counts
                for (k, a, e), x, y in zip(spans, *(w.tolist() for w in places.words(i, spans)), strict=True):
                    last[x], filler[x] = y, instance(text[a:e])
                    shapes[x] |= 1 << k
            rows = [np.zeros((0, 4), np.int64)]
            for p in places.patterns(places.nth, last):
                hit = np.flatnonzero(_in(bitmap, p))
                rows.append(np.stack([p[hit].view(np.int64), filler[hit], shapes[hit], places.around[hit].view(np.int64)], 1))
            rows = np.unique(np.concatenate(rows), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2], pa.int32()), pa.array(rows[:, 3])], ["pattern", "filler", "shapes", "place"])


def learn(docs: DataFrame, seeds: int = SEEDS, worth: float = WORTH, good: float = GOOD, rounds: int = ROUNDS) -> DataFrame:
    """Good patterns (kind, pattern, confidence) of all texts of ``docs(text)``.

    Every place in the corpus where a pattern stands counts, but places with the same words
    around as one, so that copies of a text do. A filler that is no seed and has not the shape
    of the kind scores 0. A pattern of which already the places beside seeds speak against is
    not looked up elsewhere.
    """
    texts = docs.select(docs["text"].cast("string").alias("text")).where("text is not null")
    known = durable(texts.mapInArrow(_seeds, "kind int, pattern long, filler long, held long, places long"))
    support = known.groupBy("kind", "pattern").agg(F.count_distinct("filler").alias("seeds"), F.sum("held").alias("held"), F.sum("places").alias("places"))
    support = durable(support.where((F.col("seeds") >= seeds) & (F.col("held") >= worth * F.col("places"))).select("kind", "pattern"))
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(support))
    met = texts.mapInArrow(lambda it: _fillers(it, held.value), "pattern long, filler long, shapes int, place long")
    met = met.join(support.select("pattern").distinct(), "pattern").groupBy("pattern", "filler").agg(F.bit_or("shapes").alias("shapes"), F.count_distinct("place").alias("n"))
    seen = known.select("kind", "filler", F.lit(True).alias("seed")).distinct()  # a seed anywhere is a seed everywhere
    edges = support.join(met, "pattern").join(seen, ["kind", "filler"], "left")
    edges = durable(edges.select("kind", "pattern", "n", "filler", F.coalesce("seed", F.lit(False)).alias("seed"), F.expr("(shiftright(shapes, kind) & 1) = 1").alias("like")))
    score = F.when(F.col("seed"), 1.0).otherwise(0.0)
    for n in range(rounds):
        if n:
            # an unseen identifier: what is left of its doubt when all its patterns speak for it
            doubt = edges.join(confidence, ["kind", "pattern"]).groupBy("kind", "filler").agg(F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence"))))).alias("doubt"))
            scored = edges.join(doubt, ["kind", "filler"])
            score = F.when(F.col("seed"), 1.0).when(F.col("like"), 1 - F.col("doubt")).otherwise(0.0)
        else:
            scored = edges
        confidence = durable(scored.groupBy("kind", "pattern").agg((F.sum(score * F.col("n")) / F.sum("n")).alias("confidence")))
    return confidence.where(F.col("confidence") >= good)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


@tidy
def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, texts in _chunks(b, 2):
            data, offsets = raw(texts)
            run = np.concatenate([[0], np.cumsum(_HINT[data])])
            some = run[offsets[1:]] > run[offsets[:-1]]
            spans = [[{"kind": k, "start": a, "end": e} for k, a, e in base_spans(texts[i].as_py())] if some[i] else [] for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(spans, pa.list_(_SPAN))], ["key", "doc_id", "base"])


@tidy
def _introduced(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, _, texts in _chunks(b, 1):
            places, rows = None, []
            for i, text in enumerate(texts):
                text = text.as_py()
                if text is None:
                    continue
                spans = wide_spans(text, base_spans(text))
                if not spans:
                    continue
                places = places or Places(texts)
                for p in places.patterns(*places.words(i, spans)):
                    rows += [(b.column(0)[lo + i].as_py(), *s, h) for s, h, fits in zip(spans, p.view(np.int64).tolist(), _in(bitmap, p).tolist(), strict=True) if fits]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["key", "kind", "start", "end", "pattern"])


def find(docs: DataFrame, seeds: int = SEEDS, good: float = GOOD) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its spans: ``base`` of the fixed forms, ``added`` by good patterns.

    Spans are (kind's number in KINDS, start, end) in code points, end exclusive, by kind and
    start; an added span touches no base span, and of added ones of a kind that overlap the
    first, longest one stays. Null and empty texts have none; very long texts are taken whole;
    repeated rows have equal spans and weigh as one in learning; null ids stay null; further
    columns are ignored; an empty table gives no rows.
    """
    base = keyed(docs, ["doc_id", "text"]).select("key", "doc_id", F.col("text").cast("string").alias("text"))
    patterns = durable(learn(base, seeds, good=good))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.select("key", "doc_id", "text").mapInArrow(_base, f"key long, doc_id {kind}, base array<struct<kind: int, start: long, end: long>>")
    nothing = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    if patterns.isEmpty():
        return out.select("doc_id", "base", nothing.alias("added"))
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(patterns))
    marked = base.select("key", "text").where("text is not null").mapInArrow(lambda it: _introduced(it, held.value), "key long, kind int, start long, end long, pattern long")
    marked = marked.join(patterns.select("kind", "pattern"), ["kind", "pattern"], "left_semi").select("key", "kind", "start", "end").distinct()
    # a text's own marks, at most as many as its words
    marks = marked.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", (-F.col("end")).alias("end")))).alias("marks"))
    behind = lambda a, s: (F.size(a) == 0) | (F.element_at(a, -1)["kind"] < s["kind"]) | (F.element_at(a, -1)["end"] <= s["start"])
    span = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["end"]).alias("end"))
    added = F.aggregate("marks", nothing, lambda a, s: F.when(behind(a, s), F.concat(a, F.array(span(s)))).otherwise(a))
    return out.join(marks, F.col("key") == F.col("_key"), "left").select("doc_id", "base", F.coalesce(added, nothing).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """For each document how many base spans of each kind it has, their sha256, all spans, and how many the patterns added."""
    out = find(docs)
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *count, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
