"""Near-duplicate passages by compact windows.

A passage's tokens are its five-word shingles. Under each of HASHES hash functions, the
Cartesian tree of a text's token hashes gives compact windows: the stretch around a token in
which it is the least, so every passage inside that holds the token has it as its min-hash.
Only windows of at least a passage's length are made, about 2 n / (t + 1) for n tokens.
Equal tokens that are the least of one stretch, as in periodic texts, are one window.

Windows meet by their key: the function and the CONTEXT tokens from the min-hash on, so that
a common line of a few words brings none together. In STARS rounds each window is clipped to
its key's first occurrence, the next round to the second; clipped windows along one diagonal
are a candidate passage, and the shingle sets of candidates are compared exactly. Windows
that no verified passage covers ask again. What then still asks is compared, in pairs of
blocks, with all earlier windows of its key, so that nothing is left untried. Answered
windows stay as partners of later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import components, discard, durable, keyed, packed, split_by_keys, stored, unpacked, without_copies
from .substring_exact import sliding_least
from .textgrid import Words, chunks, count_words, mix, raw, tidy

#: A passage of 50 words with a word changed in its middle keeps the CONTEXT of a min-hash with probability 0.65, and of none of HASHES with 2e-4. HASHES is a power of two.
HASHES, CONTEXT, STARS = 8, 6, 2
_rng = np.random.default_rng(4711)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
U = np.uint64
#: Shingles by which a clipped window is widened, for drift between the two sides.
SLACK = 8
#: Groups into which one text's requests are dealt.
SALTS = 256
#: Windows of a block where all earlier windows of a key are compared, rows of a task, and rows of a matrix of intersections.
BLOCK, TASK, SIDE = 2048, 2048, 512
#: A window as it is shuffled, windows that a task deals at once, and bytes of text whose windows fill a bucket.
WINDOW = np.dtype([("k", np.int64), ("pos", np.int64), ("w", np.int64), ("m", np.int32)])
DEAL, BUCKET = 1 << 18, 4 << 20
#: Tokens of pairs that are compared at once, and more places than a text has.
TOKENS, FAR = 1 << 17, 1 << 40
#: Pairs of a block's windows that wait to be compared.
PAIRS = 1 << 14
#: Cells of a table of rows and tokens.
CELLS = 1 << 25


def nearest_smaller(v: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Index of the last smaller value before each one in its text, or -1: a Cartesian tree's left links."""
    near = np.arange(len(v)) - 1

    def open_(i):
        j = near[i]
        ok = j >= 0
        ok[ok] = text[j[ok]] == text[i[ok]]
        near[i[~ok]] = -1
        i = i[ok]
        return i[v[near[i]] > v[i]]

    left = open_(np.arange(len(v)))
    for _ in range(12):
        near[left] = near[near[left]]
        left = open_(left)
    if not len(left):
        return near
    # long chains, as of equal values in periodic texts: by the least values of runs of 2**i
    least = [v]
    while 2 * (1 << len(least) - 1) <= len(v):
        have = 1 << len(least) - 1
        least.append(np.minimum(least[-1][:-have], least[-1][have:]))
    at, first = near[left], np.maximum.accumulate(np.where(np.append(True, text[1:] != text[:-1]), np.arange(len(v)), 0))[left]
    for i in range(len(least) - 1, -1, -1):
        lo = at - (1 << i) + 1
        ok = lo >= first
        ok[ok] = least[i][lo[ok]] > v[left[ok]]
        at = np.where(ok, lo - 1, at)
    near[left] = np.where(at >= first, at, -1)
    return near


def compact_windows(grams: np.ndarray, bounds: np.ndarray, least: int, apart: int):
    """For each hash function: (function, text, centre, first, last, last centre) of the windows of at least ``least`` tokens, as indices in the chunk.

    Equal centres less than ``least`` tokens apart within one stretch are one window, from the
    first to the last of them; what lies ``apart`` or more behind the first begins another,
    so that a periodic stretch meets itself.
    """
    sizes = np.diff(bounds)
    own = np.maximum(0, sizes - least + 1)
    start = np.arange(int(own.sum())) + np.repeat(bounds[:-1] - (np.cumsum(own) - own), own)
    if not len(start):
        return
    x = (grams >> U(32)).astype(np.uint32)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    orders, centres, texts = [], [], []
    for i in range(HASHES):
        order = (((x ^ _XOR[i]) * _MUL[i]).astype(U) << U(32)) | np.arange(len(x), dtype=U)
        centre = (sliding_least(order, least)[start] & U(0xFFFFFFFF)).astype(np.int64)
        centre = centre[np.append(True, centre[1:] != centre[:-1])]  # places of minima never go back
        orders.append(order[centre])
        centres.append(centre)
        texts.append(text_of[centre] + i * len(sizes))
    # the functions' trees side by side
    each, texts, orders = np.cumsum([0, *(len(c) for c in centres)]), np.concatenate(texts), np.concatenate(orders)
    befores = nearest_smaller(orders, texts)
    afters = len(orders) - 1 - nearest_smaller(orders[::-1], texts[::-1])[::-1]
    for i in range(HASHES):
        own = slice(each[i], each[i + 1])
        centre, text, v = centres[i], texts[own] - i * len(sizes), orders[own]
        before, after = np.where(befores[own] >= 0, befores[own] - each[i], -1), np.where(afters[own] < len(orders), afters[own] - each[i], len(v))
        lo = np.where(before >= 0, centre[before] + 1, bounds[text])
        hi = np.where(after < len(v), centre[np.minimum(after, len(v) - 1)] - 1, bounds[text + 1] - 1)
        by = np.argsort(v >> U(32), kind="stable")  # equal values side by side, in order of place
        c = centre[by]
        tied = np.zeros(len(by), bool)
        tied[1:] = (before[by[1:]] == by[:-1]) & (v[by[1:]] >> U(32) == v[by[:-1]] >> U(32)) & (np.diff(c) < least)
        head = ~tied
        run = np.cumsum(head) << 40
        ahead = np.flatnonzero(head)
        while len(ahead):
            then = np.searchsorted(run + c, run[ahead] + c[ahead] + apart)
            ahead = then[(then < len(by)) & (run[np.minimum(then, len(by) - 1)] == run[ahead])]
            head[ahead] = True
        at = np.flatnonzero(head)
        stop = np.append(at[1:], len(by)) - 1
        yield i, text[by[at]], c[at], lo[by[at]], hi[by[at]], c[stop]


def context_keys(grams: np.ndarray, bounds: np.ndarray, centre: np.ndarray, text: np.ndarray, function: int) -> np.ndarray:
    """Hash of the CONTEXT tokens from each centre on (none beyond the text's end), with the function's number in its last bits."""
    key = np.zeros(len(centre), U)
    for j in range(CONTEXT):
        inside = centre + j < bounds[text + 1]
        key = key * U(0xD6E8FEB86659FD93) + np.where(inside, grams[np.minimum(centre + j, len(grams) - 1)], U(0))
    return (mix(key + U(function)) & ~U(HASHES - 1)) | U(function)


def _windows(batches: Iterator[pa.RecordBatch], shingle: int, least: int, bits: int) -> Iterator[np.ndarray]:
    for b in batches:
        key = b.column(0).to_numpy()
        for lo, hi in chunks(b.column(1), 1 << 19):
            texts = b.column(1).slice(lo, hi - lo)
            parts = [Words(texts.slice(x, y - x)).grams(shingle) for x, y in chunks(texts, 1 << 17)]
            grams, bounds = np.concatenate([g for g, _ in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(at) for _, at in parts])))
            for i, text, c, first, last, tie in compact_windows(grams, bounds, least, least + shingle - 1):
                rows = np.empty(len(c), WINDOW)
                rows["k"] = context_keys(grams, bounds, c, text, i).view(np.int64)
                rows["pos"] = (key[lo:hi][text] << bits) | (c - bounds[text])
                rows["w"], rows["m"] = ((c - first) << 31) | (last - tie), tie - c
                yield rows


def deal(rows: np.ndarray, buckets: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(bucket, known, rows) of windows: two of a key at most go to the key's bucket, where its windows are counted.

    Of more, it is known that they share their key, so they are dealt evenly, and a hot key fills no bucket.
    """
    h = rows["k"].view(U) >> U(16)
    to = ((h % U(buckets)) << U(1)).astype(np.uint16 if buckets < 1 << 15 else np.int64)
    # keys that may come more than twice
    slot = (h & U(0xFFFFF)).astype(np.int64)
    often = np.flatnonzero(np.bincount(slot, minlength=1)[slot] > 2)
    if len(often):
        often = often[np.argsort(rows["k"][often], kind="stable")]
        k, n = rows["k"][often], np.arange(len(often))
        more = n - np.maximum.accumulate(np.where(np.append(True, k[1:] != k[:-1]), n, 0)) > 1
        to[often[more]] = (n[more] + int(h[0] % U(buckets))) % buckets * 2 + 1
    by = np.argsort(to, kind="stable")
    rows, to = rows[by], to[by]
    cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(to[lo]) >> 1, bool(to[lo] & 1), rows[lo:hi]


@tidy
def _dealt(batches: Iterator[pa.RecordBatch], shingle: int, least: int, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    def batch():
        bucket, known, rows = zip(*deal(np.concatenate(held), buckets), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(known), pa.array([r.tobytes() for r in rows], pa.binary())], ["bucket", "known", "rows"])

    held, n = [], 0
    for rows in _windows(batches, shingle, least, bits):
        held.append(rows)
        n += len(rows)
        if n >= DEAL:
            yield batch()
            held, n = [], 0
    if n:
        yield batch()


def _shared(table: pa.Table) -> pa.Table:
    """Windows of a bucket whose key others have too."""
    known = np.array(table.column("known"), bool)
    rows = [np.frombuffer(r.as_buffer(), WINDOW) for r in table.column("rows").combine_chunks()]
    own = np.concatenate([np.empty(0, WINDOW), *(r for r, k in zip(rows, known, strict=True) if not k)])
    own = own[np.argsort(own["k"])]
    same = own["k"][1:] == own["k"][:-1]
    out = np.concatenate([own[np.append(same, False) | np.append(False, same)[: len(own)]] if len(own) else own, *(r for r, k in zip(rows, known, strict=True) if k)])
    return pa.table([pa.array(np.ascontiguousarray(out[c])) for c in ("k", "pos", "w", "m")], ["k", "pos", "w", "m"])


def regions(pair: np.ndarray, rects: dict[str, np.ndarray], reach: int) -> tuple[np.ndarray, ...]:
    """Candidate passages (pair, first, last, other first, other last) of pairs of texts.

    ``rects`` are windows already clipped to each other: centre ``c`` to ``c + m``, other
    centre ``oc`` to ``oc + om``, ``l`` and ``r`` tokens to the left and right. Neighbours
    along a diagonal are joined.
    """
    c, oc = rects["c"], rects["oc"]
    sides = np.stack([c - rects["l"], c + rects["m"] + rects["r"], oc - rects["l"], oc + rects["om"] + rects["r"]])
    lane = (c - oc) // reach
    order = np.lexsort((sides[0], lane, pair))
    pair, lane, sides = pair[order], lane[order], sides[:, order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (lane[1:] != lane[:-1])
    shift = np.cumsum(new) << 40
    top = np.maximum.accumulate(sides[1] + shift) - shift
    new[1:] |= sides[0][1:] > top[:-1] + SLACK
    at = np.flatnonzero(new)
    if not len(at):
        return pair, *sides
    return pair[at], np.minimum.reduceat(sides[0], at), np.maximum.reduceat(sides[1], at), np.minimum.reduceat(sides[2], at), np.maximum.reduceat(sides[3], at)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that come in order of their first columns, anew in parts that cut no group of equal ``keys`` of them."""
    held = []
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(len(b), bool)
        for i, c in enumerate(cols):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and held[-1].column(i)[-1].as_py() != int(c[0])
        cut = np.flatnonzero(new)
        if len(cut):
            done = [*held, b.slice(0, int(cut[-1]))]
            yield pa.Table.from_batches(done).combine_chunks()
            held, b = [], b.slice(int(cut[-1]))
        held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@tidy
def _candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, 2):
        d, p, *rest = (c.to_numpy() for c in t.columns)
        rects = {n: c.astype(np.int64) for n, c in zip(t.column_names[2:], rest, strict=True)}
        new = np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]))
        pair, lo, hi, olo, ohi = regions(np.cumsum(new) - 1, rects, least)
        d, p, n = d[new][pair], p[new][pair], np.arange(len(pair))
        for role, x, y in ((0, lo, hi), (1, olo, ohi)):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p), pa.array(n, pa.int32()), pa.array(np.full(len(n), role), pa.int32()), pa.array(np.maximum(0, x - SLACK), pa.int32()), pa.array(y + SLACK, pa.int32())], ["d", "p", "n", "role", "lo", "hi"])


def _grams_of(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, shingles) of each text, taken in chunks."""
    for lo, hi in chunks(texts, 1 << 17):
        grams, bounds = Words(texts.slice(lo, hi - lo)).grams(shingle)
        for i in range(lo, hi):
            yield i, grams[bounds[i - lo] : bounds[i - lo + 1]]


@tidy
def _slices(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    names = ["d", "p", "n", "role", "lo"]
    for b in batches:
        at, flat, data, cut = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py(), b.column(1).flatten(), [], 0
        lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
        for i, grams in _grams_of(b.column(0), shingle):
            part = (grams >> U(32)).astype(np.uint32)
            data += [part[x : y + 1].tobytes() for x, y in zip(lo[at[i] : at[i + 1]].tolist(), hi[at[i] : at[i + 1]].tolist(), strict=True)]
            if len(data) >= 2000 or i + 1 == len(b):
                own = flat.slice(cut, len(data))
                yield pa.RecordBatch.from_arrays([*(own.field(f) for f in names), pa.array(data, pa.binary())], [*names, "part"])
                cut, data = cut + len(data), []


def common_stretches(x: np.ndarray, y: np.ndarray, least: int, threshold: float, shingle: int = 5, ahead: int | None = None, places: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Stretches (first, last, other first, other last) of tokens whose sets have Jaccard similarity of ``threshold``.

    From the first to the last common token; while that is too unlike, it is split at its
    widest gap of tokens not in common. What is shorter than ``least`` may grow to that, by up
    to a shingle's length on each side, as an edited word changes all shingles at an edge.
    Where both are parts of one text, x beginning ``ahead`` tokens after y, a token is in
    common only with one at least ``least`` places before it, and a stretch whose partner does
    not end before it is split too: it holds several repeats. ``places``, of -1 for each
    number that a token can be, saves sorting the tokens. The query compares many pairs at
    once (``stretches_of_pairs``); this is the plain form, which tests hold that one to.
    """
    if places is None:
        ids = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        x, y, places = ids[: len(x)], ids[len(x) :], np.full(len(ids), -1)
    # a token's number from here on: its first place in y, or one beyond y
    places[y[::-1]] = np.arange(len(y))[::-1]
    ys, new = places[y], x[places[x] < 0]
    places[new] = len(y) + np.arange(len(new))
    xs, n = places[x], len(y) + len(new)
    places[x] = places[y] = -1

    def like(first, last, lo, hi):
        left, right = np.zeros(n, bool), np.zeros(n, bool)
        left[xs[first : last + 1]] = True
        right[ys[max(0, lo) : hi + 1]] = True
        return np.count_nonzero(left & right) / np.count_nonzero(left | right)

    def grown(first, last, lo, hi):
        """The likest way to reach ``least`` tokens."""
        need = least - (last - first + 1)
        ways = [(g, need - g) for g in range(max(0, need - shingle), min(need, shingle) + 1)] if need > 0 else [(0, 0)]
        ways = [(first - g, last + r, lo - g, hi + r) for g, r in ways if first >= g and last + r < len(x)]
        ways = [w for w in ways if ahead is None or min(w[3], len(y) - 1) < w[0] + ahead]
        return max(((like(*w), w) for w in ways), default=(0.0, None))

    hit = np.flatnonzero(xs < len(y))
    to = xs[hit]
    # where no token repeats, a stretch has ``least`` distinct ones, and needs so many in common
    upto = np.concatenate([[0], np.cumsum(xs < len(y))]) if np.count_nonzero(np.bincount(xs, minlength=1)) == len(xs) else None
    if ahead is not None:
        early = to <= hit + (ahead - least)
        hit, to = hit[early], to[early]
    out, todo = [], [(0, len(hit))]
    while todo:
        a, b = todo.pop()
        if b - a < 1 or hit[b - 1] - hit[a] + 1 + 2 * shingle < least:
            continue
        if upto is not None and upto[min(len(x), hit[b - 1] + shingle + 1)] - upto[max(0, hit[a] - shingle)] < threshold * least - 1e-6:
            continue
        shift = to[a:b] - hit[a:b]
        along = to[a:b][np.abs(shift - np.partition(shift, (b - a) // 2)[(b - a) // 2]) <= 16 + (b - a) // 8]
        lo, hi = (int(along.min()), int(along.max())) if len(along) else (0, -1)
        similarity, way = grown(int(hit[a]), int(hit[b - 1]), lo, hi) if len(along) else (0.0, None)
        if similarity >= threshold:
            out.append((way[0], way[1], max(0, way[2]), min(way[3], len(y) - 1)))
            continue
        gaps = np.diff(hit[a:b])
        if not len(gaps):
            continue
        cut = a + int(gaps.argmax()) + 1
        if gaps.max() > 1:
            todo += [(a, cut), (cut, b)]
        else:  # all in common but out of order: halves
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def tokens_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of binary values, one after another, and the bounds of each value's."""
    data, offsets = raw(parts)
    return np.frombuffer(data.tobytes(), np.uint32), offsets // 4


def spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places of ranges of ``n`` from ``lo`` on."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + (lo - (np.cumsum(n) - n))[of]


def stretches_of_pairs(x: np.ndarray, xb: np.ndarray, y: np.ndarray, yb: np.ndarray, ahead: np.ndarray, least: int, threshold: float, shingle: int = 5) -> tuple[np.ndarray, ...]:
    """``common_stretches`` of many pairs at once: (pair, first, last, other first, other last).

    Pair i are the tokens x[xb[i]:xb[i+1]] and y[yb[i]:yb[i+1]]; ``ahead`` is FAR where they
    are of different texts. All stretches that are to be tried or split take a step together.
    """
    out = [[] for _ in range(5)]
    xn, yn = np.diff(xb), np.diff(yb)
    xp, yp = np.repeat(np.arange(len(xn)), xn), np.repeat(np.arange(len(yn)), yn)
    xat, yat = np.arange(len(x)) - xb[xp], np.arange(len(y)) - yb[yp]
    each = pa.array(np.concatenate([(xp << 32) | x, (yp << 32) | y])).dictionary_encode()
    number = each.indices.to_numpy().astype(np.int64)
    xs, ys, n = number[: len(x)], number[len(x) :], len(each.dictionary)
    place = np.full(n, -1)
    place[ys[::-1]] = yat[::-1]
    to_all = place[xs]
    common = to_all >= 0
    upto = np.concatenate([[0], np.cumsum(common)])

    def earlier(v, at):
        """The place before of the same token, or -1."""
        seen = np.full(n, -1)
        seen[v[::-1]] = np.arange(len(v))[::-1]
        again = np.flatnonzero(seen[v] != np.arange(len(v)))
        out = np.full(len(v), -1)
        if len(again):
            twice = np.zeros(n, bool)
            twice[v[again]] = True
            by = np.flatnonzero(twice[v])
            by = by[np.argsort(v[by], kind="stable")]
            same = v[by[1:]] == v[by[:-1]]
            out[by[1:][same]] = at[by[:-1][same]]
        return out, again

    xbefore, xagain = earlier(xs, xat)
    ybefore, yagain = earlier(ys, yat)
    plain = np.ones(len(xn), bool)
    plain[xp[xagain]] = False
    many = np.zeros(n, bool)
    many[ys[yagain]] = True
    by = np.flatnonzero(many[ys])
    places_of_many = np.sort((ys[by] << 32) | yat[by])

    def alike(pair, first, last, lo, hi):
        """Jaccard similarity of the sets of tokens first to last and lo to hi."""
        lo, hi = np.maximum(0, lo), np.minimum(hi, yn[pair] - 1)
        way, i = spread(xb[pair] + first, last - first + 1)
        new = xbefore[i] < first[way]
        way, i = way[new], i[new]
        token = xs[i]
        there = place[token]
        both = (there >= lo[way]) & (there <= hi[way])
        some = np.flatnonzero(many[token] & ~both)
        if len(some):
            want = (token[some] << 32) | lo[way[some]]
            found = np.append(places_of_many, -1)[np.searchsorted(places_of_many, want)]
            both[some] = (found >= want) & (found <= (token[some] << 32) | hi[way[some]])
        mine, shared = np.bincount(way, minlength=len(pair)), np.bincount(way[both], minlength=len(pair))
        way, i = spread(yb[pair] + lo, np.maximum(0, hi - lo + 1))
        told = np.bincount(way[ybefore[i] < lo[way]], minlength=len(pair))
        return shared / (mine + told - shared)

    hit = np.flatnonzero(common & (to_all <= xat + ahead[xp] - least))
    to, own, at = to_all[hit], xp[hit], xat[hit]
    pair = np.arange(len(xn))
    a, b = np.searchsorted(own, pair, "left"), np.searchsorted(own, pair, "right")
    while True:
        live = b > a
        pair, a, b = pair[live], a[live], b[live]
        first, last = at[a], at[b - 1]
        live = last - first + 1 + 2 * shingle >= least
        near = upto[xb[pair] + np.minimum(xn[pair], last + shingle + 1)] - upto[xb[pair] + np.maximum(0, first - shingle)]
        live &= ~(plain[pair] & (near < threshold * least - 1e-6))
        pair, a, b, first, last = (c[live] for c in (pair, a, b, first, last))
        if not len(pair):
            return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in out)
        seg, i = spread(a, b - a)
        start = np.cumsum(b - a) - (b - a)
        shift = to[i] - at[i]
        mid = (np.sort((seg << 32) + shift + (1 << 31))[start + (b - a) // 2] & ((1 << 32) - 1)) - (1 << 31)
        along = np.abs(shift - mid[seg]) <= 16 + (b - a)[seg] // 8
        lo, hi = np.minimum.reduceat(np.where(along, to[i], 1 << 40), start), np.maximum.reduceat(np.where(along, to[i], -1), start)
        need = least - (last - first + 1)
        g0, g1 = np.maximum(0, need - shingle), np.where(need > 0, np.minimum(need, shingle), 0)
        of, g = spread(g0, g1 - g0 + 1)
        r = np.maximum(0, need)[of] - g
        way = np.stack([first[of] - g, last[of] + r, lo[of] - g, hi[of] + r])
        ok = (way[0] >= 0) & (way[1] < xn[pair[of]]) & (np.minimum(way[3], yn[pair[of]] - 1) < way[0] + ahead[pair[of]])
        of, way = of[ok], way[:, ok]
        like = alike(pair[of], *way)
        best = np.lexsort((way[0], like, of))
        best = best[np.append(of[best][1:] != of[best][:-1], True)] if len(best) else best
        best = best[like[best] >= threshold]
        for c, v in zip(out, (pair[of[best]], way[0, best], way[1, best], np.maximum(0, way[2, best]), np.minimum(way[3, best], yn[pair[of[best]]] - 1)), strict=True):
            c.append(v)
        split = (b - a) > 1
        split[of[best]] = False
        gap = np.append(0, at[i[1:]] - at[i[:-1]])
        gap[start] = 0
        widest = np.maximum.reduceat(gap, start)
        cut = np.flatnonzero(gap == widest[seg])
        cut = i[cut[np.append(True, seg[cut][1:] != seg[cut][:-1])]]
        cut = np.where(widest > 1, cut, (a + b) // 2)  # all in common but out of order: halves
        pair, a, b, cut = pair[split], a[split], b[split], cut[split]
        pair, a, b = np.append(pair, pair), np.append(a, cut), np.append(cut, b)


@tidy
def _verify(batches: Iterator[pa.RecordBatch], least: int, threshold: float, shingle: int) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, 3):
        d, p, at = (t.column(c).to_numpy() for c in ("d", "p", "lo"))
        d, p, dl, pl = d[::2], p[::2], at[::2].astype(np.int64), at[1::2].astype(np.int64)
        ahead = np.where(d == p, dl - pl, np.int64(FAR))
        tokens, cuts = tokens_of(t.column("part").combine_chunks())
        lo = 0
        while lo < len(d):
            hi = min(len(d), max(lo + 1, int(np.searchsorted(cuts[::2], cuts[2 * lo] + TOKENS, "right")) - 1))
            sides = []
            for side in (0, 1):
                begin, n = cuts[2 * lo + side : 2 * hi : 2], np.diff(cuts)[2 * lo + side : 2 * hi : 2]
                sides += [tokens[spread(begin, n)[1]], np.append(0, np.cumsum(n))]
            i, first, last, _, _ = stretches_of_pairs(*sides, ahead[lo:hi], least, threshold, shingle)
            i += lo
            yield pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(p[i]), pa.array((first + dl[i]).astype(np.int32)), pa.array((last + dl[i]).astype(np.int32))], ["d", "p", "lo", "hi"])
            lo = hi


@tidy
def _around(batches: Iterator[pa.RecordBatch], shingle: int, least: int) -> Iterator[pa.RecordBatch]:
    """Each window with 32 bits of every shingle that a passage of least length around its centre can have."""
    names = ["k", "pos", "w", "m", "ask"]
    for b in batches:
        at, flat, data, cut = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py(), b.column(1).flatten(), [], 0
        c = flat.field("c").to_numpy()
        for i, grams in _grams_of(b.column(0), shingle):
            part = (grams >> U(32)).astype(np.uint32)
            data += [part[max(0, x - least + 1) : x + least].tobytes() for x in c[at[i] : at[i + 1]].tolist()]
            if len(data) >= 2000 or i + 1 == len(b):
                own = flat.slice(cut, len(data))
                yield pa.RecordBatch.from_arrays([*(own.field(f) for f in names), pa.array(data, pa.binary())], [*names, "part"])
                cut, data = cut + len(data), []


def in_common_between(ids: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the rows ``left`` with the rows ``right``, of tokens ``ids`` in order, distinct within a ``row`` of ``n``."""
    sides = []
    for some in (left, right):
        place = np.full(n, -1)
        place[some] = np.arange(len(some))
        own = place[row] >= 0
        sides.append((ids[own], place[row[own]]))
    most = int(ids.max(initial=-1)) + 1
    shared = (np.bincount(sides[0][0], minlength=most) > 0) & (np.bincount(sides[1][0], minlength=most) > 0)
    number = np.cumsum(shared) - 1
    sides = [(number[i[shared[i]]], r[shared[i]]) for i, r in sides]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, np.count_nonzero(shared), columns):
        m = []
        for (i, r), some in zip(sides, (left, right), strict=True):
            a, b = np.searchsorted(i, [lo, lo + columns])
            m.append(np.zeros((len(some), columns), np.float32))
            m[-1][r[a:b], i[a:b] - lo] = 1
        out += m[0] @ m[1].T
    return out


def worth_comparing(ids: np.ndarray, row: np.ndarray, asks: np.ndarray, pos: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Rows that have ``need`` of their tokens in common with the rows of the other side taken together.

    Tokens ``ids`` are distinct within a ``row``. A row with fewer cannot have as many in
    common with any one of them, so it is left out, and then what only it held up. Rows are in
    order of ``pos``; a window that is on both sides is not held up by itself.
    """
    here, last = np.ones(len(asks), bool), len(asks) + 1
    twin = np.arange(len(asks))
    same = np.flatnonzero(pos[1:] == pos[:-1])
    twin[same], twin[same + 1] = same + 1, same
    paired = twin != np.arange(len(asks))
    most = int(ids.max(initial=-1)) + 1
    while here.any() and np.count_nonzero(here) < last:
        last = np.count_nonzero(here)
        live = here[row]
        ids, row = ids[live], row[live]
        mine = asks[row]
        asked, told = np.bincount(ids[mine], minlength=most), np.bincount(ids[~mine], minlength=most)
        others = np.where(mine, told[ids], asked[ids]) - (paired & here[twin])[row]
        here = here & (np.bincount(row[others > 0], minlength=len(asks)) >= need)
    return here


def dense_enough(hits: np.ndarray, least: int, threshold: float, again: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``hits`` with a stretch of ``least`` places or more of which the share ``threshold`` are true; false ones that come ``again`` do not count."""
    run = np.zeros((len(hits), hits.shape[1] + 1))
    weight = hits - threshold
    if again is not None:
        weight = np.where(again, np.maximum(weight, 0), weight)
    np.cumsum(weight, axis=1, out=run[:, 1:])
    return (run[:, least:] - np.minimum.accumulate(run[:, : run.shape[1] - least], axis=1) >= -1e-6).any(1)


def may_repeat(told: np.ndarray, tokens: np.ndarray, both: np.ndarray, least: int, threshold: float) -> np.ndarray:
    """Rows of ``told`` (which of the places of ``tokens`` another text has too) that may hold a stretch of ``least`` places or more with Jaccard similarity of ``threshold``.

    ``both`` are the distinct tokens in common, c of them in the stretch. Both sides together
    then miss c (1 / threshold - 1) distinct ones at most, so some ``least`` places do not miss more.
    """
    n = len(tokens)
    if n < least:
        return np.zeros(len(told), bool)
    by = np.argsort(tokens, kind="stable")
    before = np.full(n, -1)
    again = tokens[by[1:]] == tokens[by[:-1]]
    before[by[1:][again]] = by[:-1][again]
    start, place = np.arange(n - least + 1)[:, None], np.arange(n)
    first = (place >= start) & (place < start + least) & (before < start)
    missed = (~told).astype(np.float32) @ first.T.astype(np.float32)
    return missed.min(1) <= both * (1 / threshold - 1) + 1e-3


def _partners(table: pa.Table, least: int, threshold: float, shingle: int, bits: int) -> pa.Table:
    """For each asking window of the blocks in ``table`` an earlier window of its key that seems to near-repeat it, if there is one."""
    table = table.sort_by([("k", "ascending"), ("x", "ascending"), ("y", "ascending"), ("pos", "ascending"), ("ask", "ascending")])
    k, x, y, pos, ask = (table.column(c).to_numpy() for c in ("k", "x", "y", "pos", "ask"))
    tokens, cuts = tokens_of(table.column("part").combine_chunks())
    n, sizes = len(k), np.diff(cuts)
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    text, begin = pos >> bits, np.maximum(0, (pos & ((1 << bits) - 1)) - least + 1)
    group, ends = np.cumsum(new) - 1, np.append(np.flatnonzero(new), n)
    # a block's tokens have numbers of their own, one after another
    of = np.repeat(np.arange(n), sizes)
    ids = pa.array((group[of] << 32) | tokens).dictionary_encode().indices.to_numpy().astype(np.int64)
    once, row = np.divmod(distinct_(ids * n + of), n)
    distinct = np.bincount(row, minlength=n)
    plain, most = distinct == sizes, np.minimum(least, distinct)
    need = threshold * np.minimum(most, np.minimum.reduceat(most, ends[:-1])[group]) - 1e-3
    twin = np.cumsum(np.append(True, new[1:] | (pos[1:] != pos[:-1])))
    here = worth_comparing(once, row, ask, twin, need)
    first = np.searchsorted(once, np.append(ids[np.minimum(cuts[ends[:-1]], len(ids) - 1)], len(ids))) if len(ids) else np.zeros(len(ends), np.int64)
    met = np.full(n, -1)
    rows = Rows(tokens, cuts, ids, once, row, plain, text, begin, ends, first)
    waiting, held = [], 0
    for b, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        asks, others = np.flatnonzero(here[lo:hi] & ask[lo:hi]), np.flatnonzero(here[lo:hi] & ~ask[lo:hi])
        if not len(asks) or not len(others):
            continue
        base = int(once[first[b]])
        own = once[first[b] : first[b + 1]] - base, row[first[b] : first[b + 1]] - lo
        for left in range(0, len(asks), SIDE):
            for right in range(0, len(others), SIDE):
                i, j = asks[left : left + SIDE], others[right : right + SIDE]
                i = i[met[lo + i] < 0]
                if not len(i):
                    break
                both = in_common_between(*own, i, j, hi - lo)
                i, j = i + lo, j + lo
                likely = np.nonzero((both >= threshold * np.minimum(most[i][:, None], most[j]) - 1e-3) & (pos[i][:, None] > pos[j]))
                waiting.append((i[likely[0]], j[likely[1]], both[likely]))
                held += len(likely[0])
                if len(others) > SIDE or held > PAIRS:
                    rows.meet(waiting, met, least, threshold, shingle)
                    waiting, held = [], 0
    rows.meet(waiting, met, least, threshold, shingle)
    a = np.flatnonzero(met >= 0)
    a, o = table.take(pa.array(a)), table.take(pa.array(met[a]))
    return pa.table([*(a.column(c) for c in ("k", "pos", "w", "m")), *(o.column(c) for c in ("pos", "w", "m"))], ["k", "pos", "w", "m", "o", "ow", "om"])


def distinct_(v: np.ndarray) -> np.ndarray:
    v = np.sort(v)
    return v[np.append(True, v[1:] != v[:-1])[: len(v)]]


class Rows:
    """Rows of tokens, of which pairs are compared; ``ids`` number the tokens of a block, ``once`` are those of a ``row`` without repeats, in order."""

    def __init__(self, tokens, cuts, ids, once, row, plain, text, begin, ends, first):
        self.tokens, self.cuts, self.ids, self.plain, self.text, self.begin = tokens, cuts, ids, plain, text, begin
        self.n, self.sizes = len(cuts) - 1, np.diff(cuts)
        self.pairs = once * self.n + row  # sorted
        of = np.repeat(np.arange(self.n), self.sizes)
        some = np.flatnonzero(~plain[of])
        some = some[np.argsort(ids[some] * self.n + of[some], kind="stable")]
        same = (ids[some[1:]] == ids[some[:-1]]) & (of[some[1:]] == of[some[:-1]])
        #: Places of tokens that their row has before.
        self.again = np.zeros(len(ids), bool)
        self.again[some[1:][same]] = True
        # a block's rows by its tokens as a table, while that is small
        base = once[np.minimum(first, len(once) - 1)] if len(once) else first
        width, high = np.diff(np.append(base[:-1], ids.max(initial=-1) + 1)), np.diff(ends)
        block = np.repeat(np.arange(len(high)), high)
        self.at, self.table = (np.cumsum(width * high) - width * high - base[:-1])[block] + width[block] * (np.arange(self.n) - ends[:-1][block]), None
        if int((width * high).sum()) <= CELLS:
            self.table = np.zeros(int((width * high).sum()), bool)
            self.table[self.at[row] + once] = True

    def places(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows ``of``, a line for each, and which of them there are."""
        place = np.arange(int(self.sizes[of].max(initial=0)))
        return np.minimum(self.cuts[of][:, None] + place, len(self.ids) - 1), place < self.sizes[of][:, None]

    def has(self, i: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which places of row ``of`` hold a token of row i of the same block, a line for each pair."""
        at, inside = self.places(of)
        if self.table is not None:
            return self.table[self.at[i][:, None] + np.where(inside, self.ids[at], self.ids[self.cuts[i]][:, None])] & inside
        want = self.ids[at] * self.n + i[:, None]
        found = np.searchsorted(self.pairs, want.ravel()).reshape(want.shape)
        return (self.pairs[np.minimum(found, len(self.pairs) - 1)] == want) & inside

    def likely(self, i: np.ndarray, j: np.ndarray, both: np.ndarray, least: int, threshold: float) -> np.ndarray:
        """Pairs that the numbers of places in common do not rule out."""
        share = 1 / (1 + (1 / threshold - 1) / 2)
        told = self.has(i, j)
        ok = np.flatnonzero(dense_enough(told, least, threshold))
        i, j, both, told = i[ok], j[ok], both[ok], told[ok]
        mine = self.has(j, i)
        good = np.ones(len(i), bool)
        plain = self.plain[i]
        p = np.flatnonzero(~plain)  # a token's repeats may be missing, as sets are compared
        good[p] = dense_enough(mine[p], least, threshold, self.again[self.places(i)[0][p, : mine.shape[1]]])
        p = p[good[p]]
        each, n = np.unique(i[p], return_counts=True)
        for r in each[n > 3].tolist():
            own = p[i[p] == r]
            good[own] = may_repeat(mine[own, : self.sizes[r]], self.ids[self.cuts[r] : self.cuts[r + 1]], both[own], least, threshold)
        p = np.flatnonzero(plain)
        run = np.zeros((len(p), mine.shape[1] + 1), np.int32)
        np.cumsum(mine[p], axis=1, out=run[:, 1:])
        fewest = least - (run[:, least:] - run[:, : run.shape[1] - least]).max(1, initial=0)
        good[p] = (fewest <= both[p] * (1 / threshold - 1) + 1e-3) & dense_enough(mine[p], least, threshold)
        # one side misses half of what both may miss at most; where tokens repeat, its stretch may be short
        one = np.flatnonzero(good & plain & self.plain[j])
        good[one] = dense_enough(mine[one], least, share)
        rest = one[~good[one]]
        good[rest] = dense_enough(told[rest], int(np.ceil(threshold * least - 1e-6)), share)
        return ok[good]

    def meet(self, waiting: list[tuple[np.ndarray, ...]], met: np.ndarray, least: int, threshold: float, shingle: int) -> None:
        """Into ``met`` the first row, by the tokens in common, that each asking one near-repeats: one is tried for each, then two more, then four."""
        if not waiting:
            return
        i, j, both = (np.concatenate(c) for c in zip(*waiting, strict=True))
        by = np.lexsort((j, -both, i))
        i, j, both = i[by], j[by], both[by]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        lo = 0
        while len(i):
            turn = np.flatnonzero(nth <= 2 * lo)
            for at in range(0, len(turn), PAIRS // 8):
                some = turn[at : at + PAIRS // 8]
                some = some[self.likely(i[some], j[some], both[some], least, threshold)]
                if not len(some):
                    continue
                a, o = i[some], j[some]
                ahead = np.where(self.text[a] == self.text[o], self.begin[a] - self.begin[o], np.int64(FAR))
                sides = [c for r in (a, o) for c in (self.tokens[spread(self.cuts[r], self.sizes[r])[1]], np.append(0, np.cumsum(self.sizes[r])))]
                good = np.unique(stretches_of_pairs(*sides, ahead, least, threshold, shingle)[0])[::-1]
                for r in good[met[a[good]] < 0].tolist():
                    met[a[r]] = o[r]
            rest = (nth > 2 * lo) & (met[i] < 0)
            i, j, both, nth = i[rest], j[rest], both[rest], nth[rest]
            lo = 2 * lo + 1


def repeats(base: DataFrame, bits: int, words: int = 50, shingle: int = 5, threshold: float = 0.8, size: int = 0) -> DataFrame:
    """Verified passages (d, p, lo, hi): shingles lo to hi of text d near-repeat a passage of text p, which comes first.

    ``base(key, text)`` with a unique key that orders the texts, of about ``size`` bytes in all.
    """
    least = words - shingle + 1
    texts = base.where("text is not null").select("key", "text")
    mask = (1 << bits) - 1

    def verified(meetings: DataFrame) -> DataFrame:
        """Passages of windows (pos, w, m) that near-repeat those they met (o, ow, om)."""
        left, right = F.shiftright("w", 31), F.col("w").bitwiseAND((1 << 31) - 1)
        oleft, oright = F.shiftright("ow", 31), F.col("ow").bitwiseAND((1 << 31) - 1)
        rect = {"c": F.col("pos").bitwiseAND(mask), "l": F.least(left, oleft), "r": F.least(right, oright), "m": F.col("m"), "oc": F.col("o").bitwiseAND(mask), "om": F.col("om")}
        rects = meetings.select(F.shiftright("pos", bits).alias("d"), F.shiftright("o", bits).alias("p"), *(v.cast("int").alias(n) for n, v in rect.items()))
        pairs = rects.repartition("d", "p").sortWithinPartitions("d", "p")  # of a pair, at most a text's own windows
        asked = pairs.mapInArrow(lambda it: _candidates(it, least), "d long, p long, n int, role int, lo int, hi int")
        key = F.when(F.col("role") == 0, F.col("d")).otherwise(F.col("p")).alias("_key")
        other = F.when(F.col("role") == 0, F.col("p")).otherwise(F.col("d"))
        asked = asked.groupBy(key, F.pmod(F.xxhash64(other), F.lit(SALTS)).alias("_salt")).agg(F.collect_list(F.struct("d", "p", "n", "role", "lo", "hi")).alias("asked"))
        asked = stored(asked)
        likely, _ = split_by_keys(texts, "key", asked, "_key")
        parts = likely.join(asked, F.col("key") == F.col("_key")).select("text", "asked").mapInArrow(lambda it: _slices(it, shingle), "d long, p long, n int, role int, lo int, part binary")
        both = parts.repartition("d", "p", "n").sortWithinPartitions("d", "p", "n", "role")  # two rows of each
        return durable(both.mapInArrow(lambda it: _verify(it, least, threshold, shingle), "d long, p long, lo int, hi int").distinct())

    def unanswered(rows: DataFrame, new: DataFrame) -> DataFrame:
        """``rows`` without those whose centre a passage of their text covers."""
        covered = new.select(F.col("d").alias("_d"), "lo", "hi")
        mine = (F.shiftright("pos", bits) == F.col("_d")) & F.col("pos").bitwiseAND(mask).between(F.col("lo"), F.col("hi"))
        return rows.join(covered, mine, "left_anti")

    buckets = size // BUCKET + 8
    dealt = texts.mapInArrow(lambda it: _dealt(it, shingle, least, bits, buckets), "bucket int, known boolean, rows binary")
    pool = stored(dealt.groupBy("bucket").applyInArrow(_shared, "k long, pos long, w long, m int"))
    asking, found = pool, []
    for _ in range(STARS):
        heads = durable(pool.groupBy("k").agg(F.min(F.struct("pos", "w", "m")).alias("_f")).select("k", F.col("_f.pos").alias("o"), F.col("_f.w").alias("ow"), F.col("_f.m").alias("om")))
        met = stored(asking.join(heads, "k").where("pos > o"))
        new = verified(met)
        found.append(new)
        asking = stored(unanswered(met.select("k", "pos", "w", "m"), new))
        if asking.isEmpty():
            break
        # answered windows stay as partners of those that still ask
        rest = pool.join(heads.select("k", "o"), "k").where("pos > o") if len(found) > 1 else met  # at first all ask
        pool = stored(rest.select("k", "pos", "w", "m").join(asking.select("k").distinct(), "k"))
        discard(met)
    else:
        own = asking.select(F.col("k").alias("_k"), F.col("pos").alias("_pos"))
        pool = pool.join(own, (F.col("k") == F.col("_k")) & (F.col("pos") == F.col("_pos")), "left").select("k", "pos", "w", "m", F.col("_k").isNotNull().alias("ask"))
        pool = stored(pool)
        # a key's askers in bx blocks meet all its windows in by blocks
        size = lambda n: F.ceil(n / BLOCK).cast("int")
        counts = durable(pool.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("ask").alias("a")).where("n > 1 and a > 0").select("k", "n", "a", size(F.col("a")).alias("bx"), size(F.col("n")).alias("by")))
        wanted = pool.join(counts.select("k"), "k").groupBy(F.shiftright("pos", bits).alias("_key")).agg(F.collect_list(F.struct("k", "pos", "w", "m", "ask", F.col("pos").bitwiseAND(mask).alias("c"))).alias("l"))
        wanted = stored(wanted)  # a text's own windows
        likely, _ = split_by_keys(texts, "key", wanted, "_key")
        around = likely.join(wanted, F.col("key") == F.col("_key")).select("text", "l").mapInArrow(lambda it: _around(it, shingle, least), "k long, pos long, w long, m int, ask boolean, part binary")
        around = stored(around).join(counts.drop("n", "a"), "k")
        block = lambda n: F.pmod(F.xxhash64("pos"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = around.withColumns({"x": every("bx"), "y": block("by"), "ask": F.lit(False)})
        dealt = dealt.unionByName(around.where("ask").withColumns({"x": block("bx"), "y": every("by")})).drop("bx", "by")
        tasks = counts.agg(F.sum(F.col("bx") * F.col("n") + F.col("by") * F.col("a"))).first()[0] or 0
        dealt = dealt.groupBy(F.pmod(F.xxhash64("k", "x", "y"), F.lit(int(tasks) // TASK + 8)).alias("_task"))
        met = dealt.applyInArrow(lambda t: _partners(t, least, threshold, shingle, bits), "k long, pos long, w long, m int, o long, ow long, om int")
        found.append(verified(met))
    out = found[0]
    for new in found[1:]:
        out = out.unionByName(new)
    return out.distinct()


@tidy
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [count_words(b.column(2).slice(lo, hi - lo)) for lo, hi in chunks(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *out]))], ["key", "doc_id", "n_words"])


def _bits(docs: DataFrame) -> tuple[int, int]:
    """Bits of a place in the longest text, and the bytes of all."""
    longest, size = docs.agg(F.max(F.octet_length("text")), F.sum(F.octet_length("text"))).first()
    return max(1, int(longest or 0).bit_length()), int(size or 0)


def passage_report(docs: DataFrame, words: int = 50, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with the near-repeated passages found in it.

    n_passages passages of at least ``words`` words and n_removed words of it repeat one of an
    earlier text (smaller doc_id) or place; class_id is the smallest doc_id connected by such
    passages. Null texts and texts of fewer words have none; repeated rows count as texts of
    their own, null ids come first; further columns are ignored.
    """
    bits, size = _bits(docs)
    base = keyed(docs, ["doc_id", "text"], most=1 << (62 - bits))
    texts, copies = without_copies(base)
    found = durable(repeats(texts, bits, words, shingle, threshold, size))
    spans = found.groupBy(F.col("d").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    join_ = lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["hi"] + shingle >= s["lo"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["lo"].alias("lo"), F.greatest(F.element_at(a, -1)["hi"], s["hi"]).alias("hi"))))).otherwise(F.concat(a, F.array(s)))
    merged = spans.select("_key", F.aggregate("spans", F.array().cast("array<struct<lo:int,hi:int>>"), join_).alias("spans"))
    counts = base.mapInArrow(_counts, "key long, doc_id long, n_words long")
    counts = durable(counts)
    whole = counts.join(copies, F.col("key") == F.col("copy")).where(F.col("n_words") >= words).select("copy", F.col("first").alias("p"))
    root = components(found.where("d <> p").select("d", "p").unionByName(whole.select(F.col("copy").alias("d"), "p")), "d", "p")
    root = root.dropDuplicates(["node"]).withColumnsRenamed({"node": "_n", "root": "_r"})
    named = base.select(F.col("key").alias("_r2"), F.col("doc_id").cast("long").alias("class_id"))
    out = counts.join(merged, F.col("key") == F.col("_key"), "left").join(root, F.col("key") == F.col("_n"), "left").join(whole.select("copy"), F.col("key") == F.col("copy"), "left")
    out = out.join(named, F.coalesce("_r", "key") == F.col("_r2"), "left")
    size = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["hi"] - s["lo"] + shingle), F.lit(0)).cast("long")
    copied = F.col("copy").isNotNull()
    return out.select("doc_id", "class_id", "n_words", F.when(copied, F.col("n_words")).otherwise(size).alias("n_removed"), F.when(copied, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_passages"))


@tidy
def _cut(batches: Iterator[pa.RecordBatch], shingle: int, words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rest, texts, all_spans = (b.column(c) for c in range(3))
        out, stays = [], []
        for i in range(len(b)):
            g, spans = Words(texts.slice(i, 1)), all_spans[i].as_py()
            if spans[0]["hi"] >= 1 << 30 and len(g.start) < words:  # a copy, but no passage
                out.append(texts[i].as_py())
                stays.append(True)
                continue
            keep = np.ones(len(g.data), bool)
            for s in spans:
                keep[g.start[s["lo"]] : g.end[min(s["hi"] + shingle, len(g.end)) - 1]] = False
            out.append(g.data[keep].tobytes().decode())
            stays.append(bool(keep[g.start].any()))  # a text whose words are all gone goes
        yield pa.RecordBatch.from_arrays([rest, pa.array(out, pa.string())], ["rest", "text"]).filter(pa.array(stays, pa.bool_()))


def remove_passages(docs: DataFrame, words: int = 50, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs(doc_id, text, ...)`` with every near-repeated passage but its first cut out of the texts.

    Earlier is as in ``passage_report``: rows with null ids come first, rows with equal ids in
    any one order. A text with no words left goes, so of repeated rows of a passage's length
    one stays. Null texts, texts without words and texts of fewer than ``words`` words stay as
    they are; very long texts are taken one at a time; an empty table gives no rows. All
    columns are kept, whatever their names.
    """
    bits, size = _bits(docs)
    base = keyed(packed(docs), ["text", "rest"], most=1 << (62 - bits))
    texts, copies = without_copies(base.select("key", "text"))
    found = durable(repeats(texts, bits, words, shingle, threshold, size))
    whole = copies.select(F.col("copy").alias("_key"), F.array(F.struct(F.lit(0).alias("lo"), F.lit((1 << 31) - 64).alias("hi"))).alias("spans"))
    spans = durable(found.groupBy(F.col("d").alias("_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).unionByName(whole))
    likely, untouched = split_by_keys(base, "key", spans, "_key")
    joined = likely.join(spans, F.col("key") == F.col("_key"), "left")
    untouched = untouched.select("rest", "text").unionByName(joined.where("spans is null").select("rest", "text"))
    cut = joined.where("spans is not null").select("rest", "text", "spans").mapInArrow(lambda it: _cut(it, shingle, words), joined.select("rest", "text").schema)
    return unpacked(untouched.unionByName(cut), docs.columns)
