"""Pairs of windows and of pieces are compared many at once, with the results of one by one."""

import numpy as np
import pyarrow as pa

from sparkfield.llm import passages, textgrid


def some_pair(rng):
    kind = rng.integers(0, 4)
    base = rng.integers(0, [30, 3, 10**6, 10**6][kind], 300)
    x, y = (base[rng.integers(0, 40) :][: rng.integers(1, 200)].copy() for _ in range(2))
    y[rng.random(len(y)) < rng.choice([0.02, 0.1, 0.3])] = 7
    if kind == 3:
        x, y = np.concatenate([x[:50], y[:60], x[50:]]), np.concatenate([y, x[:60]])
    return x.astype(np.uint32), y.astype(np.uint32), None if rng.random() < 0.6 else int(rng.integers(0, 150))


def test_stretches_of_pairs_are_those_of_each_pair():
    rng, found = np.random.default_rng(8), 0
    for least in (12, 46) * 15:
        xs, ys, ahead = zip(*(some_pair(rng) for _ in range(20)), strict=True)
        sides = [a for s in (xs, ys) for a in (np.concatenate(s), np.append(0, np.cumsum([len(v) for v in s])))]
        far = np.array([passages.FAR if a is None else a for a in ahead])
        got = zip(*(c.tolist() for c in passages.stretches_of_pairs(*sides, far, least, 0.8)), strict=True)
        want = [(i, *map(int, r)) for i, (x, y, a) in enumerate(zip(xs, ys, ahead, strict=True)) for r in passages.common_stretches(x, y, least, 0.8, 5, a)]
        assert sorted(got) == sorted(want)
        found += len(want)
    assert found > 300


def test_blocks_are_compared_together(monkeypatch):
    """40 keys of five earlier windows and one that near-repeats the fourth alone: a few calls compare all, not one or more for each key."""
    calls = []
    for name in ("common_stretches", "stretches_of_pairs"):
        old = getattr(passages, name)
        monkeypatch.setattr(passages, name, lambda *a, old=old: calls.append(1) or old(*a))
    parts, place = [], np.arange(91)
    for k in range(40):
        own = 1000 * k + place
        for j in range(6):
            t = np.where(place % 15 >= 12, 10**6 * (j + 1) + own, own)
            parts.append(np.where(place == 60, 5, parts[-2]) if j == 5 else t)
    n = len(parts)
    cols = {"k": np.arange(n) // 6, "x": np.zeros(n, np.int32), "y": np.zeros(n, np.int32), "pos": (np.arange(n) << 20) + 45, "w": np.zeros(n, np.int64), "m": np.zeros(n, np.int32), "ask": np.arange(n) % 6 == 5}
    table = pa.table(cols | {"part": pa.array([t.astype(np.uint32).tobytes() for t in parts], pa.binary())})
    for cells in (passages.CELLS, 0):
        monkeypatch.setattr(passages, "CELLS", cells)
        calls.clear()
        out = passages._partners(table, 46, 0.8, 5, 20)
        assert sorted(zip(out["pos"].to_pylist(), out["o"].to_pylist(), strict=True)) == [(((6 * k + 5) << 20) + 45, ((6 * k + 3) << 20) + 45) for k in range(40)]
        assert 0 < len(calls) < 10, len(calls)


def test_no_group_is_cut():
    keys = np.repeat(np.arange(60), np.random.default_rng(9).integers(1, 9, 60))
    for size in (1, 2, 7, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size] // 7), pa.array(keys[i : i + size] % 7), pa.array(np.arange(len(keys))[i : i + size])], ["d", "p", "v"]) for i in range(0, len(keys), size)]
        parts = [t for t in passages.whole_groups(iter(batches), 2) if len(t)]
        own = [{(d, p) for d, p in zip(t["d"].to_pylist(), t["p"].to_pylist(), strict=True)} for t in parts]
        assert sum(map(len, own)) == 60 and sum((t["v"].to_pylist() for t in parts), []) == list(range(len(keys)))


def test_words_are_counted_without_hashes():
    texts = pa.array(["a b", None, "", " x", "é1, two\nthree ", "--", "end"])
    assert textgrid.count_words(texts).tolist() == np.diff(textgrid.Words(texts).at).tolist() == [2, 0, 0, 1, 3, 0, 1]
    assert textgrid.count_words(texts.slice(2, 0)).tolist() == []
