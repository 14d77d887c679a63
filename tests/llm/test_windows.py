"""Dealing of windows to buckets, and what the block step compares."""

import numpy as np
import pyarrow as pa

from sparkfield.llm import passages


def windows(keys):
    rows = np.zeros(len(keys), passages.WINDOW)
    rows["k"], rows["pos"] = np.array(keys, np.int64), np.arange(len(keys))
    return rows


def test_windows_of_shared_keys_and_no_others():
    """Whatever the batches: keys once in all go, keys of two batches or often in one stay with all their windows; a hot key fills no bucket."""
    rng = np.random.default_rng(5)
    keys = np.concatenate([rng.integers(-(2**62), 2**62, 3000), np.repeat(rng.integers(-(2**62), 2**62, 400), 2), np.full(4000, 77 << 20)])
    rng.shuffle(keys)
    batches, buckets = np.array_split(windows(keys), 7), {}
    for b in batches:
        for bucket, known, rows in passages.deal(b, 16):
            buckets.setdefault(bucket, []).append((known, rows.tobytes()))
    assert max(sum(len(r) for _, r in v) for v in buckets.values()) < 2 * sum(len(r) for v in buckets.values() for _, r in v) / 16
    got = []
    for v in buckets.values():
        table = passages._shared(pa.table({"known": [k for k, _ in v], "rows": pa.array([r for _, r in v], pa.binary())}))
        got += zip(table["k"].to_pylist(), table["pos"].to_pylist(), strict=True)
    each, n = np.unique(keys, return_counts=True)
    shared = set(each[n > 1].tolist())
    assert sorted(got) == sorted((int(k), i) for i, k in enumerate(keys) if int(k) in shared)


def best_similarity(x, y, least):
    """The highest Jaccard similarity of a stretch of ``least`` places of x or more and any stretch of y."""
    best = 0.0
    for a in range(len(x) - least + 1):
        for b in range(a + least, len(x) + 1):
            own = set(x[a:b].tolist())
            for lo in range(len(y)):
                told = set()
                for v in y[lo:].tolist():
                    told.add(v)
                    best = max(best, len(own & told) / len(own | told))
    return best


def test_no_passage_is_left_out_unseen():
    rng = np.random.default_rng(6)
    seen = [0, 0]
    for turn in range(60):
        x = np.arange(16) if turn % 3 else np.arange(16) % rng.integers(5, 16)
        y = np.where(rng.random(16) < rng.choice([0.05, 0.1, 0.3]), 100 + np.arange(16), x)
        y = np.delete(y, rng.integers(0, 16, rng.integers(0, 3)))
        may = passages.may_repeat(np.isin(x, y)[None], x, np.array([len(np.intersect1d(x, y))]), 10, 0.8)[0]
        real = best_similarity(x, y, 10) >= 0.8
        assert may or not real
        seen[int(real)] += 1
    assert min(seen) > 5


def block(texts, asks):
    n = len(texts)
    cols = {"k": np.zeros(n, np.int64), "x": np.zeros(n, np.int32), "y": np.zeros(n, np.int32), "pos": (np.arange(n) << 20) + 45, "w": np.zeros(n, np.int64), "m": np.zeros(n, np.int32), "ask": asks}
    return pa.table(cols | {"part": pa.array([t.astype(np.uint32).tobytes() for t in texts], pa.binary())})


def test_windows_with_edits_everywhere_are_not_compared(monkeypatch):
    """Of 91 shingles five in 24 differ: 38 of 46 places are in common, of both sides' 54 shingles that is too few; one copy is found."""
    calls, old = [], passages.common_stretches
    monkeypatch.setattr(passages, "common_stretches", lambda *a: calls.append(1) or old(*a))
    texts = []
    for i in range(40):
        t = np.arange(91)
        texts.append(np.where(t % 24 >= 19, 1000 * (i + 1) + t, t))
    out = passages._partners(block(texts, np.arange(40) >= 20), 46, 0.8, 5, 20)
    assert len(out) == 0 and len(calls) < 40, len(calls)
    texts.append(texts[3].copy())
    out = passages._partners(block(texts, np.arange(41) >= 20), 46, 0.8, 5, 20)
    assert out["pos"].to_pylist() == [(40 << 20) + 45] and out["o"].to_pylist() == [(3 << 20) + 45]
