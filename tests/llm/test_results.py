"""Results against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfield.llm import embedding_graph, html_text, ngram_join, packing, passages, quality, queries, substring_exact, textgrid, url_filter
from tests.conftest import SF, SF01

from .conftest import prose

SF1 = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_word_grid_equals_regular_expression():
    t = ["Hello  World a", "a b c d e f", "", "x", None, "É é foo-bar 12 34\x7fz", "q"]
    g = textgrid.Words(pa.array(t).slice(1))
    got = [[bytes(g.data[g.start[j] : g.end[j]]).decode().translate(LOW) for j in range(g.at[i], g.at[i + 1])] for i in range(6)]
    assert got == [words(x) for x in t[1:]]
    grams, bounds = g.grams(5)
    assert np.diff(bounds).tolist() == [2, 0, 1, 0, 3, 1]
    h = textgrid.Words(pa.array(["A b C d e f"])).grams(5)[0]
    assert h.tolist() == grams[:2].tolist()


def test_substrings_equal_brute_force(spark, texts, make):
    rows = dict(texts) | {100_000 + i: prose(i, 40) + " " + prose(3, 30) + (prose(4, 25) * 2 if i % 2 else "") for i in range(6)}
    got = {r.doc_id: r for r in substring_exact.remove_repeats(make(rows.items())).collect()}
    seen = set()
    for i in sorted(rows):
        b = (rows[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i].n_removed, got[i].kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), i


def near(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else "changed" + str(r.randrange(999)) for w in text.split(" "))


@pytest.fixture(scope="module")
def family(make):
    """A group of near copies of very different likeness, one passage in all of another group, and loners."""
    base = prose(50, 150)
    rows = [(i, near(base, i, 0.01 + 0.00015 * i)) for i in range(60)]
    rows += [(100 + i, prose(200 + i, 15) + " " + prose(60, 60) + " " + prose(300 + i, 15)) for i in range(30)]
    rows += [(200 + i, prose(400 + i, 80)) for i in range(40)]
    return make(rows), dict(rows)


def test_ngram_classes_equal_brute_force(family):
    df, rows = family
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t in rows.items())}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.class_id for r in ngram_join.classes(df).collect()}
    wrong = [i for i in rows if got[i] != find(i)]
    assert len(wrong) <= 1  # a pair right at the threshold may escape the bands


@pytest.mark.parametrize("task", [2048, 20])
def test_ngram_links_equal_brute_force(make, monkeypatch, task):
    monkeypatch.setattr(ngram_join, "TASK", task)
    base = prose(50, 150)
    rows = [(i, near(base, i, 0.01 + 0.00015 * i)) for i in range(60)] + [(60, near(base, 0, 0.01)), (61, prose(51, 90))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t in rows)}
    want = {a: sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    got = {r.doc_id: r.n_links for r in ngram_join.classes(make(rows)).collect()}
    assert max(want.values()) > ngram_join.SMALL and want[61] == 0
    assert all(got[i] <= want[i] for i in want) and sum(want.values()) - sum(got.values()) <= 2  # one pair at the threshold may escape the bands


def test_bayes_bound_keeps_like_pairs():
    least = ngram_join.least_matches(0.8, 1e-4)
    assert least[-1] / ngram_join.HASHES < 0.8 and all(b > a for a, b in zip(least, least[1:], strict=False))
    rng = np.random.default_rng(1)
    zero, like = np.zeros((500, 252), np.uint8), lambda s: (rng.random((500, 252)) > s).astype(np.uint8)
    kept, gone = (len(ngram_join.survivors(zero, like(s), 0.8, 1e-4)) for s in (0.85, 0.5))
    assert kept >= 498 and gone == 0


def test_compact_windows_equal_definition():
    rng = np.random.default_rng(0)
    grams, bounds, least = rng.integers(0, 2**63, 400).astype(np.uint64), np.array([0, 150, 155, 400]), 20
    grams[30], grams[300:380] = grams[40], np.tile(grams[300:305], 16)  # a tie, and a periodic stretch
    for i, text, c, lo, hi, tie in passages.compact_windows(grams, bounds, least, least + 4):
        got = {tuple(map(int, r)) for r in zip(text, c, lo, hi, tie, strict=True)}
        v = (((grams >> np.uint64(32)).astype(np.uint32) ^ passages._XOR[i]) * passages._MUL[i]).astype(np.int64)
        want = set()
        for t in range(3):
            x = v[bounds[t] : bounds[t + 1]]
            spans, tail = {}, {}
            for k in range(len(x)):
                a, b = k, k
                while a and x[a - 1] > x[k]:
                    a -= 1
                while b + 1 < len(x) and x[b + 1] >= x[k]:
                    b += 1
                if b - a + 1 < least:
                    continue
                # a tie joins the window of the last equal one, unless that is far off
                near = next((h for h, s in spans.items() if x[h] == x[k] and s[0] + s[3] <= b and k - s[2] < least and min(x[h : k + 1]) == x[k] and h not in tail), None)
                if near is None:
                    spans[k] = [a, b, k, 0]
                elif k - near >= least + 4:
                    spans[k], tail[near] = [a, b, k, 0], True
                else:
                    spans[near][2] = k
            want |= {(t, bounds[t] + k, bounds[t] + a, bounds[t] + b, bounds[t] + e) for k, (a, b, e, _) in spans.items()}
        assert got == want


def test_block_intersections():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 60, n).astype(np.uint16) for n in (5, 30, 91, 2)]
    sets = [set(p.tolist()) for p in parts]
    ids, row = np.array(sorted((t, i) for i, p in enumerate(sets) for t in p)).T
    every = np.arange(4)
    assert passages.in_common_between(ids, row, every, every, 4, 7).tolist() == [[len(p & q) for q in sets] for p in sets]
    left, right = np.array([2, 0]), np.array([1, 3, 2])
    assert passages.in_common_between(ids, row, left, right, 4, 7).tolist() == [[len(sets[i] & sets[j]) for j in right] for i in left]
    hits = np.zeros((3, 60), bool)
    hits[0, 5:45], hits[1, 5:40], hits[2, ::2] = True, True, True
    assert passages.dense_enough(hits, 46, 0.8).tolist() == [True, False, False]


def test_rows_worth_comparing():
    """No pair with enough in common is left out; what is left out has too little in common with all that stay."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        n, need = int(rng.integers(2, 40)), int(rng.integers(1, 5))
        pos = np.sort(np.concatenate([np.arange(n // 2), np.arange(n - n // 2)]))
        asks = np.append(pos[1:] == pos[:-1], False)
        sets = {p: set(rng.choice(60, int(rng.integers(0, 12)), replace=False).tolist()) for p in set(pos.tolist())}
        ids = np.array([t for p in pos.tolist() for t in sorted(sets[p])], int)
        row = np.repeat(np.arange(n), [len(sets[p]) for p in pos.tolist()])
        got = passages.worth_comparing(ids, row, asks, pos, np.full(n, need))
        other = lambda i: [j for j in range(n) if asks[j] != asks[i] and pos[j] != pos[i]]  # noqa: B023, E731
        for i in range(n):
            mine = sets[int(pos[i])]
            if any(len(mine & sets[int(pos[j])]) >= need for j in other(i)):
                assert got[i]
            kept = set().union(*(sets[int(pos[j])] for j in other(i) if got[j]))
            assert got[i] == (len(mine & kept) >= need)


def test_nearest_smaller_in_long_rising_and_falling_runs():
    rng = np.random.default_rng(6)
    for v in (np.arange(3000), np.arange(3000)[::-1], rng.permutation(3000), np.append(np.arange(1000, 2500), np.arange(1500)[::-1])):
        text = np.sort(rng.integers(0, 3, 3000))
        for values, of in ((v, text), (v[::-1], text[::-1])):
            want, stack = [], []
            for i, x in enumerate(values.tolist()):
                while stack and (values[stack[-1]] > x or of[stack[-1]] != of[i]):
                    stack.pop()
                want.append(stack[-1] if stack else -1)
                stack.append(i)
            assert passages.nearest_smaller(values, of).tolist() == want


def test_passages_whose_keys_all_occur_in_earlier_texts(make, monkeypatch):
    """Each stretch of a passage is also in six earlier texts that do not repeat it."""
    monkeypatch.setattr(passages, "BLOCK", 3)
    rows = []
    for i in range(6):
        w = prose(900 + i, 60).split(" ")
        for k in range(6):
            for n, at in enumerate(range(0, 60, 20)):
                rows.append((i * 100 + k * 10 + n, prose(9000 + i * 100 + k * 10 + n, 40) + " " + " ".join(w[max(0, at - 7) : at + 27]) + " " + prose(20000 + i * 100 + k * 10 + n, 40)))
        rows += [(5000 + i, prose(7000 + i, 30) + " " + " ".join(w)), (6000 + i, " ".join(w) + " " + prose(8000 + i, 30))]
    got = {r.doc_id: r.n_removed for r in passages.passage_report(make(rows)).collect()}
    assert all(got[6000 + i] >= 55 for i in range(6))


def test_periodic_passages_keep_their_beginning(make):
    s = prose(31, 12)
    rows = [(1, " ".join([s] * 40)), (2, "one two three " + "la " * 400 + "end"), (3, prose(32, 200))]
    got = {r.doc_id: r for r in passages.passage_report(make(rows)).collect()}
    assert got[1].n_words - got[1].n_removed in range(40, 120) and 404 - got[2].n_removed in range(40, 120) and got[3].n_removed == 0


def runs_of(sizes, seed):
    """Runs of one word each, all different."""
    return " ".join(" ".join([f"{prose(seed + i, 1)}{i}x"] * n) for i, n in enumerate(sizes))


def test_a_text_of_several_runs_loses_each_ones_repeats(make, spark):
    rows = [(1, runs_of([121] * 8, 40)), (2, runs_of([67] * 8, 60)), (3, prose(50, 80) + " " + runs_of([200], 80) + " " + prose(51, 80) + " " + runs_of([121], 81))]
    got = {r.doc_id: r for r in passages.passage_report(make(rows)).collect()}
    assert got[1].n_passages == 8 and 8 * 70 <= got[1].n_removed <= 8 * 75
    assert got[2].n_removed == 0  # a run of 67 words is no passage and an earlier one
    assert got[3].n_passages == 2 and 220 <= got[3].n_removed <= 230
    one = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 133")  # begins with eight runs of 121 equal words
    assert passages.passage_report(one).first().n_passages == 8
    left = passages.remove_passages(one.unionByName(make([(i + 1000, t) for i, t in rows])))
    assert not passages.passage_report(left).where("n_removed > 0").count()


def test_repeats_within_one_long_text(make):
    """Brute force: of every run of 50 words that also stands earlier in the text, without overlap, the words are found."""
    r, parts, pool = random.Random(5), [], [prose(9100 + i, 60 + 10 * i) for i in range(8)]
    for k in range(60):
        parts.append(prose(9200 + k, r.randint(5, 120)))
        parts.append(pool[r.randrange(8)])
    w = " ".join(parts).split(" ")
    first, repeated = {}, set()
    for k in range(len(w) - 49):
        g = tuple(w[k : k + 50])
        if first.setdefault(g, k) + 50 <= k:
            repeated.update(range(k, k + 50))
    got = passages.passage_report(make([(1, " ".join(w)), (2, prose(9999, 300))])).where("doc_id = 1").first()
    assert len(repeated) <= got.n_removed <= 1.1 * len(repeated)


def test_passages_find_every_exact_repeat(family, texts, make):
    _, rows = family
    rows = {**{i: t for i, t in rows.items() if i >= 100}, **{1000 + i: t for i, t in texts.items() if i < 120}}
    got = {r.doc_id: r for r in passages.passage_report(make(rows.items())).collect()}
    seen, missed = {}, []
    for i in sorted(rows):
        w = words(rows[i])
        grams = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        if any(seen.get(g, i) != i for g in grams) and not got[i].n_removed:
            missed.append(i)
        for g in grams:
            seen.setdefault(g, i)
    assert not missed
    assert all(55 <= got[i].n_removed <= 66 and got[i].class_id == 100 for i in range(101, 130)) and got[100].n_removed == 0
    assert all(got[i].n_removed == 0 for i in range(200, 240))


def edited(text, *places):
    return " ".join(f"changed{k}" if k in places else w for k, w in enumerate(text.split(" ")))


def test_passages_follow_a_chain_of_edits(make):
    rows, n = [], 15
    for i in range(n):
        p = prose(700 + i, 120)
        for k, t in enumerate((p, edited(p, 24, 72), edited(p, 24, 72, 48, 96))):
            rows.append((100 * k + i, t))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t in rows)}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(like(i, 100 + i) >= 0.8 and like(100 + i, 200 + i) >= 0.8 and like(i, 200 + i) < 0.75 for i in range(n))
    got = {r.doc_id: r for r in passages.passage_report(make(rows)).collect()}
    assert all(got[100 * k + i].class_id == i and (got[100 * k + i].n_removed >= 100) == (k > 0) for i in range(n) for k in range(3))


def test_passages_recall_of_near_repeats(make):
    rows = []
    for i in range(200):
        p = prose(2000 + i, 60)
        rows += [(i, prose(3000 + i, 30) + " " + p + " " + prose(4000 + i, 30)), (1000 + i, prose(5000 + i, 30) + " " + edited(p, 30) + " " + prose(6000 + i, 30))]
    got = {r.doc_id: r.n_removed for r in passages.passage_report(make(rows)).collect()}
    missed = sum(not got[1000 + i] for i in range(200))
    print("near passages missed:", missed, "of 200")
    assert not missed


@pytest.mark.parametrize("size", [50, 51, 54, 60])
def test_stretches_with_an_edit_at_every_word(size):
    p = prose(800 + size, size)
    part = lambda t: (textgrid.Words(pa.array([t])).grams(5)[0] >> np.uint64(32)).astype(np.uint32)
    y = part(prose(801, 12) + " " + p + " " + prose(802, 12))
    for k in range(size):
        x = part(prose(803, 12) + " " + edited(p, k) + " " + prose(804, 12))
        got = passages.common_stretches(x, y, 46, 0.8)
        assert got and got[0][1] - got[0][0] + 1 >= 46, k
    assert not passages.common_stretches(part(prose(805, 80)), y, 46, 0.8)


def test_removed_passages_keep_the_rest(family):
    df, rows = family
    got = {r.doc_id: r.text for r in passages.remove_passages(df.where("doc_id >= 100")).collect()}
    assert got[100] == rows[100] and got[205] == rows[205]
    first, last = words(rows[120])[:10], words(rows[120])[-10:]
    assert words(got[120])[:10] == first and words(got[120])[-10:] == last and len(words(got[120])) < 40


def test_quality_on_held_out_labels(spark):
    out = queries.QUERIES["op5_quality"](spark, SF1).join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").where("held_out")
    n, right, good = out.agg(F.count(F.lit(1)), F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.sum(((F.col("quality") == 1) & (F.col("predicted") == 0)).cast("int"))).first()
    assert n > 500 and right / n > 0.97 and good / n < 0.03


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    d = (1 << quality.HASH_BITS) + quality.STATS
    m = quality.Model(0.3, rng.normal(size=d), rng.normal(size=(d, 3)))
    parts = quality.featurize(pa.array(["Ab ab cd. Ef!"]))
    row, feature, value, dense = parts
    x = np.zeros(d)
    x[feature], x[1 << quality.HASH_BITS :] = value, dense[0]
    at = np.flatnonzero(x)
    pairs = sum((m.factor[i] @ m.factor[j]) * x[i] * x[j] for a, i in enumerate(at) for j in at[:a])
    assert quality.raw_scores(m, *parts)[0] == pytest.approx(0.3 + m.weight @ x + pairs)


def test_html_on_held_out_pages():
    field = html_text.default_field()
    wrong = total = 0
    for html, labels in html_text.labelled_pages(60, seed=77):
        page = html_text.blocks(html)
        for b, y in zip(page, html_text.viterbi(field, html_text.features(page)), strict=True):
            total, wrong = total + 1, wrong + (labels.get(b.text, 0) != y)
    assert wrong / total < 0.01


def test_html_pages_equal_their_articles(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_viterbi_is_the_best_path():
    f = html_text.Field({"a": (0.5, -0.2), "b": (-1.0, 0.7)}, (0.1, 0.2), ((0.3, -0.4), (0.2, 0.6)))
    rows = [["a"], ["b"], ["a", "b"], ["a"]]

    def value(path):
        e = sum(f.weights[x][y] for r, y in zip(rows, path, strict=True) for x in r)
        return e + f.start[path[0]] + sum(f.move[a][b] for a, b in zip(path, path[1:], strict=False))

    paths = [[(n >> k) & 1 for k in range(4)] for n in range(16)]
    assert value(html_text.viterbi(f, rows)) == pytest.approx(max(map(value, paths)))


def test_vectors_recall_and_components(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 64))
    rows = [(i, (centre[i % 30] + rng.normal(scale=0.12, size=64)).tolist()) for i in range(900)] + [(1000 + i, rng.normal(size=64).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = embedding_graph.near_duplicates(df)
    assert embedding_graph.recall(df, found, every=10) >= 0.95
    x = embedding_graph.unit(np.array([np.array(r[1], np.float32) for r in rows], float))
    true = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in found.collect()}
    assert all(got[i] <= true[k] for k, (i, _) in enumerate(rows)) and sum(got.values()) >= 0.95 * true.sum()


def test_large_shards_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "CAP", 100)
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(scale=0.1, size=64)).tolist()) for i in range(300)]
    found = embedding_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.agg(F.min("n_links")).first()[0] >= 285


def test_url_trees_on_other_urls(spark):
    suffixes, model = url_filter.train(spark)
    trained = url_filter.TRAINING_URLS  # urls are made from their number, so later ones are new
    other = url_filter.labelled_urls(spark, trained + 6000, trained).join(url_filter.labelled_urls(spark).select("url"), "url", "left_anti")
    host, path = url_filter.host_and_path(F.col("url"))
    scored = url_filter.features(other.withColumns({"host": host, "path": path}), suffixes).withColumn("p", url_filter.score(model))
    assert scored.where((F.col("p") >= 0.5).cast("int") == F.col("bad")).count() / scored.count() > 0.95


def test_packing_round_trip(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    rows = packing.pack(docs).collect()
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = sum(r.length for r in rows)
    assert used / (4096 * len({r.sequence_id for r in rows})) > 0.97


def test_word_encoder_agrees():
    import public_tokenizers

    coder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=10)
    hard = ["a b c  \n\t d", "don't x's", "ΑΣ ΟΔΟΣ İ", "<|endoftext|> a.", "é ́x", "  ", "", "a\x1cb", "x\x01y \x01 z", "a\xa0b c", "'s .b….c …d.", "≠x a≠b", "IT'S rock'n'roll 3.14", "é" * 50 + "."]
    assert coder.sides and coder.agrees(hard) and coder.agrees(hard)


def test_plan_places_everything():
    rng = np.random.default_rng(4)
    for n in (1, 5, 300, 20000):
        hist = Counter(int(min(4096, v)) for v in rng.geometric(1 / 700, n))
        ranges = packing.plan(hist, 4096)
        per = defaultdict(int)
        fill = defaultdict(int)
        for length, lo, hi, first, _ in ranges:
            assert lo == per[length]
            per[length] = hi
            for s in range(first, first + hi - lo):
                fill[s] += length
        assert dict(per) == dict(hist) and max(fill.values()) <= 4096
        if n == 20000:
            assert sum(k * v for k, v in hist.items()) / (4096 * len(fill)) > 0.99


def test_decontamination_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    want = Counter(map(tuple, c.sql(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({queries.ORACLES['op2_decontaminate']})").fetchall()))
    assert Counter(map(tuple, queries.QUERIES["op2_decontaminate"](spark, SF01).collect())) == want
