"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkfield.llm import decontaminate, embedding_graph, html_text, ngram_join, packing, passages, quality, sharding, substring_exact, url_filter

from .conftest import prose


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, prose(1, 120)[:200]), (2, "x"), (3, None), (None, "x"), (4, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (8, 1, 0), (9, 0, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_sharding(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 12 and {r.law for r in rows} == {"rows"}
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min([*sizes.values(), *[0] * (16 - len(sizes))]) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 5)} == {(1, 0)}
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_keeps_groups_and_splits_a_hot_one(make):
    rows = [(i, f"copy {i // 4}") for i in range(160)] + [(1000 + i, "hot") for i in range(100)] + [(2000 + i, f"single {i}") for i in range(61)]
    out = sharding.shard_documents(make(rows))
    sizes = Counter(r.shard for r in out.collect())
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    small = out.where("doc_id < 1000")
    assert sharding.cut_links(small, "text_crc32") <= 30  # a random placement cuts about 110 of 120, with a hot group in competition
    hot = Counter(r.shard for r in out.where("doc_id between 1000 and 1999").collect())
    assert max(hot.values()) >= 10  # of 6 or 7 by chance


def test_grants_never_overfill():
    given = sharding.grant({(0, 1, 2): 10, (1, 0, 1): 4, (2, 1, 3): 9}, [20, 20, 20], [5, 3, 5])
    assert given[0, 1, 2] + given.get((2, 1, 3), 0) - given[1, 0, 1] <= 3 and given[1, 0, 1] == 4


def test_contamination(odd, empty, benchmark):
    out = decontaminate.contamination(odd, benchmark)
    rows = out.collect()
    assert len(rows) == 12
    assert all(r.contaminated for r in rows if r.doc_id in (1, 2, 7)) and not any(r.contaminated for r in rows if r.doc_id in (3, 4, 5, 6, 8, 9))
    assert [r.n_items for r in rows if r.doc_id == 7] == [1] and [r.n_hit for r in rows if r.doc_id == 7] == [1]
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert not decontaminate.contamination(odd, benchmark.where("false")).where("contaminated").count()


def test_contamination_without_broadcast(odd, benchmark, monkeypatch):
    key = lambda df: Counter(map(tuple, df.collect()))
    want = key(decontaminate.contamination(odd, benchmark))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert key(decontaminate.contamination(odd, benchmark)) == want


def test_passages(odd, empty):
    rows = {r.doc_id: r for r in passages.passage_report(odd.where("doc_id <> 2 or doc_id is null")).collect()}
    assert rows[1].n_removed in (0, 120) and rows[3].n_words == 0 and rows[8].n_removed == 0 and rows[5].n_passages == 0
    assert passages.passage_report(odd).count() == 12 and passages.passage_report(empty).count() == 0
    kept = passages.remove_passages(odd)
    assert kept.columns == odd.columns and kept.where("text like 'x' or doc_id in (3, 4, 5, 6, 7, 8, 9)").count() == 7
    assert kept.count() == 9  # one of four equal texts stays


def test_substrings(odd, empty):
    rows = substring_exact.remove_repeats(odd).collect()
    assert len(rows) == 12
    size = len(prose(1, 120).encode())
    same = [r.n_removed for r in rows if r.n_bytes == size]
    assert sorted(same) == [0, size, size, size]
    assert [r.n_removed for r in rows if r.doc_id is None and r.n_bytes] == [0]  # null ids come first
    assert substring_exact.remove_repeats(empty).count() == 0


def test_quality(odd, empty, labels):
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
    assert quality.keep_good(odd, labels.where("false")).columns == odd.columns


def test_html(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>One &amp; two.</p><p>Three.</p></article>"), (3, "u", "<p"), (3, "u", "<p"), (4, "u", "<script>x"), (5, "u", "<nav><ul><li><a href=x>Home</a></ul></nav><main><h1>T</h1><p>" + "long word " * 5000 + "</main>")]
    out = html_text.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"))
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == 7 and got[1].text == got[2].text == "" and got[None].text == "One & two.\n\nThree."
    assert got[5].text.startswith("T\n\nlong word") and "Home" not in got[5].text and got[5].n_chars == len(got[5].text)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ngram_classes(odd, empty):
    rows = ngram_join.classes(odd).collect()
    assert len(rows) == 12
    assert {r.class_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.n_links for r in rows if r.doc_id == 1} == {3}
    assert {r.class_id for r in rows if r.doc_id in (5, 6)} == {5} and {r.n_links for r in rows if r.doc_id in (3, 4)} == {0}
    assert ngram_join.classes(empty).count() == 0


def test_vectors(spark):
    v = [float(i % 5 - 2) for i in range(64)]
    near = [*v[:-1], v[-1] + 0.1]
    rows = [(1, v), (2, v), (2, v), (3, near), (4, None), (5, [0.0] * 64), (6, [float("nan")] * 64), (7, [None, *v[1:]]), (8, [1.0]), (9, [-x for x in v]), (None, [1.0, *[0.0] * 63])]
    out = embedding_graph.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, e int"))
    got = {r.vec_id: r for r in out.collect()}
    assert out.count() == 11 and got[1].n_links == 3 and got[3].component_id == 1 and not got[3].kept and got[1].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (4, 5, 6, 7, 8, 9))
    assert embedding_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_urls(spark):
    rows = [
        (1, None, "", "", None), (2, "no scheme", "", "", None), (3, "http://A.Example.com/en/7?x", "a.example.com", "/en/7", "example.com/en/7"), (4, "https://b.example.net/de/81#t", "b.example.net", "/de/81", "example.net/de/8"),
        (5, "x://net/de/", "net", "/de/", "net/de/"), (6, "http://anet/de/", "anet", "/de/", None), (7, "http://h.org?q=/es/", "h.org", "", None), (8, "http://É.com/en/", "É.com", "/en/", "com/en/"), (9, "a://b://c", "b:", "//c", None),
    ]
    df = spark.createDataFrame([r[:2] + ("z",) for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df.unionByName(df)).collect()}
    for i, _, host, path, rule in rows:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
    assert [got[i].verdict for i in (3, 4, 5, 8)] == ["allow", "block", "allow", "block"]
    assert url_filter.judge(df.where("false")).count() == 0


def test_packing(odd, empty):
    rows = packing.pack(odd).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 and len({r.doc_tokens for r in rows if r.doc_id in (3, 4, 5, 6)}) == 1
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(empty).count() == 0


NAMES = ("key", "node", "uid", "shard", "score", "n", "k", "pos", "tkey", "w", "_n", "label", "copy", "_own", "_row", "_bits", "_gone", "_hit", "_spans", "rest", "gone", "hit", "spans", "_key", "a.b")


def test_clashing_columns(odd, labels, benchmark):
    """Columns named like the operators' own do not matter."""
    clash = odd
    for c in NAMES:
        clash = clash.withColumn(c, F.lit(1))
    for f in (sharding.shard_documents, passages.passage_report, substring_exact.remove_repeats, ngram_join.classes, packing.pack, lambda d: quality.classify(d, labels), lambda d: decontaminate.contamination(d, benchmark)):
        assert f(clash).count() >= 12
    for f in (passages.remove_passages, lambda d: quality.keep_good(d, labels)):
        out = f(clash)
        assert out.columns == clash.columns and {r["key"] + r["_spans"] for r in out.collect()} == {2}
