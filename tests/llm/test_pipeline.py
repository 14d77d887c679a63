"""The pipeline's stages, each judged on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkfield.llm import decontaminate, ngram_join, passages
from tests.conftest import SF


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        f(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs, new))
        docs = new
    return out


def test_columns_and_rows(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0


def test_decisions_take_effect(stages, spark):
    by = {name: (before, after) for name, before, after in stages}
    before, after = by["n-gram Jaccard join"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in ngram_join.classes(before).where("kept").collect()}
    before, after = by["substring dedup"]
    assert passages.passage_report(before).where("n_removed > 0").count() and not passages.passage_report(after).where("n_removed > 0").count()
    before, after = by["benchmark decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    report = decontaminate.contamination(before, items)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in report.where(~F.col("contaminated")).collect()}
    before, after = by["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = by["quality classifier"]
    good = before.join(labels.where("quality = 1"), "doc_id")
    assert after.join(good.select("doc_id"), "doc_id").count() >= 0.97 * good.count()


def test_run_equals_stages(stages, spark):
    assert corpus_pipeline.run(spark, SF).agg(F.count(F.lit(1)), F.sum("length")).first() == stages[-1][2].agg(F.count(F.lit(1)), F.sum("length")).first()


def test_stages_on_odd_rows(odd, empty, spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing column names; and no rows at all."""
    for t, rows in (("labels", [(1, 1, 0), (7, 1, 0), (9, 0, 1)]), ("benchmark", [(1, odd.where("doc_id = 8").first().text[:300]), (None, "x"), (2, None)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int" if t == "labels" else "item_id long, text string").write.parquet(f"{tmp_path}/{t}.parquet")
    clash = odd
    for c in ("key", "_own", "_row", "_bits", "_gone", "_hit", "_spans", "rest", "gone", "hit"):
        clash = clash.withColumn(c, F.col("doc_id") + 1000)
    left = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, clash, str(tmp_path))
        assert f(spark, empty, str(tmp_path)).count() == 0
        if name == "packing":
            assert out.count() >= 12
            continue
        assert out.columns == clash.columns
        rows = out.collect()
        assert all(r["key"] == (None if r.doc_id is None else r.doc_id + 1000) for r in rows)
        left[name] = [r.doc_id for r in rows]
    both = lambda *gone: sorted((i for i in [1, 2, 2, 3, 4, None, None, 5, 6, 7, 8, 9] if i not in gone), key=str)
    key = lambda ids: sorted(ids, key=str)
    assert key(left["n-gram Jaccard join"]) == both(1, 2, 6)
    assert key(left["substring dedup"]) == both(1, 2)
    assert key(left["benchmark decontamination"]) == both(7, 8)
