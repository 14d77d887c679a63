"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each window of ``window`` words keeps the minimum of its ``k``-gram hashes as fingerprint, so
a window that both sides share has the same fingerprint on both: no shared span of that
length can be missed. Document fingerprints meet the benchmark's in a join, and a hit is
extended to its whole window word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .common import NON_WORD, ascii_lower, durable, split_by_keys

#: Benchmark windows up to which their table is broadcast; a larger one is shuffled.
BROADCAST_WINDOWS = 200_000


def words(col) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), NON_WORD), "")


def _gram(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(k)))


def _runs(df: DataFrame, lengths: list[int], k: int, keys: list[str]) -> DataFrame:
    """Rows (keys, n, i, fp): every run of ``n`` words, for each of the lengths, and its fingerprint; the words stay behind."""
    grams = {min(k, n) for n in lengths}
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def grams_of(j: int) -> Column:
        return F.transform(upto(F.size("w") - j), lambda i: _gram(F.col("w"), i, j))

    def runs_of(n: int) -> Column:
        g, more = F.col(f"g{min(k, n)}"), n - min(k, n)
        least = lambda i: F.least(*(F.get(g, i + j) for j in range(more + 1))) if more else F.get(g, i)
        return F.transform(upto(F.size(g) - 1 - more), lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), least(i).alias("fp")))

    df = df.withColumns({f"g{j}": grams_of(j) for j in sorted(grams)})
    runs = [runs_of(n) for n in lengths]
    return df.select(*keys, F.inline(F.concat(*runs)))


def _window_text(w: Column, i: Column, n: Column) -> Column:
    return F.concat_ws(" ", F.slice(w, i + 1, n))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Rows (doc_id, tkey, i, n, item_id): document words i to i+n-1 are a window of the item.

    ``docs(doc_id, text)``; tkey tells apart the texts of rows with one doc_id. Null and
    word-free texts and items have none, repeated rows repeat theirs, empty tables give no
    rows. Texts of any length are taken whole: fingerprints go without their words, and only
    documents with equal fingerprints meet their words again, once each.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    lengths = sorted(r.len for r in items.select("len").distinct().collect())  # at most ``window`` values
    own = docs.select("doc_id", F.xxhash64("text").alias("tkey"), words(F.col("text")).alias("w"))
    if not lengths:
        return own.select("doc_id", "tkey", F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("item_id")).where("false")
    # the item's words are joined to its runs only here, where texts are few and short
    named = _runs(items, lengths, k, ["item_id", "w", "len"]).where("n = len").select("item_id", "n", "fp", _window_text(F.col("w"), F.col("i"), F.col("n")).alias("t")).distinct()
    named = durable(named)
    want = named.select(F.col("n").alias("_n"), F.col("fp").alias("_fp"), "t").distinct()
    if want.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        want = F.broadcast(want)
    met = _runs(own, lengths, k, ["doc_id", "tkey"]).join(want, (F.col("fp") == F.col("_fp")) & (F.col("n") == F.col("_n")))
    # a document's own runs
    lists = durable(met.groupBy(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).agg(F.collect_list(F.struct("i", "n", "t")).alias("l")))
    likely, _ = split_by_keys(own, "tkey", lists, "_t")
    both = likely.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")))
    same = F.filter("l", lambda r: _window_text(F.col("w"), r["i"], r["n"]) == r["t"])
    # rows with equal ids and texts have equal runs, which are rows of their own
    found = both.select("doc_id", "tkey", F.inline(F.array_distinct(same)))
    names = named.select("item_id", F.col("n").alias("_n"), F.col("t").alias("_s")).distinct()
    return found.join(names, (F.col("n") == F.col("_n")) & (F.col("t") == F.col("_s"))).select("doc_id", "tkey", "i", "n", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with the words and items of ``benchmark(item_id, text)`` found in it.

    A word inside any occurrence of a window of ``window`` item words is hit; an item of fewer
    words, but not none, is one window. Null and word-free texts have no words. Repeated rows
    get equal results, null ids are kept, further columns are ignored, empty tables give no
    rows or no hits.
    """
    found = durable(hits(docs, benchmark, window, k))  # read twice below
    spans = found.groupBy("doc_id", "tkey", "i").agg(F.max("n").alias("n"))
    before = W.partitionBy("doc_id", "tkey").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("i") + F.col("n")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("i"), F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = spans.select("doc_id", "tkey", new.alias("new")).groupBy("doc_id", "tkey").agg(F.sum("new").alias("n_hit"))
    named = found.select("doc_id", "tkey", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id", "tkey").agg(F.count("item").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    known = covered.withColumnsRenamed({"doc_id": "_d", "tkey": "_t"})
    named = named.withColumnsRenamed({"doc_id": "_d2", "tkey": "_t2"})
    known = known.join(named, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2")), "left").drop("_d2", "_t2")
    base = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(known, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
