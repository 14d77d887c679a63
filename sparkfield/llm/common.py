"""Helpers shared by the corpus operators: durable cuts, gapless ranks, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from sparkfield.plans.durable import folder
from sparkfield.plans.ship import ship

#: Every byte that is not part of a word once A-Z is lower-cased.
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bounds of an Arrow batch, so that workers and executors hold little at a time, however long the texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; the session's workers get the package and small Arrow batches.

    Plans are lazy, so the batch bounds stay set in the session; they change no result.
    """
    ship(spark)
    for name_, value in BATCH.items():
        spark.conf.set(name_, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small table that go into one partition.
PART_ROWS = 50_000


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so lost executors cost no rerun.

    With a bound on its ``rows``, the table gets no more partitions than it needs: otherwise
    loops over small tables would fill disks with tiny files. The folder is ``spark.checkpoint.dir`` (see ``plans.durable``).
    """
    folder(df.sparkSession)
    return (df if rows is None else df.coalesce(rows // PART_ROWS + 4)).checkpoint()


def ascii_lower(col):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def gapless(df: DataFrame, groups: list[str], key: str, out: str, total: int, per_bucket: int = 8192) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... without one task per group.

    Rows are dealt into hash buckets of ``key`` (a unique column) within the group; buckets
    are numbered on their own and shifted by the sizes of the buckets before them.
    """
    n = max(1, total // per_bucket)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)))
    cut = [*groups, "_bucket"]
    sizes = df.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    for c in groups:
        df, sizes = df.withColumn(f"_g_{c}", F.col(c)), sizes.withColumnRenamed(c, f"_g_{c}")
    own = W.partitionBy(*groups, "_bucket").orderBy(key)
    return (
        df.join(sizes, [*(f"_g_{c}" for c in groups), "_bucket"])
        .withColumn(out, (F.row_number().over(own) - 1 + F.col("_shift")).cast("long"))
        .drop("_bucket", "_shift", *(f"_g_{c}" for c in groups))
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a link table: (node, root) with root the smallest node.

    Alternating large-star and small-star rounds; every round is two aggregations and two
    joins, and its table is checkpointed. Only counts reach the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = durable(edges)
    rows, seen = edges.count(), None
    edges = edges.coalesce(rows // PART_ROWS + 4)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = durable(small.where("u <> v").distinct(), rows)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def keyed(docs: DataFrame, columns: list[str], order: str = "doc_id", most: int = 1 << 62) -> DataFrame:
    """``docs`` with a unique ``key`` from 0 to ``most`` that sorts as ``order`` does (nulls first).

    A column that is unique and in range is its own key. Otherwise (repeated rows, null or
    negative ids) the rows are sorted, numbered across the sorted partitions and stored.
    """
    seen = docs.agg(F.count(F.lit(1)), F.count_distinct(order), F.count(order), F.min(order), F.max(order)).first()
    if not seen[0] or (seen[0] == seen[1] == seen[2] and seen[3] >= 0 and seen[4] < most):
        return docs.select(F.col(order).cast("long").alias("key"), *columns)
    parts = docs.select(order, *(c for c in columns if c != order)).orderBy(F.col(order).asc_nulls_first())
    parts = durable(parts.select(F.monotonically_increasing_id().alias("_at"), *columns))
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return durable(parts.withColumn("_part", part).join(sizes, "_part").select((own + F.col("_shift")).alias("key"), *columns))


#: Rows of a key bitmap; with 64 bits each its size never grows with the data.
BITMAP_ROWS = 1 << 16


def split_by_keys(df: DataFrame, key: str, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys[name]``, rows whose key surely is not), without a shuffle of ``df``.

    The keys become a bitmap of BITMAP_ROWS x 64 bits, which is broadcast; where it fills up,
    more rows are kept for the exact join that follows.
    """
    h = F.xxhash64(name)
    bits = keys.select(F.pmod(h, F.lit(BITMAP_ROWS)).alias("_row"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({name}), 32), 64) as int))").alias("_bit"))
    bits = F.broadcast(bits.groupBy("_row").agg(F.bit_or("_bit").alias("_bits")))
    own = df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(BITMAP_ROWS))).join(bits, F.col("_own") == F.col("_row"), "left")
    hit = F.expr(f"coalesce(_bits, 0L) & shiftleft(1L, cast(pmod(shiftright(xxhash64({key}), 32), 64) as int))") != 0
    return own.where(hit).select(*df.columns), own.where(~hit).select(*df.columns)


def stored(df: DataFrame) -> DataFrame:
    """Like ``durable``, for large tables: compressed Parquet in the shared checkpoint folder."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``stored`` table that nothing will read any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``rest``, a struct of all columns but the text: names that an operator adds cannot clash with theirs."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``packed`` put away, in their order, with the text as it now is."""
    return df.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns))


def without_copies(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``base(key, text)`` with only the first of equal texts, and the others as (key, first).

    Copies are found by two 64-bit hashes; the texts that surely are none are not shuffled.
    """
    base = base.where("text is not null").select("key", "text")
    ids = base.select("key", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    firsts = ids.groupBy("h", "g").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "g", "first")
    copies = durable(ids.join(firsts, ["h", "g"]).where("key <> first").select(F.col("key").alias("copy"), "first"))
    maybe, sure = split_by_keys(base, "key", copies, "copy")
    return sure.unionByName(maybe.join(copies, F.col("key") == F.col("copy"), "left_anti")), copies
