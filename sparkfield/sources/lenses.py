"""The star-schema tables seen as grids, tensors, environments, systems and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkfield.operators.boundary import Boundary
from sparkfield.operators.grid import Grid
from sparkfield.operators.tensor import Tensor
from sparkfield.plans.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def months_grid(*faces: Boundary, **kw) -> Grid:
    """84 months by 50 quantities."""
    return Grid((84, 50), (0.5, 0.5), boundaries=tuple(faces), **kw)


def months(spark: SparkSession, sf_dir: str, name: str = "u") -> DataFrame:
    """Line items by month and quantity: at most 4200 sums, whatever the table's size."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    counted = table(spark, sf_dir, "lineitem").groupBy(month.cast("int").alias("i"), (F.col("l_quantity") - 1).cast("int").alias("j")).agg(F.count(F.lit(1)).cast("double").alias(name))
    return months_grid().densify(counted, name)


def hours_grid(*faces: Boundary) -> Grid:
    return Grid((744,), (0.5,), boundaries=tuple(faces))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour of January 2024."""
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("int")
    counted = table(spark, sf_dir, "events").groupBy(hour.alias("i")).agg(F.count(F.lit(1)).cast("double").alias("u"))
    return hours_grid().densify(counted, "u")


def matrices(spark: SparkSession, sf_dir: str, key: str = "vec_id") -> Tensor:
    """Embeddings as 8 x 8 matrices of whole numbers."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), F.posexplode("embedding").alias("p", "x"))
    value = F.round(F.col("x").cast("double") * 1000)
    return Tensor(rows.select(key, F.lit(0).alias("i"), F.floor(F.col("p") / 8).cast("int").alias("j"), (F.col("p") % 8).cast("int").alias("k"), value.alias("v")), (1, 8, 8), (key,))


def vectors(spark: SparkSession, sf_dir: str, shift: int = 0) -> Tensor:
    """Embeddings as vectors of whole numbers; with a shift, vector n + shift under the key n."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - shift).alias("vec_id"), F.posexplode("embedding").alias("k", "x"))
    return Tensor(rows.select("vec_id", F.lit(0).alias("i"), F.lit(0).alias("j"), "k", F.round(F.col("x").cast("double") * 1000).alias("v")), (1, 1, 64), ("vec_id",))


def conversation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each turn depends on the one before it in its conversation."""
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    nodes = turns.select(name(F.col("turn")).alias("var"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"))
    edges = turns.where("turn > 0").select(name(F.col("turn")).alias("var"), name(F.col("turn") - 1).alias("dep"))
    return nodes, edges.join(nodes.select(F.col("var").alias("dep")), "dep", "left_semi").select("var", "dep")
