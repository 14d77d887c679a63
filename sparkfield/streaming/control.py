"""Control events as a stream: each batch of events changes the simulations' state, which then advances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sparkfield.operators import wave
from sparkfield.operators.grid import Grid

EVENTS = "sim long, seq long, kind string, x double, y double, amplitude double, sigma double"


def apply_events(state: DataFrame, events: DataFrame, grid: Grid) -> DataFrame:
    """Impulses add a Gaussian to the current field, in any number per simulation; a reset zeroes what came before it."""
    last = events.where("kind = 'reset'").groupBy("sim").agg(F.max("seq").alias("_reset"))
    waves = events.where("kind = 'wave'").join(last, "sim", "left").where("_reset is null or seq > _reset")
    hx, hy = grid.spacing
    x, y = F.col("i") * hx, F.col("j") * hy
    r2 = (x - F.col("x")) ** 2 + (y - F.col("y")) ** 2
    points = grid.points(state.sparkSession)
    added = waves.crossJoin(F.broadcast(points)).groupBy("sim", "i", "j").agg(F.sum(F.col("amplitude") * F.exp(-r2 / (2 * F.col("sigma") ** 2))).alias("_add"))
    out = state.join(last, "sim", "left").join(added, ["sim", "i", "j"], "left")
    keep = F.when(F.col("_reset").isNull(), F.lit(1.0)).otherwise(0.0)
    return out.select("sim", "i", "j", (F.col("u_curr") * keep + F.coalesce("_add", F.lit(0.0))).alias("u_curr"), (F.col("u_prev") * keep).alias("u_prev"))


def run(events: DataFrame, state_of: Callable[[int], DataFrame], save: Callable[[DataFrame, int], None], grid: Grid, c2dt2: float, steps: int, checkpoint: str, interval: str | None = None):
    """Start a query over streaming ``events``: after each batch every simulation advances ``steps`` steps.

    ``state_of(batch)`` reads the state before a batch and ``save`` stores the one after it;
    a batch that is run again reads the same state, so nothing is applied twice.
    """

    def batch(df: DataFrame, n: int) -> None:
        moved = wave.run_fused(apply_events(state_of(n), df, grid), grid, c2dt2, steps, ["sim"])
        save(moved.drop("step"), n)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
