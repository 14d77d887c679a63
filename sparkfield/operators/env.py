"""Variable environments as tables (env keys, name, value): the dictionary operations as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def set_all(env: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Upsert; among several new values of a key the one of greatest ``order`` wins."""
    if order:
        values = [c for c in new.columns if c not in (*keys, order)]
        new = new.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in values))
    return env.join(new, keys, "left_anti").unionByName(new)


def get(env: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(env, keys, "left")


def has(env: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted keys that exist."""
    return wanted.join(env, keys, "left_semi")


def remove(env: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return env.join(gone, keys, "left_anti")


def size(env: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    return env.groupBy(*by).agg(F.count_distinct(name).alias("n"))


def merge(parameters: DataFrame, guess: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """All names of both; the guess wins."""
    own = guess.withColumnRenamed(value, "_g")
    return parameters.join(own, keys, "full").select(*keys, F.coalesce("_g", value).alias(value))


def describe(env: DataFrame, name: str = "name", packed: str = "t") -> DataFrame:
    """Names and shapes, for printing."""
    return env.select(name, F.col(f"{packed}.shape").alias("shape"))
