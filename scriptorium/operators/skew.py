"""Joins of many rows with one row per key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 200_000
"""Rows of one key that a task takes; keys with more are spread."""


def met_with_one(many: DataFrame, one: DataFrame, keys: list[str], *, spread: Column, count: str, hot: int = HOT) -> DataFrame:
    """``many`` with the columns of ``one`` (a row per key, whose column ``count`` says how many rows of ``many`` have it).

    Only keys with more than ``hot`` rows are salted: their rows are spread by the hash of ``spread``, their one row is repeated for each part. Hot keys
    are few (at most all rows / ``hot``); the rest meets unsalted, and nothing of it is repeated. ``count`` is dropped.
    """
    salts = F.ceil(F.col(count) / F.lit(hot)).cast("int")
    few = one.where(F.col(count) > hot).select(*keys, salts.alias("_salts"))
    salted = many.join(few, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(count)
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")
