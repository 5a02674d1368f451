"""One row for each key, set operations and incremental joins, all with a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must not leave ties.

    Rank filters run on both sides of the shuffle, so a hot key sends one row from each task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def last_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, key, [F.desc(c) for c in order])


def append_keep_first(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Both frames' rows, of each key the old one, or else the first new one."""
    both = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    return first_per_key(both, key, [F.asc("_part"), *order]).drop("_part")


def only_new(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return found.join(stored.select(key), key, "left_anti")


def already_stored(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return found.join(stored.select(key), key, "left_semi")


def with_bodies(rows: DataFrame, bodies: DataFrame, key: str = "url", column: str = "text") -> DataFrame:
    """Every row, with the body of its key or an empty one; bodies must be unique by key."""
    return rows.join(bodies.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit("")))
