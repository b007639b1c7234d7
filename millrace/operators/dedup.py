"""Deduplication with a stated order: which row of a key stays is never left to chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: Sequence[Column], order: Column, pick) -> DataFrame:
    """One row for each key by a partial aggregate: a hot key shrinks before the shuffle."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    named = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(pick(whole, order).alias("_row")).select("_row.*")


def first_wins(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    return _one(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    return _one(df, keys, order, F.max_by)


def counted(df: DataFrame, keys: Sequence[Column], order: Column, pick, name: str = "n_copies") -> DataFrame:
    """One row for each key, chosen by ``pick`` (F.min_by or F.max_by), with how many rows have it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    named = [k.alias(f"_key{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(pick(whole, order).alias("_row"), F.count("*").alias(name)).select("_row.*", name)


def stronger_wins(df: DataFrame, keys: Sequence[Column], trusted: Column, order: Column) -> DataFrame:
    """A trusted row beats others; among equals the first stays."""
    return first_wins(df, keys, F.struct((~trusted).alias("weak"), order.alias("order")))
