"""Columns that later steps use many times, evaluated once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns added behind a generator, so that the optimizer does not copy long expressions into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(values: dict[str, Column], use) -> Column:
    """use(v) with v a struct of the values, each evaluated once however often v's fields are read."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), use), F.lit(0))
