"""Accuracy of predictions and agreement of annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy_by(pairs: DataFrame, group: str, truth: str, guess: str, z: float = 1.96) -> DataFrame:
    """Per group: n, accuracy and its Wilson interval. Rows with a null on either side are left out."""
    g = pairs.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))
    p, n = F.col("accuracy"), F.col("n")
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return g.select(group, "n", F.round("accuracy", 6).alias("accuracy"), F.round(middle - half, 6).alias("low"), F.round(middle + half, 6).alias("high"))


def kappa(pairs: DataFrame, a: str, b: str, blind: str | None = None) -> DataFrame:
    """Cohen's kappa of two annotators: one row, null where chance agreement is complete.

    blind: a boolean column; records that were not annotated without sight of the prediction, or do not say so, are left out.
    """
    pairs = pairs if blind is None else pairs.where(F.col(blind))
    table = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("k"))
    rows = table.groupBy(F.col(a).alias("v")).agg(F.sum("k").alias("ra"))
    cols = table.groupBy(F.col(b).alias("w")).agg(F.sum("k").alias("rb"))
    both = rows.join(cols, F.col("v") == F.col("w")).agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("e"))
    seen = table.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("k"))), F.lit(0)).alias("o"))
    joined = seen.crossJoin(both)  # one row each
    po, pe = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return joined.select("n", F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))
