"""Accuracy of exported fields against what the packs truly print, with intervals that keep the fields of a pack together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions.normalize import STABLE, values_equal
from packlens.sources.folders import written

REPLICATES = 200
OUTCOMES = ("equal", "both_empty", "wrong", "missed", "invented")
#: Draws of eight hex digits that one md5 holds.
PER_HASH = 4
_ODDS = [math.exp(-1) / math.factorial(k) for k in range(13)]
#: A draw under the k-th of these texts weighs k: the distribution function of a Poisson count with mean 1, as hex digits.
STEPS = [f"{int(sum(_ODDS[: k + 1]) * 2**32):08x}" for k in range(12)]


def _told(values: DataFrame, name: str) -> DataFrame:
    return values.groupBy("image_id", "field").agg(F.min(F.when(F.trim("value") != "", F.col("value"))).alias(name))


def field_outcomes(results: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, field, outcome of each field that `truth` has a row for.

    results, truth: image_id, field, value. A null or blank value is none: with none on both sides the outcome is both_empty, else missed or
    invented. Of repeated rows the smallest value counts. A field that was not exported is missed; one without a true row is not judged.
    Two values that cannot be read are wrong.
    """
    both = written(_told(truth, "true_value").join(_told(results, "value"), ["image_id", "field"], "left"), "told-values")
    value, true = F.col("value"), F.col("true_value")
    none, no_truth = value.isNull(), true.isNull()
    # pairs that form NFKC leaves as they are, nearly all of them, do not go through Python
    odd = F.coalesce(F.regexp_like(value, F.lit(f"[^{STABLE}]")), F.lit(False)) | F.coalesce(F.regexp_like(true, F.lit(f"[^{STABLE}]")), F.lit(False))
    outcome = F.when(none & no_truth, "both_empty").when(none, "missed").when(no_truth, "invented")
    judged = lambda rows, compatible: rows.select("image_id", "field", outcome.when(values_equal(F.col("field"), value, true, compatible), "equal").otherwise("wrong").alias("outcome"))
    return judged(both.where(~odd), False).unionByName(judged(both.where(odd), True))


def _weight(draw: Column) -> Column:
    weight = F.when(draw < STEPS[0], 0)
    for k, step in enumerate(STEPS[1:], 1):
        weight = weight.when(draw < step, k)
    return weight.otherwise(len(STEPS))


def resampled(outcomes: DataFrame, replicates: int = REPLICATES, seed: str = "") -> DataFrame:
    """field, replicate, accuracy: a Poisson bootstrap over packs, in one pass.

    A pack weighs in a replicate what its id draws there, and so do all of its fields: they are right or wrong together. A replicate
    that draws no pack of a field has no row. Tasks add up fields times replicates sums, whatever the number of packs. Reads `outcomes` for the names of its fields first.
    """
    names = sorted((r.field for r in outcomes.select("field").distinct().collect()), key=lambda f: (f is not None, f))  # tens at most
    if not names:
        return outcomes.sparkSession.createDataFrame([], "field string, replicate int, accuracy double")
    # a pack draws once for all of its fields, which are columns beside it
    is_right, of = F.col("outcome").isin("equal", "both_empty"), lambda f: F.col("field").eqNullSafe(F.lit(f))
    counts = [c for i, f in enumerate(names) for c in (F.count_if(of(f)).alias(f"n{i}"), F.count_if(of(f) & is_right).alias(f"right{i}"))]
    held = [f"{c}{i}" for i in range(len(names)) for c in ("n", "right")]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // PER_HASH) - 1))).alias("block")
    hashed = outcomes.groupBy("image_id").agg(*counts).select("image_id", *held, blocks)
    digits = F.md5(F.concat_ws(":", F.lit(seed), F.col("image_id").cast("string"), F.col("block").cast("string")))
    draws = F.posexplode(F.array(*[F.substring("digits", 8 * i + 1, 8) for i in range(PER_HASH)])).alias("place", "draw")
    drawn = hashed.select(*held, "block", digits.alias("digits")).select(*held, "block", draws)
    drawn = drawn.select(*held, (F.col("block") * PER_HASH + F.col("place")).alias("replicate"), _weight(F.col("draw")).alias("weight"))
    sums = drawn.where((F.col("weight") > 0) & (F.col("replicate") < replicates)).groupBy("replicate").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in held])
    each = F.inline(F.array(*[F.struct(F.lit(f).cast("string").alias("field"), F.col(f"n{i}").alias("n"), F.col(f"right{i}").alias("right")) for i, f in enumerate(names)]))
    return sums.select("replicate", each).where("n > 0").select("field", "replicate", (F.col("right") / F.col("n")).alias("accuracy"))


def accuracy_by_field(outcomes: DataFrame, level: float = 0.95, replicates: int = REPLICATES, seed: str = "") -> DataFrame:
    """A row a field: n, how many of each outcome, accuracy (equal or both_empty), low and high at `level`.

    outcomes: as of `field_outcomes`; read three times, so written first where they are dear. An empty table gives no row.
    """
    counts = outcomes.groupBy("field").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    tail = (1 - level) / 2
    ends = resampled(outcomes, replicates, seed).groupBy("field").agg(F.percentile("accuracy", [tail, 1 - tail]).alias("ends"))
    accuracy = (F.col("equal") + F.col("both_empty")) / F.col("n")
    return counts.join(ends, "field", "left").select(
        "field", "n", *OUTCOMES, F.round(accuracy, 6).alias("accuracy"), F.round(F.col("ends")[0], 6).alias("low"), F.round(F.col("ends")[1], 6).alias("high"))
