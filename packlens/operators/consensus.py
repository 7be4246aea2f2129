"""Votes over repeated readings, and the merge of a pack's sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.functions.normalize import norm_field, readable
from packlens.sources.folders import written

MIN_VOTES, MAX_FRAMES = 3, 5
BLANK, UNREAD = "__blank__", "__unread__"


def bucketed(observations: DataFrame) -> DataFrame:
    """`observations` with bucket: readings that agree after normalisation share one. Each distinct text of a field is normalised once.

    Blank readings are a bucket of their own; each unreadable text is one that can never win.
    """
    value = F.coalesce(F.col("value"), F.lit(""))
    texts = observations.select(F.col("field").alias("__field"), value.alias("__value")).distinct()
    field, text = F.col("__field"), F.col("__value")
    bucket = F.when(F.trim(text) == "", F.lit(BLANK)).when(~readable(field, text), F.concat(F.lit(UNREAD), text)).otherwise(norm_field(field, text))
    # written, so that Spark knows how small it is and sends it to the readings, not the readings to it
    read = written(texts.withColumn("bucket", bucket), "field-texts")
    return observations.join(read, (F.col("field") == field) & (value == text), "left").drop("__field", "__value")


def tally(marked: DataFrame) -> DataFrame:
    """Votes per (scan, side, field, bucket) of `bucketed` readings."""
    return marked.groupBy("scan_id", "side", "field", "bucket").agg(
        F.count(F.lit(1)).alias("votes"), F.min("frame").alias("first_frame"), F.min_by("value", "frame").alias("value"), F.collect_set("frame").alias("seen"))


def decided(observations: DataFrame) -> DataFrame:
    """Per (scan, side, field): value, bucket, votes, frames, agreed, confidence and candidates (votes, first frame and value, most votes first).

    Readings are dealt by scan once, not at all where they lie so already; what follows needs no other shuffle. Groups are a side's few frames: more than MAX_FRAMES are
    an error, since the number of votes that are needed rests on them.
    """
    votes = tally(bucketed(observations).repartition("scan_id"))
    by_side = Window.partitionBy("scan_id", "side")
    frames = F.size(F.array_distinct(F.flatten(F.collect_list("seen").over(by_side))))
    votes = votes.withColumn("frames", F.when(frames <= MAX_FRAMES, frames).otherwise(F.raise_error(F.lit(f"a side has more than {MAX_FRAMES} frames")).cast("int")))
    can_win = ~F.startswith(F.col("bucket"), F.lit(UNREAD))
    best = F.struct(F.when(can_win, F.col("votes")).otherwise(0).alias("v"), (-F.col("first_frame")).alias("f"), F.col("value"), F.col("bucket"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("least"), "first_frame", "value", "votes")))
    won = votes.groupBy("scan_id", "side", "field").agg(F.max(best).alias("b"), F.max("frames").alias("frames"), listed.alias("candidates"))
    enough = F.col("b.v") >= F.least(F.lit(MIN_VOTES), F.col("frames"))
    return won.select(
        "scan_id", "side", "field", F.when(enough, F.when(F.col("b.bucket") == BLANK, "").otherwise(F.col("b.value"))).alias("value"), F.when(enough, F.col("b.bucket")).alias("bucket"),
        F.col("b.v").alias("votes"), F.col("frames").cast("long").alias("frames"), enough.alias("agreed"), F.when(enough, F.col("b.v") / F.col("frames")).otherwise(0.0).alias("confidence"), "candidates")


def consensus_vote(observations: DataFrame) -> DataFrame:
    """Per (scan, side, field): value, votes, frames, agreed, confidence = votes / frames.

    Needs min(3, frames) votes of the side's frames; the most votes win, then the earliest frame.
    Where unread or too thin, value is null and agreed false.
    """
    return decided(observations).drop("candidates", "bucket")


def consensus_failures(observations: DataFrame) -> DataFrame:
    """Fields without agreement, with their candidates by votes, then by first frame, as 'value:votes'."""
    shown = F.array_join(F.transform("candidates", lambda c: F.concat(c["value"], F.lit(":"), c["votes"].cast("string"))), "; ")
    return decided(observations).where("not agreed").select("scan_id", "side", "field", shown.alias("candidates"), "frames")


def side_merge(agreed: DataFrame) -> DataFrame:
    """One row per (scan, field) over its sides: value, confidence, reason, candidates (value, votes).

    Blank readings are ignored if any side has a reading; two different readings give reason
    'sides_disagree', no value, and each reading as first seen with how many sides have it, most sides first. Else the surest side wins, the first by
    side name on ties. `decided` rows bring their bucket; others are normalised.
    """
    filled = F.col("agreed") & (F.trim(F.coalesce("value", F.lit(""))) != "")
    norm = F.when(filled, F.col("bucket") if "bucket" in agreed.columns else norm_field(F.col("field"), F.col("value")))
    best = F.min(F.when(F.col("agreed"), F.struct((-filled.cast("int")).alias("f"), (-F.col("confidence")).alias("c"), "side", "value", "confidence")))
    # a pack's few sides, in the order of their names
    read = F.sort_array(F.collect_list(F.when(F.col("norm").isNotNull(), F.struct("side", "value", "norm"))))
    grouped = agreed.withColumn("norm", norm).groupBy("scan_id", "field").agg(read.alias("read"), best.alias("b"))
    grouped = grouped.withColumn("norms", F.array_distinct(F.transform("read", lambda x: x["norm"])))
    of = lambda n: F.filter("read", lambda x: x["norm"] == n)
    ranked = F.array_sort(F.transform("norms", lambda n, i: F.struct((-F.size(of(n))).alias("least"), i.alias("i"), F.get(of(n), F.lit(0))["value"].alias("value"))))
    candidates = F.transform(ranked, lambda x: F.struct(x["value"].alias("value"), (-x["least"]).alias("votes")))
    apart = F.size("norms") > 1
    reason = F.when(apart, "sides_disagree").when(F.col("b").isNull(), "ocr_no_consensus")
    none = F.array().cast("array<struct<value: string, votes: int>>")
    return grouped.select(
        "scan_id", "field", F.when(reason.isNull(), F.col("b.value")).alias("value"), F.when(reason.isNull(), F.col("b.confidence")).otherwise(0.0).alias("confidence"), reason.alias("reason"),
        F.when(apart, candidates).otherwise(none).alias("candidates"))


def unresolved_fields(votes: DataFrame) -> DataFrame:
    """The fields of `consensus_vote` that the frames did not settle, by scan, side and field."""
    return votes.where(~F.col("agreed")).select("scan_id", "side", "field").orderBy("scan_id", "side", "field")
