"""From recognised lines of several frames and sides to one finding a scan and rule: fields, votes, sides, rules, in one dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.operators import consensus, extract, rules
from packlens.sources.folders import written

#: Parts side and frame where both are one text.
MARK = "\x1f"
#: A reading that every frame has, so that a frame without any field counts among its side's frames.
SEEN, ROLE = "__seen", "role:"


def observations_of(lines: DataFrame, strict: bool = False) -> DataFrame:
    """What each frame of each side says: scan_id, side, frame, field, value, relative.

    The fields of `extract`, the address under its caption ('' for a caption alone), the brand, each role that an address has (as ROLE and its name), and SEEN.
    `lines`: scan_id, side, frame, line_no, text and a box.
    """
    kinds = written(_kinds(lines), "frame-kinds")
    framed = kinds.select("scan_id", F.concat("side", F.lit(MARK), F.col("first").cast("string")).alias("frame"), F.inline("lines"))
    found = extract.extract(framed, strict, lambda fields: written(fields, "frame-fields")).select("scan_id", "frame", "field", "value", "relative")
    tagged = extract.tag_addresses(framed)
    none = F.lit(False).alias("relative")
    body = F.trim("body")
    # the first address that has a body, else the first caption
    address = tagged.where("role <> 'UNKNOWN'").groupBy("scan_id", "frame").agg(F.min(F.struct((body == "").alias("bare"), "line_no", body.alias("body"))).alias("a"))
    addresses = address.select("scan_id", "frame", F.lit("manufacturer_address").alias("field"), F.col("a.body").alias("value"), none)
    roles = tagged.where(body != "").select("scan_id", "frame", F.concat(F.lit(ROLE), "role").alias("field"), F.col("role").alias("value"), none).distinct()
    brands = extract.brand_prominence(framed).select("scan_id", "frame", F.lit("brand").alias("field"), F.col("brand").alias("value"), none)
    seen = framed.select("scan_id", "frame").distinct().select("scan_id", "frame", F.lit(SEEN).alias("field"), F.lit("x").alias("value"), none)
    rows = found.unionByName(addresses).unionByName(roles).unionByName(brands).unionByName(seen)
    parts = F.split("frame", MARK)
    rows = rows.select("scan_id", F.get(parts, F.lit(0)).alias("side"), F.get(parts, F.lit(1)).cast("int").alias("first"), "field", "value", "relative")
    return rows.join(kinds.select("scan_id", "side", "first", "frames"), ["scan_id", "side", "first"]).select("scan_id", "side", F.explode("frames").alias("frame"), "field", "value", "relative")


def _kinds(lines: DataFrame) -> DataFrame:
    """Frames of a side that show the same lines in the same places, as one row: scan_id, side, first, frames, lines. What they say is read once for all of them."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by scan once, not at all where they lie so already; a scan has some frames, and a frame tens of lines
    shot = F.sort_array(F.collect_list(F.struct("line_no", "text", *extract.SIDES))).alias("lines")
    shots = lines.repartition(tasks, "scan_id").groupBy("scan_id", "side", F.col("frame").cast("int").alias("frame")).agg(shot)
    return shots.groupBy("scan_id", "side", "lines").agg(F.min("frame").alias("first"), F.collect_list("frame").alias("frames"))


def declared_of(observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The voted and merged fields of each scan, ready for `rules.evaluate`; the scans; and the roles of their addresses.

    A field whose frames or sides do not settle it is not declared. relative: some frame read the value that won as counted from another date.
    """
    merged = written(consensus.side_merge(consensus.decided(observations)).where(F.col("value").isNotNull()), "merged-fields")
    relative = observations.where("relative").select("scan_id", "field", "value").distinct().withColumn("relative", F.lit(True))
    fields = merged.where((F.col("field") != SEEN) & ~F.startswith("field", F.lit(ROLE)))
    declared = fields.join(relative, ["scan_id", "field", "value"], "left").select(
        "scan_id", "field", "value", (F.trim("value") == "").alias("anchor_only"), F.coalesce("relative", F.lit(False)).alias("relative"), "confidence")
    roles = merged.where(F.startswith("field", F.lit(ROLE))).select("scan_id", F.lower("value").alias("role"))
    scans = merged.where(F.col("field") == SEEN).select("scan_id")
    return written(declared, "declared"), scans, roles


def judge(lines: DataFrame, ruleset: DataFrame, exemptions: DataFrame, today: str, **facts: DataFrame) -> DataFrame:
    """The findings of `rules.evaluate`, one a scan and rule, out of recognised lines. facts: registry, heights, scales of `evaluate`.

    Observations, merged fields and declared fields are written on the way: the rules read the last ones many times.
    """
    declared, scans, roles = declared_of(written(observations_of(lines), "observations"))
    return rules.evaluate(declared, ruleset, exemptions, today, scans=scans, roles=roles, **facts)
