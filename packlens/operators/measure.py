"""Sizes from optics, calibrations, and the focus of a burst's frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Relative tolerance of the focus distance: approximate, calibrated, corrected by the user's own reference.
APPROXIMATE, CALIBRATED, CORRECTED = 0.30, 0.10, 0.05
UNCALIBRATED = 0
FOCUS_FLOOR = 0.40
#: How far the focus may lie from that of a calibration, as a ratio either way, and the largest plausible correction.
WINDOW, MAX_CORRECTION = 2.0, 3.0
#: Objects of known size: name, long edge and short edge in mm. The card format of everyday cards.
REFERENCES = (("card, long edge", 85.60), ("card, short edge", 53.98))


def reference_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REFERENCES), "reference string, reference_mm double")


def sensor_cover() -> Column:
    """The sensor's height in mm that the image spans: an image wider than the sensor is a crop of its height."""
    wide = F.col("image_w_px") / F.col("image_h_px") > F.col("sensor_w_mm") / F.col("sensor_h_mm")
    return F.when(wide, F.col("sensor_w_mm") * F.col("image_h_px") / F.col("image_w_px")).otherwise(F.col("sensor_h_mm"))


def scale_unavailable() -> Column:
    """The first ingredient that is missing, null if none is: a fact about the device, not about the pack."""
    return (
        F.when(F.col("sensor_h_mm").isNull(), "sensor").when(F.coalesce(F.col("calibration"), F.lit(UNCALIBRATED)) == UNCALIBRATED, "uncalibrated")
        .when(F.col("focal_mm").isNull(), "focal length").when(F.col("diopters").isNull(), "focus"))


def mm_scale(optics: DataFrame) -> DataFrame:
    """min_mm and max_mm of one pixel and `scale_source`, null where there is no scale; `unavailable` names a missing ingredient.

    Thin lens: the subject is at 1000 / diopters mm, and a pixel spans (distance - focal) / focal of its width on the sensor. Focus at
    infinity, or nearer than the focal length, gives no scale. The near end of the distance is kept just beyond the focal length.
    """
    distance = F.when(F.col("diopters") > 0, 1000.0 / F.col("diopters"))
    corrected = F.col("correction") != 1.0
    tolerance = F.when(corrected, CORRECTED).when(F.col("calibration") == 2, CALIBRATED).otherwise(APPROXIMATE)
    per_px = lambda d: sensor_cover() / F.col("image_h_px") * (d - F.col("focal_mm")) / F.col("focal_mm") * F.col("correction")
    usable = scale_unavailable().isNull() & (distance > F.col("focal_mm")) & (F.col("correction") > 0) & (F.col("sensor_h_mm") > 0) & (F.col("image_h_px") > 0) & (F.col("focal_mm") > 0)
    usable = F.coalesce(usable, F.lit(False))
    near = F.greatest(distance * (1 - tolerance), F.col("focal_mm") * 1.0001)
    return optics.select(
        "*", F.when(usable, per_px(near)).alias("min_mm"), F.when(usable, per_px(distance * (1 + tolerance))).alias("max_mm"),
        F.when(usable, F.when(corrected, "CALIBRATED_DEVICE").otherwise("REPORTED_OPTICS")).alias("scale_source"), scale_unavailable().alias("unavailable"))


def mm_measure(scaled: DataFrame, px: str = "height_px") -> DataFrame:
    """`scaled` with a length of `px` pixels as a range: low_mm, high_mm, middle_mm and text; null without a scale."""
    low, high = F.col("min_mm") * F.col(px), F.col("max_mm") * F.col(px)
    return scaled.select("*", low.alias("low_mm"), high.alias("high_mm"), ((low + high) / 2).alias("middle_mm"), F.when(low.isNotNull(), F.format_string("%.2f-%.2f mm", low, high)).alias("measured"))


def cap_heights(agreed: DataFrame, scales: DataFrame, fields: Sequence[str] = ("mrp", "net_quantity")) -> DataFrame:
    """scan_id, field, low_mm, high_mm of the fields whose height is ruled; blank captions and flat boxes have none.

    agreed: scan_id, field, anchor_only, box_h_px; scales: scan_id, min_mm, max_mm.
    """
    printed = agreed.where(F.col("field").isin(*fields) & ~F.col("anchor_only") & (F.col("box_h_px") > 0))
    return mm_measure(printed.join(scales.where("min_mm is not null"), "scan_id"), "box_h_px").select("scan_id", "field", "low_mm", "high_mm", "measured", "scale_source")


def min_height(measured: DataFrame, least_mm: float) -> DataFrame:
    """`measured` has height_px, min_mm, max_mm, unavailable; adds the status of the height rule."""
    low, high = F.col("min_mm") * F.col("height_px"), F.col("max_mm") * F.col("height_px")
    status = F.when(F.col("unavailable").isNotNull(), "NOT_APPLICABLE").when(low.isNull() | high.isNull(), "NOT_ASSESSABLE").when(low >= least_mm, "PASS").when(high < least_mm, "FAIL").otherwise("NEEDS_REVIEW")
    return measured.withColumn("status", status)


def calibration_compute(shots: DataFrame) -> DataFrame:
    """`shots` with correction, error_percent and described: reference_mm over reference_px against the optics' mm_per_px.

    Null where an input is not above 0, or the correction reaches a factor of MAX_CORRECTION either way.
    """
    sound = (F.col("reference_mm") > 0) & (F.col("reference_px") > 0) & (F.col("mm_per_px") > 0)
    correction = F.try_divide(F.try_divide(F.col("reference_mm"), F.col("reference_px")), F.col("mm_per_px"))
    kept = F.when(F.coalesce(sound, F.lit(False)), F.when((correction > 1 / MAX_CORRECTION) & (correction < MAX_CORRECTION), correction))
    out = shots.withColumn("correction", kept).withColumn("error_percent", (F.col("correction") - 1.0) * 100)
    described = F.format_string("%s, %.1f mm measured across %d px (device out by %+.0f%%)", "reference", "reference_mm", F.col("reference_px").cast("int"), "error_percent")
    return out.withColumn("described", F.when(F.col("correction").isNotNull(), described))


def calibration_apply(shots: DataFrame, calibrations: DataFrame) -> DataFrame:
    """`shots` (device_id, diopters) with the correction of the device's newest calibration, 1 where none applies at the focus."""
    newest = latest_calibration(calibrations).select("device_id", F.col("correction").alias("c"), F.col("diopters").alias("at"))
    ratio = F.try_divide(F.col("diopters"), F.col("at"))
    near = (F.col("diopters") > 0) & (F.col("at") > 0) & ratio.between(1 / WINDOW, WINDOW)
    return shots.join(newest, "device_id", "left").withColumn("correction", F.when(F.coalesce(near, F.lit(False)), F.col("c")).otherwise(1.0)).drop("c", "at")


def latest_calibration(calibrations: DataFrame, low: float = 1 / 3, high: float = 3.0) -> DataFrame:
    """The newest plausible calibration of each device."""
    order = Window.partitionBy("device_id").orderBy(F.desc("calibrated_at"))
    return calibrations.where(F.col("correction").between(low, high)).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def burst_ratio(bursts: DataFrame) -> DataFrame:
    """Sharpness against the burst's sharpest; 1 for a lone frame or a burst without any."""
    w = Window.partitionBy("burst_id")
    top = F.max("variance").over(w)
    return bursts.withColumn("ratio", F.when((F.count(F.lit(1)).over(w) == 1) | (top <= 0), F.lit(1.0)).otherwise(F.col("variance") / top))


def focus_gate(bursts: DataFrame) -> DataFrame:
    """The frames at or over the floor; all frames of a burst that has none."""
    kept = burst_ratio(bursts).withColumn("sharp", F.col("ratio") >= FOCUS_FLOOR)
    kept = kept.withColumn("any_sharp", F.max("sharp").over(Window.partitionBy("burst_id")))
    return kept.where(F.col("sharp") | ~F.col("any_sharp")).drop("sharp", "any_sharp")


def laplacian_variance(luma: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian over the inner pixels; 0 for an image under three pixels a side."""
    if min(luma.shape) < 3:
        return 0.0
    x = luma.astype(np.int64)
    edges = x[1:-1, :-2] + x[1:-1, 2:] + x[:-2, 1:-1] + x[2:, 1:-1] - 4 * x[1:-1, 1:-1]
    return float((edges.astype(np.float64) ** 2).mean() - edges.mean() ** 2)


def _sharpness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for h, w, channels, data in zip(batch.height, batch.width, batch.channels, batch["data"], strict=True):
            pixels = np.frombuffer(data, np.uint8).reshape(h, w, channels).astype(np.int64)
            # Rec. 601 luma in integers; the image source gives blue, green, red
            grey = pixels[..., 0] if channels == 1 else (77 * pixels[..., 2] + 150 * pixels[..., 1] + 29 * pixels[..., 0]) >> 8
            found.append(laplacian_variance(grey))
        yield pd.DataFrame({"origin": batch.origin, "variance": found})


def frame_sharpness(images: DataFrame) -> DataFrame:
    """origin, variance of the rows of Spark's image source (column image)."""
    return images.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data").mapInPandas(_sharpness, "origin string, variance double")
