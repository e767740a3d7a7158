"""Healthy references by cadence, and strides scored against the one that fits each.

A reference is a row: the label, the cadence interval, the centre of its log vectors, the
region's threshold and scale, and an interval for each metric.  A bank is a table of
references; a stride takes the whole row whose cadence interval lies nearest, so that a slow stride
is never measured by a fast one's centre, region or intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.functions import columns as C
from strideline.operators import models

#: What a reference hands to a stride.
PAYLOAD = ("upper", "centre", "threshold", "scale", "ranges")
#: Percentiles of cadence and metric intervals, and the one that bounds the region.
ENDS, REGION = (0.05, 0.95), 0.95


def intervals(metrics: list[str]) -> Column:
    """Aggregate: array of (lower, upper) in the metrics' order."""
    ends = F.array(*map(F.lit, ENDS))
    return F.array(*[F.struct(F.percentile(m, ends)[0].alias("lower"), F.percentile(m, ends)[1].alias("upper")) for m in metrics])


def build_bank(strides: DataFrame, metrics: list[str], cadence: str = "stride_time", width: int = 3) -> DataFrame:
    """References (label, lower, upper, centre, threshold, scale, ranges, n) of strides (label, v, cadence, metrics); strides without a vector shape none."""
    rows = strides.where("v is not null")
    ends = F.percentile(cadence, F.array(*map(F.lit, ENDS)))
    out = rows.groupBy("label").agg(ends[0].alias("lower"), ends[1].alias("upper"), models.mean_vector("v", width).alias("centre"), intervals(metrics).alias("ranges"), F.count("*").alias("n"))
    far = rows.join(out.select("label", "centre"), "label").withColumn("d", C.distance(F.col("v"), F.col("centre")))
    q = F.percentile("d", F.array(F.lit(0.5), F.lit(REGION)))
    region = far.groupBy("label").agg(q[1].alias("threshold"), F.greatest(q[1] - q[0], F.stddev_pop("d"), F.lit(1e-9)).alias("scale"))
    return out.join(region, "label").select("label", "lower", "upper", "centre", "threshold", "scale", "ranges", "n")


def choose_reference(strides: DataFrame, bank: DataFrame, cadence: str = "stride_time") -> DataFrame:
    """Adds ``reference``, the bank's row for each stride (label and PAYLOAD): the nearest cadence interval, the last one where the cadence is unknown."""
    row = models.as_bank(bank, PAYLOAD)  # its size is checked
    chosen = models.select_reference(strides, row, cadence).drop("gap").join(F.broadcast(row.withColumnRenamed("bank", "_bank")))
    return chosen.withColumn("reference", F.get(F.filter("_bank", lambda b: b["label"] == F.col("label")), F.lit(0))).drop("_bank", "label")


def score_by_reference(strides: DataFrame, patients: DataFrame, terms: list[tuple[str, str, float | None, float]], metrics: list[str], target: str = "interpolated_target", alpha: float = 0.3, most_gain: float = 0.8) -> DataFrame:
    """Strides (session, stride_id, v, metrics, ``reference``) with distances, region, errors, source and raw gain.

    ``patients`` has (session, centre, ranges) of each session's own baseline.  A stride with a
    reference is measured by its centre, region and intervals; one without (null) by
    the session's own, has no healthy distance and no region, and its deviation is 0.
    ``terms``: metric, direction, scale (None: the interval's lower end) and weight.
    """
    rows = strides.join(patients.select("session", F.col("centre").alias("own"), F.col("ranges").alias("own_ranges")), "session")
    ref, known = F.col("reference"), F.col("reference").isNotNull()
    aim = models.target_of(F.col("own"), ref["centre"], target, alpha)[1]
    rows = rows.withColumns({"d_patient": C.distance(F.col("v"), F.col("own")), "d_healthy": C.distance(F.col("v"), ref["centre"]), "d_target": C.distance(F.col("v"), aim)})
    rows = rows.withColumns({
        "inside": F.when(known, F.col("d_healthy") <= ref["threshold"]), "deviation": F.coalesce(C.region_deviation(F.col("d_healthy"), ref["threshold"], ref["scale"]), F.lit(0.0)),
        "source": models.range_source(known, F.lit(False), ref["label"]), "used": F.coalesce(ref["ranges"], F.col("own_ranges")),
    })
    errors = {}
    for metric, direction, scale, _ in terms:
        low, high = F.col("used")[metrics.index(metric)]["lower"], F.col("used")[metrics.index(metric)]["upper"]
        errors[f"e_{metric}"] = C.interval_error(F.col(metric), low, high, low if scale is None else F.lit(scale), direction)
    rows = rows.withColumns(errors)
    rows = rows.withColumn("deficit", C.weighted_deficit([(t[3], F.col(f"e_{t[0]}")) for t in terms]))
    return rows.withColumn("raw_gain", C.assist_score(F.col("deficit"), F.col("deviation")) * most_gain).drop("own", "own_ranges", "used", "reference")
