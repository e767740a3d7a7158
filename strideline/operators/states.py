"""Gait states of strides: centres of a session's baseline, nearest state with its confidence, outliers, hold.

A session's model is one row, made of its first strides, so a bounded group; every stride is
then judged by columns and one window over its session.  What cannot be judged is invalid
with a reason, state UNKNOWN and null distances, never an exception in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions import columns as C
from strideline.operators import models
from strideline.operators.clusters import kmeans, select_k

#: Numbers of strides without a state and of outliers.
UNKNOWN, OUTLIER = -1, -2
#: Least confidence that gives a state of its own.
LEAST_CONFIDENCE = 0.15
#: What the distance to the second centre is enlarged by, against division by 0.
GUARD = 1e-6


def state_models(strides: DataFrame, first: int = 30) -> DataFrame:
    """(session, n, k, centre, centres, near_mean, near_sd, threshold, scale, reason) of strides (session, stride_id, v).

    The first ``first`` strides with a vector are clustered with the number of states that the gates of
    ``clusters.select_k`` accept, 1 if they accept none.  ``near_mean`` and ``near_sd`` are of
    the distances to the nearest centre; ``threshold`` and ``scale`` are those of the region about the
    session's own centre (95th percentile; the greatest of its way to the median, the spread and 1e-9).
    Fewer than two strides are no baseline: nulls and the reason.
    """
    def run(group: pa.Table) -> pa.Table:
        x = np.stack(group.sort_by("stride_id")["v"].to_pylist()).astype(float)
        row = {"session": group["session"][0].as_py(), "n": len(x), "reason": "" if len(x) >= 2 else "too_few_strides"}
        if len(x) >= 2:
            k, _ = select_k(x)
            centres = kmeans(x, k)[1] if k > 1 else x.mean(axis=0)[None, :]
            near = np.linalg.norm(x[:, None] - centres[None], axis=2).min(axis=1)
            own = np.linalg.norm(x - x.mean(axis=0), axis=1)
            middle, high = np.percentile(own, [50, 95])
            row |= {"k": k, "centre": x.mean(axis=0).tolist(), "centres": centres.tolist(), "near_mean": float(near.mean()), "near_sd": float(near.std())}
            row |= {"threshold": float(high), "scale": float(max(high - middle, own.std(), 1e-9))}
        return pa.Table.from_pylist([row], MODEL)

    early = models.baseline_strides(strides.select(F.col("session").cast("long").alias("session"), "stride_id", "v"), first)
    return early.groupBy("session").applyInArrow(run, "session long, n long, k int, centre array<double>, centres array<array<double>>, near_mean double, near_sd double, threshold double, scale double, reason string")


_VECTOR = pa.list_(pa.float64())
MODEL = pa.schema([("session", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("centre", _VECTOR), ("centres", pa.list_(_VECTOR)), ("near_mean", pa.float64()), ("near_sd", pa.float64()), ("threshold", pa.float64()), ("scale", pa.float64()), ("reason", pa.string())])


def state_name(state: Column) -> Column:
    """S0, S1, ...; UNKNOWN and OOD for the two numbers below 0."""
    return F.when(state == UNKNOWN, "UNKNOWN").when(state == OUTLIER, "OOD").otherwise(F.concat(F.lit("S"), state.cast("string")))


def assign_states(strides: DataFrame, state_rows: DataFrame, sigmas: float = 3.0, least_confidence: float = LEAST_CONFIDENCE, hold: bool = True, bound: float | None = None) -> DataFrame:
    """``strides`` (session, stride_id, v, reason, ...) with valid, message, nearest, runner_up, confidence, ood, state and gait_state.

    Of two centres equally near the first one counts.  The confidence is 1 - nearest / runner_up, held in [0, 1], and 1
    for a single state.  Beyond ``near_mean`` and ``sigmas`` spreads, or beyond ``bound`` if it is
    given, a stride is an outlier.  One of too little confidence keeps with ``hold`` the state of the session's last
    stride that had one of its own; after an outlier, at the start and without ``hold`` it is UNKNOWN.
    Invalid strides are passed over.  Stride numbers are unique in a session.
    """
    rows = strides.join(state_rows.select("session", "centres", "near_mean", "near_sd"), "session", "left")
    valid = F.col("v").isNotNull() & F.col("centres").isNotNull()
    given = F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise("no_vector")
    message = C.first_reason((F.col("v").isNull(), given), (F.col("centres").isNull(), "no_baseline"))
    ways = F.array_sort(F.transform("centres", lambda c, i: F.struct(C.distance(F.col("v"), c).alias("d"), i.alias("i"))))
    rows = rows.withColumn("valid", valid).withColumn("message", message).withColumn("ways", F.when(F.col("valid"), ways))
    rows = rows.withColumn("nearest", F.get("ways", F.lit(0))["d"]).withColumn("runner_up", F.get("ways", F.lit(1))["d"])
    trust = F.when(F.col("runner_up").isNull(), 1.0).otherwise(C.clip(1 - F.col("nearest") / (F.col("runner_up") + GUARD), 0.0, 1.0))
    limit = F.lit(bound) if bound is not None else F.col("near_mean") + sigmas * F.col("near_sd")
    rows = rows.withColumn("confidence", F.when(F.col("valid"), trust).otherwise(0.0)).withColumn("ood", F.col("valid") & (F.col("nearest") > limit))
    sure = F.when(F.col("ood"), OUTLIER).when(F.col("valid") & (F.col("confidence") >= least_confidence), F.get("ways", F.lit(0))["i"])
    rows = rows.withColumn("sure", sure)
    before = F.last("sure", ignorenulls=True).over(Window.partitionBy("session").orderBy("stride_id").rowsBetween(Window.unboundedPreceding, -1))
    held = F.when(F.col("valid") & (before >= 0), before) if hold else F.lit(None).cast("int")
    rows = rows.withColumn("state", F.coalesce("sure", held, F.lit(UNKNOWN)))
    return rows.withColumn("gait_state", state_name(F.col("state"))).drop("centres", "near_mean", "near_sd", "ways", "sure")


def analyse(strides: DataFrame, state_rows: DataFrame, healthy: DataFrame | None = None, target: str = "interpolated_target", alpha: float = 0.3, **options) -> DataFrame:
    """``assign_states`` with d_patient, d_healthy, d_target, inside and deviation of each stride.

    ``healthy`` has one row (healthy, healthy_threshold, healthy_scale).  With it ``inside`` and ``deviation``, 0 to 1, are
    those of its region; without it ``inside`` is null, the deviation is from the session's own region and
    distances are measured from its own centre.
    """
    rows = assign_states(strides, state_rows, **options)
    own = state_rows.select("session", "centre", "threshold", "scale")
    if healthy is not None:
        own = own.join(F.broadcast(healthy.select("healthy", "healthy_threshold", "healthy_scale")))  # one row
    else:
        own = own.withColumns({"healthy": F.lit(None).cast("array<double>"), "healthy_threshold": F.lit(None).cast("double"), "healthy_scale": F.lit(None).cast("double")})
    own = own.withColumn("target", models.target_of(F.col("centre"), F.col("healthy"), target, alpha)[1])
    rows = rows.join(own, "session", "left")
    rows = rows.withColumns({f"d_{n}": F.when(F.col("valid"), C.distance(F.col("v"), F.col(c))) for n, c in (("patient", "centre"), ("healthy", "healthy"), ("target", "target"))})
    away = F.when(F.col("healthy").isNull(), C.region_deviation(F.col("d_patient"), F.col("threshold"), F.col("scale"))).otherwise(C.region_deviation(F.col("d_healthy"), F.col("healthy_threshold"), F.col("healthy_scale")))
    rows = rows.withColumn("inside", F.col("d_healthy") <= F.col("healthy_threshold")).withColumn("deviation", F.when(F.col("valid"), away))
    return rows.drop("centre", "threshold", "scale", "healthy", "healthy_threshold", "healthy_scale", "target")
