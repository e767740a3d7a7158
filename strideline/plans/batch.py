"""Offline replay: samples to strides, baseline model, scores, gain and set-point.

Samples are read once: a stride's metrics and the moments of its channels are one aggregate, and that
table, a row a stride, is written to the shared folder.  All that follows works on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.functions import columns as C
from strideline.functions.matrices import scaled_logs
from strideline.operators import folds, models, references, segments
from strideline.operators.live import EXCURSION_WEIGHT, SWING_SCALE, SWING_WEIGHT, baseline_model
from strideline.operators.models import LEAST_SPREAD, RIDGE
from strideline.operators.policy import AssistPolicy
from strideline.sources.shared import fresh_folder
from strideline.sources.sinks import Config

#: Metrics that a reference has intervals of, in their order, and the channels of log vectors unless others are named.
METRICS, CHANNELS = ["swing_ratio", "excursion"], ("x", "k")


def stride_moments(samples: DataFrame, config: Config, validity: tuple = (), channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Valid strides: their metrics, each channel's count, mean and variance, and ``cov``, the upper triangle of the channels' covariance.

    ``validity`` holds the least samples and the shortest and longest time of a valid stride.
    A value that is not finite is left out of the moments it belongs to; where a moment has
    none at all ``cov`` is null.  ``nth`` counts a session's strides that have one, up to and with
    this.  ``veto``, a column that samples may have, is a stride's last sample's.  The rows are
    written to the shared folder and read back.
    """
    segments.check_channels(samples, [*channels])
    value = [F.when(C.finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in channels]
    cov = [F.covar_samp(a, b) if i < j else F.var_samp(a) for i, a in enumerate(value) for j, b in enumerate(value) if i <= j]
    veto = F.max_by("veto", F.struct(*segments.ORDER)) if "veto" in samples.columns else F.first(F.lit(False))
    more = (F.array(*map(F.count, value)).alias("counts"), F.array(*map(F.avg, value)).alias("means"), F.array(*map(F.var_pop, value)).alias("variances"), F.array(*cov).alias("cov"), F.coalesce(veto, F.lit(False)).alias("veto"))
    needed = dict.fromkeys(["session", "seq", "t", "x", "k", "strike", "swing", *channels, *(["veto"] if "veto" in samples.columns else [])])
    rows = segments.metrics(segments.cut(samples.select(*needed)), *validity, more=more).where("valid")
    rows = rows.withColumn("cov", F.when(F.forall("cov", C.finite), F.col("cov")))
    so_far = Window.partitionBy("session").orderBy("stride_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("nth", F.count("cov").over(so_far))
    folder = fresh_folder(samples.sparkSession, "strides")
    rows.select("session", "stride_id", "t_end", "stride_time", "swing_ratio", "excursion", "counts", "means", "variances", "cov", "veto", "nth").write.parquet(folder)
    return samples.sparkSession.read.parquet(folder)


def _early(strides: DataFrame, config: Config) -> DataFrame:
    return strides.where((F.col("nth") <= config.baseline_strides) & F.col("cov").isNotNull())


def _models(strides: DataFrame, config: Config, opening: DataFrame | None = None, target: str = "interpolated_target", alpha: float = 0.3) -> DataFrame:
    """A row a session: frozen spreads of the channels, states, bounds and intervals of its first strides.

    ``opening``, one row ``healthy``, is a reference's centre: ``aim`` is then what ``target`` makes of it, and
    ``scale`` that of the distances to it; else both are the session's own.
    """
    if target not in models.TARGET_MODES:
        raise ValueError(f"unknown target {target!r}; known: {', '.join(models.TARGET_MODES)}")

    def model(group: pa.Table) -> pa.Table:
        group = group.sort_by("stride_id")
        counts, means, variances, cov = (np.array(group[c].to_pylist(), float) for c in ("counts", "means", "variances", "cov"))
        total = counts.sum(axis=0)
        middle = (counts * means).sum(axis=0) / total
        spread = np.maximum(np.sqrt((counts * (variances + (means - middle) ** 2)).sum(axis=0) / total), LEAST_SPREAD)
        v = scaled_logs(cov, np.broadcast_to(spread, means.shape), RIDGE)
        found = baseline_model(v)
        centre = np.array(found["centre"])
        found |= {"spread": spread.tolist(), "aim": found["centre"]}
        healthy = group["healthy"][0].as_py()
        if healthy is not None:
            aim = {"patient_baseline": centre, "interpolated_target": (1 - alpha) * centre + alpha * np.array(healthy), "healthy_region": np.array(healthy)}[target]
            d = np.linalg.norm(v - aim, axis=1)
            found |= {"aim": aim.tolist(), "scale": float(d.mean() + 2 * d.std())}
        for c in METRICS:
            found[f"{c}_range"] = np.percentile(group[c].to_numpy(), [5, 95]).tolist()
        return pa.table({"session": group["session"].slice(0, 1)} | {k: [found[k]] for k in kinds})

    kinds = {"centre": "array<double>", "centres": "array<array<double>>", "near_mean": "double", "near_sd": "double", "scale": "double", "spread": "array<double>", "aim": "array<double>"} | {f"{c}_range": "array<double>" for c in METRICS}
    rows = _early(strides, config).select("session", "stride_id", "counts", "means", "variances", "cov", *METRICS)
    rows = rows.withColumn("healthy", F.lit(None).cast("array<double>")) if opening is None else rows.join(F.broadcast(opening.select("healthy")))  # one row
    return rows.groupBy("session").applyInArrow(model, f"session {dict(strides.dtypes)['session']}, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _log_vector(cov: pd.Series, spread: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(cov), dtype=object)
    some = np.flatnonzero(cov.notna() & spread.notna())
    if len(some):
        found = scaled_logs(np.stack(cov.iloc[some].to_list()), np.stack(spread.iloc[some].to_list()), RIDGE)
        for place, v in zip(some, found, strict=True):
            out.iat[place] = v
    return out


def reference(samples: DataFrame, config: Config | None = None, validity: tuple = (), channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row, ``healthy``: the mean of the centres of healthy sessions' first strides, each scaled by its own."""
    strides = stride_moments(samples, config or Config(), validity, channels)
    return _models(strides, config or Config()).agg(models.mean_vector("centre", _width(channels)).alias("healthy"))


def _width(channels: tuple[str, ...]) -> int:
    return len(channels) * (len(channels) + 1) // 2


def reference_bank(samples: DataFrame, label: Column, config: Config | None = None, validity: tuple = (), channels: tuple[str, ...] = CHANNELS, most_strides: int | None = None) -> DataFrame:
    """A bank for ``replay``: a reference (``references.build_bank``) for each ``label`` of healthy sessions' strides.

    ``label`` is an expression over a stride's columns, one literal for a single reference.  Each
    session is scaled by its own first strides; ``most_strides`` takes that many of each session only.
    """
    config = config or Config()
    strides = stride_moments(samples, config, validity, channels)
    rows = strides.join(_models(strides, config).select("session", "spread"), "session")
    rows = rows.withColumn("v", _log_vector("cov", "spread")).withColumn("label", label)
    if most_strides is not None:
        rows = rows.where(F.col("nth") <= most_strides)
    return references.build_bank(rows, METRICS, width=_width(channels))


def replay(
    samples: DataFrame, config: Config | None = None, healthy: DataFrame | None = None, target: str = "interpolated_target", alpha: float = 0.3, validity: tuple = (),
    channels: tuple[str, ...] = CHANNELS, bank: DataFrame | None = None,
) -> DataFrame:
    """One row per stride after the baseline: nearest state, log distances, outlier flag, errors, score and gain.

    The baseline, a session's first strides, gives the frozen scaling of the ``channels``,
    the number of states and their centres, the outlier bound, the spread that distances
    are measured in, and the intervals of the metrics.  That model is one row that is
    joined back to the session's strides; nothing leaves the executors.

    Distances are measured from the session's own centre, or with a ``reference`` from
    what ``target`` names; their scale is that of the baseline's distances to the same.  With a
    ``bank`` (``reference_bank``) each stride takes the whole reference of its cadence:
    centre, intervals and, where the target is ``healthy_region``, its region, beyond which ``e_r`` counts;
    else the scale is that of the bank's last reference.  Its rows have ``source``, ``d_healthy`` and ``inside`` as well.

    A stride without a log vector has no distances, state or score and leads the gain toward 0, as does one with a veto.
    """
    config = config or Config()
    strides = stride_moments(samples, config, validity, channels)
    if bank is not None:
        # read several times below, a row a label
        folder = fresh_folder(samples.sparkSession, "bank")
        bank.write.parquet(folder)
        bank = samples.sparkSession.read.parquet(folder)
        healthy = models.as_bank(bank, references.PAYLOAD).select(F.element_at("bank", -1)["centre"].alias("healthy"))
    model = _models(strides, config, healthy, target, alpha)
    n = config.baseline_strides
    late = strides.where((F.col("nth") > n) | (F.col("cov").isNull() & (F.col("nth") >= n))).join(model, "session")
    late = late.withColumn("v", _log_vector("cov", "spread")).withColumn("bound", F.col("near_mean") + config.ood_sigmas * F.col("near_sd"))
    known = F.col("v").isNotNull()
    swing, exc, extra = F.col("swing_ratio_range"), F.col("excursion_range"), []
    if bank is not None:
        late = references.choose_reference(late, bank)
        ref = F.col("reference")
        late = late.withColumn("aim", models.target_of(F.col("centre"), ref["centre"], target, alpha)[1]).withColumn("d_healthy", C.distance(F.col("v"), ref["centre"]))
        late = late.withColumn("inside", F.col("d_healthy") <= ref["threshold"]).withColumn("source", models.range_source(F.lit(True), F.lit(True), ref["label"]))
        swing, exc = (F.array(ref["ranges"][i]["lower"], ref["ranges"][i]["upper"]) for i in range(2))
        extra = ["source", "d_healthy", "inside"]
    late = late.withColumn("d", C.distance(F.col("v"), F.col("aim")))
    nearest = F.array_min(F.transform("centres", lambda c, i: F.struct(C.distance(F.col("v"), c).alias("d"), i.alias("state"))))
    late = late.withColumn("nearest", F.when(known, nearest)).withColumn("state", F.col("nearest.state")).withColumn("d_state", F.col("nearest.d"))
    e_r = F.when(F.col("scale") > 0, C.clip(F.col("d") / F.nullif(F.col("scale"), F.lit(0.0)), 0.0, 1.0)).otherwise(0.0)
    if bank is not None and target == "healthy_region":
        e_r = C.region_deviation(F.col("d_healthy"), F.col("reference.threshold"), F.col("reference.scale"))
    late = late.withColumn("e_swing", C.interval_error(F.col("swing_ratio"), swing[0], swing[1], F.lit(SWING_SCALE), "deficit"))
    # a total loss of excursion is an error of 1
    late = late.withColumn("e_exc", C.interval_error(F.col("excursion"), exc[0], exc[1], F.greatest(exc[0], F.lit(1e-9)), "deficit"))
    e_b = C.weighted_deficit([(SWING_WEIGHT, F.col("e_swing")), (EXCURSION_WEIGHT, F.col("e_exc"))])
    late = late.withColumn("ood", F.coalesce(F.col("d_state") > F.col("bound"), F.lit(False))).withColumn("e_r", F.when(known, e_r)).withColumn("e_b", e_b)
    raw = F.when(known, C.assist_score(F.col("e_b"), F.col("e_r")) * config.most_gain)
    scored = late.withColumn("x", raw).withColumn("t", F.col("stride_id").cast("double")).withColumn("seq", F.col("stride_id"))
    given = ("stride_id", "t_end", "state", "d_state", "d", "bound", "scale", "e_swing", "e_exc", "e_b", "e_r", *extra)
    gain = folds.run_machine(scored.select("session", "seq", "t", "x", "ood", "veto", *given), AssistPolicy(config), keep=(*given, "ood"))
    return gain.select("session", *given[:7], "ood", *given[7:], "gain", "engaged", "updated")
