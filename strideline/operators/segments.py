"""Strides: cutting samples at strikes, their metrics and validity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.functions.columns import finite, magnitude

ORDER = ["t", "seq"]


def by_session(*more: str) -> Window:
    """Samples of a session in time order; equal times by sequence number."""
    return Window.partitionBy("session", *more).orderBy(*ORDER)


def cut(samples: DataFrame) -> DataFrame:
    """Samples with stride_id and closing: a strike ends one stride and opens the next, so its row is in both.

    Rows before the first strike and the stride that no strike closes are left out.
    """
    n = F.sum(F.col("strike").cast("long")).over(by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(F.col("strike").cast("long")).over(Window.partitionBy("session"))
    numbered = samples.withColumn("n", n).withColumn("total", total)
    own = F.struct((F.col("n") - 1).alias("id"), F.lit(False).alias("closing"))
    before = F.struct((F.col("n") - 2).alias("id"), F.lit(True).alias("closing"))
    both = numbered.withColumn("part", F.explode(F.when(F.col("strike"), F.array(own, before)).otherwise(F.array(own))))
    inside = (F.col("part.id") >= 0) & (F.col("part.id") < F.col("total") - 1)
    return both.where(inside).select(*samples.columns, F.col("part.id").alias("stride_id"), F.col("part.closing").alias("closing"))


def metrics(cut_samples: DataFrame, min_samples: int = 3, shortest: float = 0.5, longest: float = 150.0, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each stride with its times, ratios, excursion and the first reason to reject it.

    An interval belongs to the phase of its left sample; the last sample has none.
    ``more`` are further aggregates over a stride's samples, taken in the same pass.
    """
    w = Window.partitionBy("session", "stride_id").orderBy(*ORDER)
    step = F.coalesce(F.lead("t").over(w) - F.col("t"), F.lit(0.0))
    rows = cut_samples.withColumn("step", step).withColumn("swings", F.col("swing") & ~F.col("closing"))
    out = rows.groupBy("session", "stride_id").agg(
        F.count("*").alias("n_samples"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        F.sum(F.when(F.col("swing"), F.col("step")).otherwise(0.0)).alias("swing_time"), F.sum(F.when(~F.col("swing"), F.col("step")).otherwise(0.0)).alias("stance_time"),
        (F.max("x") - F.min("x")).alias("excursion"), F.avg("x").alias("mean_x"), F.max(F.abs("k")).alias("peak_k"), F.stddev_pop("x").alias("rms_x"),
        F.count_if("swing").alias("n_swing"), F.count_if(~F.col("swing")).alias("n_stance"), F.count_if(~finite(F.col("x"))).alias("n_not_finite"), *more,
    )
    both = F.col("swing_time") + F.col("stance_time")
    out = out.withColumn("stride_time", F.col("t_end") - F.col("t_start"))
    out = out.withColumn("swing_ratio", F.when(both > 0, F.col("swing_time") / F.nullif(both, F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("swing_stance_ratio", F.when(F.col("stance_time") > 0, F.col("swing_time") / F.nullif(F.col("stance_time"), F.lit(0.0))).otherwise(0.0))
    return out.withColumn("reject_reason", reject_reason(min_samples, shortest, longest)).withColumn("valid", F.col("reject_reason") == "")


def reject_reason(min_samples: int, shortest: float, longest: float) -> Column:
    """First reason why a stride's metrics cannot be used; empty if they can."""
    out = F.lit("")
    checks = [("n_stance = 0", "no_stance"), ("n_swing = 0", "no_swing"), ("n_not_finite > 0", "non_finite"), (f"stride_time > {longest}D", "too_long"), (f"stride_time < {shortest}D", "too_short"), (f"n_samples < {min_samples}", "too_few_samples")]
    for condition, reason in checks:
        out = F.when(F.expr(condition), reason).otherwise(out)
    return out


def session_summary(strides: DataFrame) -> DataFrame:
    """Per session: strides, valid ones and their mean times."""
    good = F.col("valid")
    return strides.groupBy("session").agg(F.count("*").alias("strides"), F.count_if("valid").alias("valid_strides"), F.avg(F.when(good, F.col("stride_time"))).alias("mean_stride_time"), F.avg(F.when(good, F.col("swing_ratio"))).alias("mean_swing_ratio"), F.max(F.when(good, F.col("excursion"))).alias("max_excursion"))


def symmetry(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ratios of the strides of one side to those of the other, and each side's swing to stance; all null unless both sides have both times."""
    other = right.select("session", "pair", F.col("swing_time").alias("other_swing"), F.col("stance_time").alias("other_stance"))
    usable = (F.col("swing_time") > 0) & (F.col("stance_time") > 0) & (F.col("other_swing") > 0) & (F.col("other_stance") > 0)
    ratio = lambda a, b: F.when(usable, F.col(a) / F.nullif(F.col(b), F.lit(0.0)))
    out = left.join(other, ["session", "pair"], "left").select(
        "session", "pair", ratio("swing_time", "other_swing").alias("swing_symmetry"), ratio("stance_time", "other_stance").alias("stance_symmetry"),
        ratio("swing_time", "stance_time").alias("own_ratio"), ratio("other_swing", "other_stance").alias("other_ratio"),
    )
    return out.withColumn("ratio_symmetry", F.col("own_ratio") / F.nullif(F.col("other_ratio"), F.lit(0.0)))


def rms(axes: list[Column]) -> Column:
    """Aggregate: spread of the vector's length; null where a component is not finite."""
    fine = finite(axes[0])
    for a in axes[1:]:
        fine = fine & finite(a)
    return F.when(F.bool_and(fine), F.stddev_pop(magnitude(*axes)))


def trunk_rms(cut_samples: DataFrame, axes: list[Column]) -> DataFrame:
    """(session, stride_id, rms): spread of the vector's length within each stride; null where a component is not finite."""
    return cut_samples.groupBy("session", "stride_id").agg(rms(axes).alias("rms"))


def check_channels(df: DataFrame, channels: list[str]) -> None:
    """A KeyError that names the channels that a table lacks."""
    unknown = [c for c in channels if c not in df.columns]
    if unknown:
        raise KeyError(f"unknown channels: {', '.join(unknown)}; known: {', '.join(df.columns)}")


def to_vector(df: DataFrame, channels: list[str], name: str = "vector") -> DataFrame:
    """Adds the channels as one array of doubles."""
    check_channels(df, channels)
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in channels]))


def feature_matrix(cut_samples: DataFrame, channels: list[str], points: int = 100) -> DataFrame:
    """(session, stride_id, a column for each channel): the channel over the cycle in ``points`` values.

    A stride's samples are gathered and put in order once for all channels; strides of one sample are left out.
    The points of a batch of strides are looked up at once, so a point costs the same in strides of any length.
    A point beside a missing value is null.
    """
    check_channels(cut_samples, channels)
    names = [f"c{i}" for i in range(len(channels))]
    rows = cut_samples.groupBy("session", "stride_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, *[F.col(c).cast("double").alias(n) for c, n in zip(channels, names, strict=True)]))).alias("rows"))
    rows = rows.where(F.size("rows") >= 2).select("session", "stride_id", *[F.col("rows")[n].alias(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RESAMPLED):
                part = batch.slice(at, RESAMPLED)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[resampled(c, points) for c in part.columns[2:]]], names=["session", "stride_id", *names])

    kind = T.StructType([*rows.schema.fields[:2], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])
    return rows.mapInArrow(run, kind).withColumnsRenamed(dict(zip(names, channels, strict=True)))


#: Strides whose points are held at once.
RESAMPLED = 2000


def resampled(lists: pa.ListArray, n: int) -> pa.ListArray:
    """``columns.resample`` of each list, all of which have 2 values at least."""
    begin, size = lists.offsets.to_numpy()[:-1].astype(np.int64)[:, None], lists.value_lengths().to_numpy()[:, None]
    place = np.arange(n) * (size - 1).astype(float) / (n - 1)
    low = np.minimum(np.floor(place).astype(np.int64), size - 2)
    at = begin + low
    values = lists.values.to_numpy(zero_copy_only=False)
    a, b = values[at], values[at + 1]
    missing = lists.values.is_null().to_numpy(zero_copy_only=False) if lists.values.null_count else None
    points = pa.array((a + (b - a) * (place - low)).ravel(), mask=None if missing is None else (missing[at] | missing[at + 1]).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * n), points)

