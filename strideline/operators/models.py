"""A session's model: frozen scaling, log vectors of its strides, baseline, reference bank, targets.

Every model is a row that is joined to the strides of its session; a bank is a table of one
row a label.  What cannot be represented is a reason in a column, never an exception in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.functions import columns as C
from strideline.functions.matrices import c_squares, log_vectors_2x2, moments_2x2
from strideline.operators.segments import ORDER, check_channels
from strideline.sources.sinks import blank_non_finite

#: Least spread that a channel is divided by, and what is added to each variance.
LEAST_SPREAD, RIDGE = 1e-8, 1e-6
#: Targets that distances can be measured from.
TARGET_MODES = ("patient_baseline", "interpolated_target", "healthy_region")


# --- scaling ----------------------------------------------------------------------------

def fit_scaling(cut_samples: DataFrame, channels: list[str], strides: int) -> DataFrame:
    """(session, channels, mean, spread, reason): scaling of a session's first strides, null arrays and a reason where a value is not finite."""
    check_channels(cut_samples, channels)
    early = cut_samples.where(F.col("stride_id") < strides)
    value = {c: F.col(c).cast("double") for c in channels}
    fine = F.bool_and(C._all([C.finite(v) for v in value.values()]))
    rows = early.groupBy("session").agg(
        fine.alias("fine"), F.array(*[F.avg(v) for v in value.values()]).alias("mean"),
        F.array(*[F.greatest(F.stddev_pop(v), F.lit(LEAST_SPREAD)) for v in value.values()]).alias("spread"),
    )
    names = F.array(*[F.lit(c) for c in channels])
    return rows.select("session", names.alias("channels"), F.when(F.col("fine"), F.col("mean")).alias("mean"), F.when(F.col("fine"), F.col("spread")).alias("spread"), F.when(F.col("fine"), "").otherwise("non_finite").alias("reason"))


def scale(df: DataFrame, scaling: DataFrame, channels: list[str], back: bool = False) -> DataFrame:
    """``df`` with its channels scaled by its session's row, or scaled ``back``; a KeyError for a channel that the table lacks.

    A model of another number of channels gives nulls.
    """
    check_channels(df, channels)
    rows = df.join(scaling.select("session", "mean", "spread"), "session")
    fits = F.size("mean") == len(channels)
    one = lambda i, c: F.col(c) * F.col("spread")[i] + F.col("mean")[i] if back else (F.col(c) - F.col("mean")[i]) / F.col("spread")[i]
    return rows.withColumns({c: F.when(fits, one(i, c)) for i, c in enumerate(channels)}).select(*df.columns)


def scaling_json(scaling: DataFrame) -> DataFrame:
    """(session, json) of scaling rows."""
    return scaling.select("session", F.to_json(F.struct("channels", "mean", "spread", "reason")).alias("json"))


def scaling_of_json(rows: DataFrame) -> DataFrame:
    """Scaling rows of (session, json)."""
    kind = "struct<channels: array<string>, mean: array<double>, spread: array<double>, reason: string>"
    return rows.select("session", F.from_json("json", kind).alias("m")).select("session", "m.*")


# --- strides as log vectors ----------------------------------------------------------------

def log_vectors(cut_samples: DataFrame) -> DataFrame:
    """(session, stride_id, v, reason): logarithm of the covariance of x and k as a vector that keeps lengths; null with a reason where there is none."""
    return with_log_vector(cut_samples.groupBy("session", "stride_id").agg(log_moments()))


def log_moments() -> Column:
    """Aggregate ``moments``: what ``with_log_vector`` needs of a stride's samples (t, seq, closing, x, k), which are put in order, the closing one last."""
    k, x = F.col("k").cast("double"), F.col("x").cast("double")
    rows = F.array_sort(F.collect_list(F.struct("closing", *ORDER, x.alias("x"), k.alias("k"))))
    return F.struct(F.count("*").alias("n"), F.bool_and(C.finite(x) & C.finite(k)).alias("fine"), rows["x"].alias("x"), rows["k"].alias("k")).alias("moments")


def with_log_vector(rows: DataFrame) -> DataFrame:
    """``rows`` with v and reason in place of ``moments``.

    Variances are summed in the order of the samples, so any partitioning gives the same bits, and those of the
    SQL: two strides lie equally far from their middle, where the last bit tells whether both are inside.
    """
    rows = rows.withColumn("log", _log_2x2(F.col("moments")["x"], F.col("moments")["k"]))
    n, fine, a, b, c = (F.col("moments")["n"], F.col("moments")["fine"], *(F.col("log")[f] for f in "abc"))
    reason = C.first_reason((n < 2, "too_few_samples"), (~fine, "non_finite"), (~(a * c - b * b > 0), "not_positive_definite"))
    rows = rows.withColumn("reason", reason).withColumn("v", F.when(F.col("reason") == "", F.col("log")["v"]))
    return rows.select(*[x for x in rows.columns if x not in ("moments", "log", "v", "reason")], "v", "reason")


@F.arrow_udf(T.StructType([*[T.StructField(c, T.DoubleType()) for c in "abc"], T.StructField("v", T.ArrayType(T.DoubleType()))]))
def _log_2x2(x: pa.Array, k: pa.Array) -> pa.Array:
    """Entries 11, 12, 22 of each stride's covariance and its logarithm as a vector."""
    begin, size = x.offsets.to_numpy()[:-1].astype(np.int64), x.value_lengths().to_numpy().astype(np.int64)
    first = x.offsets[0].as_py()
    moments = moments_2x2(*(c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (x, k)), begin - first, size)
    a, b, c = moments[:, 0] + RIDGE, moments[:, 1], moments[:, 2] + RIDGE
    v = log_vectors_2x2(a, b, c)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * 3), pa.array(v.ravel()))
    return pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(c), lists], names=["a", "b", "c", "v"])


@F.arrow_udf(T.DoubleType())
def distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """``columns.distance`` with squares as the SQL rounds them, for distances that are held against others."""
    alike = pc.fill_null(pc.equal(pc.list_value_length(a), pc.list_value_length(b)), False)
    a, b = a.filter(alike), b.filter(alike)
    size = pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    x, y = (c.flatten() for c in (a, b))
    missing = ~(x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False))
    gaps = x.to_numpy(zero_copy_only=False).astype(float) - y.to_numpy(zero_copy_only=False).astype(float)
    total, known = np.zeros(len(size)), np.ones(len(size), bool)
    with np.errstate(all="ignore"):
        squares = c_squares(gaps)
        for i in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > i)
            total[on] += squares[begin[on] + i]
            known[on] &= ~missing[begin[on] + i]
    place, ok = np.flatnonzero(alike.to_numpy(zero_copy_only=False)), np.zeros(len(alike), bool)
    out = np.zeros(len(alike))
    out[place], ok[place] = np.sqrt(total), known
    return pa.array(out, mask=~ok)


def mean_vector(column: str, width: int) -> Column:
    """Element by element mean of a column of arrays."""
    return F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(width)])


def baseline_strides(strides: DataFrame, first: int) -> DataFrame:
    """Each session's first strides that have a vector (session, stride_id, v)."""
    nth = F.row_number().over(Window.partitionBy("session").orderBy("stride_id"))
    return strides.where("v is not null").withColumn("nth", nth).where(F.col("nth") <= first).drop("nth")


def baselines(strides: DataFrame, first: int, width: int = 3, last_first: bool = False) -> DataFrame:
    """(session, n, centre, d_mean, d_std, threshold, scale, reason): each session's first strides that have a vector (session, stride_id, v).

    ``threshold`` is the 95th percentile of the distances to the centre, ``scale`` the
    greatest of its way to the median, their spread and 1e-9.  Fewer than two strides are no baseline.
    The spread takes the distances in the order of the strides or ``last_first``: of two that differ by their
    last bit it is 0 in one order and not in the other.
    """
    early = baseline_strides(strides, first)
    centre = early.groupBy("session").agg(mean_vector("v", width).alias("centre"))
    near = early.join(centre, "session").withColumn("d", distance(F.col("v"), F.col("centre")))
    out = near.groupBy("session").agg(F.count("*").alias("n"), F.first("centre").alias("centre"), F.avg("d").alias("d_mean"), F.array_sort(F.collect_list("d")).alias("all"), F.sort_array(F.collect_list(F.struct("stride_id", "d")), asc=not last_first)["d"].alias("turn"))
    enough = F.col("n") >= 2
    out = out.withColumn("threshold", C.quantile(F.col("all"), 0.95)).withColumn("d_std", C.spread(F.col("turn")))
    out = out.withColumn("scale", F.greatest(F.col("threshold") - C.quantile(F.col("all"), 0.5), F.col("d_std"), F.lit(1e-9)))
    columns = ["centre", "d_mean", "d_std", "threshold", "scale"]
    return out.select("session", "n", *[F.when(enough, F.col(c)).alias(c) for c in columns], F.when(enough, "").otherwise("too_few_strides").alias("reason"))


# --- references -----------------------------------------------------------------------------

def target_of(patient: Column, healthy: Column, mode: str, alpha: float) -> tuple[Column, Column]:
    """(mode, target): what the distance is measured from; without a reference the patient's own centre."""
    if mode not in TARGET_MODES:
        raise ValueError(f"unknown target {mode!r}; known: {', '.join(TARGET_MODES)}")
    target = {"patient_baseline": patient, "interpolated_target": C.interpolate(patient, healthy, alpha), "healthy_region": healthy}[mode]
    return F.when(healthy.isNull(), TARGET_MODES[0]).otherwise(mode), F.when(healthy.isNull(), patient).otherwise(target)


def as_bank(references: DataFrame, columns: tuple[str, ...] = ("lower", "upper")) -> DataFrame:
    """One row: the references (label, lower, upper, ...) as an array in the bank's order, which is by lower bound, null last, then by label.

    A bank has a row for each recorded cadence, a few dozen at most; ``MOST_LABELS`` is checked.
    """
    place = F.struct(F.col("lower").isNull().alias("last"), "lower", "label", *[c for c in columns if c != "lower"])
    row = references.agg(F.array_sort(F.collect_list(place)).alias("bank"))
    return row.select(F.when(F.size("bank") <= MOST_LABELS, F.col("bank")).otherwise(F.raise_error(F.lit(f"a bank has {MOST_LABELS} labels at most"))).alias("bank"))


#: Labels of a bank at most: its row is broadcast.
MOST_LABELS = 1000


def select_reference(strides: DataFrame, bank: DataFrame, value: str = "stride_time") -> DataFrame:
    """Adds label and gap: the reference whose interval lies nearest to a stride's cadence; the bank's last label where that is unknown."""
    v = F.col(value)
    gaps = F.transform("bank", lambda b: F.struct(F.when(b["lower"].isNull() | b["upper"].isNull(), float("inf")).otherwise(F.greatest(b["lower"] - v, v - b["upper"], F.lit(0.0))).alias("gap"), b["label"].alias("label")))
    best = F.when(C.finite(v), F.array_min(gaps))
    rows = strides.join(F.broadcast(bank)).withColumn("best", best)
    label = F.when(F.col("best").isNull(), F.element_at("bank", -1)["label"]).otherwise(F.col("best.label"))
    return rows.withColumn("label", label).withColumn("gap", F.col("best.gap")).drop("bank", "best")


def range_source(has_bank: Column, has_reference: Column, label: Column) -> Column:
    """Where a stride's intervals come from."""
    return F.when(has_bank, F.concat(F.lit("healthy_reference:"), label)).when(has_reference, "healthy_reference").otherwise("patient_baseline")


def write_bank(references: DataFrame, path: str) -> None:
    """A reference (one row) or a bank (a row a label)."""
    blank_non_finite(references).write.mode("overwrite").parquet(path)


def read_bank(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """('reference' or 'bank', its rows): which of the two a folder holds is told by its rows."""
    rows = spark.read.parquet(path)
    return ("bank" if rows.limit(2).count() > 1 else "reference"), rows


def warnings_of(n: Column, k: Column, has_reference: Column) -> Column:
    """Texts that a model's report carries."""
    return F.filter(F.array(
        F.when(n < 30, F.concat(F.lit("baseline of "), n.cast("string"), F.lit(" strides; 30 are advised"))),
        F.when(k < 2, F.lit("one state only")), F.when(~has_reference, F.lit("no healthy reference: deviations are from the session's own baseline")),
    ), lambda w: w.isNotNull())


def distances(strides: DataFrame, references: DataFrame, mode: str, alpha: float, how: str = "inner") -> DataFrame:
    """``strides`` (session, v, ...) with d_patient, d_healthy and d_target; references: (session, centre, healthy), healthy null where there is none.

    ``how`` is the join: ``left`` keeps strides of sessions without a reference, with null distances.
    """
    chosen = references.withColumn("target", target_of(F.col("centre"), F.col("healthy"), mode, alpha)[1])
    rows = strides.join(chosen.select("session", "centre", "healthy", "target"), "session", how)
    rows = rows.withColumns({f"d_{n}": distance(F.col("v"), F.col(c)) for n, c in (("patient", "centre"), ("healthy", "healthy"), ("target", "target"))})
    return rows.drop("centre", "healthy", "target")


def distance_scales(measured: DataFrame, first: int) -> DataFrame:
    """(session, scale_patient, scale_healthy, scale_target): mean and two spreads of the first strides' distances."""
    nth = F.row_number().over(Window.partitionBy("session").orderBy("stride_id"))
    early = measured.where("v is not null").withColumn("nth", nth).where(F.col("nth") <= first)
    return early.groupBy("session").agg(*[(F.avg(f"d_{n}") + 2 * F.stddev_pop(f"d_{n}")).alias(f"scale_{n}") for n in ("patient", "healthy", "target")])


def model_json(models_: DataFrame) -> DataFrame:
    """(session, json) of any model rows; what is not finite is left out."""
    rows = blank_non_finite(models_)
    return rows.select("session", F.to_json(F.struct(*[c for c in rows.columns if c != "session"])).alias("json"))


def model_of_json(rows: DataFrame, kind: str) -> DataFrame:
    """Model rows of (session, json); ``kind`` is their schema without the session."""
    return rows.select("session", F.from_json("json", kind).alias("m")).select("session", "m.*")


def centre_distances(centres: DataFrame) -> DataFrame:
    """(a, b, d) for each two labels of (label, centre), the smaller first; a table of labels is small, and its size is checked."""
    row = centres.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("all"))
    row = row.select(F.when(F.size("all") <= MOST_LABELS, F.col("all")).otherwise(F.raise_error(F.lit(f"{MOST_LABELS} labels at most"))).alias("all"))
    pairs = row.select(F.posexplode("all").alias("i", "x"), "all").select("x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    return pairs.select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), C.distance(F.col("x.centre"), F.col("y.centre")).alias("d"))
