"""Writers and readers of logs, models and references, and the configuration."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles as null: a value that was not measured is no number."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in doubles})


def write_log(df: DataFrame, path: str) -> None:
    """A log as CSV with a header; null, NaN and infinity are empty cells, flags are 0 and 1."""
    flags = {f.name: F.col(f.name).cast("int") for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    blank_non_finite(df).withColumns(flags).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_logs(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Logs of several versions as one table of ``schema``; columns that a version lacks are null."""
    parts = []
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        parts.append(raw.select(*[(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def newest_log(spark: SparkSession, root: str, stage: str) -> str | None:
    """The log of a stage in the newest run folder that has one, else in the root; folders are named by time."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = sorted((str(s.getPath().getName()) for s in fs.listStatus(path) if s.isDirectory()), reverse=True)
    for where in [*(f"{root}/{r}" for r in runs), root]:
        found = f"{where}/{stage}.csv"
        if fs.exists(jvm.org.apache.hadoop.fs.Path(found)):
            return found
    return None


def write_models(df: DataFrame, path: str) -> None:
    """Models or references, one row each, as JSON lines."""
    blank_non_finite(df).write.mode("overwrite").json(path)


@dataclasses.dataclass(frozen=True)
class Config:
    """Settings of a run, in the units of the samples."""

    baseline_strides: int = 30
    least_confidence: float = 0.15
    ood_sigmas: float = 3.0
    most_gain: float = 0.8
    most_step: float = 0.1
    ood_gain: float = 0.2
    ood_streak: int = 5
    window: int = 3
    persist: int = 3
    settle: int = 10
    hold: int = 3
    fixed_gain: float = 0.0
    ood_policy: str = "hold"
    ood_safe_gain: float = 0.0

    def __post_init__(self) -> None:
        if self.ood_policy not in ("hold", "safe_minimum"):
            raise ValueError(f"unknown outlier policy {self.ood_policy!r}")

    @classmethod
    def load(cls, text: str) -> Config:
        """From JSON; an unknown key is an error."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)
