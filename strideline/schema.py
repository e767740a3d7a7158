"""Canonical columns of a sample table and the adapter from event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channels of a device sample; a missing one reads as 0.0.
CHANNELS = ("timestamp", "belt_length", "belt_velocity", "motor_position", "motor_velocity", "motor_current", "accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")
SWING_TYPES = ("click", "view")
STRIKE_TYPE = "signup"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts: str) -> F.Column:
    """A zone-free timestamp as hours since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 3600000000D")


def of_events(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as samples: session, seq, t (hours), x, k, kind, strike, swing."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), hours("ts").alias("t"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), kind.alias("kind"), (kind == STRIKE_TYPE).alias("strike"), kind.isin(*SWING_TYPES).alias("swing"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as samples."""
    return of_events(table(spark, sf_dir, "events"))


SAMPLES_SQL = """s AS (SELECT user_id AS session, event_id AS seq, epoch_us(ts) / 3600000000.0::DOUBLE AS t, value AS x, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INT AS k,
  event_type AS kind, event_type = 'signup' AS strike, event_type IN ('click', 'view') AS swing FROM events)"""
