"""Streaming twins: detection with kept state, windowed counts behind a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strideline.operators.folds import Machine, run_machine_stream
from strideline.operators.live import LiveLoop
from strideline.schema import CHANNELS, hours
from strideline.sources.sinks import blank_non_finite
from strideline.sources.telemetry import decode_captures, decode_pieces


def sample_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of events that arrive in a folder, as samples; ``ts`` is a zoned timestamp for watermarks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), hours("ts").alias("t"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"), F.col("event_type").alias("kind"))


def detect(stream: DataFrame, machine: Machine) -> DataFrame:
    """Events of a machine, its state kept from micro-batch to micro-batch."""
    return run_machine_stream(stream, machine)


def live(stream: DataFrame, loop: LiveLoop, stale: float | None = None) -> DataFrame:
    """What a session's loop says of each closed stride, of samples that came late, and of sessions that have been silent for ``stale`` seconds.

    With ``stale`` the query must run on (a processing-time trigger): a timer makes a batch even where nothing is new.
    """
    steps = run_machine_stream(stream, loop, stale)
    return steps.where("stride_id is not null or late = 1 or session_state = 'SAFE_STOP'")


def recording_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Pieces of recordings that arrive as CSV of the canonical channels, ``folder/recording/piece.csv``, as samples; a time counts once in a recording."""
    raw = spark.readStream.schema(", ".join(f"{c} double" for c in CHANNELS)).option("header", True).option("enforceSchema", False).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).csv(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = raw.select(F.xxhash64(name).alias("session"), F.floor(F.col("timestamp") * 1e6).cast("long").alias("seq"), F.col("timestamp").alias("t"), F.col("belt_length").alias("x"), F.col("belt_velocity").alias("k"))
    return rows.where("t is not null")


def windowed(stream: DataFrame, late: str = "10 minutes", length: str = "1 day") -> DataFrame:
    """Count and mean of each session's samples by window; rows behind the watermark are dropped and counted by Spark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length), "session").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"))


def capture_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of captured bytes that arrive as files; a file is a capture of its own."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return decode_captures(raw.select("path", "content"))


def piece_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of captures whose bytes arrive in pieces, ``folder/capture/piece`` in the order of the pieces' names; the parser's state is kept between them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).load(folder)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return decode_pieces(raw.select(part(-2).alias("path"), part(-1).alias("piece"), "content"))


def paced(stream: DataFrame, seconds: float):
    """A writer that takes a micro-batch of the stream every so many seconds, to replay recorded files at their pace."""
    return stream.writeStream.trigger(processingTime=f"{seconds} seconds")


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``act`` (rows, number) on each micro-batch of what has arrived, then stop."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what arrives to a log in CSV, empty cells for what is no number; a batch that is run again replaces its own files."""
    def write(rows: DataFrame, number: int) -> None:
        blank_non_finite(rows).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(f"{path}/batch={number}")

    return each_batch(stream, write, checkpoint)


def run_until(stream: DataFrame, goal: Callable[[DataFrame], bool], checkpoint: str, timeout: float = 60.0) -> bool:
    """Run a stream until a micro-batch meets a goal; whether one did before the time was up or the stream ended."""
    met: list[bool] = []

    def look(rows: DataFrame, number: int) -> None:
        if not met and goal(rows):
            met.append(True)
            raise _GoalMet

    query = each_batch(stream, look, checkpoint)
    try:
        query.awaitTermination(timeout)
    except Exception:  # noqa: BLE001 - the goal ends the query with an error of its own
        if not met:
            raise
    finally:
        query.stop()
    return bool(met)


class _GoalMet(Exception):
    """Ends a stream whose goal is met."""
