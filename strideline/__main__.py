"""``python -m strideline inspect RECORDING``: how a recording in CSV falls into strides.

``python -m strideline simulate RECORDING OUT`` replays it and writes the stride log.

``python -m strideline live FOLDER OUT --checkpoint PLACE`` follows pieces of recordings as they
come (FOLDER/recording/piece.csv, canonical channels) and appends what the loop says of each
stride to OUT in Parquet; with ``--once`` it takes what is there and ends.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strideline.operators import folds, segments
from strideline.operators.live import LiveLoop
from strideline.plans.batch import reference, replay
from strideline.sources.csv_samples import read_samples
from strideline.sources.settings import Detection, Settings, from_json, override
from strideline.sources.sinks import write_log
from strideline.streaming.strides import live, recording_stream


def detected(spark: SparkSession, path: str, detection: Detection) -> DataFrame:
    """Samples of recordings with the belt trigger's strikes and phases; ``session`` is a hash of the name ``recording``."""
    rows = read_samples(spark, path, detection.rate).withColumnRenamed("session", "recording")
    rows = rows.select(F.xxhash64("recording").alias("session"), "recording", "seq", F.col("timestamp").alias("t"), F.col("belt_length").alias("x"), F.col("belt_velocity").alias("k"))
    found = folds.run_machine(rows.select("session", "seq", "t", "x"), folds.BeltTrigger(tau=detection.tau, refractory=detection.refractory))
    found = found.select("session", "seq", "event").join(rows, ["session", "seq"])
    hit, off = F.col("event") == "heel_strike", F.col("event") == "toe_off"
    last = F.last(F.when(hit | off, F.col("event")), ignorenulls=True).over(segments.by_session())
    return found.withColumns({"strike": F.coalesce(hit, F.lit(False)), "swing": F.coalesce(last == "toe_off", F.lit(False))})


def inspected(spark: SparkSession, path: str, detection: Detection | None = None) -> DataFrame:
    """Strides of recordings by the belt trigger, with the reason of those that are rejected."""
    detection = detection or Detection()
    found = detected(spark, path, detection)
    strides = segments.metrics(segments.cut(found), detection.min_samples, *detection.stride_time)
    names = found.select("session", "recording").distinct()
    return strides.join(names, "session").select("recording", "stride_id", "n_samples", "stride_time", "reject_reason")


def simulated(spark: SparkSession, path: str, settings: Settings, healthy: str | None = None) -> DataFrame:
    """The replay of recordings: a row for each stride after a recording's baseline; distances as ``target`` says if there are ``healthy`` recordings."""
    found = detected(spark, path, settings.detection)
    validity = (settings.detection.min_samples, *settings.detection.stride_time)
    against = reference(detected(spark, healthy, settings.detection), settings.policy, validity) if healthy else None
    names = found.select("session", "recording").distinct()
    return replay(found, settings.policy, against, settings.target.value, validity=validity).join(names, "session").drop("session")


def followed(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings, stale: float | None, every: float | None) -> StreamingQuery:
    """A running query over the pieces of recordings in a folder: each ``every`` seconds, or once over what is there."""
    detection = settings.detection
    loop = LiveLoop(settings.policy, folds.BeltTrigger(tau=detection.tau, refractory=detection.refractory), (detection.min_samples, *detection.stride_time))
    writer = live(recording_stream(spark, folder, 1000), loop, stale if every else None).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{every} seconds") if every else writer.trigger(availableNow=True)).start()


def main(arguments: list[str] | None = None) -> None:
    """Print the counts and the first strides; ``simulate`` writes all of them."""
    parser = argparse.ArgumentParser(prog="strideline")
    parser.add_argument("command", choices=["inspect", "simulate", "live"])
    parser.add_argument("path")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--reference", help="healthy recordings")
    parser.add_argument("--config", help="JSON of the settings")
    parser.add_argument("--set", action="append", default=[], metavar="PATH=VALUE", help="a setting, as policy.window=5")
    parser.add_argument("--checkpoint", help="where live keeps its state")
    parser.add_argument("--once", action="store_true", help="take what is there and end")
    parser.add_argument("--every", type=float, default=1.0, help="seconds between batches")
    parser.add_argument("--stale", type=float, default=5.0, help="seconds of silence that stop a session")
    given = parser.parse_args(arguments)
    if given.command != "inspect" and not given.out:
        parser.error(f"{given.command} needs a place for its log")
    if given.command == "live" and not given.checkpoint:
        parser.error("live needs a place for its state")
    settings = Settings()
    if given.config:
        with open(given.config) as file:
            settings = from_json(Settings, file.read())
    for text in given.set:
        path, _, value = text.partition("=")
        settings = override(settings, path, value)
    spark = SparkSession.builder.appName("strideline").getOrCreate()
    if given.command == "simulate":
        write_log(simulated(spark, given.path, settings, given.reference), given.out)
        log = spark.read.option("header", True).option("inferSchema", True).csv(given.out)
        log.groupBy("recording").agg(F.count("*").alias("strides"), F.avg("gain").alias("mean_gain"), F.max("gain").alias("max_gain"), F.sum(F.col("ood")).alias("outliers")).show()
        return
    if given.command == "live":
        followed(spark, given.path, given.out, given.checkpoint, settings, given.stale, None if given.once else given.every).awaitTermination()
        return
    found = inspected(spark, given.path, settings.detection)
    found.groupBy("recording").agg(F.count_if(F.col("reject_reason") == "").alias("accepted"), F.count_if(F.col("reject_reason") != "").alias("rejected")).show()
    found.orderBy("recording", "stride_id").show(10)


if __name__ == "__main__":
    main()
