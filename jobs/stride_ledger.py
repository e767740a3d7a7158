"""Incremental job: samples that arrive as files become a ledger of closed strides, one row each, by day.

    python jobs/stride_ledger.py --samples IN --ledger OUT --checkpoint PLACE [--config jobs/stride_ledger.json]

A stream over the files of IN, a folder or a pattern that names files or folders
(Parquet of event_id, ts, user_id, event_type, value, props),
takes what the checkpoint has not seen, closes strides with the state that it kept of each
session, appends them to OUT and ends.  A run without new files adds nothing; a run that
was cut off is taken up where it stopped; the file sink lists each stride once.

OUT is partitioned by ``kind`` and ``day``.  ``stride``: a stride and the first reason to
reject it.  ``late``: a sample that came in a later run than one that follows it in time; its stride is
closed, so it is kept for review instead of counted.  Samples of one run may stand in any
order and in any files.  A session's new samples are one task's work; ``files_per_batch``
bounds them for files that come in time order (0: all new files at once).
Samples without a session or a time take no part; null values and flags count as not
measured and not set.
"""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.operators.folds import run_machine_stream
from strideline.operators.live import StrideCloser, closed, day_of
from strideline.schema import of_events
from strideline.sources.settings import from_json

LOG = logging.getLogger("stride_ledger")
SAMPLES = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LEDGER = (
    "session long, seq long, stride_id int, t_start double, t_end double, stride_time double, swing_time double, stance_time double, swing_ratio double, excursion double, "
    "mean_x double, n_samples int, reject_reason string, kind string, day date"
)


@dataclasses.dataclass(frozen=True)
class Settings:
    """What makes a stride valid (samples, hours), and how many files a batch takes."""

    min_samples: int = 3
    shortest: float = 0.5
    longest: float = 150.0
    files_per_batch: int = 0


def ledger_rows(steps: DataFrame, settings: Settings) -> DataFrame:
    """The ledger's rows among a closer's: strides, and late samples with their own time as the end."""
    late = F.col("late") == 1
    judged = closed(steps, settings.min_samples, settings.shortest, settings.longest, keep=late)
    rows = judged.withColumns({
        "kind": F.when(late, "late").otherwise("stride"), "t_end": F.when(late, F.col("t")).otherwise(F.col("t_end")), "seq": F.when(late, F.col("seq")),
        **{c: F.when(~late, F.col(c)) for c in ("swing_ratio", "reject_reason")},
    })
    names = [c.split()[0] for c in LEDGER.split(", ")]
    return rows.withColumn("day", day_of(F.col("t_end"))).select(*names)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger as it stands."""
    return spark.read.schema(LEDGER).parquet(ledger)


def run(spark: SparkSession, samples: str, ledger: str, checkpoint: str, settings: Settings | None = None) -> DataFrame:
    """Take in what is new and return the whole ledger."""
    settings = settings or Settings()
    source = spark.readStream.schema(SAMPLES)
    if settings.files_per_batch > 0:
        source = source.option("maxFilesPerTrigger", settings.files_per_batch)
    rows = of_events(source.parquet(samples)).where(F.col("session").isNotNull() & F.col("t").isNotNull())
    rows = rows.withColumn("seq", F.coalesce("seq", F.lit(-1))).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("strike", "swing")})

    out = ledger_rows(run_machine_stream(rows, StrideCloser()), settings)
    query = out.writeStream.format("parquet").outputMode("append").partitionBy("kind", "day").option("path", ledger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    took = sum(p["numInputRows"] for p in query.recentProgress)
    LOG.info("read %d new samples of %s in %d batches", took, samples, len(query.recentProgress))
    found = read_ledger(spark, ledger)
    for r in found.groupBy("kind").count().orderBy("kind").collect():
        LOG.info("%s holds %d rows of kind %s", ledger, r["count"], r["kind"])
    return found


def main(arguments: list[str] | None = None) -> None:
    """The command line."""
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("samples", "ledger", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="JSON of the settings")
    given = parser.parse_args(arguments)
    settings = Settings()
    if given.config:
        with open(given.config) as file:
            settings = from_json(Settings, file.read())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("stride_ledger").getOrCreate()
    try:
        run(spark, given.samples, given.ledger, given.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
