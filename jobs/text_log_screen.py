"""Batch job: finds the text logs that differ from the other logs of their source.

    python jobs/text_log_screen.py --logs IN --out OUT [--config jobs/text_log_screen.json]

IN is Parquet of doc_id, text and source.  Each log is measured (words, letters a word,
words a line, shares of digits and capitals); each source's logs give a scaling, and a
log's distance is the length of its scaled measures.  It is ``unusual`` beyond the mean
distance of its source and ``sigmas`` spreads; a log without words is ``blank`` and shapes no
scaling.  Every log gets a row.

OUT/screened is partitioned by ``verdict``, so that the few logs to look at are read
without the others; OUT/measures holds the measures, OUT/profile each source's scaling and
bound.  All are overwritten by a run, so a rerun gives the same.  Per-source rows come of partial sums, so a source with most logs is
no single task's work.  A null source is a source of its own; rows that repeat a doc_id are
each judged; an empty table gives empty outputs.
"""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.operators import models
from strideline.sources.settings import from_json

LOG = logging.getLogger("text_log_screen")
MEASURES = ["words", "word_length", "line_words", "digits", "capitals"]
SCREENED = "doc_id long, source string, words double, word_length double, line_words double, digits double, capitals double, distance double, bound double, strongest string, verdict string"


@dataclasses.dataclass(frozen=True)
class Settings:
    """Spreads above the mean distance from which a log is unusual."""

    sigmas: float = 3.0


COUNTS = ["words", "solid", "lines", "digits", "capitals"]


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in COUNTS]))
def counts(text: pa.Array) -> pa.Array:
    """Of each text its words, characters that are no white space, lines, digits and capital letters: the UTF-8 bytes of a batch are looked at once."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    text = text.fill_null("")
    at = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.append(np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.uint8(32))  # each text begins at some byte
    at -= at[0]
    empty = at[1:] == at[:-1]

    def of_each(found: np.ndarray) -> np.ndarray:
        return np.where(empty, 0.0, np.add.reduceat(found.view(np.uint8), at[:-1], dtype=np.int64))

    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[at[:-1]] = solid[at[:-1]]
    found = [begins, solid & (raw & 0xC0 != 0x80), raw == 10, (raw >= 48) & (raw <= 57), (raw >= 65) & (raw <= 90)]
    numbers = [of_each(f) for f in found] if len(text) else [np.zeros(0)] * len(COUNTS)
    numbers[2] = numbers[2] + 1
    return pa.StructArray.from_arrays([pa.array(n) for n in numbers], names=COUNTS)


def measures(found: Column) -> dict[str, Column]:
    """What is measured of a text with these ``counts``; 0 where there are no words."""
    words, solid, lines, digits, capitals = (found[c] for c in COUNTS)
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return {"words": words, "word_length": share(solid, words), "line_words": words / lines, "digits": share(digits, solid), "capitals": share(capitals, solid)}


def measured(logs: DataFrame) -> DataFrame:
    """(doc_id, source, session, measures) of each log; session names the source, a null one as well."""
    key = F.coalesce(F.concat(F.lit("source "), F.col("source")), F.lit("none"))
    rows = logs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("session"), counts(F.col("text")).alias("counts"))
    return rows.select("doc_id", "source", "session", *[v.alias(c) for c, v in measures(F.col("counts")).items()])


def screen(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(a row for each log, a row for each source) of measured logs."""
    some = rows.where("words > 0")
    scaling = models.fit_scaling(some.withColumn("stride_id", F.lit(0)), MEASURES, 1)
    given = some.select("*", *[F.col(c).alias(f"own_{c}") for c in MEASURES])
    scaled = models.scale(given, scaling, MEASURES)
    squares = F.aggregate(F.array(*[F.col(c) * F.col(c) for c in MEASURES]), F.lit(0.0), lambda a, b: a + b)
    strongest = F.array_max(F.array(*[F.struct(F.abs(F.round(c, 6)).alias("by"), F.lit(c).alias("name")) for c in MEASURES]))["name"]
    far = scaled.withColumn("distance", F.sqrt(squares)).withColumn("strongest", strongest)
    bounds = far.groupBy("session").agg((F.avg("distance") + settings.sigmas * F.stddev_pop("distance")).alias("bound"), F.count("*").alias("logs"))
    judged = far.join(bounds, "session").select(
        "doc_id", "source", *[F.col(f"own_{c}").alias(c) for c in MEASURES], "distance", "bound", "strongest",
        F.when(F.col("distance") > F.col("bound"), "unusual").otherwise("usual").alias("verdict"),
    )
    blank = rows.where("words = 0").select("doc_id", "source", *MEASURES, F.lit("blank").alias("verdict"))
    names = [c.split()[0] for c in SCREENED.split(", ")]
    return judged.unionByName(blank, allowMissingColumns=True).select(*names), scaling.join(bounds, "session")


def read_screened(spark: SparkSession, out: str) -> DataFrame:
    """The screened logs as they stand."""
    return spark.read.schema(SCREENED).parquet(f"{out}/screened")


def run(spark: SparkSession, logs: str, out: str, settings: Settings | None = None) -> DataFrame:
    """Screen all logs, write both outputs and return the screened logs."""
    texts = measured(spark.read.parquet(logs))
    texts.write.mode("overwrite").parquet(f"{out}/measures")  # texts are read once; what follows reads a few numbers a log
    screened, profile = screen(spark.read.schema(texts.schema).parquet(f"{out}/measures"), settings or Settings())
    screened.write.mode("overwrite").partitionBy("verdict").parquet(f"{out}/screened")
    profile.write.mode("overwrite").parquet(f"{out}/profile")
    found = read_screened(spark, out)
    counts = {r["verdict"]: r["count"] for r in found.groupBy("verdict").count().collect()}
    LOG.info("read %d logs of %s", sum(counts.values()), logs)
    for verdict, n in sorted(counts.items()):
        LOG.info("%s/screened holds %d logs of verdict %s", out, n, verdict)
    return found


def main(arguments: list[str] | None = None) -> None:
    """The command line."""
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("logs", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="JSON of the settings")
    given = parser.parse_args(arguments)
    settings = Settings()
    if given.config:
        with open(given.config) as file:
            settings = from_json(Settings, file.read())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_log_screen").getOrCreate()
    try:
        run(spark, given.logs, given.out, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
