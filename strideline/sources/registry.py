"""Sources of samples by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideline import schema
from strideline.sources import csv_samples, mock, telemetry


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Files of captured bytes as channels in physical units; one file is one capture."""
    return telemetry.scaled_channels(telemetry.decode_captures(spark.read.format("binaryFile").load(path).select("path", "content")))


#: Reader of each kind of source; the first argument is the session.
SOURCES: dict[str, Callable[..., DataFrame]] = {"csv": csv_samples.read_samples, "captures": captures, "events": schema.samples, "mock": mock.mock_sessions, "mock_walks": mock.mock_walks}


def register_source(name: str, reader: Callable[..., DataFrame]) -> None:
    """Make a reader known by name; a name is given once."""
    if name in SOURCES:
        raise ValueError(f"source {name!r} is registered already")
    SOURCES[name] = reader


def open_source(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    """The samples of a source by its name."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[name](spark, *args, **options)
