"""Tables of vectors made ready for numpy: checked, and each distinct vector once.

A vector takes part if it is not null, has the table's dimension (that of most
rows), and its components are neither null nor non-finite and not all zero.
Equal vectors are one *node*, named by 128 bits of their content, so a vector that
very many rows share costs no more than one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.scratch import map_batches, stored


class VectorTable(NamedTuple):
    """rows: (vec_id, node) of every row, node null if it takes no part; nodes: (node, vec binary, least_id, copies)."""

    rows: DataFrame
    nodes: DataFrame
    dimension: int
    dtype: str


def vector_table(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> VectorTable:
    """The rows and distinct vectors of a table with an array of float or double."""
    dtype = "<f4" if dict(table.dtypes)[embedding] == "array<float>" else "<f8"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if dtype == "<f4" else "array<double>").alias("v"))
    sizes = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 1
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size("v") == dimension) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    code = F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("v")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), "v")), 16, "0")))
    named = rows.select("vec_id", F.when(usable, code).alias("node"), "v")
    slim = stored(named.select("vec_id", "node"), "vector-rows")
    grouped = named.where("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))

    def packed(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dimension * np.dtype(dtype).itemsize), batch.num_rows, [None, pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary()), batch.column(2), batch.column(3)], names=["node", "vec", "least_id", "copies"])

    nodes = stored(map_batches(grouped, packed, "node binary, vec binary, least_id long, copies long"), "vector-nodes")
    return VectorTable(slim, nodes, dimension, dtype)


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int, dtype: str) -> np.ndarray:
    """(rows, dimension) of a column of packed vectors, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dimension).astype(np.float64)


def binaries(values: list[bytes]) -> pa.Array:
    """A binary column."""
    return pa.array(values, pa.binary())


def sampled(table: VectorTable, size: int, n: int) -> tuple[list[bytes], np.ndarray]:
    """About ``size`` nodes and their vectors, those of least content hash: a bounded sample that does not depend on partitions."""
    nodes = table.nodes.select("node", "vec")
    if n > size:
        cut = int(2**32 * min(1.0, (size + 8 * size**0.5 + 64) / n))  # enough but for a chance of 1e-9
        nodes = nodes.where(F.col("node") < F.lit(bytearray(min(cut, 2**32 - 1).to_bytes(4, "big"))))
    rows = nodes.orderBy("node").limit(size).collect()
    return [bytes(r["node"]) for r in rows], matrix(pa.array([bytes(r["vec"]) for r in rows], pa.binary()), table.dimension, table.dtype)
