"""Nearest neighbours by inner product with cross-polytope hashing.

Vectors are scaled by the largest norm and given one more coordinate that makes
them unit vectors, where norms differ (a query gets 0 there), so the largest inner
product is the smallest angle.  Each of ``tables`` hash tables applies three rounds
of random signs and a fast Hadamard transform, a pseudo-rotation, and names a
vector by the signed axis nearest to it; with more than ``CELL`` vectors per axis
on average two such names are joined.  A query probes, in every table, the cells
of the axes that are nearest to its own rotated vector.  Candidates are ranked
exactly, in double precision on the original vectors.

The number of probes is fitted on a bounded sample (``SAMPLE`` vectors, of which
``SAMPLE_QUERIES`` query the rest) to a recall of ``RECALL``; neighbours in a sample
are farther than in the whole, so the sample errs on the safe side.  Where no number
of probes up to ``MOST_PROBES`` reaches it, as with joined names and norms that differ
much, the second round compares each query with every vector, exactly, in blocks of
``BLOCK_BYTES`` a side.

Tables are looked up in two rounds.  The nearest cell in each of the first
``FIRST_TABLES`` tables gives each query a 20th best so far; the cells of the second
round hand on only what is not below it, so what a query gathers does not grow
with the table.

Cells are compared in blocks of ``CELL`` vectors by ``QUERIES`` queries, so a cell of
any size is spread over tasks.  Equal vectors are one node: only the ``top + 1``
smallest ids of a node can be in any answer.

Defined results: rows with a null id take no part; neither do null, zero and
non-finite vectors, as queries or candidates; ties go to the smaller id; a row that is
repeated counts once, as a query and as a candidate; rows of one id with other vectors
are queries of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.scratch import discard, map_batches, stored
from strideline.llm.vectors import VectorTable, binaries, matrix, sampled, vector_table

TABLES = 8
CELL, QUERIES = 4096, 1024
SAMPLE, SAMPLE_QUERIES, RECALL = 4096, 256, 0.96
MOST_PROBES = 2048
#: Packed vectors on a side of a block where everything is compared.
BLOCK_BYTES = 16 << 20
#: Tables of the first round.
FIRST_TABLES = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """Hash tables of ``parts`` joined cross-polytope names over vectors of a dimension."""

    def __init__(self, dimension: int, tables: int, parts: int, longest: float | None, seed: int = 11):
        self.dimension, self.tables, self.parts, self.longest = dimension, tables, parts, longest
        wanted = dimension + (longest is not None)
        self.width = 1 << (wanted - 1).bit_length() if wanted > 1 else 1
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (tables, parts, 3, self.width))
        self.axes = 2 * self.width

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors of the padded width."""
        out = np.zeros((len(x), self.width), np.float32)
        norm = np.linalg.norm(x, axis=1)
        if self.longest is None or query:
            out[:, : self.dimension] = x / norm[:, None]
        else:
            out[:, : self.dimension] = x / self.longest
            out[:, self.dimension] = np.sqrt(np.maximum(1 - (norm / self.longest) ** 2, 0))
        return out

    def responses(self, u: np.ndarray, table: int, part: int) -> np.ndarray:
        """(rows, axes): inner product with each signed axis after the rotation."""
        for signs in self.signs[table, part]:
            u = hadamard(u * signs)
        return np.concatenate([u, -u], axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): each vector's cell."""
        u = self.unit(x, query=False)
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for p in range(self.parts):
                out[:, t] = out[:, t] * self.axes + self.responses(u, t, p).argmax(axis=1)
            out[:, t] += t * self.axes**self.parts
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """(rows, tables, count): the cells to look at, the nearest first."""
        u = self.unit(x, query=True)
        count = min(count, self.axes**self.parts)
        out = np.zeros((len(x), self.tables, count), np.int64)
        for t in range(self.tables):
            score, code = self.responses(u, t, 0), np.arange(self.axes)[None, :].repeat(len(x), 0)
            for p in range(1, self.parts):
                keep = min(count, score.shape[1])
                best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
                score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
                more = self.responses(u, t, p)
                score = (score[:, :, None] + more[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * self.axes + np.arange(self.axes)).reshape(len(x), -1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :count]
            out[:, t] = np.take_along_axis(code, best, 1) + t * self.axes**self.parts
        return out


def fitted_probes(index: CrossPolytope, sample: np.ndarray, top: int, recall: float = RECALL) -> int | None:
    """Least number of probes a table with which sampled queries find ``recall`` of their neighbours in the sample.

    None if ``MOST_PROBES`` do not reach it.
    """
    most = min(MOST_PROBES, index.axes**index.parts)
    if len(sample) <= top + 1:
        return most if most == index.axes**index.parts else None
    q = sample[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    own = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    score = q @ sample.T
    score[np.arange(len(q)), own] = -np.inf
    near = np.argpartition(-score, top, axis=1)[:, :top]
    cells, probes = index.cells(sample), index.probes(q, most)
    first = np.full((len(q), top), most)
    for i in range(len(q)):
        for t in range(index.tables):
            place = {c: k for k, c in enumerate(probes[i, t].tolist())}
            first[i] = np.minimum(first[i], [place.get(c, most) for c in cells[near[i], t].tolist()])
    reached = np.sort(first.ravel())
    at = min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)
    return int(reached[at] + 1) if reached[at] < most else None


def nearest(table: DataFrame, is_query: Column, top: int = 20, tables: int = TABLES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest of every row for which ``is_query`` (of the column vec_id) holds."""
    vt = vector_table(table, vec_id, embedding)
    rows = vt.rows.where("vec_id is not null and node is not null").distinct()  # a row that is repeated is one
    by_id = Window.partitionBy("node").orderBy("vec_id")
    ids = stored(rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= top + 1).select("node", "vec_id"), "node-ids")
    asked = stored(rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("asker")).distinct(), "askers")
    best = _best_nodes(vt, asked, top)
    # the first top + 1 ids of each asking vector, then each query without itself
    named = best.join(ids, "node").select("asker", "score", "vec_id").distinct()
    order = [F.desc("score"), F.col("vec_id")]
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy(*order))).where(F.col("nth") <= top + 1)
    answers = asked.join(named.drop("nth"), "asker").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "asker").orderBy(*order))
    return answers.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _best_nodes(vt: VectorTable, asked: DataFrame, top: int) -> DataFrame:
    """(asker, node, score): the nearest nodes of each asking vector, its own among them."""
    n = vt.nodes.count()
    d, dtype = vt.dimension, vt.dtype
    _, sample = sampled(vt, SAMPLE, n)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.linalg.norm(matrix(batch.column(0), d, dtype), axis=1)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([x.min()]), pa.array([x.max()])], names=["low", "high"])

    low, high = map_batches(vt.nodes.select("vec"), norms, "low double, high double").agg(F.min("low"), F.max("high")).first()
    longest = None if not n or high - low <= 1e-3 * high else float(high)
    parts = 1
    width = CrossPolytope(d, 1, 1, longest).width
    while n / (2 * width) ** parts > CELL and parts < 2:
        parts += 1
    index = CrossPolytope(d, TABLES, parts, longest)
    count = fitted_probes(index, sample, top)
    first_cells = FIRST_TABLES * index.axes**index.parts

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(matrix(batch.column(1), d, dtype))
                pick = pa.array(np.repeat(np.arange(batch.num_rows), index.tables))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *(batch.column(k).take(pick) for k in range(3))], names=["cell", "node", "vec", "least_id"])

    def asks(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    probes = index.probes(matrix(part.column(1), d, dtype), 1 if first else count)
                    asked_first = np.zeros(probes.shape, bool)
                    asked_first[:, :FIRST_TABLES, 0] = True
                    row, table, nth = np.nonzero(asked_first == first)
                    yield pa.RecordBatch.from_arrays([pa.array(probes[row, table, nth]), *(part.column(k).take(pa.array(row)) for k in range(3))], names=["cell", "asker", "vec", "floor"])

        return run

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"asker": binaries([]), "node": binaries([]), "least_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q = matrix(left["vec"], d, dtype), matrix(right["vec"], d, dtype)
        floor = right["floor"].to_numpy()
        rough = q @ x.T
        # all that may tie with the last one wanted are scored exactly, so that ids can decide
        least = np.partition(rough, len(x) - top - 1, axis=1)[:, len(x) - top - 1] if len(x) > top + 1 else np.full(len(q), -np.inf)
        bound = np.maximum(least, floor)
        i, j = np.nonzero(rough >= (bound - np.where(np.isfinite(bound), 1e-9 * (1 + np.abs(bound)), 0))[:, None])
        score = (q[i] * x[j]).sum(axis=1)
        order = np.lexsort((left["least_id"].fill_null(2**63 - 1).to_numpy()[j], -score, i))
        order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) <= top]
        i, j, score = i[order], j[order], score[order]
        mine, theirs = left.take(pa.array(j)), right.take(pa.array(i))
        return pa.table({"asker": theirs["asker"], "node": mine["node"], "least_id": mine["least_id"], "score": pa.array(score)})

    def compare_all(left: pa.Table, right: pa.Table) -> pa.Table:
        """``compare`` of a block of any size in squares of ``CELL`` by ``QUERIES``; of each query's finds the ``top + 1`` best."""
        found = []
        for i in range(0, right.num_rows, QUERIES):
            asking = right.slice(i, QUERIES)
            best = pa.concat_tables([compare(left.slice(j, CELL), asking) for j in range(0, max(left.num_rows, 1), CELL)])
            if best.num_rows == 0:
                continue
            place = {a: k for k, a in enumerate(asking["asker"].to_pylist())}
            asker = np.array([place[a] for a in best["asker"].to_pylist()])
            least = best["least_id"].fill_null(2**63 - 1).to_numpy()
            order = np.lexsort((least, -best["score"].to_numpy(), asker))
            begin = np.searchsorted(asker[order], asker[order])
            found.append(best.take(pa.array(order[np.arange(len(order)) - begin <= top + 1])))
        return pa.concat_tables(found) if found else compare(left.slice(0, 0), right)

    def against_all(query_rows: DataFrame) -> DataFrame:
        """Candidates of the queries among all vectors: blocks of vectors by blocks of queries."""
        held = max(1, BLOCK_BYTES // (d * np.dtype(dtype).itemsize))
        chunks, turns = -(-n // held), -(-query_rows.count() // held)
        left = vt.nodes.select("node", "vec", "least_id").withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int"))
        right = query_rows.withColumn("turn", F.pmod(F.xxhash64("asker"), F.lit(max(turns, 1))).cast("int"))
        left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max(turns, 1) - 1))))
        right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        left, right = left.select("chunk", "turn", "node", "vec", "least_id"), right.select("chunk", "turn", "asker", "vec", "floor")
        found = left.groupBy("chunk", "turn").cogroup(right.groupBy("chunk", "turn")).applyInArrow(compare_all, "asker binary, node binary, least_id long, score double")
        return found.where("asker != node")

    def looked_up(index_rows: DataFrame, query_rows: DataFrame) -> DataFrame:
        """Candidates of the queries in the cells they probe, in blocks: vectors of a cell by queries of that cell."""
        blocks = index_rows.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
        blocks = stored(blocks.join(query_rows.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns")), "cell"), "cells")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = index_rows.join(blocks, "cell").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("turn", every("turns"))
        right = query_rows.join(blocks, "cell").withColumn("turn", F.pmod(F.xxhash64("asker"), F.col("turns")).cast("int")).withColumn("chunk", every("chunks"))
        left, right = left.select("cell", "chunk", "turn", "node", "vec", "least_id"), right.select("cell", "chunk", "turn", "asker", "vec", "floor")
        keys = ["cell", "chunk", "turn"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "asker binary, node binary, least_id long, score double")
        return found.where("asker != node")

    askers = asked.select(F.col("asker").alias("node")).distinct().join(vt.nodes, "node").select(F.col("node").alias("asker"), "vec", "least_id")
    askers = stored(askers, "asking")
    index_rows = map_batches(vt.nodes.select("node", "vec", "least_id"), entries, "cell long, node binary, vec binary, least_id long")
    no_floor = F.lit(float("-inf")).alias("floor")
    rows = "cell long, asker binary, vec binary, floor double"
    found = stored(looked_up(index_rows.where(F.col("cell") < first_cells), map_batches(askers.select("asker", "vec", no_floor), asks(True), rows)), "first-round")
    # each query's top-th best so far, from a few rows for each query
    so_far = found.select("asker", "node", "score").distinct().groupBy("asker").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    so_far = so_far.select("asker", F.coalesce(F.get("scores", F.lit(top - 1)), F.lit(float("-inf"))).alias("floor"))
    second = askers.join(so_far, "asker", "left").select("asker", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    again = against_all(second) if count is None and n else looked_up(index_rows, map_batches(second, asks(False), rows))
    found = found.unionByName(again)

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d, dtype)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), batch.column(2), pa.array((x * x).sum(axis=1))], names=["asker", "node", "least_id", "score"])

    # a vector is always among its own candidates: rows equal to the query's
    found = found.unionByName(map_batches(askers.select("asker", "vec", "least_id"), itself, "asker binary, node binary, least_id long, score double"))
    found = found.groupBy("asker", "node").agg(F.max("score").alias("score"), F.min("least_id").alias("least_id"))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), F.col("least_id").asc_nulls_last())
    return stored(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1).select("asker", "node", "score"), "best-nodes")
