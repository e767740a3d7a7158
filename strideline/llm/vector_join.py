"""Exact cosine range join of a vector table by pivots and triangle inequality.

On unit vectors cosine c is Euclidean distance sqrt(2 - 2c), a metric.  Pivots,
taken from a bounded sample of the vectors, cut space into cells: a vector's own cell is its
nearest pivot's.  There are between the fourth and the square root of the number of vectors of them
(``MOST_PIVOTS`` at most; larger cells are joined in blocks), each the sampled vector farthest
from those before it: for several numbers between, the sample shows how many comparisons and copies the bounds below would leave, and the
cheapest is taken.  Vectors in clusters get many small cells, vectors that
fill space evenly, which no bound parts, few.  A link between two cells is found in the one of smaller number,
so a vector x of cell i is replicated to cell j < i unless one of these bounds shows
that cell j holds nothing within the radius r of x:

* d(x, p_j) > R_j + r, with R_j the largest distance of cell j's vectors to its pivot
  (triangle inequality at the pivot);
* the distance of x to the plane midway between the two pivots, which every
  vector of cell j lies beyond, is greater than r.

Cells are then joined independently, in blocks of ``OWN`` of the cell's vectors by
``OTHERS`` of its vectors and visitors.  A block returns the number of links of each
vector and links that span its components, never all pairs.

Products are first taken in single precision with a margin; every pair near the
threshold or above it is decided in double precision on the original vectors.

Defined results: a vector that takes no part (see ``vectors``) has no links and is
its own component; equal vectors always link; a null id is no component's name
unless nothing else is; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.components import connected_components
from strideline.llm.scratch import discard, map_batches, stored
from strideline.llm.vectors import VectorTable, binaries, matrix, sampled, vector_table

#: Fewest vectors that are cut into cells, pivots at most, vectors that the number of pivots is judged on, and comparisons that cost as much as a copy of a vector.
LEAST_CUT, MOST_PIVOTS, JUDGED, COPY_COST = 64, 4096, 2048, 300
#: The sides of a block.
OWN, OTHERS = 8192, 16384
#: Slack of the bounds and margin of the single-precision filter.
SLACK, MARGIN = 1e-6, 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine(x_i, y_j) >= threshold, decided in double precision."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]).astype(np.float32), (y / ny[:, None]).astype(np.float32)
    at_i, at_j = [], []
    step = max(1, (1 << 21) // max(len(y), 1))
    for s in range(0, len(x), step):
        i, j = np.nonzero(u[s : s + step] @ v.T >= threshold - MARGIN)
        i += s
        exact = (x[i] * y[j]).sum(axis=1) / (nx[i] * ny[j]) >= threshold
        at_i.append(i[exact])
        at_j.append(j[exact])
    return np.concatenate(at_i), np.concatenate(at_j)


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) for each component of the links (i, j) over n numbers, without the least themselves."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    other = np.flatnonzero(label != np.arange(n))
    return other, label[other]


class Cells(NamedTuple):
    """pivots: unit vectors; compared and every: comparisons that the bounds leave, as the sample shows, and those of all pairs."""

    pivots: np.ndarray
    compared: float
    every: float


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * _unit(x) @ pivots.T, 0))


def _visits(dist: np.ndarray, between: np.ndarray, reach: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, rows by cells whether a vector visits the cell) of vectors ``dist`` from the pivots."""
    own = dist.argmin(axis=1)
    near = dist[np.arange(len(own)), own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (dist**2 - near[:, None] ** 2) / (2 * between[own])
    plane[~np.isfinite(plane)] = 0
    return own, (np.arange(dist.shape[1])[None, :] < own[:, None]) & (dist <= reach[None, :] + radius) & (plane <= radius)


def _between(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of ``k`` of the unit vectors ``x``, the first and then always the one farthest from those taken."""
    order, near = [0], _distances(x, x[:1])[:, 0]
    while len(order) < k:
        order.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[order[-1:]])[:, 0])
    return np.array(order)


def plan_cells(sample: np.ndarray, n: int, radius: float) -> Cells:
    """The cells for ``n`` vectors of which ``sample`` is one, in random order."""
    every = n * n / 2
    sample = _unit(sample) if len(sample) else sample
    if n < LEAST_CUT:
        return Cells(sample[:1], every, every)
    most = max(2, min(math.isqrt(n), MOST_PIVOTS, len(sample) // 2))
    order = farthest_first(sample, most)
    rest = np.delete(sample, order, axis=0)[:JUDGED]
    numbers, m = [most], max(2, round(n**0.25))
    while m < most:
        numbers.append(m)
        m *= 2
    best = None
    for m in sorted(numbers):
        pivots = sample[order[:m]]
        dist = _distances(rest, pivots)
        own, near = dist.argmin(axis=1), dist.min(axis=1)
        reach = np.full(m, -1.0)
        np.maximum.at(reach, own, near)
        _, visits = _visits(dist, _between(pivots), reach, radius)
        scale = n / len(rest)
        held, guests = np.bincount(own, minlength=m) * scale, visits.sum(axis=0) * scale
        compared, copies = float((held * (held / 2 + guests)).sum()), float(guests.sum())
        if best is None or compared + COPY_COST * copies < best[0]:
            best = (compared + COPY_COST * copies, Cells(pivots, min(compared, every), every))
    return best[1]


def _radius(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def cells_of(vt: VectorTable, threshold: float) -> Cells:
    """The cells of a table; at most ``2 * MOST_PIVOTS + JUDGED`` vectors come to the driver."""
    n = vt.nodes.count()
    _, sample = sampled(vt, min(n, 2 * min(math.isqrt(n), MOST_PIVOTS) + JUDGED), n)
    return plan_cells(sample, n, _radius(threshold))


def _join_cells(vt: VectorTable, threshold: float) -> DataFrame:
    """(node, other, n): with other null, n links of a node; else a link between two nodes."""
    d, dtype = vt.dimension, vt.dtype
    radius = _radius(threshold)
    pivots = cells_of(vt, threshold).pivots
    between = _between(pivots)

    def distances(x: np.ndarray) -> np.ndarray:
        return _distances(x, pivots)

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist = distances(matrix(batch.column(0), d, dtype))
            own = dist.argmin(axis=1) if len(dist) else np.zeros(0, np.int64)
            count = np.bincount(own, minlength=len(pivots))
            far = np.zeros(len(pivots))
            np.maximum.at(far, own, dist[np.arange(len(own)), own])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(far[some])], names=["cell", "n", "far"])

    # one row for each of at most MOST_PIVOTS cells
    sizes = map_batches(vt.nodes.select("vec"), extents, "cell int, n long, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()
    count, reach = np.zeros(max(len(pivots), 1), np.int64), np.full(max(len(pivots), 1), -1.0)
    for r in sizes:
        count[r["cell"]], reach[r["cell"]] = r["n"], r["far"]

    def visited(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _visits(dist, between, reach, radius)

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += visited(distances(matrix(batch.column(0), d, dtype)))[1].sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    # blocks are sized by the vectors that really come
    guests = np.zeros(max(len(pivots), 1), np.int64)
    if len(pivots):
        for r in map_batches(vt.nodes.select("vec"), visitors, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            guests[r["cell"]] = r["n"]
    own_chunks = np.maximum(1, -(-count // OWN)).astype(np.int64)
    all_chunks = np.maximum(1, -(-(count + guests) // OTHERS)).astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, chunk, other_chunk, own, node, vec, copies): each vector in the blocks of its own cell and of those it visits."""
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                batch = whole.slice(s, 2048)
                own, visits = visited(distances(matrix(batch.column(1), d, dtype)))
                row = np.arange(len(own))
                salt = np.frombuffer(b"".join(x[-4:] for x in batch.column(0).to_pylist()), ">u4").astype(np.int64)
                parts = []
                # as own: one chunk of its cell's own vectors, every chunk of the others
                for cell in np.unique(own):
                    mine = row[own == cell]
                    k, m = own_chunks[cell], all_chunks[cell]
                    parts.append((mine.repeat(m), np.full(len(mine) * m, cell), (salt[mine] % k).repeat(m), np.tile(np.arange(m), len(mine)), True))
                    parts.append((mine.repeat(k), np.full(len(mine) * k, cell), np.tile(np.arange(k), len(mine)), (salt[mine] % m).repeat(k), False))
                v_row, v_cell = np.nonzero(visits)
                for cell in np.unique(v_cell):
                    mine = v_row[v_cell == cell]
                    k, m = own_chunks[cell], all_chunks[cell]
                    parts.append((mine.repeat(k), np.full(len(mine) * k, cell), np.tile(np.arange(k), len(mine)), (salt[mine] % m).repeat(k), None))
                for at, cell, chunk, other, role in parts:
                    # role 0: own vector on the left; 1: own on the right; 2: visitor on the right
                    code = 0 if role else 1 if role is False else 2
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(other.astype(np.int32)), pa.array(np.full(len(at), code, np.int32)), batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick)], names=["cell", "chunk", "other", "role", "node", "vec", "copies"])

    def compare(block: pa.Table) -> pa.Table:
        role = block["role"].to_numpy()
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        names = np.array(block["node"].to_pylist() + [b""], dtype=object)[:-1]
        if len(left) == 0 or len(right) == 0:
            return pa.table({"node": binaries([]), "other": binaries([]), "n": pa.array([], pa.int64())})
        x = matrix(block["vec"], d, dtype)
        copies = block["copies"].to_numpy()
        i, j = _linked(x[left], x[right], threshold)
        i, j = left[i], right[j]
        apart = names[i] != names[j]
        i, j = i[apart], j[apart]
        links = np.zeros(len(names), np.int64)
        np.add.at(links, i, copies[j])
        visit = role[j] == 2
        np.add.at(links, j[visit], copies[i[visit]])
        some = np.flatnonzero(links)
        # a node may stand on both sides: number nodes, not rows
        _, number = np.unique(names, return_inverse=True)
        member, least = _spanning(len(names), number[i], number[j])
        first = np.zeros(len(names), np.int64)
        first[number] = np.arange(len(names))
        return pa.table({
            "node": binaries([*names[some], *names[first[member]]]),
            "other": binaries([None] * len(some) + [*names[first[least]]]),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(member), np.int64)])),
        })

    if len(pivots) == 0:
        return vt.nodes.select("node", F.lit(None).cast("binary").alias("other"), F.lit(0).cast("long").alias("n")).limit(0)
    grid = map_batches(vt.nodes.select("node", "vec", "copies"), placed, "cell int, chunk int, other int, role int, node binary, vec binary, copies long")
    return grid.groupBy("cell", "chunk", "other").applyInArrow(compare, "node binary, other binary, n long")


def near_vectors(table: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; see the module's text."""
    vt = vector_table(table, vec_id, embedding)
    found = stored(_join_cells(vt, threshold), "cell-links")
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("node").agg(F.sum("n").alias("links"))
    nodes = vt.nodes.select("node", "least_id", "copies").join(links, "node", "left").join(roots, "node", "left")
    nodes = stored(nodes.select("node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "linked")
    for table in (found, vt.nodes):
        discard(table)
    least = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = nodes.join(least, "root").select("node", "n_links", "component_id")
    out = vt.rows.join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
