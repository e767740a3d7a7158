"""Choosing a number of clusters for a session's log vectors, and checks of their matrices."""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.operators.segments import ORDER


def kmeans(x: np.ndarray, k: int, starts: int = 10, seed: int = 0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of the best of several seeded Lloyd runs; centres are ordered, so the result does not depend on the start."""
    label, centres = kmeans_of_each(x[None], k, starts, seed, rounds)
    return label[0], centres[0]


@lru_cache(maxsize=4096)
def _draws(n: int, k: int, starts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows of each start, and the numbers in [0, 1) that its further rows are drawn by; the same for every table of n rows."""
    rng = np.random.default_rng(seed)
    drawn = [(int(rng.integers(n)), [rng.random() for _ in range(k - 1)]) for _ in range(starts)]
    return np.array([d[0] for d in drawn]), np.array([d[1] for d in drawn]).reshape(starts, k - 1)


def kmeans_of_each(tables: np.ndarray, k: int, starts: int = 10, seed: int = 0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """``kmeans`` of each of some tables of one size (tables, rows, width), all their starts at once."""
    b, n, width = tables.shape
    first, drawn = _draws(n, k, starts, seed)
    x = np.repeat(tables, starts, axis=0)
    each = np.arange(len(x))
    centres = x[each, np.tile(first, b)][:, None]
    while centres.shape[1] < k:
        d = ((x[:, :, None] - centres[:, None]) ** 2).sum(-1).min(2)
        total = d.sum(1)[:, None]
        # rows that are all centres already are drawn alike
        share = np.divide(d, total, out=np.full_like(d, 1 / n), where=total > 0).cumsum(1)
        share /= share[:, -1:]
        at = (share <= np.tile(drawn[:, centres.shape[1] - 1], b)[:, None]).sum(1)
        centres = np.concatenate([centres, x[each, at][:, None]], axis=1)
    label, open_ = np.zeros((len(x), n), np.int64), each
    for _ in range(rounds):
        own, old = x[open_], centres[open_]
        found = ((own[:, :, None] - old[:, None]) ** 2).sum(-1).argmin(2)
        label[open_] = found
        member = found[:, None] == np.arange(k)[:, None]
        count = member.sum(2)[..., None]
        new = np.divide((member[..., None] * own[:, None]).sum(2), count, out=old.copy(), where=count > 0)
        moved = ~np.isclose(new, old).all((1, 2))
        centres[open_[moved]] = new[moved]
        open_ = open_[moved]
        if not len(open_):
            break
    cost = ((x - centres[each[:, None], label]) ** 2).reshape(b, starts, -1).sum(-1)
    labels, chosen = np.empty((b, n), np.int64), np.empty((b, k, width))
    for i in range(b):
        best = 0
        for s in range(1, starts):
            if cost[i, s] < cost[i, best] - 1e-12:
                best = s
        order = np.lexsort(centres[i * starts + best].T[::-1])
        labels[i], chosen[i] = np.argsort(order)[label[i * starts + best]], centres[i * starts + best][order]
    return labels, chosen


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean Euclidean silhouette; NaN for a single cluster."""
    groups = np.unique(label)
    if len(groups) < 2:
        return math.nan
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out, a, b = np.zeros(len(x)), np.zeros(len(x)), np.full(len(x), np.inf)
    for g in groups:
        inside = label == g
        m = int(inside.sum())
        if m > 1:
            a[inside] = d[np.ix_(inside, inside)][~np.eye(m, dtype=bool)].reshape(m, m - 1).mean(1)
        b[~inside] = np.minimum(b[~inside], d[np.ix_(~inside, inside)].mean(1))
    alone = np.bincount(label)[label] == 1
    np.divide(b - a, np.maximum(np.maximum(a, b), 1e-300), out=out, where=~alone)
    return float(np.mean(out))


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """Agreement of two partitions, corrected for chance."""
    width = int(b.max()) + 1
    table = np.bincount(a * width + b, minlength=(int(a.max()) + 1) * width).reshape(-1, width)
    pairs = lambda n: (n * (n - 1) / 2).sum()
    both, one, two, total = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    chance, most = one * two / total, (one + two) / 2
    return 1.0 if most == chance else float((both - chance) / (most - chance))


def required_size(n: int, least: int = 3, share: float = 0.15) -> int:
    """Members that every cluster must have."""
    return max(least, math.ceil(share * n), 1)


@lru_cache(maxsize=4096)
def _parts(n: int, k: int, seed: int) -> np.ndarray:
    """Ten pairs of parts of n rows, each of four fifths of them; the same for every table of n rows."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(n)[: max(k + 1, int(0.8 * n))] for _ in range(20)])


def select_k(x: np.ndarray, candidates: tuple[int, ...] = (2, 3, 4), least_silhouette: float = 0.35, least_stability: float = 0.60, seed: int = 0) -> tuple[int, list[tuple]]:
    """The number of clusters and the evidence (k, silhouette, stability, reason) for each candidate.

    Gates are asked in order: size, silhouette, stability; the accepted k of best
    silhouette wins, the first on ties, and 1 if none is accepted.
    """
    n, evidence, best = len(x), [], (1, -math.inf)
    need = required_size(n)
    for k in candidates:
        if k >= n or k * need > n:
            evidence.append((k, None, None, "too_few_rows"))
            continue
        label, _ = kmeans(x, k, seed=seed)
        s = silhouette(x, label)
        if np.bincount(label, minlength=k).min() < need:
            evidence.append((k, s, None, "small_cluster"))
            continue
        if s < least_silhouette:
            evidence.append((k, s, None, "low_silhouette"))
            continue
        parts, scores = _parts(n, k, seed + k), []
        fits = kmeans_of_each(x[parts], k, starts=3, seed=seed)[0]
        place = np.full((len(parts), n), -1)
        np.put_along_axis(place, parts, fits, axis=1)
        for one, two in zip(place[0::2], place[1::2], strict=True):
            both = (one >= 0) & (two >= 0)
            scores.append(min(max(adjusted_rand(one[both], two[both]), 0.0), 1.0))
        stability = float(np.mean(scores))
        accepted = stability >= least_stability
        evidence.append((k, s, stability, "" if accepted else "unstable"))
        if accepted and s > best[1]:
            best = (k, s)
    return best[0], evidence


def choose_clusters(table: DataFrame) -> DataFrame:
    """(key, chosen_k, k, silhouette, stability, reason) of rows (key, v): one group per key, as a session's baseline is short."""
    def run(group: pa.Table) -> pa.Table:
        chosen, evidence = select_k(np.stack(group["v"].to_pylist()).astype(float))
        columns = list(zip(*evidence, strict=True))
        n = len(evidence)
        return pa.table({"key": pa.array([group["key"][0].as_py()] * n, pa.int64()), "chosen_k": pa.array([chosen] * n, pa.int32()), "k": pa.array(columns[0], pa.int32()), "silhouette": pa.array(columns[1], pa.float64()), "stability": pa.array(columns[2], pa.float64()), "reason": pa.array(columns[3], pa.string())})
    return table.withColumn("key", F.col("key").cast("long")).groupBy("key").applyInArrow(run, "key long, chosen_k int, k int, silhouette double, stability double, reason string")


def spd_reason(m: np.ndarray, tolerance: float = 1e-10) -> str:
    """Why a matrix is not symmetric positive definite; empty if it is."""
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        return "not_square"
    if not np.isfinite(m).all():
        return "non_finite"
    if not np.allclose(m, m.T, atol=1e-8):
        return "not_symmetric"
    return "" if np.linalg.eigvalsh(m).min() > tolerance else "not_positive_definite"


def two_means_threshold(x: np.ndarray, lower: bool = True, least_gap: float = 5.0, rounds: int = 12) -> tuple[float, float] | None:
    """Threshold and reset at 65 % and 80 % of the way from one mean of a signal to the other; None without a gap.

    The way starts at the low mean if the gate opens below the threshold, else at the high
    one.  A value as far from both means is the low one's; distances are compared as they are rounded, not by the means'
    middle, and values are summed in the order given, so that ties fall as in a plain query.  Missing values are left out.
    """
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    if not len(x):
        return None
    low, means = None, (x.min(), x.max())
    for _ in range(rounds):
        before, low = low, np.abs(x - means[0]) <= np.abs(x - means[1])
        if low.all():
            return None
        if before is not None and (low == before).all():
            break
        means = tuple(np.cumsum(part)[-1] / len(part) for part in (x[low], x[~low]))
    if means[1] - means[0] < least_gap:
        return None
    ways = (0.65, 0.8) if lower else (0.35, 0.2)
    return tuple(float(means[0] + share * (means[1] - means[0])) for share in ways)


def match_events(reference: list[float], detected: list[float], tolerance: float = 0.25) -> tuple[int, float, float, float]:
    """Hits, precision, recall and F1: each reference in turn takes the nearest detection still free within the tolerance, the earlier one of two."""
    free, hits = sorted(detected), 0
    for r in reference:
        at = bisect_left(free, r)
        ways = [(abs(free[i] - r), i) for i in (at - 1, at) if 0 <= i < len(free)]
        if ways and min(ways)[0] <= tolerance:
            free.pop(min(ways)[1])
            hits += 1
    p, q = hits / len(detected) if detected else 0.0, hits / len(reference) if reference else 0.0
    return hits, p, q, 2 * p * q / (p + q) if p + q else 0.0


def trailing_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Mean of the last ``width`` values, of all so far at the start."""
    width, i = max(1, width), np.arange(1, len(x) + 1)
    total = np.concatenate([[0.0], np.cumsum(x)])
    return (total[i] - total[np.maximum(i - width, 0)]) / np.minimum(i, width)


def normalised_autocorrelation(y: np.ndarray) -> np.ndarray:
    """For each lag below the length, the cosine between the signal without its end and without its start.

    All products come from one Fourier transform, all lengths from one running sum of squares.
    """
    n = len(y)
    products = np.fft.irfft(np.abs(np.fft.rfft(y, 2 * n)) ** 2, 2 * n)[:n]
    energy = np.concatenate([[0.0], np.cumsum(y * y)])
    lengths = np.sqrt(energy[n - np.arange(n)] * np.maximum(energy[n] - energy[np.arange(n)], 0.0))
    return np.divide(products, lengths, out=np.zeros(n), where=lengths > 1e-12)


def cycle_by_autocorrelation(x: np.ndarray, dt: float, shortest: float = 0.9, longest: float = 2.5) -> float | None:
    """Period of a signal: first local peak of its autocorrelation of at least half the highest one, at the tip of the parabola through it.

    None for fewer than 100 values, for signals shorter than the lags, and without a peak of 0.1.
    """
    lags = range(max(1, round(shortest / dt)), min(len(x) - 2, round(longest / dt)) + 1)
    if len(x) < 100 or len(lags) < 2:
        return None
    y = trailing_mean(x, round(0.05 / dt))
    r = normalised_autocorrelation(y - y.mean())
    peaks = [k for k in lags if r[k - 1] < r[k] >= r[k + 1]]
    highest = max((r[k] for k in peaks), default=0.0)
    if highest < 0.1:
        return None
    k = next(k for k in peaks if r[k] >= max(0.1, highest / 2))
    square, slope = (r[k - 1] + r[k + 1]) / 2 - r[k], (r[k + 1] - r[k - 1]) / 2
    tip = -slope / (2 * square) if abs(square) > 5e-13 else 0.0
    return float((k + min(max(tip, -0.5), 0.5)) * dt)


def matched_sessions(events: DataFrame, tolerance: float) -> DataFrame:
    """(session, n_reference, n_detected, hits, precision, recall, f1) of rows (session, t, detected)."""
    def run(group: pa.Table) -> pa.Table:
        t, found = np.array(group["t"].to_pylist()), np.array(group["detected"].to_pylist())
        ref, det = sorted(t[~found].tolist()), sorted(t[found].tolist())
        hits, p, q, f1 = match_events(ref, det, tolerance)
        return pa.table({"session": pa.array([group["session"][0].as_py()]), "n_reference": pa.array([len(ref)]), "n_detected": pa.array([len(det)]), "hits": pa.array([hits]), "precision": pa.array([p]), "recall": pa.array([q]), "f1": pa.array([f1])})
    return events.groupBy("session").applyInArrow(run, "session long, n_reference long, n_detected long, hits long, precision double, recall double, f1 double")


def thresholds(samples: DataFrame) -> DataFrame:
    """(session, threshold, reset): two-means threshold of each session's signal, null without a gap."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ORDER])
        got = two_means_threshold(group["x"].to_numpy()) or (None, None)
        return pa.table({"session": pa.array([group["session"][0].as_py()]), "threshold": pa.array([got[0]], pa.float64()), "reset": pa.array([got[1]], pa.float64())})
    return samples.select("session", *ORDER, "x").groupBy("session").applyInArrow(run, "session long, threshold double, reset double")


def _label_sums(a: tuple, b: tuple) -> tuple[np.ndarray, ...]:
    """(key, label, other, d): the summed distances of each row of ``a`` to the rows of each label of ``b``; both are (keys, labels, vectors) by label."""
    (keys, labels, x), (_, others, y) = a, b
    names, first = np.unique(others, return_index=True)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    out = np.empty((len(x), len(names)))
    for at in range(0, len(x), MEASURED):
        rows = slice(at, at + MEASURED)
        most = xx[rows, None] + yy
        d = most - 2 * (x[rows] @ y.T)
        # the product loses the digits of small distances, so those are taken from the differences
        near, to = np.nonzero(~(d > 1e-4 * most))
        for k in range(0, len(near), CLOSE):
            r, c = near[k : k + CLOSE], to[k : k + CLOSE]
            d[r, c] = ((x[at + r] - y[c]) ** 2).sum(1)
        out[rows] = np.add.reduceat(np.sqrt(d, out=d), first, axis=1)
    return np.repeat(keys, len(names)), np.repeat(labels, len(names)), np.tile(names, len(keys)), out.ravel()


#: Rows of a block that are measured at once, and small distances that are measured anew at once.
MEASURED, CLOSE = 256, 1 << 15


#: Rows of a table whose silhouettes are taken.
MOST_ROWS = 1_000_000


def silhouettes(table: DataFrame, block: int = 8192) -> DataFrame:
    """(key, label, silhouette) of rows (key, label, v): Euclidean silhouette of every row against all rows.

    Rows are packed into blocks of about ``block``, and each two blocks meet once in a group of
    their own, which adds its distances up by row and label for both; so what a task holds does
    not grow with the table.  A row alone in its label has 0.  All pairs are measured, which is
    what a silhouette is: a table of over ``MOST_ROWS`` is an error.
    """
    rows = table.count()
    if rows > MOST_ROWS:
        raise ValueError(f"{rows} rows have too many pairs for a silhouette; {MOST_ROWS} at most")
    n = max(-(-rows // block), 1)  # blocks
    packed = table.select("key", "label", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("key"), F.lit(n)).alias("own"))
    packed = packed.groupBy("own").agg(F.collect_list(F.struct("key", "label", "v")).alias("rows"))
    packed = packed.select("own", F.col("rows.key").alias("keys"), F.col("rows.label").alias("labels"), F.flatten("rows.v").alias("values"))
    meeting = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))

    def run(group: pa.Table) -> pa.Table:
        sides = []
        for i in range(len(group)):
            key, label, v = (group[c][i].values.to_numpy(zero_copy_only=False) for c in ("keys", "labels", "values"))
            order = np.argsort(label, kind="stable")
            sides.append((key[order], label[order], v.reshape(len(key), -1)[order]))
        parts = [_label_sums(a, b) for a, b in ([sides, sides[::-1]] if len(sides) == 2 else [(sides[0], sides[0])] if group["own"][0] == group["other"][0] else [])]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
        return pa.table({c: pa.array(x.astype(t)) for c, x, t in zip(("key", "label", "other", "d"), columns, ("i8", "i4", "i4", "f8"), strict=True)})

    pair = meeting.groupBy(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sums = pair.applyInArrow(run, "key long, label int, other int, d double").groupBy("key", "label", "other").agg(F.sum("d").alias("d"))
    sizes = table.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    means = sums.join(sizes, "other").withColumn("mine", F.col("label") == F.col("other"))
    means = means.withColumn("m", F.col("d") / F.nullif(F.col("n") - F.col("mine").cast("int"), F.lit(0)))
    both = means.groupBy("key", "label").agg(F.max(F.when(F.col("mine"), F.col("m"))).alias("a"), F.min(F.when(~F.col("mine"), F.col("m"))).alias("b"))
    return both.select("key", "label", F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))).alias("silhouette"))


def principal_plane(table: DataFrame, axes: int = 2) -> DataFrame:
    """(key, axis0, axis1, ...) of rows (key, v): coordinates about the mean on the main axes.

    The axes come from one pass over the table; only a matrix of dimensions by axes
    reaches the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = table.select("key", array_to_vector(F.col("v").cast("array<double>")).alias("f"))
    model = PCA(k=axes, inputCol="f", outputCol="p").fit(rows)
    loads, mean = model.pc.toArray(), rows.agg(Summarizer.mean(F.col("f")).alias("m")).first()["m"].toArray()
    sign = np.sign(loads[np.abs(loads).argmax(0), np.arange(axes)])
    out = model.transform(rows).select("key", vector_to_array("p").alias("p"))
    return out.select("key", *[((F.col("p")[i] - float(mean @ loads[:, i])) * float(sign[i])).alias(f"axis{i}") for i in range(axes)])
