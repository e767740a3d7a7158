"""All maximal periodic runs of the words of each text, by Kolpakov and Kucherov's algorithm.

A run is a stretch of words with smallest period q that no neighbouring word extends.
Reported are those of at least ``MIN_WORDS`` words and ``MIN_REPEATS`` periods:

1. Words are numbered.  A word inside a reported run stands there at least ``MIN_REPEATS``
   times, so words that are rarer part the text; each remaining segment is looked at by
   itself and parted again until nothing changes.  No run crosses or touches such a word
   that would extend it, so the runs of the segments are the runs of the text.
2. A segment is factored: each factor is the longest stretch that began earlier as well
   (occurrences may overlap), or one new word.  A suffix automaton with the end of each
   state's first occurrence gives the factors in linear time.
3. Main's algorithm finds, from four prefix tables, the runs that touch a boundary between
   factors; a run that ends in factor k starts at most 2|k-1| + |k| words before it.
4. Every other run lies strictly inside a factor and is copied from the factor's earlier
   occurrence.

A text is one row's work; memory is a few dozen bytes a word and, in the periodic segments
alone, about 1 KB a word for the automaton.

Defined results: a null, empty or blank text has no word and no run; rows that repeat a
doc_id or a text are each judged by themselves; an empty table gives an empty one; other
columns are neither read nor returned.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.scratch import map_batches

MIN_WORDS, MIN_REPEATS = 6, 4

Run = tuple[int, int, int]  # start, end (exclusive), period


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of the earlier occurrence or -1) of each factor."""
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(step)
        step.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, i, n = [], 0, len(s)
    while i < n:
        state, j = 0, i
        while j < n:
            after = step[state][s[j]]
            if first[after] >= j:
                break
            state, j = after, j + 1
        if j == i:
            out.append((i, i + 1, -1))
        else:
            out.append((i, j, first[state] - (j - i) + 1))
        i = max(j, i + 1)
    return out


def matches(s: list[int]) -> list[int]:
    """For each position, how many letters from there agree with the beginning of ``s``."""
    n = len(s)
    out = [0] * n
    if n:
        out[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _touching(s: list[int], low: int, at: int, high: int) -> Iterator[Run]:
    """Repetitions that touch boundary ``at`` within s[low:high], with some period; each is maximal in s."""
    before, after = s[low:at], s[at:high]
    back = before[::-1]
    m, n = len(before), len(after)
    ahead = matches(after)  # after against itself, shifted
    behind = matches(back)  # before against itself, read backwards
    back_over = matches(back + [-1] + after[::-1] + back)[m + 1 :]  # what ends at each place of before + after, against the end of before
    ahead_over = matches(after + [-1] + before + after)[n + 1 :]  # what starts at each place of before + after, against after
    most = (m + n) // MIN_REPEATS  # no longer period can repeat often enough here
    for p in range(1, min(n, most) + 1):  # the run holds the p words after the boundary
        left, right = min(back_over[n - p], m), ahead[p] if p < n else 0
        if left + right >= p:
            yield at - left, at + p + right, p
    for p in range(1, min(m, most) + 1):  # the run holds the p words before it
        left, right = behind[p] if p < m else 0, min(ahead_over[m - p], n)
        if left + right >= p:
            yield at - p - left, at + right, p


def _segment_runs(s: list[int]) -> list[Run]:
    """Runs of one segment that are long enough, by start and period."""
    n = len(s)
    parts = factors(s)
    found: dict[tuple[int, int], int] = {}
    by_start: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def add(start: int, end: int, period: int) -> None:
        if start not in by_start:
            by_start[start] = []
            insort(order, start)
        by_start[start].append((end, period))
        found[start, end] = period

    for k in range(1, len(parts) + 1):
        at, high, source = parts[k] if k < len(parts) else (n, n, -1)
        before = at - parts[k - 1][0]
        low = max(0, at - 2 * before - (high - at))
        best: dict[tuple[int, int], int] = {}
        for start, end, p in _touching(s, low, at, high):
            if end - start < max(MIN_WORDS, MIN_REPEATS * p):
                continue
            if (start > 0 and s[start - 1] == s[start - 1 + p]) or (end < n and s[end] == s[end - p]):
                continue  # cut off by the window; the boundary it ends behind has it whole
            best[start, end] = min(p, best.get((start, end), p))
        for (start, end), p in best.items():
            if (start, end) not in found:
                add(start, end, p)
        if source >= 0:
            shift, stop = at - source, source + high - at
            # runs of the source in order of their starts; a copy may itself be copied further on
            i = bisect_right(order, source)
            while i < len(order) and order[i] < stop:
                start = order[i]
                for end, p in by_start[start]:
                    if end < stop and (start + shift, end + shift) not in found:
                        add(start + shift, end + shift, p)
                i = bisect_right(order, start)
    return sorted((start, end, p) for (start, end), p in found.items())


def _segments(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``ids`` outside which no reported run can reach."""
    todo = [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        if high - low < MIN_WORDS:
            continue
        part = ids[low:high]
        _, number, count = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[number] < MIN_REPEATS)
        if len(rare) == 0:
            yield low, high
            continue
        edges = np.concatenate([[-1], rare, [len(part)]])
        wide = np.flatnonzero(np.diff(edges) > MIN_WORDS)
        todo.extend((low + int(edges[i]) + 1, low + int(edges[i + 1])) for i in wide)


def periodic_runs(words: list) -> list[Run]:
    """(start, end, period) of every run of ``words`` (hashable), by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(ids) - len(index) < MIN_WORDS - MIN_WORDS // MIN_REPEATS:
        return []  # too few repeated words for any run
    out = [(low + a, low + b, p) for low, high in _segments(ids) for a, b, p in _segment_runs(ids[low:high].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """``words`` without those that a run contains after its first period."""
    gone = np.zeros(len(words), dtype=bool)
    for start, end, p in runs:
        gone[start + p : end] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def text_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period in words) and collapsed (text, words joined by one space) of each document.

    ``prepare`` may change a document's words, given its id, before runs are sought.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            lists, texts = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()
                if prepare is not None:
                    words = prepare(doc_id, words)
                found = periodic_runs(words)
                lists.append([{"start": a, "length": b - a, "period": p} for a, b, p in found])
                texts.append(b" ".join(collapsed(words, found) if found else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(rows, run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of ``text_runs``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.withColumn("longest", longest)
    exponent = F.floor(F.lit(1000) * F.col("longest.length") / -F.col("longest.period")).cast("long")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        exponent.alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
