"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each
filter's largest response over the window feeds one softmax layer.  The network
is trained here, in numpy, on windows of a bounded sample of labelled texts, and
applied to every window of every text: windows tile the whole text, and a text's
probabilities are the mean of its windows', weighted by their length.

A filter over one-hot bytes is a table of ``width * 256`` weights, so a response
is a sum of table rows; for prediction neighbouring positions are folded into
tables over byte pairs, which halves the look-ups.

Defined results: ``und`` with score 0.0 for a null text and one without a letter,
and for every text if there is nothing to learn from; a null doc_id is neither
held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.scratch import free_names, map_batches
from strideline.llm.textcore import text_buffer

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 4, 6)
FILTERS = 8
#: Labelled texts that training looks at, at most, and windows taken of each.
SAMPLE_TEXTS = 4000
WINDOWS_PER_TEXT = 3
#: Windows that are convolved together.
CHUNK = 256


@dataclass
class ByteCnn:
    """weights: for each width, (width, 256, filters); bias, dense and dense_bias as usual."""

    languages: list[str]
    weights: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, a (65536, filters) table for each two neighbouring positions."""
        out = []
        for w in self.weights:
            steps = [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(w), 2)]
            out.append([np.ascontiguousarray(s, dtype=np.float32) for s in steps])
        return out


def _pooled(x: np.ndarray, model: ByteCnn) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Largest response and its position for each width; x: (windows, length) bytes."""
    top, place = [], []
    for w, b in zip(model.weights, model.bias, strict=True):
        n = x.shape[1] - len(w) + 1
        r = w[0][x[:, :n]]
        for j in range(1, len(w)):
            r = r + w[j][x[:, j : j + n]]
        at = r.argmax(axis=1)
        top.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0, :] + b)
        place.append(at)
    return top, place


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: list[bytes], languages: list[str], steps: int = 1200, batch: int = 96, rate: float = 0.01, seed: int = 7) -> ByteCnn | None:
    """Adam on the cross entropy; None without a labelled window. The same input gives the same network."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    x = np.zeros((len(windows), WINDOW), np.uint8)
    for row, text in zip(x, windows, strict=True):
        row[: len(text)] = np.frombuffer(text, np.uint8)[:WINDOW]
    sizes = np.array([min(len(t), WINDOW) for t in windows])
    y = np.array([names.index(v) for v in languages])
    f = FILTERS
    weights = [rng.normal(0, 0.1, (w, 256, f)) for w in WIDTHS]
    model = ByteCnn(names, weights, [np.zeros(f) for _ in WIDTHS], rng.normal(0, 0.1, (f * len(WIDTHS), len(names))), np.zeros(len(names)))
    params = [*model.weights, *model.bias, model.dense, model.dense_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        part = x[pick].copy()
        # short texts are met too: some windows are cut at a random length
        cut = np.where(rng.random(batch) < 0.3, rng.integers(8, WINDOW + 1, batch), sizes[pick])
        part[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
        top, place = _pooled(part, model)
        hidden = np.maximum(np.concatenate(top, axis=1), 0)
        p = _softmax(hidden @ model.dense + model.dense_bias)
        p[np.arange(batch), y[pick]] -= 1
        p /= batch
        grads_dense = hidden.T @ p
        back = (p @ model.dense.T) * (hidden > 0)
        grads = []
        for k, w in enumerate(model.weights):
            g = np.zeros_like(w)
            part_back = back[:, k * f : (k + 1) * f]
            for j in range(len(w)):
                byte = np.take_along_axis(part, place[k] + j, 1)
                np.add.at(g[j], (byte, np.arange(f)[None, :]), part_back)
            grads.append(g)
        grads += [back[:, k * f : (k + 1) * f].sum(axis=0) for k in range(len(WIDTHS))]
        grads += [grads_dense, p.sum(axis=0)]
        now = rate * (1 - step / (steps + 1))
        for v, g, m, s in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def _window_probabilities(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, tables: list[list[np.ndarray]], model: ByteCnn) -> np.ndarray:
    """(windows, languages); positions lie along the first axis, so that pooling runs over whole rows."""
    out = np.empty((len(begin), len(model.languages)), np.float32)
    steps = np.arange(WINDOW)[:, None]
    dense = model.dense.astype(np.float32)
    for i in range(0, len(begin), CHUNK):
        b, s = begin[i : i + CHUNK], size[i : i + CHUNK]
        x = buf[np.minimum(b[None, :] + steps, len(buf) - 1)].astype(np.uint16)
        x[steps >= s[None, :]] = 0
        pair = x[:-1] * np.uint16(256) + x[1:]
        top = []
        for table, bias in zip(tables, model.bias, strict=True):
            n = WINDOW - 2 * len(table) + 1
            r = table[0].take(pair[:n], axis=0)
            for j in range(1, len(table)):
                r += table[j].take(pair[2 * j : 2 * j + n], axis=0)
            top.append(np.maximum.reduce(r, axis=0) + bias.astype(np.float32))
        out[i : i + CHUNK] = _softmax(np.maximum(np.concatenate(top, axis=1), 0) @ dense + model.dense_bias.astype(np.float32))
    return out


def probabilities(buf: np.ndarray, at: np.ndarray, model: ByteCnn, tables: list[list[np.ndarray]]) -> np.ndarray:
    """(documents, languages): mean over the windows that tile each whole text, weighted by their bytes."""
    length = np.diff(at)
    count = -(-length // WINDOW)
    n = len(length)
    doc = np.repeat(np.arange(n), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][doc] + nth * WINDOW
    size = np.minimum(at[1:][doc] - begin, WINDOW)
    p = _window_probabilities(buf, begin, size, tables, model) * size[:, None]
    total = np.stack([np.bincount(doc, p[:, k], minlength=n) for k in range(p.shape[1])], axis=1)
    return total / np.maximum(length, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> tuple[list[bytes], list[str]]:
    """Windows of at most ``sample_texts`` labelled texts that are not held out, taken by hash of the id.

    Where there are more, each language gives an equal share, and what small ones
    leave goes to the others, so none is missing.  A first filter on the hash leaves
    about as many rows of each as are wanted, whatever the size of the table, so the
    final cut orders a bounded set.  Of more languages than ``sample_texts`` those of
    most texts are learned.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    held = usable.groupBy("lang").agg(F.count("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_texts).collect()
    share = shares({row["lang"]: row["n"] for row in held}, sample_texts)
    order = F.xxhash64("doc_id", F.lit("sample"))
    if sum(row["n"] for row in held) > sum(share.values()):
        table = docs.sparkSession.createDataFrame([(row["lang"], share[row["lang"]], _cut(share[row["lang"]], row["n"])) for row in held], "lang string, share int, cut long")
        usable = usable.join(F.broadcast(table), "lang").where(F.pmod(order, F.lit(1 << 30)) < F.col("cut"))
    else:
        usable = usable.withColumn("share", F.lit(sample_texts))
    length = F.length("text")
    parts = []
    for k in range(WINDOWS_PER_TEXT):
        start = F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(length - WINDOW, F.lit(1))).cast("int") + 1
        parts.append(F.substring(F.col("text"), start, F.lit(WINDOW)))
    ranked = ["rank", "doc_id", "lang", "parts"]
    picked = usable.select(order.alias("rank"), "doc_id", "lang", F.array(*parts).alias("parts"), "share")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(*ranked))
    picked = picked.withColumn("nth", nth).where(F.col("nth") <= F.col("share")).select(*ranked).orderBy(*ranked)
    windows, languages = [], []
    for row in picked.collect():
        for part in row["parts"]:
            raw = part.encode()[:WINDOW]
            if raw:
                windows.append(raw)
                languages.append(row["lang"])
    return windows, languages


def shares(held: dict[str, int], most: int) -> dict[str, int]:
    """Texts to take of each language: equal shares of ``most``, those of what small languages leave."""
    out, left = {}, most
    for k, name in enumerate(sorted(held, key=lambda s: (held[s], s))):
        out[name] = min(held[name], left // (len(held) - k))
        left -= out[name]
    return out


def _cut(wanted: int, n: int) -> int:
    """Bound on 30 bits of a hash that leaves at least ``wanted`` of ``n`` rows but for a chance of about 1e-9."""
    return int((1 << 30) * min(1.0, (wanted + 8 * wanted**0.5 + 64) / n))


def fit(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> ByteCnn | None:
    """A network trained on the labelled documents of ``docs`` (doc_id, text, lang) that are not held out."""
    return train(*training_windows(docs, sample_texts))


def identify(docs: DataFrame, model: ByteCnn | None, keep: list[str] | None = None, own: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, under the names ``own``, with the columns ``keep`` of docs before them."""
    keep = ["doc_id"] if keep is None else keep
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    body = keep.index("text") if "text" in keep else len(keep)  # a text goes to the workers once
    given = [F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)] + [F.col("text").alias(f"in_{len(keep)}")] * (body == len(keep))
    rows = docs.select(*given, held_out(F.col("doc_id")).alias("held_out"), has_letter.alias("letter"))
    names = [*(f"in_{i}" for i in range(len(keep))), "held_out", "lang_pred", "score"]
    tables = None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal tables
        if model is not None and tables is None:
            tables = model.pair_tables()
        for batch in batches:
            n = batch.num_rows
            label, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            if model is not None and n and letter.any():
                p = probabilities(*text_buffer(batch.column(body)), model, tables)
                best = p.argmax(axis=1)
                label = np.where(letter, np.array(model.languages, dtype=object)[best], UNKNOWN)
                score = np.where(letter, np.clip(p[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], batch.column(batch.num_columns - 2), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=names)

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"in_{i} {types[c]}" for i, c in enumerate(keep)), "held_out boolean, lang_pred string, score double"])
    out = map_batches(rows, predict, schema)
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(o) for c, o in zip(("held_out", "lang_pred", "score"), own, strict=True)])


#: The least score at which a document counts as text of a language.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the documents of no language: null, no letter, or no language of at least ``min_score``."""
    model = fit(docs, sample_texts)
    own = free_names(docs, "held_out", "lang_pred", "score")
    found = identify(docs, model, docs.columns, tuple(own))
    return found.where((F.col(own[1]) != UNKNOWN) & (F.col(own[2]) >= min_score)).select(*docs.columns)


def accuracy(predicted: pd.DataFrame, truth: pd.Series) -> float:
    """Share of held-out rows whose prediction equals the label."""
    rows = predicted["held_out"] & truth.notna()
    return float((predicted["lang_pred"][rows] == truth[rows]).mean())
