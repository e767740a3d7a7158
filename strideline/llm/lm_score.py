"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end after each text.
The n-grams counted are single tokens and pairs; an end also stands before the first word.

1. Each task counts the n-grams of its training texts in buffers and keeps frequent ones to
   its end; the rest is dealt by hash to shards of about ``SHARD_BYTES`` of text each, the
   sorted keys of a shard as the bytes of their differences.
2. A shard adds the counts up and writes its part of the filter: a count c has level
   ``1 + floor(log2 c)`` and the n-gram is entered once for each level up to its own,
   with ``HASHES`` bits, all in one 64-bit word of the filter, so that a probe reads
   memory once.  It also writes the exact counts of its words.
3. The filter goes to the workers as a broadcast while all of it has at most
   ``BROADCAST_BYTES``.  A larger one stays in its shards: documents are dealt to chunks of
   about ``CHUNK_BYTES`` of text, the distinct n-grams of a chunk go to the shards as such
   bytes, and their levels and exact counts come back in the same order, without the keys.
   Both ways give the same scores.
4. A probe asks for level 1, 2, ... until one is missing and takes the middle of the last
   level's counts.  An n-gram never reads lower than it was entered; it reads higher with
   a chance of one or two in a hundred.

    P(w | v) = (c(vw) + MU * P(w)) / (max(c(v), c(vw)) + MU),  P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

with c from the filter.  ``score`` is the sum of log10 P over the tokens of a text.
``base_score`` takes P(w) alone with exact counts: those of the ``HEAD`` most frequent
words travel with the filter, documents' rarer words are joined with the exact table.
Words are told apart by 63 bits of a hash, pairs by 47: as long as there are fewer than 1e10
of them, one in 1e4 at most reads another's count, far fewer than by false probes.

Defined results: a null, empty or blank text has the end as its only token; a null doc_id
counts as training; rows that repeat a doc_id or a text are each learnt from and scored; with
no training text N = V = 0 and the base score is 0; an empty table gives an empty one; other
columns are not read.  Texts of any length pass in pieces or chunks; some 100 bytes a word of
one text are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.scratch import discard, map_batches, small_batches, stored
from strideline.llm.textcore import GOLDEN, mix64, slices, text_buffer, word_hashes

SHARD_BYTES, BROADCAST_BYTES, CHUNK_BYTES = 8 << 20, 128 << 20, 8 << 20
HASHES, BITS = 5, 12
HEAD = 1 << 19
MU = 2.0
#: N-grams of a counting buffer; counts from which a task keeps one to its end, and how many it keeps at most before it sends them on.
BUFFER, FREQUENT, KEPT = 1 << 21, 8, 1 << 19
PIECE = 1 << 20
END = np.uint64(0x6A09E667F3BCC909)
_ONE = np.uint64(1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))


def word_keys(tokens: np.ndarray) -> np.ndarray:
    """Key of each token's count: odd numbers."""
    return tokens | _ONE


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Key of each pair's count: even numbers below 2**48."""
    return (mix64(mix64(first + GOLDEN) ^ (second * GOLDEN)) >> np.uint64(16)) & ~_ONE


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, an end after each, and n + 1 offsets by text."""
    words, at = word_hashes(*text_buffer(column))
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of whole texts of about ``PIECE`` bytes, as arrays take some 100 bytes a word."""
    for batch in batches:
        _, at = text_buffer(batch.column(text))
        for i, j in slices(at, PIECE):
            yield batch.slice(i, j - i)


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each one."""
    return np.concatenate([[END], tokens[:-1]]) if len(tokens) else tokens


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count) of positive counts."""
    return np.frexp(counts.astype(np.float64))[1]


def level_counts(most: int = 64) -> np.ndarray:
    """Count that each level stands for: the middle of its range; 0 for level 0."""
    j = np.arange(most + 1, dtype=np.float64)
    return np.where(j == 0, 0.0, (np.exp2(j - 1) + np.exp2(j) - 1) / 2)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of n-grams, each a few times at most."""
    waiting, size = [], 0
    kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal waiting, size, kept
        keys, n = np.unique(np.concatenate(waiting), return_counts=True)
        waiting, size = [], 0
        keys, n = _summed(np.concatenate([kept[0], keys]), np.concatenate([kept[1], n]))
        often = n >= FREQUENT if np.count_nonzero(n >= FREQUENT) <= KEPT else np.zeros(len(n), bool)
        kept = keys[often], n[often]
        yield rows(keys[~often], n[~often])

    for batch in _pieces(batches, 0):
        tokens, _ = tokens_of(batch.column(0))
        waiting += [word_keys(tokens), pair_keys(before(tokens), tokens)]
        size += 2 * len(tokens)
        if size >= BUFFER:
            yield from flush()
    if size:
        yield from flush()
    yield rows(*kept)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes: the lowest byte of each, then the next, as many as the largest needs."""
    wide = values.astype(np.uint64, copy=False)
    planes = (int(wide.max(initial=0)).bit_length() + 7) // 8 or 1
    return bytes([planes]) + wide.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64)[:, 0]


def _by_shard(keys: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by shard, and where each shard begins in it, with the end."""
    shard = ((keys >> _ONE) % np.uint64(number)).astype(np.uint16 if number <= 1 << 16 else np.int64)
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=number))])


def _packed_keys(keys: np.ndarray, number: int) -> bytes:
    """A shard's sorted keys of one kind; what the shard tells of them is left out."""
    return _packed(np.diff((keys >> _ONE) // np.uint64(number), prepend=np.uint64(0)))


def _unpacked_keys(data: bytes, number: int, shard: int, kind: np.uint64) -> np.ndarray:
    return ((np.cumsum(_unpacked(data), dtype=np.uint64) * np.uint64(number) + np.uint64(shard)) << _ONE) | kind


def _blocks(keys: np.ndarray, number: int, n: np.ndarray | None = None) -> tuple[pa.Array, list[pa.Array]]:
    """Shards that have some of the sorted keys, and for each its pairs and words, with ``n`` their counts too."""
    words = (keys & _ONE) == 1
    columns, some = [], np.zeros(number, bool)
    for on in (~words, words):
        own = keys[on]
        order, at = _by_shard(own, number)
        own = own[order]
        columns.append([_packed_keys(own[i:j], number) for i, j in zip(at[:-1], at[1:])])
        some |= np.diff(at) > 0
        if n is not None:
            times = n[on][order]
            columns.append([_packed(times[i:j]) for i, j in zip(at[:-1], at[1:])])
    shards = np.flatnonzero(some)
    return pa.array(shards.astype(np.int32)), [pa.array([c[i] for i in shards], pa.binary()) for c in columns]


def _dealt_counts(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of ``_count``, packed: a row for each shard of some."""
        for batch in _count(batches):
            keys, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            shards, columns = _blocks(keys, number, n)
            yield pa.RecordBatch.from_arrays([shards, *columns], names=["shard", "pairs", "pair_n", "words", "word_n"])

    return run


def _entries(keys: np.ndarray, levels: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where in its shard each entry's word is, as a fraction of 2**32, and the bits it sets there."""
    h = mix64(keys ^ mix64(np.atleast_1d(np.asarray(levels, np.uint64)) * GOLDEN))
    marks = np.zeros(len(h), np.uint64)
    for i in range(HASHES):
        marks |= _ONE << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return h >> np.uint64(32), marks


def _build(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The words of a shard's filter, from distinct keys and their counts."""
    level = levels_of(n)
    words = np.zeros(max(1, math.ceil(int(level.sum()) * BITS / 64)), np.uint64)
    for nth in range(1, int(level.max(initial=0)) + 1):
        place, marks = _entries(keys[level >= nth], nth)
        np.bitwise_or.at(words, ((place * np.uint64(len(words))) >> np.uint64(32)).astype(np.int64), marks)
    return words


class LogFrequencyFilter:
    """The shards' words end to end; ``starts`` has the first word of each shard and the end."""

    def __init__(self, starts: np.ndarray, data: np.ndarray):
        self.starts, self.data = starts, data

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, 0 for one that was not entered: probes level after level until one is missing."""
        out = np.zeros(len(keys), np.int64)
        if len(self.data) == 0:
            return out
        shard = ((keys >> _ONE) % np.uint64(len(self.starts) - 1)).astype(np.int64)
        first = self.starts[shard]
        size = (self.starts[shard + 1] - first).astype(np.uint64)
        alive, level = np.flatnonzero(size), 0
        while len(alive):
            level += 1
            place, marks = _entries(keys[alive], level)
            at = first[alive] + ((place * size[alive]) >> np.uint64(32)).astype(np.int64)
            alive = alive[(self.data[at] & marks) == marks]
            out[alive] = level
        return out


class Model(NamedTuple):
    """shards: rows of a shard's filter (shard, bits) and of its words' exact counts (shard, key, n); number: of shards; tokens and words: N and V; size: bytes of the filter."""

    shards: DataFrame
    number: int
    tokens: int
    words: int
    size: int


def _build_shards(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds one shard: a row with its bits, and one for each of its words."""
        parts, shard = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                shard = r["shard"]
                for kind, name in ((np.uint64(0), "pair"), (_ONE, "word")):
                    parts.append((_unpacked_keys(r[f"{name}s"], number, shard, kind), _unpacked(r[f"{name}_n"]).astype(np.int64)))
        if not parts:
            return
        keys, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        parts.clear()
        bits = _build(keys, n)
        row = lambda k, b, i, m: pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), pa.array(b, pa.binary()), pa.array(i, pa.int64()), pa.array(m, pa.int64())], names=["shard", "bits", "key", "n"])
        yield row(1, [bits.tobytes()], [None], [None])
        words = (keys & _ONE) == 1
        keys, n = keys[words].view(np.int64), n[words]
        for i in range(0, len(keys), 1 << 16):
            part = keys[i : i + (1 << 16)]
            yield row(len(part), [None] * len(part), part, n[i : i + (1 << 16)])

    return run


def fit(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the n-grams of ``texts`` (text) and build the filter in shards that hold about ``shard_bytes`` of text each."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, math.ceil(total / shard_bytes))
    counted = map_batches(texts.select("text"), _dealt_counts(number), "shard int, pairs binary, pair_n binary, words binary, word_n binary")
    dealt = counted.repartitionById(number, F.col("shard"))
    shards = stored(map_batches(dealt, _build_shards(number), "shard int, bits binary, key long, n long"), "ngram-shards")
    row = shards.agg(F.sum("n"), F.count("n"), F.sum(F.length("bits"))).first()
    return Model(shards, number, row[0] or 0, row[1], row[2] or 0)


def _gathered(model: Model) -> LogFrequencyFilter:
    """The whole filter, of ``model.size`` bytes, read shard by shard."""
    parts = {r["shard"]: np.frombuffer(r["bits"], np.uint64) for r in model.shards.where("bits is not null").select("shard", "bits").toLocalIterator()}
    ordered = [parts.get(i, np.zeros(0, np.uint64)) for i in range(model.number)]
    return LogFrequencyFilter(np.concatenate([[0], np.cumsum([len(x) for x in ordered])]).astype(np.int64), np.concatenate(ordered))


def _head(model: Model, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and exact counts, of the most frequent words: all of a count or none, at most ``most``."""
    words = model.shards.where("key is not null")
    bucket = F.floor(F.log2("n") * 8)
    left, least = most, None
    for r in sorted(words.groupBy(bucket.alias("bucket")).count().collect(), key=lambda r: -r["bucket"]):  # some hundred buckets
        if r["count"] > left:
            break
        left, least = left - r["count"], r["bucket"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = words.where(bucket >= least).select("key", "n").toArrow()
    keys, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def pair_scores(first: np.ndarray, second: np.ndarray, both: np.ndarray, tokens: int, words: int) -> np.ndarray:
    """log10 P(second | first) from the counts of the first, the second and the pair."""
    alone = np.minimum((second + 0.5) / (tokens + 0.5 * (words + 1)), 1.0)
    return np.log10((both + MU * alone) / (np.maximum(first, both) + MU))


def _joined(table: pa.Table, column: str) -> pa.Array:
    found = table[column].combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _grams(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Offsets of the texts' tokens, their distinct words and pairs in order, and which of these each token is."""
    tokens, at = tokens_of(texts)
    return at, *np.unique(word_keys(tokens), return_inverse=True), *np.unique(pair_keys(before(tokens), tokens), return_inverse=True)


def _ask(number: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        """(chunk, shard, pairs, words): the distinct n-grams of a chunk that each shard has to tell."""
        _, words, _, pairs, _ = _grams(_joined(docs, "text"))
        shards, (pairs, words) = _blocks(np.concatenate([pairs, words]), number)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(shards), pa.int32()), "shard": shards, "pairs": pairs, "words": words})

    return run


def _tell(number: int):
    def run(key: tuple, shard: pa.Table, asked: pa.Table) -> pa.Table:
        """(chunk, shard, pairs, words, n): levels of each chunk's pairs and words, and the words' exact counts, in the order of the keys."""
        at, bits, known, counts = int(key[0].as_py() or 0), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if shard.num_rows and asked.num_rows:
            own = shard.filter(shard["bits"].is_valid())
            bits = np.frombuffer(own["bits"][0].as_py(), np.uint64) if own.num_rows else bits
            own = shard.filter(shard["key"].is_valid())
            known, counts = own["key"].to_numpy().view(np.uint64), own["n"].to_numpy()
            order = np.argsort(known)
            known, counts = known[order], counts[order]
        found, out = LogFrequencyFilter(np.array([0, len(bits)]), bits), {}

        def packed(values: np.ndarray, parts: list[np.ndarray]) -> pa.Array:
            ends = np.cumsum([len(x) for x in parts])
            return pa.array([_packed(values[j - len(x) : j]) for x, j in zip(parts, ends)], pa.binary())

        for column, kind in (("pairs", np.uint64(0)), ("words", _ONE)):
            parts = [_unpacked_keys(x.as_py(), number, at, kind) for x in asked[column]]
            keys = np.concatenate([np.zeros(0, np.uint64), *parts])
            out[column] = packed(found.levels(keys), parts)
        place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        out["n"] = packed(np.where(known[place] == keys, counts[place], 0) if len(known) else np.zeros(len(keys), np.int64), parts)
        return pa.table({"chunk": _joined(asked, "chunk"), "shard": _joined(asked, "shard")} | out)

    return run


def _score_chunk(number: int, n: int, v: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        """A row for each document of a chunk, from its texts and what the shards have told of its n-grams."""
        at, words, word, pairs, pair = _grams(_joined(docs, "text"))
        told = told.sort_by("shard")

        def of(keys: np.ndarray, column: str) -> np.ndarray:
            out = np.zeros(len(keys), np.int64)
            out[_by_shard(keys, number)[0]] = np.concatenate([_unpacked(x.as_py()) for x in told[column]])
            return out

        total = lambda x: np.add.reduceat(x, at[:-1])
        middle, exact = level_counts(), of(words, "n")
        c = middle[of(words, "words")][word]
        ahead = before(c)
        ahead[at[:-1]] = c[at[1:] - 1]  # an end stands before the first word
        score = total(pair_scores(ahead, c, middle[of(pairs, "pairs")][pair], n, v))
        base = total((np.log10(exact + 0.5) - math.log10(n + 0.5 * (v + 1)))[word])
        return pa.table({
            "doc_id": _joined(docs, "doc_id"), "held_out": _joined(docs, "held_out"), "n_tokens": pa.array(np.diff(at).astype(np.int64)), "n_known": pa.array(total((exact > 0).astype(np.int64)[word])),
            "train_tokens": pa.array(np.full(len(at) - 1, n, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def _score_in_shards(docs: DataFrame, model: Model, chunk_bytes: int) -> DataFrame:
    """The rows of ``score_texts`` of docs (doc_id, held_out, text) without a filter or a count leaving its shard's task.

    A chunk's texts are shuffled once, for both groupings; else only packed keys and what is told of them move.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chunks = max(1, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / chunk_bytes))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    dealt = docs.withColumn("chunk", chunk).repartition(chunks, "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(model.number), "chunk int, shard int, pairs binary, words binary")
    told = model.shards.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_tell(model.number), "chunk int, shard int, pairs binary, words binary, n binary")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score_chunk(model.number, model.tokens, model.words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, model: Model, broadcast_bytes: int = BROADCAST_BYTES, head: int = HEAD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    if model.size > broadcast_bytes:
        return _score_in_shards(rows, model, chunk_bytes)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "*")
    sent = docs.sparkSession.sparkContext.broadcast((_gathered(model), *_head(model, head)))
    n, v = model.tokens, model.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lfbf, keys, counts = sent.value
        middle, logs = level_counts(), np.log10(counts + 0.5)
        for batch in _pieces(batches, 3):
            tokens, at = tokens_of(batch.column(3))
            total = lambda x: np.add.reduceat(x, at[:-1]) if batch.num_rows else np.zeros(0)
            own, number = np.unique(word_keys(tokens), return_inverse=True)  # each distinct word is looked up once
            place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            hit = keys[place] == own if len(keys) else np.zeros(len(own), bool)
            known, base = hit[number], (np.where(hit, logs[place], 0.0) if len(keys) else np.zeros(len(own)))[number]
            c = middle[lfbf.levels(own)][number]
            starts = at[:-1]
            ahead = before(c)
            ahead[starts] = c[at[1:] - 1]  # an end stands before the first word
            score = total(pair_scores(ahead, c, middle[lfbf.levels(pair_keys(before(tokens), tokens))], n, v))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))[~known]
            rare = own[number[~known]]
            order = np.lexsort((rare, doc))
            doc, rare = doc[order], rare[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1])])) if len(rare) else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(rare[new].view(np.int64)), pa.array(np.diff(np.append(new, len(rare))).astype(np.int64))], names=["key", "times"])
            ends = np.searchsorted(doc[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            arrays = [*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(total(known.astype(np.int64)).astype(np.int64)), pa.array(total(base)), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), pairs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", "n_tokens", "n_head", "head_sum", "score", "rare"])

    scored = map_batches(rows, run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head_sum double, score double, rare array<struct<key: long, times: long>>")
    scored = stored(scored, "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times")
    exact = rare.join(model.shards.where("key is not null").select("key", "n"), "key")
    exact = exact.groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("rare_sum"))
    out = scored.drop("rare").join(exact, "row", "left")
    n_known = F.col("n_head") + F.coalesce("n_rare", F.lit(0))
    base = F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) + (F.col("n_tokens") - n_known) * math.log10(0.5) - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))
    return out.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def score_documents(docs: DataFrame, shard_bytes: int = SHARD_BYTES, broadcast_bytes: int = BROADCAST_BYTES, head: int = HEAD) -> DataFrame:
    """Learn from the documents that are not held out and score all; result stored, the model's tables deleted."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), shard_bytes)
    out = stored(score_texts(docs, model, broadcast_bytes, head), "lm-scores")
    discard(model.shards)
    return out
