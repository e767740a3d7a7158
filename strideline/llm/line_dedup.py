"""Exact removal of repeated lines through sharded minimal perfect hashes.

1. Each document gives the 128-bit hash of each of its distinct keys (a line
   stripped of blanks, A-Z lower-cased, of ``MIN_CHARS`` code points or more).
2. Distinct hashes are dealt to shards.  A shard's hashes are numbered without
   gaps by a minimal perfect hash (bit arrays of several levels, about 3 bits a
   key); three arrays in that order hold a 32-bit fingerprint, the number of
   documents (up to 255) and the least doc_id of each key.
3. The documents' hashes are dealt by shard as well and look themselves up in the
   arrays: a line goes if its key's count is at least 2 and its least doc_id is
   smaller than the document's own.  A shard that a very common line makes hot is
   probed in several chunks, each with a copy of the shard's few MB of arrays.
4. Only hashes of lines to drop travel back to their documents.

Every key that is probed was numbered, so no false positive is possible; two
keys are taken for one only if all 128 bits agree.

Defined results: a null or empty text is one empty line; a null doc_id counts as
the largest; rows that repeat a doc_id are one document to this operator; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.scratch import discard, free_names, map_batches, stored
from strideline.llm.textcore import mix64

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
LAST_ID = 2**63 - 1
#: Distinct keys of a shard, and probes of a chunk, on average.
SHARD_KEYS, CHUNK_PROBES = 200_000, 400_000
LEVELS, LOAD = 32, 1.6


def line_key(line: bytes) -> bytes | None:
    """Hash of the line's key, None if the key is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, doc_id, tie) for each distinct key of each document."""
    for batch in batches:
        ids = batch.column(0).fill_null(LAST_ID).to_numpy()
        found, counts = [], []
        for text in batch.column(1).cast(pa.large_binary()):
            raw = text.as_py()
            keys = {k for line in raw.split(b"\n") if (k := line_key(line)) is not None} if raw else ()
            found.extend(keys)
            counts.append(len(keys))
        both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.repeat(ids, counts)), pa.array(np.repeat(batch.column(2).to_numpy(), counts))], names=["high", "low", "doc_id", "tie"])


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys, given as two unsigned columns."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, left: np.ndarray):
        self.sizes, self.bits, self.left = sizes, bits, left  # words of each level; all levels' words; keys that no level took
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, level: int, words: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0xD6E8FEB86659FD93 % 2**64)
        salted = mix64(high + salt) ^ (low * (salt | np.uint64(1)))
        return (mix64(salted) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(LEVELS):
            if len(high) == 0:
                break
            words = int(len(high) * LOAD / 64) + 1
            at = cls._place(high, low, level, words)
            alone = np.bincount(at, minlength=64 * words) == 1
            sizes.append(words)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            again = ~alone[at]
            high, low = high[again], low[again]
        left = np.stack([high, low], axis=1)
        return cls(np.array(sizes, np.int64), np.concatenate([*bits, np.zeros(0, np.uint64)]).astype(np.uint64), left)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Number of each key; -1 for some, not all, that were not numbered."""
        out = np.full(len(high), -1, np.int64)
        todo = np.arange(len(high))
        for level, words in enumerate(self.sizes.tolist()):
            at = self._place(high[todo], low[todo], level, words)
            word = self.start[level] + at // 64
            bit = (at % 64).astype(np.uint64)
            mine = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[mine]] = (self.rank[word] + np.bitwise_count(below))[mine]
            todo = todo[~mine]
        for k, (h, v) in enumerate(self.left):
            out[todo[(high[todo] == h) & (low[todo] == v)]] = self.rank[-1] + k
        return out


_SHARD = "shard int, levels binary, bits binary, rest binary, fingerprints binary, counts binary, least binary"


def _build_shard(table: pa.Table) -> pa.Table:
    high, low = (table[c].to_numpy().view(np.uint64) for c in ("high", "low"))
    order = PerfectHash.build(high, low)
    at = order.index(high, low)
    prints, counts, least = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint8), np.zeros(len(at), np.int64)
    prints[at] = (low >> np.uint64(32)).astype(np.uint32)
    counts[at] = np.minimum(table["n"].to_numpy(), 255)
    least[at] = table["least"].to_numpy()
    arrays = [order.sizes, order.bits, order.left, prints, counts, least]
    names = ["levels", "bits", "rest", "fingerprints", "counts", "least"]
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(names, arrays, strict=True)})


def _probe(arrays: pa.Table, probes: pa.Table) -> pa.Table:
    """(doc_id, tie, key) of the lines to drop."""
    if arrays.num_rows == 0 or probes.num_rows == 0:
        return pa.table({"doc_id": pa.array([], pa.int64()), "tie": pa.array([], pa.int64()), "key": pa.array([], pa.binary())})
    read = lambda c, t: np.frombuffer(arrays[c][0].as_py(), dtype=t)
    order = PerfectHash(read("levels", np.int64), read("bits", np.uint64), read("rest", np.uint64).reshape(-1, 2))
    prints, counts, least = read("fingerprints", np.uint32), read("counts", np.uint8), read("least", np.int64)
    ids = probes["doc_id"].to_numpy()
    high, low = (probes[c].to_numpy().view(np.uint64) for c in ("high", "low"))
    at = order.index(high, low)
    known = at >= 0
    at = np.maximum(at, 0)
    known &= prints[at] == (low >> np.uint64(32)).astype(np.uint32)
    drop = np.flatnonzero(known & (counts[at] >= 2) & (least[at] < ids))
    keys = np.stack([high[drop], low[drop]], axis=1).astype("<u8").tobytes()
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(drop), [None, pa.py_buffer(keys)]).cast(pa.binary())
    return pa.table({"doc_id": pa.array(ids[drop]), "tie": probes["tie"].take(pa.array(drop)), "key": keys})


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, keys): the key hashes of the lines that each document of docs (doc_id, text, tie) loses.

    ``tie``, a hash of the text, parts the rows of a doc_id that very many share, null above all.
    """
    lines = stored(map_batches(docs, _line_keys, "high long, low long, doc_id long, tie long"), "line-keys")
    shards = max(1, -(-lines.count() // SHARD_KEYS))
    shard = F.pmod(F.shiftrightunsigned("high", 20), F.lit(shards)).cast("int").alias("shard")
    distinct = lines.groupBy("high", "low").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).select(shard, "high", "low", "n", "least")
    arrays = stored(distinct.groupBy("shard").applyInArrow(_build_shard, _SHARD), "line-arrays")
    probed = lines.select(shard, "high", "low", "doc_id", "tie")
    chunks = stored(probed.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_PROBES).cast("int").alias("chunks")), "line-chunks")
    left = arrays.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = probed.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.col("chunks")).cast("int")).drop("chunks")
    dropped = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(_probe, "doc_id long, tie long, key binary")
    found = stored(dropped.groupBy("doc_id", "tie").agg(F.collect_set("key").alias("keys")), "lines-dropped")
    for table in (lines, arrays, chunks):
        discard(table)
    return found


def _without(raw: bytes | None, keys: list[bytes] | None) -> tuple[bytes, int, int]:
    """The text that stays, and how many lines there were and went."""
    raw = raw or b""
    if not keys:
        return raw, raw.count(b"\n") + 1, 0
    gone = set(keys)
    lines = raw.split(b"\n")
    kept = [x for x in lines if line_key(x) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _with_keys(docs: DataFrame, doc_id: str, text: str, key_name: str, id_name: str, tie_name: str) -> DataFrame:
    """docs, each with the keys of the lines that it loses."""
    own, tie = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)), F.xxhash64(text)
    found = repeated_lines(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), tie.alias("tie")))
    found = found.select(F.col("doc_id").alias(id_name), F.col("tie").alias(tie_name), F.col("keys").alias(key_name))
    return docs.join(found, (own == F.col(id_name)) & (tie == F.col(tie_name)), "left").drop(id_name, tie_name)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_without(t.as_py(), k.as_py()) for t, k in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True)]
            sums = [hashlib.sha256(x[0]).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(_with_keys(rows, "doc_id", "text", "keys", "own_id", "own_tie"), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the text that stays; ``n_chars``, where there is such a column, counts its code points. No row goes."""
    keys, own, tie = free_names(docs, "keys", "own_id", "own_tie")
    names = docs.columns
    at = names.index(text)
    count_at = names.index(n_chars) if n_chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            texts = [None if not t.is_valid else _without(t.as_py(), k.as_py())[0].decode() for t, k in zip(columns[at].cast(pa.large_binary()), columns[-1], strict=True)]
            if count_at is not None:
                columns[count_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[count_at].type)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns[:-1], names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return map_batches(_with_keys(docs, doc_id, text, keys, own, tie), run, schema)
