"""A binary token store: frequency-ranked ids in byte-aligned variable-length code.

Format of a store (a folder of Parquet files, so that any store Spark can write to
holds it):

* ``meta``: one row; ``ids`` lists the token ids, the most frequent first, as
  little-endian unsigned 32-bit integers.  A token's place in that list is its rank.
* ``blocks/shard=S``: rows ``start, doc_ids, counts, control, data``, whole documents
  in ascending (doc_id, text hash) order inside a shard and from shard to shard.
  ``start`` counts the ids of all documents before the block.  ``data`` holds the
  ranks of all the block's ids in 1 to 4 little-endian bytes each, ``control`` the
  byte counts less one, 2 bits each, four to a byte: Stream VByte.

Decoding looks the control bytes up in a table of four lengths each, sums them to
offsets and gathers unaligned 32-bit words, without a loop over ids.

Defined results: a null text is an empty one (one id, the end id); null doc_ids
come first; rows that repeat a doc_id follow each other; an empty table gives an empty
store; a text of any length is encoded whole.  A tokenizer file with settings that the
cutting into pieces does not follow is an error (see ``bpe.supported``).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm.bpe import CACHE_CHARS, Encoder, supported
from strideline.llm.cutting import parts, piece_starts
from strideline.llm.scratch import discard, map_batches, stored
from strideline.llm.textcore import slices, text_buffer

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
#: Bytes of ids that a worker gathers before it hands them on.
FLUSH_BYTES = 4 << 20

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = length - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of ``pack``."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    if n == 0:
        return np.zeros(0, np.uint32)
    begin = np.cumsum(length, dtype=np.int64) - length
    padded = data + b"\0\0\0"
    words = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    return words[begin] & _MASKS[length]


#: Pieces that a worker remembers while it writes a store.
STORE_PIECES = 700_000


#: New pieces that go through the library as one text, and bytes of text that are cut at a time.
JOINED, CUT_BYTES = 4096, 1 << 21


class LibraryEncoder(Encoder):
    """Texts to ids; each piece that is not remembered goes through the tokenizers library.

    The pieces of many texts are cut at once, and only the distinct ones among them are looked
    up.  New pieces that start with a blank and go on with another sign are cut again where they
    were cut before if they stand one after the other, so many of them are one text to the
    library; the lengths of its tokens in bytes part their ids again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        supported(path)
        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        self.library = library
        added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        # a byte-level token has one character for each byte
        tokens = library.get_vocab(with_added_tokens=True)
        self.token_length = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, i in tokens.items():
            self.token_length[i] = len(token)
        self.may_join = not any(" " in t for t in added)
        super().__init__(lambda piece: library.encode(piece, add_special_tokens=False).ids, added, STORE_PIECES)

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and the n + 1 offsets of each text's in them."""
        buf, at = text_buffer(column)
        ids, counts = [], [np.zeros(1, np.int64)]
        for i, j in slices(at, CUT_BYTES):
            raw = buf[at[i] : at[j]].tobytes()
            for found, n in self._encoded(raw, at[i : j + 1] - at[i]):
                ids.append(found)
                counts.append(n)
        return np.concatenate([*ids, np.zeros(0, "<u4")]), np.cumsum(np.concatenate(counts))

    def _encoded(self, raw: bytes, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of each text's) for runs of the texts that ``at`` cuts raw into."""
        if any(t.encode() in raw for t in self.added):
            for i, j in pairwise(at.tolist()):
                text = raw[i:j].decode()
                if any(t in text for t in self.added):
                    ids = np.frombuffer(self.encode(text), "<u4")
                    yield ids, np.array([len(ids)])
                else:
                    yield self._cut_and_encoded(raw[i:j], np.array([0, j - i]))
        else:
            yield self._cut_and_encoded(raw, at)

    def _cut_and_encoded(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens; a long one is cut in parts."""
        if len(at) > 2 or len(raw) <= CUT_BYTES:
            return self._pieces_encoded(raw, at)
        ids = np.concatenate([self._pieces_encoded(x, np.array([0, len(x)]))[0] for x in parts(raw, CUT_BYTES)])
        return ids, np.array([len(ids)])

    def _pieces_encoded(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = piece_starts(raw, at)
        if len(start) == 0:
            return np.zeros(0, "<u4"), np.zeros(len(at) - 1, np.int64)
        offsets = np.append(start, len(raw))
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        known = self._looked_up(pieces.dictionary.to_pylist())
        size = np.array([len(x) for x in known]) // 4
        begin, which = np.cumsum(size) - size, pieces.indices.to_numpy()
        size, begin = size[which], begin[which]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        ids = np.frombuffer(b"".join(known), "<u4")[place]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(start, at)])

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of some distinct pieces; what was not remembered is now."""
        memory = self.memory
        single, joined = [], []
        for p in filterfalse(memory.__contains__, pieces):
            if len(p) <= CACHE_CHARS:
                (joined if self.may_join and len(p) > 1 and p[0] == " " and not p[1].isspace() else single).append(p)
        fresh = {}
        for i in range(0, len(single), JOINED):
            group = single[i : i + JOINED]
            found = self.library.encode_batch_fast(group, add_special_tokens=False)
            fresh.update((p, struct.pack("<%dI" % len(ids := x.ids), *ids)) for p, x in zip(group, found, strict=True))
        for i in range(0, len(joined), JOINED):
            group = joined[i : i + JOINED]
            fresh.update(zip(group, self._encode_joined(group), strict=True))
        out = [fresh[p] if p in fresh else memory[p] for p in pieces] if fresh else [memory[p] for p in pieces]
        for p, ids in fresh.items():
            memory.keep(p, ids)
        return out

    def _encode_joined(self, group: list[str]) -> list[bytes]:
        """Ids of each of some pieces that are cut again when joined."""
        ids = np.array(self.library.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.token_length[ids])
        wanted = np.cumsum([len(p.encode()) for p in group])
        last = np.searchsorted(ends, wanted)
        if last[-1] != len(ids) - 1 or not np.array_equal(ends[last], wanted):
            raise ValueError("the tokenizers library cut joined pieces elsewhere")
        raw, at = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
        return [raw[x:y] for x, y in pairwise(at)]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """Encoder of a tokenizer file, kept with its memory for the life of a worker."""
    return LibraryEncoder(path)


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _counted(rows: list, kind: str, size: int) -> np.ndarray:
    return np.bincount(np.frombuffer(b"".join(raw for _, _, raw in rows), kind), minlength=size)


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, kind: str, size: int) -> DataFrame:
    """(shard, doc_id, local_start, ids) in ascending order; local_start counts the ids before in the shard, -1 marks a shard's token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, total = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=kind).tobytes()

        def out(rows: list) -> pa.RecordBatch:
            ids, starts, raw = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(raw, pa.binary())], names=["shard", "doc_id", "local_start", "ids"])

        count = np.zeros(size, np.int64)
        for batch in batches:
            rows, held = [], 0
            ids, at = enc.encode_texts(batch.column(1))
            whole, at = ids.astype(kind).tobytes(), (at * len(end)).tolist()
            for doc_id, i, j in zip(batch.column(0).to_pylist(), at, at[1:], strict=False):
                raw = whole[i:j] + end
                rows.append((doc_id, total, raw))
                total += len(raw) // len(end)
                held += len(raw)
                if held >= FLUSH_BYTES:
                    count += _counted(rows, kind, size)
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                count += _counted(rows, kind, size)
                yield out(rows)
        # one more row: how often the shard holds each token, deflated
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([zlib.compress(count.tobytes(), 1)], pa.binary())], names=["shard", "doc_id", "local_start", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("tie"))
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return map_batches(placed, run, "shard int, doc_id long, local_start long, ids binary")


def _ranking(ids: DataFrame, size: int) -> np.ndarray:
    """All ids, the most frequent first. At most one row per token of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(raw), np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["token", "n"])

    rows = map_batches(ids.where("local_start < 0").select("ids"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(size, np.int64)
    for r in rows:
        count[r["token"]] = r["n"]
    return np.lexsort((np.arange(size), -count)).astype(np.uint32)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every document of docs (doc_id, text), append ``end_id`` and write a store at ``path``."""
    spark = docs.sparkSession
    size = max(vocabulary_size(tokenizer), end_id + 1)
    kind = _id_type(size)
    counted = stored(_tokenised(docs, tokenizer, end_id, kind, size), "token-ids", "zstd")
    order = _ranking(counted, size)
    ids = counted.where("local_start >= 0")
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    # one number for each shard, as many as the tasks that wrote them
    totals = dict(ids.groupBy("shard").agg(F.sum(F.octet_length("ids")).alias("n")).collect())
    base, before = {}, 0
    for s in sorted(totals):
        base[s] = before
        before += totals[s] // np.dtype(kind).itemsize

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, np.ndarray]] = []
        shard, n = None, 0

        def out() -> pa.RecordBatch:
            control, data = pack(rank[np.concatenate([x[2] for x in held])])
            columns = [pa.array([base[shard] + held[0][1]], pa.int64()), pa.array([[x[0] for x in held]], pa.list_(pa.int64())), pa.array([[len(x[2]) for x in held]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary()), pa.array([shard], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["start", "doc_ids", "counts", "control", "data", "shard"])

        for batch in batches:
            for s, doc_id, start, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (s != shard or n >= BLOCK_IDS):
                    yield out()
                    held, n = [], 0
                shard = s
                held.append((doc_id, start, np.frombuffer(raw, kind)))
                n += len(held[-1][2])
        if held:
            yield out()

    packed = map_batches(ids, blocks, "start long, doc_ids array<long>, counts array<long>, control binary, data binary, shard int")
    packed.write.option("compression", "none").partitionBy("shard").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(order.astype("<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/meta")
    discard(counted)


def _documents(spark: SparkSession, path: str, schema: str, row: callable, names: list[str]) -> DataFrame:
    """``row`` of (start, ids) for each document of a store."""
    order = np.frombuffer(bytes(spark.read.schema("ids binary").parquet(f"{path}/meta").first()[0]), "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, counts, control, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = order[unpack(control, data, sum(counts))]
                ends = np.cumsum(counts).tolist()
                rows = [row(start + e - c, ids[e - c : e]) for e, c in zip(ends, counts, strict=True)]
                columns = [list(x) for x in zip(*rows, strict=True)]
                kinds = {"start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(c, kinds[n]) for c, n in zip(columns, names, strict=True))], names=["doc_id", *names])

    stored_blocks = spark.read.schema("start long, doc_ids array<long>, counts array<long>, control binary, data binary").parquet(f"{path}/blocks")
    return map_batches(stored_blocks.select("start", "doc_ids", "counts", "control", "data"), run, schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document of a store."""
    return _documents(spark, path, "doc_id long, start long, n_tokens long, ids array<long>", lambda s, ids: (s, len(ids), ids.astype(np.int64)), ["start", "n_tokens", "ids"])


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a store."""
    return _documents(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda s, ids: (s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), ["start", "n_tokens", "ids_crc32"])
