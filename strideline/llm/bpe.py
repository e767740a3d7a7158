"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut into pieces by the vocabulary's pattern; a piece's ids are found by
holding its part boundaries and the rank of each two adjacent parts in two short
arrays, and again and again scanning for the least rank, deleting that boundary
and refreshing the two neighbouring ranks.  Pieces of over ``SHORT`` bytes, where
scanning would take quadratic time, keep the ranks in a heap instead; both give
the same merges in the same order.  Pieces met before are looked up.

Defined results: a null text encodes as an empty one; an added token's string in
a text is that token, as the tokenizers library has it; repeated rows give the
same result each; an empty table gives an empty one; a text of any length is encoded
whole.  Files with settings that are not followed are an error (``supported``).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.scratch import map_batches

SHORT = 128
#: Pieces that a worker remembers, and the characters of the longest of them. It lives on in the workers
#: that a later stage shares, and a piece forgotten is only encoded anew.
CACHE_PIECES, CACHE_CHARS = 250_000, 48

#: What counts as white space in the vocabulary's pattern, as the inside of a character class.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_WHITE_SPACE = r"\t-\r \x85\xa0"


def _category(first: str, end: int) -> str:
    """Inside of a character class: the code points below ``end`` whose general category starts with ``first``."""
    out, start = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == first
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=2)
def piece_pattern(latin: bool = False) -> re.Pattern:
    """The pattern that cuts a text into pieces: contractions, words, numbers, signs, each with a blank before it, and white space.

    With ``latin`` it knows the code points below 256 only, which makes it several times as fast.
    """
    end = 256 if latin else sys.maxunicode + 1
    letter, number, blank = _category("L", end), _category("N", end), LATIN_WHITE_SPACE if latin else WHITE_SPACE
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


def pieces(text: str) -> list[str]:
    """The pieces of a text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return piece_pattern().findall(text)
    return piece_pattern(latin=True).findall(text)


def byte_symbols() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def supported(path: str) -> dict:
    """A tokenizer file's contents; a ValueError if it has settings that this module does not follow.

    Followed are byte-level BPE files without a normalizer, with the byte-level cutting
    pattern and no blank put before a text, whose added tokens stand for themselves only.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain_added = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])
    checks = {
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "normalizer": spec.get("normalizer") is None,
        "pre_tokenizer": cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True),
        "decoder": (spec.get("decoder") or {}).get("type") == "ByteLevel",
        "added_tokens": plain_added,
    }
    wrong = [k for k, fine in checks.items() if not fine]
    if wrong:
        raise ValueError(f"{path}: settings of {', '.join(wrong)} are not supported")
    return spec


class Vocabulary:
    """Merge ranks, token bytes and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        spec = supported(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        back = {c: b for b, c in byte_symbols().items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.base = self.size + 1
        self.byte_id = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.rank = {vocab[a] * self.base + vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > SHORT:
            return self._encode_long(ids)
        get, base, none = self.rank.get, self.base, len(self.merged)
        ranks = [get(a * base + b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [self.merged[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] * base + ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] * base + ids[i], none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap of (rank, place) with links between the parts left."""
        n, get, base = len(ids), self.rank.get, self.base
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] * base + ids[j]) != r:
                continue  # a part of this pair has gone meanwhile
            ids[i], ids[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] * base + ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] * base + ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


class PieceMemory(dict):
    """Ids of pieces met, as little-endian unsigned 32-bit integers; a new piece is encoded when it is first asked for.

    Holds ``most`` at most: the older half goes when it is full.
    """

    def __init__(self, encode_piece: Callable[[str], list[int]], most: int = CACHE_PIECES):
        super().__init__()
        self.encode_piece, self.most = encode_piece, most

    def __missing__(self, piece: str) -> bytes:
        ids = struct.pack("<%dI" % len(found := self.encode_piece(piece)), *found)
        if len(piece) <= CACHE_CHARS:
            self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        """Remember a piece."""
        if len(self) >= self.most:
            for old in list(islice(self, self.most // 2)):
                del self[old]
        self[piece] = ids


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers; ``encode_piece`` gives the ids of one piece."""

    def __init__(self, encode_piece: Callable[[str], list[int]], added: dict[str, int], most: int = CACHE_PIECES):
        self.memory = PieceMemory(encode_piece, most)
        self.added = added
        self.splitter = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

    def parts(self, text: str) -> list[tuple[bytes | None, list[str]]]:
        """The text cut into added tokens, given by their id, and runs of pieces between them."""
        if self.splitter is None or not any(t in text for t in self.added):
            return [(None, pieces(text))]
        return [(self.added[p].to_bytes(4, "little"), []) if i % 2 else (None, pieces(p)) for i, p in enumerate(self.splitter.split(text))]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        return b"".join([known if known is not None else b"".join(map(self.memory.__getitem__, p)) for known, p in self.parts(text)])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """An encoder by rank arrays, kept with its memory for the life of a worker."""
    v = vocabulary(path)
    return Encoder(lambda piece: v.encode_piece(piece.encode()), v.added)


def decode(ids: bytes, v: Vocabulary) -> str:
    """Text of little-endian ids; bytes that are no UTF-8 read as U+FFFD."""
    table = v.token_bytes
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, v = encoder(path), vocabulary(path)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for text in batch.column(1):
                ids = enc.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, v).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(enc.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(rows, run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [decode(np.asarray(x.as_py() or [], dtype="<u4").tobytes(), v) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(ids.select("doc_id", "ids"), run, "doc_id long, text string")
