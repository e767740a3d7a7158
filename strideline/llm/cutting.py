"""The byte-level cutting pattern over whole buffers of text, without a Python object per piece.

``bpe.piece_pattern`` cuts a text one match at a time.  Here the class of every code
point is looked up and the same pieces follow from where the class changes:

* a run of letters, of numbers or of other signs is a piece, with the blank before it;
* white space before such a run gives its last character to it if that is a blank, and is
  a piece of its own else; white space at the end of a text is one piece;
* an apostrophe that starts a piece takes the letters of a contraction with it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from strideline.llm.bpe import WHITE_SPACE

BLANK, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Planes 4 to 16 of Unicode have neither letters nor numbers.
LETTERS_END = 0x40000
_APOSTROPHE, _SPACE = ord("'"), ord(" ")
#: A place where a text may be parted without changing its pieces: before white space that follows a visible sign.
_SEAM = re.compile(rb"[!-~](?=[ \n])")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    out[:LETTERS_END] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LETTERS_END)), np.uint8, LETTERS_END)
    white = re.findall(f"[{WHITE_SPACE}]", "".join(map(chr, range(0x3100))))
    out[[ord(c) for c in white]] = BLANK
    return out


def _after(points: np.ndarray, at: np.ndarray, letters: str) -> np.ndarray:
    """Whether ``letters`` follow each place; ``points`` has room behind its end."""
    out = np.ones(len(at), bool)
    for k, letter in enumerate(letters):
        out &= points[at + 1 + k] == ord(letter)
    return out


def piece_starts(raw: bytes, text_at: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of some texts start; the texts are ``raw`` cut at the n + 1 offsets ``text_at``."""
    if not raw:
        return np.zeros(0, np.int64)
    points = np.frombuffer(raw.decode().encode("utf-32-le") + b"\0" * 16, "<u4")
    n = len(points) - 4
    byte_at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if n < len(raw) else None
    heads = text_at[:-1][np.diff(text_at) > 0]
    heads = heads if byte_at is None else np.searchsorted(byte_at, heads)
    kind = _classes()[points[:n]]
    start = np.ones(n + 4, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[heads] = True
    head = np.zeros(n + 4, bool)
    head[heads] = True
    head[n:] = True
    # white space before a run
    run = np.flatnonzero(start[1:n] & (kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~head[1:n]) + 1
    start[run - 1] = True
    start[run] = points[run - 1] != _SPACE
    # contractions
    quote = np.flatnonzero((points[:n] == _APOSTROPHE) & start[:n])
    quote = quote[~head[quote + 1]]
    for letters in ("s", "t", "m", "d", "re", "ve", "ll"):
        at = quote[_after(points, quote, letters)]
        at = at[~head[at + len(letters)]]
        for k in range(len(letters)):
            start[at + 1 + k] = False
        start[at + 1 + len(letters)] = True
    at = np.flatnonzero(start[:n])
    return at if byte_at is None else byte_at[at]


def parts(raw: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes that have the pieces of the whole."""
    at = 0
    while len(raw) - at > limit:
        seam = _SEAM.search(raw, at + limit)
        if seam is None:
            break
        yield raw[at : seam.end()]
        at = seam.end()
    yield raw[at:]
