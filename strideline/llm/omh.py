"""Order MinHash sketches and banded alignment in numpy, without Spark.

An Order MinHash draws, for each of ``m`` hash functions, the ``ell`` k-mers of
smallest hash among the document's occurrence-labelled k-mers and keeps them in
text order.  Two documents share such an entry only if they share those k-mers
*and* their order, which ties the collision probability to edit similarity
rather than to set overlap alone.  Copies whose blocks have moved seldom share one,
so the ``few`` smallest k-mers of each hash function give an entry without order too.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from strideline.llm.textcore import GOLDEN, mix64

#: Expected number of k-mers below the cut that is tried before all of a document's k-mers are looked at.
CUT = 24


def _multipliers(m: int) -> np.ndarray:
    return mix64(np.arange(1, m + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def sketch(labels: np.ndarray, at: np.ndarray, m: int, ell: int, few: int) -> np.ndarray:
    """(documents, 2 * m) sketch values, first those in text order, then those without order; a row of a document without k-mers is 0.

    A document of fewer than ``ell`` (or ``few``, at most ``ell``) k-mers is represented by all of them.
    """
    sizes = np.diff(at)
    n = len(sizes)
    out = np.zeros((n, 2 * m), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some) == 0:
        return out
    doc = np.repeat(np.arange(n), sizes)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    share = np.minimum(1.0, CUT / np.maximum(sizes, 1))
    cut = np.where(share >= 1.0, most, (share * 2.0**64 * (1 - 2.0**-12)).astype(np.uint64))
    cut_by_kmer = cut[doc]
    for j, a in enumerate(_multipliers(m)):
        value = labels * a
        value ^= value >> np.uint64(32)
        low = np.flatnonzero(value <= cut_by_kmer)
        got = np.bincount(doc[low], minlength=n)
        short = np.flatnonzero(got < np.minimum(ell, sizes))
        if len(short):
            low = np.union1d(low, np.concatenate([np.arange(at[i], at[i + 1]) for i in short]))
        out[:, j], out[:, m + j] = _entries(value, labels, low, doc[low], n, ell, few)
    return out


def _entries(value: np.ndarray, labels: np.ndarray, low: np.ndarray, doc: np.ndarray, n: int, ell: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``ell`` smallest of each document's candidates, read in text order, and of the ``few`` smallest by size."""
    order = np.lexsort((value[low], doc))
    counts = np.bincount(doc, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    nth = np.arange(len(low)) - begin[doc]  # doc is ascending, so it is its own order after the sort
    return _hashed(np.sort(low[order[nth < ell]]), labels, np.minimum(counts, ell)), _hashed(low[order[nth < few]], labels, np.minimum(counts, few))


def _hashed(chosen: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each document's chosen k-mers as they stand; ``sizes`` of them a document."""
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros(len(sizes), np.uint64)
    for i in range(sizes.max(initial=0)):
        has = np.flatnonzero(sizes > i)
        out[has] = mix64((out[has] ^ labels[chosen[begin[has] + i]]) * GOLDEN + np.uint64(i + 1))
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float, order_a: np.ndarray | None = None) -> float:
    """Aligned k-mers of a and b over all their k-mers, 0.0 if that is below ``threshold``.

    a and b hold distinct labels in text order.  An alignment good enough leaves
    at most ``spare`` k-mers unmatched, so no matched pair of it lies more than
    ``spare`` off the diagonal: matches outside that band are dropped, and the
    longest increasing chain of the rest is the alignment.  If that falls short,
    whole blocks may have moved: matches are then cut, in the order of b, wherever
    they leave the band of ``BLOCK_BAND`` about the diagonal they were on, and each
    such block of at least ``BLOCK_KMERS`` aligned k-mers counts with its own chain.
    K-mers that are shared but neither on the chain nor in a block do not count.
    """
    na, nb = len(a), len(b)
    need = least_aligned(na, nb, threshold)
    if min(na, nb) < max(need, 1):
        return 0.0
    if order_a is None:
        order_a = np.argsort(a)
    at = np.searchsorted(a, b, sorter=order_a)
    at[at == na] = na - 1
    at = order_a[at]
    pos_b = np.flatnonzero(a[at] == b)
    if len(pos_b) < need:
        return 0.0
    pos_a = at[pos_b]
    chain = pos_a[np.abs(pos_a - pos_b) <= na + nb - 2 * need]
    best = _longest_chain(chain) if len(chain) >= need else 0
    if best < need:
        best = _in_blocks(pos_a, pos_b)
    return best / (na + nb - best) if best >= need else 0.0


#: Off-diagonal steps that stay inside a moved block, and aligned k-mers that make a block.
BLOCK_BAND, BLOCK_KMERS = 16, 8


def least_aligned(na: int, nb: int, threshold: float) -> int:
    """Aligned k-mers that two documents of na and nb need."""
    return int(np.ceil(threshold * (na + nb) / (1 + threshold) - 1e-9))


def _in_blocks(pos_a: np.ndarray, pos_b: np.ndarray) -> int:
    """Aligned k-mers of all blocks; each match is in one of them."""
    cut = 1 + np.flatnonzero(np.abs(np.diff(pos_a - pos_b)) > BLOCK_BAND)
    chains = [_longest_chain(x) for x in np.split(pos_a, cut) if len(x) >= BLOCK_KMERS]
    return sum(c for c in chains if c >= BLOCK_KMERS)


def _longest_chain(x: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if np.all(x[1:] > x[:-1]):
        return len(x)
    tails: list[int] = []
    for v in x.tolist():
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
        else:
            tails[k] = v
    return len(tails)
