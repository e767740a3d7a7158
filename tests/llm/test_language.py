"""Language-model scores and periodic runs against plain versions, and on odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strideline.llm import lm_score, queries, runs

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(1, "A b a B c", "x"), (2, None, None), (3, "", "x"), (4, " \t\n", "x"), (None, "a b of a null id", "x"), (5, "b a", "x"), (5, "b a", "x"), (6, "never seen wörds 中文 x a", "x"), (7, "k " * 3000 + "end", "x"), (8, "unique" + "z" * 70000 + " a b", "x"), (12, "a b a b", "x"), (15, "q q q q never", "x")]


def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, row string").withColumn("held_out", F.lit(3)).withColumn("score", F.lit("x")).withColumn("runs", F.lit(1)).withColumn("key", F.lit(1))


# --- 11 language model

def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + [None]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base) of each row and the counts of tokens and pairs."""
    one, two = collections.Counter(), collections.Counter()
    for doc_id, text in rows:
        if not out(doc_id):
            t = tokens(text)
            one.update(t)
            two.update(zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    got = []
    for doc_id, text in rows:
        t = tokens(text)
        got.append((doc_id, out(doc_id), len(t), sum(x in one for x in t), n, sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)))
    return got, one, two


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def model_score(text, one, two, n, v):
    def middle(c):
        level = c.bit_length()
        return (2 ** (level - 1) + 2**level - 1) / 2 if level else 0

    total, last = 0.0, None
    for x in tokens(text):
        alone = min((middle(one[x]) + 0.5) / (n + 0.5 * (v + 1)), 1)
        both = middle(two[last, x])
        total += math.log10((both + lm_score.MU * alone) / (max(middle(one[last]), both) + lm_score.MU))
        last = x
    return total


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 2000, "broadcast_bytes": 0, "head": 20}, {"shard_bytes": 5000, "head": 0}])
def test_scores_equal_plain_ones(spark, limits):
    sf = "/root/testdata/sf0.001"
    docs = queries.read_table(spark, sf, "documents")
    got = [tuple(r) for r in lm_score.score_documents(docs, **limits).collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want, one, two = plain(rows)
    for g, w in zip(ordered(got), ordered(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
    texts, n, v = dict(rows), sum(one.values()), len(one)
    scores = {r[0]: r[6] for r in got}
    wanted = {k: model_score(t, one, two, n, v) for k, t in texts.items()}
    # a false probe raises a count now and then, and with it a probability
    assert np.mean([abs(scores[k] - wanted[k]) <= 0.01 * abs(wanted[k]) + 1e-9 for k in texts]) > 0.9
    # one false probe moves a score by log10(N) at most; some three in a hundred n-grams have one
    assert all(abs(scores[k] - wanted[k]) <= math.log10(n) * (2 + 0.06 * len(tokens(t))) for k, t in texts.items())
    assert sum(scores.values()) > sum(r[5] for r in got)  # the model knows more than single words


def test_both_ways_give_one_score_and_reruns_agree(spark):
    docs = odd(spark)
    first, again, sharded = (sorted(map(tuple, lm_score.score_documents(docs, **k).collect()), key=str) for k in ({}, {}, {"broadcast_bytes": 0, "shard_bytes": 4000}))
    assert first == again
    # the number of shards does not change exact columns; scores differ by false probes at most
    assert [r[:5] for r in first] == [r[:5] for r in sharded]
    model = lm_score.fit(docs.where(~lm_score.held_out(F.col("doc_id"))), 4000)
    one = lm_score.score_texts(docs, model).toPandas()["score"].sort_values().to_numpy()
    other = lm_score.score_texts(docs, model, broadcast_bytes=0, head=2).toPandas()["score"].sort_values().to_numpy()
    assert np.allclose(one, other)


def bytes_moved(spark):
    """Bytes that stages have shuffled or written so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))


def test_a_filter_in_shards_moves_few_bytes(spark):
    """Not a row for each pair of each document, which is stored and joined three times."""
    path = "/root/testdata/sf0.01/documents.parquet"
    before = bytes_moved(spark)
    assert lm_score.score_documents(spark.read.parquet(path), shard_bytes=1 << 19, broadcast_bytes=0).count() == 1000
    assert 1 < (bytes_moved(spark) - before) / os.path.getsize(path) < 9


def test_keys_go_packed_and_come_back():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    keys = np.concatenate([np.unique(lm_score.pair_keys(tokens[:-1], tokens[1:])), np.unique(lm_score.word_keys(tokens))])
    n = rng.zipf(1.5, len(keys)).astype(np.int64) % 2**40 + 1
    for number in (1, 7, 70000):
        shards, columns = lm_score._blocks(keys, number, n)
        got = {}
        for i, shard in enumerate(shards.to_pylist()):
            for kind in (0, 1):
                back = lm_score._unpacked_keys(columns[2 * kind][i].as_py(), number, shard, np.uint64(kind))
                got |= zip(back.tolist(), lm_score._unpacked(columns[2 * kind + 1][i].as_py()).tolist(), strict=True)
        assert got == dict(zip(keys.tolist(), n.tolist(), strict=True))
    extremes = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (lm_score._unpacked(lm_score._packed(extremes)) == extremes).all() and len(lm_score._unpacked(lm_score._packed(extremes[:0]))) == 0


def test_odd_rows_are_scored(spark):
    got = [tuple(r) for r in lm_score.score_documents(odd(spark)).collect()]
    want, _, _ = plain([(r[0], r[1]) for r in ROWS])
    assert [g[:5] for g in ordered(got)] == [w[:5] for w in ordered(want)]
    assert [g[5] for g in ordered(got)] == pytest.approx([w[5] for w in ordered(want)])
    assert all(g[6] <= 0 for g in got)


def test_scores_without_training_and_without_rows(spark):
    assert lm_score.score_documents(spark.createDataFrame([], DOC)).count() == 0
    held = next(i for i in range(100) if out(i))
    for limits in ({}, {"broadcast_bytes": -1}):
        row = lm_score.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), **limits).collect()
        assert [tuple(r)[:6] for r in row] == [(held, True, 3, 0, 0, 0.0)]


def test_filter_never_reads_low_and_seldom_high():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(1, 2**62, 50000, dtype=np.uint64)), None
    counts = np.minimum(rng.zipf(1.6, len(keys)), 10**6).astype(np.int64)
    bits = lm_score._build(keys, counts)
    found = lm_score.LogFrequencyFilter(np.array([0, len(bits)]), bits)
    got, true = found.levels(keys), lm_score.levels_of(counts)
    assert (got >= true).all() and (got > true).mean() < 0.03
    strangers = rng.integers(1, 2**62, 50000, dtype=np.uint64)
    assert (found.levels(strangers) > 0).mean() < 0.03
    assert lm_score.levels_of(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_frequent_counts_survive_many_buffers(monkeypatch):
    monkeypatch.setattr(lm_score, "BUFFER", 64)
    monkeypatch.setattr(lm_score, "KEPT", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30)) for _ in range(40)]
    got = collections.Counter()
    for batch in lm_score._count(pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2])], names=["text"]) for i in range(0, 40, 2)):
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got[k] += n
    _, one, two = plain([(None, t) for t in texts])
    assert sorted(got.values()) == sorted([*one.values(), *two.values()])


# --- 12 periodic runs

def brute(words):
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=6), st.integers(1, 5))
def test_runs_equal_brute_force(base, times, tail, again):
    words = (base[: 1 + len(base) // 4] * times + tail) * again + base
    assert runs.periodic_runs(words) == brute(words)


def test_runs_of_words_and_powers():
    fib = ["a", "b"]
    one, two = ["a"], ["a", "b"]
    for _ in range(12):
        one, two = two, two + one
    for words in (two, ["x"] * 5000, ["x"] * 5, ["a", "b"] * 3, ["a", "b"] * 4, fib, [], ["a", "b", "c"] * 4 + ["a"] * 7):
        assert runs.periodic_runs(words) == brute(words)
    long = [str(i % 700) for i in range(20000)]
    assert runs.periodic_runs(long) == [(0, 20000, 700)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50))
def test_factors_are_the_longest_that_began_before(s):
    at = 0
    for low, high, source in runs.factors(s):
        assert low == at
        if source < 0:
            assert high == low + 1 and s[low] not in s[:low]
        else:
            assert source < low and s[source : source + high - low] == s[low:high]
            assert high == len(s) or not any(s[i : i + high - low + 1] == s[low : high + 1] for i in range(low))
        at = high
    assert at == len(s)


def plain_runs(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = min(((a - b, a, q) for a, b, q in found), default=None)
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *longest, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_equals_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.read_table(spark, sf, "documents")
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, sf).collect()))
    want = sorted(plain_runs(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert got == want and sum(r[1] for r in got) > 10


def test_runs_of_odd_rows(spark):
    docs = odd(spark)
    got = sorted(map(tuple, runs.digests(runs.text_runs(docs, queries.rewritten)).collect()), key=str)
    assert got == sorted((plain_runs(r[0], r[1]) for r in ROWS), key=str)
    assert runs.text_runs(spark.createDataFrame([], DOC)).count() == 0
    texts = {r.doc_id: r.collapsed for r in runs.text_runs(docs).collect()}
    assert texts[7] == "k end" and texts[2] == ""
