"""URL verdicts from longest-match rules and an exact Bloom filter cascade.

The cascade answers membership in a list of hosts without a join.  Level 1 is a
Bloom filter of the listed keys; level 2 one of the keys of the corpus that
level 1 takes for listed by mistake; level 3 one of the listed keys that level 2
takes for such mistakes; and so on until a level makes no mistake on any key of
the corpus.  As the mistakes are counted over the corpus's complete key universe,
a key of the corpus is answered exactly: by the parity of the first level that
does not hold it.

Filters are literals in the plan.  Their size follows the *list*, not the corpus;
a list whose filters would pass ``MAX_BITS`` is dealt by hash to several
cascades of that size each, ``MOST_SHARDS`` at most (about 56 million keys), since a
plan must be shipped to every task; a longer list is an error.

Keys are domains, which stand for their subdomains too, and single pages (host and path).

Defined results: a null url and one without ``://`` have an empty host and path,
fit no rule and are on no list, so they are allowed; repeated rows are judged each
for itself; an empty table gives an empty one; urls of any length are read whole.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.scratch import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of one literal filter at most (1 MB).
MAX_BITS = 1 << 23
MOST_SHARDS = 64


class Rule(NamedTuple):
    """A rule fits its host and all subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        """The rule as it is written, host and path together."""
        return self.host + self.path


class Level(NamedTuple):
    """One Bloom filter: words of 64 bits, number of bits and of hashes."""

    words: list[int]
    bits: int
    hashes: int


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = _after_scheme(url)
    return F.translate(_until(rest, "/", "?", "#"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = _after_scheme(url)
    return _until(F.substring(rest, F.length(_until(rest, "/", "?", "#")) + 1, F.length(rest)), "?", "#")


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _until(text: Column, *stops: str) -> Column:
    for s in stops:
        text = F.substring_index(text, s, 1)
    return text


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def host_keys(host: Column, depth: int) -> Column:
    """The host and its parent domains, of ``depth`` labels at most, shortest first."""
    labels = F.split(host, r"\.")
    count = F.least(F.size(labels), F.lit(depth))
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(labels, -k, k), "."))


def _hash(key: Column, salt: int, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(size))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    one, two = _hash(key, 2 * level, bits), _hash(key, 2 * level + 1, bits)
    return [F.pmod(one + two * i, F.lit(bits)) for i in range(hashes)]


def _holds(key: Column, level: int, f: Level) -> Column:
    """Whether the filter holds the key."""
    if not any(f.words):
        return F.lit(False)
    words = F.split(F.lit(",".join(map(str, f.words))), ",").cast("array<bigint>")  # folded to one literal
    out = F.lit(True)
    for at in _positions(key, level, f.bits, f.hashes):
        word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
        out = out & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return out


def _filter_of(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """A Bloom filter of n distinct keys (key); its words are gathered, not the keys."""
    bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    at = F.explode(F.array(*_positions(F.col("key"), level, bits, min(hashes, 16))))
    word = F.shiftright("at", 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")
    rows = keys.select(at.alias("at")).groupBy(word).agg(F.bit_or(bit).alias("bits")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return Level(words, bits, min(hashes, 16))


class Cascade(NamedTuple):
    """Levels for each shard of the keys."""

    shards: list[list[Level]]

    def contains(self, key: Column, shard: int = 0) -> Column:
        """Whether a key of the universe is listed, as an expression."""
        levels = self.shards[shard]
        out = F.lit(len(levels) % 2 == 1)
        for i in reversed(range(len(levels))):
            out = F.when(_holds(key, i, levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return out

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed, whatever its shard."""
        out = self.contains(key)
        for s in range(1, len(self.shards)):
            out = F.when(self.shard_of(key) == s, self.contains(key, s)).otherwise(out)
        return out

    def shard_of(self, key: Column) -> Column:
        """The shard that answers for a key."""
        return _hash(key, 97, len(self.shards))


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 0.01, next_rate: float = 0.5) -> Cascade:
    """Cascade of the keys ``listed`` (key) that is exact on ``universe`` (key)."""
    listed = stored(listed.where("key is not null").distinct(), "listed")
    others = stored(universe.where("key is not null").distinct().join(listed, "key", "left_anti"), "unlisted")
    bits = -listed.count() * math.log(first_rate) / math.log(2) ** 2
    n_shards = max(1, math.ceil(bits / MAX_BITS))
    if n_shards > MOST_SHARDS:
        raise ValueError(f"a list of {n_shards} filters of {MAX_BITS} bits is too long for a plan; {MOST_SHARDS} are possible")
    shards = []
    for s in range(n_shards):
        mine = _hash(F.col("key"), 97, n_shards) == s
        inside, outside = listed.where(mine), others.where(mine)
        levels: list[Level] = []
        old: list[DataFrame] = []
        while (n := inside.count()) or not levels:
            levels.append(_filter_of(inside, len(levels), n, next_rate if levels else first_rate))
            wrong = stored(outside.where(_holds(F.col("key"), len(levels) - 1, levels[-1])), "wrong")
            old.append(wrong)
            inside, outside = wrong, inside
        for t in old:
            discard(t)
        shards.append(levels)
    discard(listed)
    discard(others)
    return Cascade(shards)


def split_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host and path of every page."""
    whole = F.coalesce(url, F.lit(""))
    return pages.select(F.col(page_id).alias("page_id"), host_of(whole).alias("host"), path_of(whole).alias("path"))


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame | list[str], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A rule decides where one fits; elsewhere a url is blocked if its host, one of the
    host's parent domains, or its host and path together is ``listed``, a list or the
    column ``key`` of a table.
    """
    rows = split_urls(pages, page_id, url)
    if isinstance(listed, list):
        listed = pages.sparkSession.createDataFrame([(k,) for k in sorted({k for k in listed if k})], "key string")
    # the host of a key is lower-cased, a path is as it is
    listed = listed.select(F.concat(F.translate(F.substring_index("key", "/", 1), UPPER, LOWER), F.substring(F.col("key"), F.length(F.substring_index("key", "/", 1)) + 1, F.length("key"))).alias("key"))
    depth = listed.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("n")).first()["n"] or 1
    keys = lambda: F.array_append(host_keys(F.col("host"), depth), F.concat("host", "path"))
    universe = rows.select("host", "path").distinct().select(F.explode(keys()).alias("key")).distinct()
    cascade = build_cascade(listed, universe)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    keyed = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    on_list = F.exists(keys(), cascade.lists)
    return keyed.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(on_list, "block").otherwise("allow")).alias("verdict"))
