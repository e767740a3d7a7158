"""Secrets in texts: fixed patterns, and strings that pass for random.

Base spans come from three patterns.  The method adds spans of kind ``random``:
runs of at least ``MIN_LENGTH`` characters whose make-up implies an encoding (hex,
base 32, digits with letters of one or both cases, letters of both cases, base 64).
Each is tested against the hypothesis that its characters are drawn evenly and
independently from that encoding's alphabet:

* chi-squared of the character counts (Wilson-Hilferty to a normal score),
* the number of runs above and below the alphabet's middle,
* the serial correlation of neighbouring characters,

and the least of the three p-values, combined as that of three independent tests, is
the string's: about even between 0 and 1 if the string is random, near 0 if it is not.

What is reported is controlled: of the strings with p >= t in a family, as many are
expected to be random as the family holds random ones, times 1 - t.  How many it holds
is estimated from those with p >= ``EVEN``, where ordinary strings seldom get.  The
least t is taken at which the rest, the ordinary strings, are at most a share ``RATE`` of
the reported; fewer than 1 / ``RATE`` strings cannot show so low a share, and are not reported.
Each band of lengths is a family of its own over the whole corpus, as short strings give the tests
little to go on.  A string that overlaps a base span is not tested, so the share holds among
the spans that the method adds.

Not tested are strings of lower-case letters, or of capitals, alone: at these lengths
the tests cannot tell a long word from random letters.

Everything is a column expression.  One pass writes the few spans and scores of
each document; the families' counts come from that slim table.

Defined results: a null text is an empty one and has no spans; repeated rows are
judged each for itself and counted each in its family; strings of equal p are all
reported or none is; an empty table gives an empty one; a text of any length is one row's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.scratch import stored

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base spans and the least length of what they must find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{16,}"
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
MIN_LENGTH = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
BANDS = (32, 64, 128)
RATE, EVEN = 0.05, 0.5
#: p-values are counted in steps of a hundredth of a power of ten, up to this many.
STEPS = 4000

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried: pattern that the whole string fits, alphabet.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _UPPER),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z]+$", _UPPER + _LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)

_SPAN = "array<struct<s: int, k: int, e: int>>"
_SCORED = "array<struct<s: int, e: int, word: string>>"


def _found(text: Column, pattern: str, hint: Column, kind: int, passes) -> Column:
    """Spans (s, k, e) in code points of all matches, left to right, that pass. ``hint`` tells cheaply where there is none."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(pieces, hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("own"), F.coalesce(passes(h), F.lit(False)).alias("ok")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(x["own"], F.lit(0))
        span = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(x["ok"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(hint, F.aggregate(lengths, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _candidates(text: Column) -> Column:
    """(s, e, word) of the strings that imply an encoding."""
    pieces, hits = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    parts = F.zip_with(pieces, hits, lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("word")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SCORED).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(F.length(x["word"]), F.lit(0))
        mixed = F.coalesce(x["word"].rlike("[0-9A-Z]") & x["word"].rlike("[0-9a-z]") & x["word"].rlike("[A-Za-z]"), F.lit(False))
        item = F.array(F.struct(s.alias("s"), e.alias("e"), x["word"].alias("word")))
        return F.struct(e.alias("at"), F.when(mixed, F.concat(acc["out"], item)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(CANDIDATE), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SCORED))


def _alphabet(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, letters in reversed(ENCODINGS):
        out = F.when(word.rlike(pattern), letters).otherwise(out)
    return out


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal at z >= 0 (the classical rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) / 2.5066282746310002 * poly, F.lit(1e-40))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def p_value(word: Column, alphabet: Column) -> Column:
    """The battery's p-value of a string under even, independent draws from ``alphabet``."""
    size = F.length(alphabet).cast("double")
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double"))

    def battery(x: Column) -> Column:
        n = F.size(x).cast("double")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
        chi = squares * size / n - n
        spread = 2 / (9 * (size - 1))
        z_chi = (F.pow(chi / (size - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        p_chi = F.when(z_chi >= 0, _tail(z_chi)).otherwise(1 - _tail(-z_chi))

        high = F.transform(x, lambda v: F.when(v * 2 >= size, 1.0).otherwise(0.0))
        ones = F.aggregate(high, F.lit(0.0), lambda a, v: a + v)
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + F.when((q["a"] * 2 >= size) == (q["b"] * 2 >= size), 0.0).otherwise(1.0))
        both = 2 * ones * (n - ones)
        var = both * (both - n) / (n * n * (n - 1))
        p_runs = F.when((ones == 0) | (ones == n), F.pow(F.lit(0.5), n - 1)).when(var <= 0, 1.0).otherwise(2 * _tail(F.abs(runs - 1 - both / n) / F.sqrt(F.greatest(var, F.lit(1e-12)))))

        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + (q["a"] - mean) * (q["b"] - mean))
        p_serial = F.when(total <= 0, F.lit(1e-40)).otherwise(2 * _tail(F.abs(lagged / F.greatest(total, F.lit(1e-12)) + 1 / n) * F.sqrt(n)))
        least = F.least(F.lit(1.0), p_chi, p_runs, p_serial)
        return F.when(least < 1e-6, 3 * least).otherwise(1 - F.pow(1 - least, F.lit(3.0)))

    return _let(codes, battery)


def _band(length: Column) -> Column:
    out = F.lit(0)
    for i, b in enumerate(BANDS):
        out = F.when(length >= b, i + 1).otherwise(out)
    return out


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and scored spans of each document, before the corpus decides on the scored."""
    text = F.coalesce("text", F.lit(""))
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body"))
    body = F.col("body")
    assign = _found(body, ASSIGN, body.rlike("(?i:passw|secret|token|api_?key)"), 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= ASSIGN_VALUE)
    access = _found(body, ACCESS, F.contains(body, F.lit("AKIA")), 1, lambda h: F.length(h) >= ACCESS_LENGTH)
    hexes = _found(body, HEX, body.rlike(HEX), 2, lambda h: h.isNotNull())

    def scored(c: Column) -> Column:
        p = _let(_alphabet(c["word"]), lambda a: F.when(a.isNotNull(), p_value(c["word"], a)))
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), _band(F.length(c["word"])).alias("band"), p.alias("p"))

    raw = raw.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hexes"), F.transform(_candidates(body), scored).alias("scored"))
    step = lambda p: F.least(F.lit(STEPS), F.floor(-100 * F.log10(F.greatest(p, F.lit(1e-39))))).cast("int")
    clear = lambda c: ~F.exists(F.concat("assign", "access", "hexes"), lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"]))
    tested = F.transform(F.filter("scored", lambda c: c["p"].isNotNull() & clear(c)), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["band"].alias("band"), step(c["p"]).alias("step")))
    return raw.select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hexes").cast("long").alias("n_hex"), F.array_sort(F.concat("assign", "access", "hexes")).alias("base"), tested.alias("tested"))


def reported_steps(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each band the largest step, that is the least p-value, at which strings are reported; see the module's text.

    At most ``STEPS`` counts of each band come to the driver.
    """
    rows = found.select(F.explode("tested").alias("t")).groupBy("t.band", "t.step").agg(F.count("*").alias("n")).collect()
    out = {}
    for band in {r["band"] for r in rows}:
        counts = {r["step"]: r["n"] for r in rows if r["band"] == band}
        even = int(-100 * math.log10(EVEN))
        random = sum(n for s, n in counts.items() if s <= even) / (1 - 10 ** (-(even + 1) / 100))
        upto = 0
        for s in sorted(counts):
            upto += counts[s]
            # the step holds p-values above 10 ** (-(s + 1) / 100)
            if rate * upto >= 1 and upto - random * (1 - 10 ** (-(s + 1) / 100)) <= rate * upto:
                out[band] = s
    return out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, the three counts, and ``base`` and ``all`` spans (s, k, e) sorted by start and kind, of every document."""
    found = stored(spans(docs), "secret-spans")
    least = reported_steps(found, rate)

    def limit_of(c: Column) -> Column:
        out = F.lit(-1)
        for band, s in least.items():
            out = F.when(c["band"] == band, s).otherwise(out)
        return out

    more = F.transform(F.filter("tested", lambda c: c["step"] <= limit_of(c)), lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", more)).alias("all"))


def joined(spans_: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
