"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are put in a fixed pseudo-random order and laid end to
end; the source's words are then cut into blocks of ``block_words``.  The mix is
a sequence of slots, each filled by one block.  Slot i has the point
``frac(i / golden ratio)``, kept as an integer of 31 bits; the point falls into
one source's interval of the cumulative weights, so that every stretch of the
mix holds the sources in about their shares.  The k-th slot of a source takes
the source's block ``k mod blocks``: when the blocks are used up, the next epoch
begins.  The last slot of a source is cut to the words still due.

All steps are DataFrame operations.  Running sums and ranks are taken in two
levels (totals of small groups, then inside each group), so that a source that
holds most rows is never one task's window.  Tables of one row per source are
joined without hints; the planner broadcasts them while they are small.

Defined results: a null source is a source, the last; a null or blank text has
size 0 and is never taken; with no word at all every target is 0; rows without a doc_id
are put in order by their text, rows that share one by size and text, and rows alike in
all of that share what they are taken; an empty table gives an empty mix; a text
of any length is one row's count.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.scratch import free_names, stored

WORD = r"[^\x20\x09-\x0D]+"
#: 2**31 and the odd number nearest to it over the golden ratio.
POINTS, STEP = 1 << 31, 1327217885
BIN_BITS = 19
BLOCK_WORDS = 256
#: Slots that are ranked together, and documents of a source that are summed together, on average.
SLOT_GROUP, DOCUMENT_GROUP = 1 << 16, 1 << 15


class Mix(NamedTuple):
    """documents: one row each with source, size, source_size, target and taken; schedule: (position, source, epoch, block, words) of each slot; sources: the plan."""

    documents: DataFrame
    schedule: DataFrame
    sources: DataFrame


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds sid, weight, target and quota to rows (source, source_size).

    Sources share the sum of all sizes by weight; a target stops at ``most``
    times its source's size and the excess goes to the others by weight, until
    none is above.  The level that the uncapped reach is found directly: sources
    are taken in the order of cap over weight, and the level is the largest of
    those that a source reaches without being capped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("sid", F.row_number().over(by_name))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * most)
    by_reach = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, everything = by_reach.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("level", left / share)
    level = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    out = out.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return out.select("sid", "source", "source_size", "weight", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def _laid_out(sized: DataFrame, plan: DataFrame, groups: int) -> DataFrame:
    """Adds the source's plan and ``begin``, the document's first word in its source's order."""
    # rows without an id are told apart by their text, so that they fall into many groups
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string"))))
    docs = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("place", key)
    digits = 1
    while 16**digits < groups:
        digits += 1
    docs = docs.withColumn("part", F.substring("place", 1, digits))
    parts = docs.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(Window.partitionBy("sid").orderBy("part")) - F.col("words")
    parts = parts.select("sid", "part", offset.alias("offset"))
    inside = Window.partitionBy("sid", "part").orderBy("place", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(parts, ["sid", "part"])
    return docs.withColumn("begin", F.col("offset") + F.col("inside")).drop("place", "part", "offset", "inside")


def _scheduled(plan: DataFrame, block_words: int) -> DataFrame:
    """(position, sid, k): which slot of which source stands at each position of the mix."""
    size, quota = F.col("source_size"), F.col("quota")
    blocks = F.ceil(size / block_words).cast("long")
    whole = F.when(size > 0, F.floor(quota / size)).otherwise(0).cast("long")
    slots = whole * blocks + F.ceil((quota - whole * size) / block_words).cast("long")
    plan = stored(plan.select("sid", slots.alias("slots")).where("slots > 0"), "slots")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    spark = plan.sparkSession
    upto = F.sum("slots").over(Window.orderBy("sid"))
    cut = lambda c: F.floor(c / F.lit(float(max(total, 1))) * POINTS).cast("long")
    ranges = plan.select("sid", "slots", cut(upto - F.col("slots")).alias("low"), cut(upto).alias("high")).where("low < high")
    binned = ranges.withColumn("bin", F.explode(F.sequence(F.shiftright("low", BIN_BITS), F.shiftright(F.col("high") - 1, BIN_BITS))))
    points = spark.range(total).select(F.col("id").alias("position"), F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * STEP, F.lit(POINTS)).alias("point"))
    points = points.withColumn("bin", F.shiftright("point", BIN_BITS))
    hit = points.join(binned, "bin").where("point >= low and point < high").select("position", "sid", "slots", F.floor(F.col("position") / SLOT_GROUP).alias("part"))
    parts = hit.groupBy("sid", "part").agg(F.count("*").alias("n"))
    parts = stored(parts.select("sid", "part", "n", (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("offset")), "slot-parts")
    rank = F.row_number().over(Window.partitionBy("sid", "part").orderBy("position"))
    hit = hit.withColumn("rank", rank).join(parts.drop("n"), ["sid", "part"]).select("position", "sid", "slots", (F.col("offset") + F.col("rank") - 1).alias("k"))
    hit = stored(hit, "slots-hit")
    # a few positions are beyond their source's last slot, as many as slots of other sources lack a position
    got = parts.groupBy("sid").agg(F.sum("n").alias("got"))
    lacking = plan.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    lacking = lacking.select("sid", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("k"))
    lacking = lacking.withColumn("turn", F.row_number().over(Window.orderBy("k", "sid")))
    over = hit.where("k >= slots").select("position", F.row_number().over(Window.orderBy("position")).alias("turn"))
    return hit.where("k < slots").select("position", "sid", "k").unionByName(over.join(lacking, "turn").select("position", "sid", "k"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS) -> Mix:
    """Mix the documents (doc_id, text, source) to the targets of ``plan_targets``."""
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    n = sized.count()
    plan = stored(plan_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "plan")
    laid = stored(_laid_out(sized, plan, -(-n // DOCUMENT_GROUP)), "laid-out")

    size = F.col("source_size")
    blocks = F.ceil(size / block_words).cast("long")
    slots = _scheduled(plan, block_words).join(plan, "sid")
    whole = F.floor(F.col("quota") / size).cast("long")
    block_size = F.least(F.lit(block_words), size - F.col("block") * block_words)
    due = F.col("quota") - F.col("epoch") * size - F.col("block") * block_words
    schedule = slots.withColumn("epoch", F.floor(F.col("k") / blocks).cast("long")).withColumn("block", F.pmod(F.col("k"), blocks))
    schedule = schedule.withColumn("words", F.when(F.col("epoch") < whole, block_size).otherwise(F.least(block_size, due)).cast("long"))
    schedule = stored(schedule.select("position", "sid", "source", "epoch", "block", "words"), "schedule")

    # how often each block is taken: to its end, or to some word in it
    uses = schedule.groupBy("sid", "block", "words").agg(F.count("*").alias("times"))
    some = laid.where("size > 0")
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    cut = some.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    from_, to = F.greatest("begin", F.col("block") * block_words), F.least(F.col("begin") + F.col("size"), F.col("block") * block_words + F.col("words"))
    part = cut.join(uses, ["sid", "block"]).select("sid", "begin", "doc_id", (F.col("times") * F.greatest(to - from_, F.lit(0))).alias("part"))
    # a document's place in its source is its identity: rows of equal doc_id stay apart
    taken = part.groupBy("sid", "begin").agg(F.sum("part").alias("taken"))
    some = some.join(taken, ["sid", "begin"], "left")
    out = some.unionByName(laid.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    documents = out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "tie")
    return Mix(documents, schedule.select("position", "source", "epoch", "block", "words"), plan)


def repeat_to_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, each row as often as the mix takes it whole: words taken over its words, rounded half up."""
    size, tie, copies, total, rows, nth, own_id, own_source, own_size, own_tie = free_names(docs, "size", "tie", "copies", "total", "rows", "nth", "own_id", "own_source", "own_size", "own_tie")
    mixed = mix_sources(docs, weights, most, block_words).documents
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    # rows that are alike in id, source and text share their copies
    plan = mixed.groupBy("doc_id", "source", "size", "tie").agg(F.sum(times).cast("int").alias("total"), F.count("*").cast("int").alias("rows"))
    plan = plan.where("total > 0").select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size), F.col("tie").alias(own_tie), F.col("total").alias(total), F.col("rows").alias(rows))
    given = docs.withColumn(size, word_count(F.col("text"))).withColumn(tie, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(size) == F.col(own_size)) & (F.col(tie) == F.col(own_tie)) & F.col("source").eqNullSafe(F.col(own_source))
    got = given.join(plan, same)
    own = [own_id, own_size, own_tie, own_source]
    got = got.withColumn(nth, F.when(F.col(rows) == 1, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy(*own).orderBy(*own))))
    each = F.floor(F.col(total) / F.col(rows)).cast("int") + (F.col(nth) <= F.pmod(F.col(total), F.col(rows))).cast("int")
    got = got.withColumn(copies, F.explode(F.array_repeat(F.lit(1), each)))
    return got.select(*docs.columns)
