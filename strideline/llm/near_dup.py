"""Near-duplicate documents by Order MinHash and banded alignment.

1. One pass over the texts gives each document a content key (128 bits of its
   word sequence) and an Order MinHash sketch of its five-word shingles.
   Documents of equal key are copies and go on as one node.
2. Nodes that agree in any sketch entry, a bucket, are candidates.  First each bucket's
   nodes are compared with its leader only, whatever its size: the node that meets most
   others in all its buckets, so of edited copies the text that they were made of.  What that
   links is joined to components; a bucket whose nodes all lie in one component is done.
3. Of the other buckets, pairs across components are compared: those of up to ``SMALL``
   nodes as pairs.  Components that larger buckets hold together are a *cluster*; its nodes
   outside its largest component meet all of its nodes in blocks, which stop comparing what
   they have linked.  So a group of copies of any size costs about one comparison a node, and
   no task or row set holds all its pairs.
4. Candidates are verified on all their shingles by banded alignment
   (``omh.aligned_similarity``); links of 0.8 or more are joined to components.

A pair of similarity 0.8 agrees in one entry of four k-mers with probability
about 0.8**4 = 0.41 where its order is kept, so 32 such entries miss it once in 2e7
pairs.  Where blocks have moved the order seldom agrees, so each hash function also
gives an entry of its three smallest k-mers without order: 0.8**3 = 0.51 wherever
they stand, a miss in 1e10 pairs.  The least such rate is that of documents of 4 and
5 shingles, 0.4 and a miss in about 1e7 pairs.  One agreeing entry makes a pair a
candidate whatever the size of its bucket, so which near copies are found does not
depend on how many others share their entries.

Defined results: a null or empty text, or one without words, is like no other
document; documents of fewer than five words are alike only if their words are;
repeated rows are copies of each other; a null doc_id comes after all others; an empty
table gives an empty one; a text of any length is compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.components import connected_components
from strideline.llm.omh import aligned_similarity, sketch
from strideline.llm.scratch import discard, free_names, map_batches, small_batches, stored
from strideline.llm.textcore import content_keys, occurrence_labels, shingles, slices, text_buffer, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
ENTRIES = 32
KMERS = 4
#: K-mers of the entries without order.
FREE_KMERS = 3
#: Nodes of a bucket whose pairs are listed one by one; larger ones go through blocks.
SMALL = 32
#: Nodes, and shingles of all of them, on a side of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


class NearDuplicates(NamedTuple):
    """documents: (doc_id, node, class_id, class_size, kept) for each row; links: (a, b) verified links between nodes."""

    documents: DataFrame
    links: DataFrame


def _nodes(keys: np.ndarray) -> pa.Array:
    raw = keys.byteswap().tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, at = text_buffer(batch.column(1))
        for i, j in slices(at):
            words, word_at = word_hashes(buf[at[i] : at[j]], at[i : j + 1] - at[i])
            keys = content_keys(words, word_at)
            grams, gram_at = shingles(words, word_at, SHINGLE_WORDS)
            values = sketch(occurrence_labels(grams, gram_at), gram_at, ENTRIES, KMERS, FREE_KMERS).view(np.int64)
            width = values.shape[1]
            some = np.diff(word_at) > 0
            entries = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * width, width, dtype=np.int32)), pa.array(values.ravel()))
            mask = pa.array(some)
            nodes, none = _nodes(keys), pa.nulls(j - i, pa.binary())
            columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.compute.if_else(mask, nodes, none), pa.array(np.diff(gram_at)), entries]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "node", "shingles", "entries"])


def content_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the content key ``node`` (null without words) of the last column, a text, to each row."""
    for batch in batches:
        buf, at = text_buffer(batch.column(batch.num_columns - 1))
        parts = []
        for i, j in slices(at):
            words, word_at = word_hashes(buf[at[i] : at[j]], at[i : j + 1] - at[i])
            parts.append(pa.compute.if_else(pa.array(np.diff(word_at) > 0), _nodes(content_keys(words, word_at)), pa.nulls(j - i, pa.binary())))
        node = pa.concat_arrays(parts) if parts else pa.nulls(0, pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], node], names=[*batch.schema.names[:-1], "node"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, labels): the document's shingles, 32 bits each, in text order; rows whose text is another node's are dropped."""
    for batch in batches:
        buf, at = text_buffer(batch.column(1))
        wanted = batch.column(0).to_pylist()
        for i, j in slices(at):
            words, word_at = word_hashes(buf[at[i] : at[j]], at[i : j + 1] - at[i])
            own = _nodes(content_keys(words, word_at)).to_pylist()
            grams, gram_at = shingles(words, word_at, SHINGLE_WORDS)
            labels = (occurrence_labels(grams, gram_at) >> np.uint64(32)).astype(np.uint32)
            keep = [k for k in range(j - i) if own[k] == wanted[i + k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([own[k] for k in keep], pa.binary()), pa.array([labels[gram_at[k] : gram_at[k + 1]].tobytes() for k in keep], pa.binary())],
                names=["node", "labels"],
            )


_LINKS = "a binary, b binary"


def _links(found: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})


def _check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (a, b) of (a, b, labels of a, labels of b) that are links."""
    last, x, order = None, None, None
    for batch in batches:
        keep = []
        for k in range(batch.num_rows):
            node = batch.column(0)[k].as_py()
            if node != last:
                last, x = node, np.frombuffer(batch.column(2)[k].as_py(), np.uint32)
                order = np.argsort(x)
            keep.append(aligned_similarity(x, np.frombuffer(batch.column(3)[k].as_py(), np.uint32), THRESHOLD, order) > 0)
        yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _check_block(table: pa.Table) -> pa.Table:
    """Links of a block that join what was apart: rows of side 0 against those of side 1.

    Skipped are pairs that known or found links connect already, that agree in no
    sketch entry or whose sizes differ too much.
    """
    nodes, roots = table["node"].to_pylist(), table["root"].to_pylist()
    side = table["side"].to_numpy()
    labels = [np.frombuffer(x, np.uint32) for x in table["labels"].to_pylist()]
    entries = np.stack([np.asarray(x, dtype=np.int64) for x in table["entries"].to_pylist()])
    size = np.array([len(x) for x in labels])
    group = np.unique(np.array(roots, dtype=object), return_inverse=True)[1]  # nodes that are connected have one number
    major = table["major"].to_numpy(zero_copy_only=False)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = []
    for i in left.tolist():
        others = right[(group[right] != group[i]) & (np.minimum(size[right], size[i]) >= THRESHOLD * np.maximum(size[right], size[i]))]
        others = others[(entries[others] == entries[i]).any(axis=1)]
        order = np.argsort(labels[i]) if len(others) else None
        for k in others.tolist():
            # two nodes outside the largest component meet twice
            if group[i] != group[k] and (major[k] or nodes[i] < nodes[k]) and aligned_similarity(labels[i], labels[k], THRESHOLD, order) > 0:
                group[group == group[k]] = group[i]
                found.append((nodes[i], nodes[k]))
    return _links(found)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> NearDuplicates:
    """Classes of near-duplicate documents; see the module's text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    schema = "doc_id long, tie long, node binary, shingles long, entries array<long>"
    sketched = stored(map_batches(rows, _sketched, schema), "sketches")
    # one row stands for a node; ``tie`` tells rows of equal or null id apart
    nodes = sketched.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first"), F.first("shingles").alias("shingles"), F.first("entries").alias("entries"))
    nodes = stored(nodes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"), "shingles", "entries"), "nodes")

    entry = nodes.select("node", F.posexplode("entries").alias("place", "value")).select("node", F.xxhash64("place", "value").alias("key"))
    by_key = Window.partitionBy("key")
    members = stored(entry.select("key", "node", F.count("*").over(by_key).alias("n")).where("n > 1"), "members")
    reach = members.groupBy("node").agg(F.sum("n").alias("reach"))
    leader = F.max(F.struct("reach", "node")).over(by_key)["node"]
    sized, members = members, stored(members.join(reach, "node").select("key", "node", "n", leader.alias("leader")), "buckets")
    discard(sized)
    payload = _payload(rows, nodes, members)

    star = stored(members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    first = stored(_verified(star, payload), "links")
    roots = stored(connected_components(first), "roots")
    rest = stored(_across(members, roots, star, nodes, payload), "links")
    links = stored(first.unionByName(rest).distinct(), "links")
    # the rest links components of the first
    of_a, of_b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
    between = rest.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = connected_components(between).toDF("first_root", "last_root")
    of_node = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("first_root"))
    of_node = of_node.join(joined, "first_root", "left").select("node", F.coalesce("last_root", "first_root").alias("root"))
    # ids: null ones last; a node's least id stands for all its copies
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    by_node = sketched.where("node is not null").groupBy("node").agg(F.min(last).alias("least_id"), F.count("*").alias("copies"))
    of_node = stored(of_node.join(by_node, "node"), "classes")
    for table in (nodes, members, payload, star, first, roots, rest):
        discard(table)
    by_root = of_node.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct("least_id", "node")).alias("keeper"))
    classes = of_node.join(by_root, "root").select("node", "class_id", "class_size", (F.col("keeper.node") == F.col("node")).alias("keeps"))
    found = sketched.select("doc_id", "node").join(classes, "node", "left")
    class_id = F.when(F.col("class_id") == 2**63 - 1, F.lit(None)).otherwise(F.coalesce("class_id", "doc_id"))
    kept = F.coalesce(F.col("keeps") & (last == F.col("class_id")), F.lit(True))
    documents = found.select("doc_id", "node", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), kept.alias("kept"))
    return NearDuplicates(documents, links)


def _payload(rows: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, labels): the shingles of every node that has a candidate, from one of its rows."""
    needed = members.select("node").distinct().join(nodes.select("node", "first_id", "first_tie"), "node")
    texts = needed.join(rows, F.col("first_id").eqNullSafe(F.col("doc_id")) & (F.col("first_tie") == F.col("tie"))).select("node", "text")
    found = map_batches(texts, _labelled, "node binary, labels binary").groupBy("node").agg(F.first("labels").alias("labels"))  # one row where a document is repeated
    return stored(found, "labels")


def _verified(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are links."""
    # fresh column identities: both sides come from the same table
    left, right = payload.toDF("a", "labels_a"), payload.toDF("b", "labels_b")
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "labels_a", "labels_b")
    return map_batches(rows, _check_pairs, _LINKS)


def _across(members: DataFrame, roots: DataFrame, star: DataFrame, nodes: DataFrame, payload: DataFrame) -> DataFrame:
    """(a, b): links between nodes that share a bucket but no component; enough to connect all that belong together."""
    small_batches(members.sparkSession)
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    opened = stored(placed.join(mixed, "key"), "open-buckets")

    small = opened.where(F.col("n") <= SMALL).select("key", "node", "root")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = pairs.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    by_pair = _verified(stored(pairs, "pairs"), payload)

    large = opened.where(F.col("n") > SMALL)
    chief = F.max(F.when(F.col("node") == F.col("leader"), F.col("root"))).over(Window.partitionBy("key"))
    held = connected_components(large.select(F.col("root").alias("a"), chief.alias("b"))).toDF("root", "cluster")
    met = large.select("node", "root").distinct().join(held, "root").join(nodes.select("node", "shingles"), "node")
    by_root = met.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"))
    most = F.max(F.struct("n", "root", "shingles"))
    clusters = by_root.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), most.alias("most"))
    # nodes and shingles of a cluster, and of what is not in its largest component, decide on its blocks
    chunks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    clusters = clusters.select("cluster", F.col("most.root").alias("major_root"), chunks(F.col("n"), F.col("shingles")).alias("rights"), chunks(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("lefts"))
    met = met.join(clusters, "cluster").join(payload, "node").join(nodes.select("node", "entries"), "node")
    met = met.select("cluster", "node", "root", (F.col("root") == F.col("major_root")).alias("major"), "labels", "entries", "lefts", "rights", F.xxhash64("node").alias("salt"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod("salt", F.col(c)).cast("int")
    left = met.where("not major").withColumn("i", own("lefts")).withColumn("j", every("rights")).withColumn("side", F.lit(0))
    right = met.withColumn("j", own("rights")).withColumn("i", every("lefts")).withColumn("side", F.lit(1))
    grid = left.unionByName(right).select("cluster", "i", "j", "side", "node", "root", "major", "labels", "entries")
    by_block = grid.groupBy("cluster", "i", "j").applyInArrow(_check_block, _LINKS)
    return by_pair.unionByName(by_block).distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but one document of each class; its columns stay as they are.

    Of rows that repeat a document whole, one stays as well.  Documents without
    words stay, since they are like no other.
    """
    found = near_duplicates(docs, doc_id, text).documents.where("kept and node is not null")
    node, kept_id, kept_node, nth = free_names(docs, "node", "kept_id", "kept_node", "nth")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField(node, T.BinaryType())])

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in content_nodes(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=schema.names)

    given = map_batches(docs.withColumn(node, F.col(text)), with_node, schema)
    keys = found.select(F.col("doc_id").alias(kept_id), F.col("node").alias(kept_node)).distinct()
    # both columns are keys of the join: copies of one text, however many, spread by their ids
    held = given.where(F.col(node).isNotNull()).join(keys, (F.col(node) == F.col(kept_node)) & F.col(doc_id).cast("long").eqNullSafe(F.col(kept_id)))
    repeated = Window.partitionBy(kept_node, kept_id).orderBy(kept_node)
    held = held.withColumn(nth, F.row_number().over(repeated)).where(F.col(nth) == 1)
    return held.select(*docs.columns).unionByName(given.where(F.col(node).isNull()).select(*docs.columns))
