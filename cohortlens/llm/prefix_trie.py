"""The trie of conversation prefixes, with subtree sums by the Euler tour technique.

A node is a distinct sequence of first turns, named by its depth and two rolling hashes of the turns' 120-bit digests. It
is owned by its smallest member; the nodes of one owner form a path, so that numbered by owner and depth most nodes follow their
parent. Every node has an enter and an exit arc. The arcs' successors make one tour of the trie, children in
the order of their owners; ranking that list distributedly gives every arc its position. The leaves and
savings of a subtree are then differences of prefix sums at a node's two positions.

No group is gathered anywhere: turns of a conversation and children of a node are numbered in range slices, counts are partial
sums, and the ids of the members that end at a node are joined to strings in range slices before a task hashes those
strings one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import mapped, stored
from cohortlens.llm.list_rank import BLOCK, LIMIT, list_rank
from cohortlens.llm.ordered import numbered
from cohortlens.operators.lookup import attach

DONOR, HEADS = 5, 9  # of ``rebuilt``
PIECE = 1 << 20  # bytes of joined ids in one row


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, d1, d2, n_bytes, nth of every turn: its digest, the UTF-8 bytes of its text, its number from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    halves = [F.conv(F.substring("digest", at, 15), 16, 10).cast("bigint").alias(f"d{i}") for i, at in ((1, 1), (2, 16))]
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )
    rows = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", *halves, "n_bytes")
    return numbered(rows, "conv_id", ["turn", "d1", "d2"]).select("conv_id", "nth", "d1", "d2", "n_bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The test conversations of the trie query: conversation c begins with the first h turns of c - c % 5 in place of its own first h."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % DONOR).alias("donor"))
    heads = turns.filter(F.col("nth") < HEADS).filter(F.col("conv_id") % DONOR == 0).withColumnRenamed("conv_id", "donor")
    names = ["conv_id", "own", "nth", "d1", "d2", "n_bytes"]
    lent = heads.join(convs, "donor").filter("nth <= h").withColumn("own", F.lit(0)).select(*names)
    return lent.unionByName(turns.filter(F.col("nth") > h).withColumn("own", F.lit(1)).select(*names))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of equal nodes, joined by commas, in order; a string is closed when it is long."""
    names = ["depth", "k1", "k2", "first", "ids"]

    def packed(rows):
        types = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    now, ids, size, rows = None, [], 0, []
    for batch in batches:
        for *node, conv in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "conv_id")]):
            if node != now or size > PIECE:
                if ids:
                    rows.append((*now, ids[0], ",".join(map(str, ids)).encode()))
                now, ids, size = node, [], 0
            ids.append(conv)
            size += 8
        if rows:
            yield packed(rows)
            rows = []
    if ids:
        yield packed([(*now, ids[0], ",".join(map(str, ids)).encode())])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings joined by commas; they come one after the other, none is kept."""
    def packed(rows):
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["depth", "k1", "k2", "ends_sha256"])

    now, state, rows = None, None, []
    for batch in batches:
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")]):
            if node != now:
                if now is not None:
                    rows.append((*now, state.hexdigest()))
                now, state = node, sha256(ids)
            else:
                state.update(b"," + ids)
        if rows:
            yield packed(rows)
            rows = []
    if now is not None:
        yield packed([(*now, state.hexdigest())])


def _ends(prefixes: DataFrame, silent: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which a conversation ends."""
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("n")).select("n.*", "conv_id")
    zero = F.lit(0).cast("bigint")
    last = last.unionByName(silent.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    keys = ["depth", "k1", "k2"]
    ranged = last.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    pieces = mapped(ranged, _joined_ids, "depth bigint, k1 bigint, k2 bigint, first bigint, ids binary")
    pieces = pieces.repartition(*keys).sortWithinPartitions(*keys, "first").drop("first")
    return mapped(pieces, _hashed_ids, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _tour(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Per node v: parent, n_children and the successors of its enter arc (2 v) and exit arc (2 v + 1).

    ``tops``, nodes whose parent has another owner, have (v, parent). Any other node follows its parent directly and is its first child.
    """
    siblings = stored(numbered(tops.select("parent", "v"), "parent", ["v"]), "siblings")
    one = siblings.select(F.col("at") - 1, "v", "parent").toDF("at", "following", "same")
    beside = siblings.join(one, "at", "left").select("v", "parent", F.when(F.col("same") == F.col("parent"), F.col("following")).alias("beside"))
    first = stored(siblings.groupBy("parent").agg(F.min("v").alias("first_top"), F.count("*").alias("n_tops")), "first")
    goes_on = nodes.filter("NOT top").select((F.col("v") - 1).alias("v"), F.lit(True).alias("goes_on"))
    out = nodes.select("v", "top").join(beside, "v", "left").join(goes_on, "v", "left")
    out = out.join(first.withColumnRenamed("parent", "v"), "v", "left")
    out = out.join(first.select((F.col("parent") + 1).alias("v"), F.col("first_top").alias("uncle")), "v", "left")
    parent = F.when(F.col("v") == 0, None).when(F.col("top"), F.col("parent")).otherwise(F.col("v") - 1)
    sibling = F.when(F.col("top"), F.col("beside")).otherwise(F.col("uncle"))
    child = F.when(F.col("goes_on"), F.col("v") + 1).otherwise(F.col("first_top"))
    return out.select(
        "v",
        parent.alias("parent"),
        (F.coalesce("n_tops", F.lit(0)) + F.coalesce("goes_on", F.lit(False)).cast("bigint")).alias("n_children"),
        F.coalesce(2 * child, 2 * F.col("v") + 1).alias("behind_enter"),
        F.coalesce(2 * sibling, 2 * parent + 1, F.lit(-1).cast("bigint")).alias("behind_exit"),
    )


def _subtrees(nodes: DataFrame, tour: DataFrame, block: int, limit: int) -> DataFrame:
    """(v, n_leaves, saved_tokens) from prefix sums along the tour."""
    both = F.array(
        F.struct((2 * F.col("v")).alias("arc"), F.col("behind_enter").alias("following")),
        F.struct((2 * F.col("v") + 1).alias("arc"), F.col("behind_exit").alias("following")),
    )
    ranks = list_rank(tour.select(F.inline(both)), block, limit)
    own = tour.select("v", (F.col("n_children") == 0).cast("bigint").alias("leaf")).join(
        nodes.select("v", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "v"
    )
    weights = own.select((2 * F.col("v")).alias("arc"), "leaf", "saved")
    placed = ranks.join(weights, "arc", "left").fillna(0, ["leaf", "saved"])
    placed = stored(placed.withColumn("bucket", F.floor(F.col("position") / block)), "placed")
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per ``block`` arcs
    totals = placed.groupBy("bucket").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    offsets = totals.select("bucket", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("leaf", "saved")])
    inside = Window.partitionBy("bucket").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(offsets, "bucket").select(
        F.floor(F.col("arc") / 2).alias("v"),
        (F.col("arc") % 2 == 1).alias("leaving"),
        *[(F.col(f"{c}_ahead") + F.sum(c).over(inside)).alias(f"{c}_upto") for c in ("leaf", "saved")],
        *["leaf", "saved"],
    )
    parts = [
        F.sum(F.when(F.col("leaving"), F.col(f"{c}_upto")).otherwise(F.col(c) - F.col(f"{c}_upto"))).alias(name)
        for c, name in (("leaf", "n_leaves"), ("saved", "saved_tokens"))
    ]
    return summed.groupBy("v").agg(*parts)


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, own, nth, d1, d2, n_bytes; in the order of own and nth).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``members``
    (conv_id, distinct) are all conversations, also those without turns. Without members there is no root and no row.
    """
    rolled = numbered(turns.withColumnRenamed("nth", "place"), "conv_id", ["own", "place"], ("d1", "d2"))
    names = [F.col(c).alias(n) for c, n in (("nth", "depth"), ("d1_upto", "k1"), ("d2_upto", "k2"), ("d1_before", "p1"), ("d2_before", "p2"))]
    prefixes = stored(rolled.select("conv_id", *names, "n_bytes"), "prefixes")
    found = prefixes.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2")
    )
    zero = F.lit(0).cast("bigint")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select("conv_id", "n_convs", *[zero.alias(c) for c in ("depth", "k1", "k2", "n_bytes", "p1", "p2")])
    nodes = numbered(found.unionByName(root), "conv_id", ["depth"]).withColumn("top", F.col("nth") == 1)
    nodes = stored(nodes.withColumnRenamed("at", "v").drop("nth"), "nodes")  # the root is v = 0

    key = [F.concat_ws(":", *columns) for columns in ((F.col("depth") - 1, "p1", "p2"), ("depth", "k1", "k2"))]
    tops = nodes.filter("top AND depth > 1").select("v", key[0].alias("node_key"))
    owners = nodes.filter("depth > 0").select(key[1].alias("node_key"), F.col("v").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = attach(tops, owners, "node_key").select("v", "parent", "parent_conv_id")
    least = members.agg(F.min("conv_id")).first()[0]
    shallow = nodes.filter("top AND depth = 1").select("v", zero.alias("parent"), F.lit(least).cast("bigint").alias("parent_conv_id"))
    tops = stored(shallow.unionByName(deep), "tops")
    tour = stored(_tour(nodes, tops), "tour")
    sums = _subtrees(nodes, tour, block, limit)

    silent = members.join(prefixes.select("conv_id").distinct(), "conv_id", "left_anti")
    out = nodes.join(tour.select("v", "n_children"), "v").join(sums, "v").join(tops.select("v", "parent_conv_id"), "v", "left")
    out = out.join(_ends(prefixes, silent), ["depth", "k1", "k2"], "left")
    parent = F.when(F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, parent).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, plant: bool = False, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), see ``prefix_trie``.

    Turns go by ``turn``, NULL first, those of equal number by a digest of role and text; equal rows are turns of their own. A NULL role or
    text is the empty one. Rows with a NULL conv_id belong to no conversation and are left out. Extra columns are ignored; an
    empty table gives no rows. ``plant`` first makes the conversations of ``rebuilt``.
    """
    turns = stored(turns_of(conversations), "turns")
    members = stored(turns.select("conv_id").distinct(), "members")
    rows = rebuilt(turns) if plant else turns.withColumn("own", F.lit(1))
    return prefix_trie(rows, members, block, limit)
