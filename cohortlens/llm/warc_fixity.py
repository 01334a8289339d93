"""Merkle fixity audit of web archive records.

A replica is an ordered sequence of WARC records. Each record is hashed where it is read; what travels on
are ids, lengths and digests. A leaf hashes a record's offset range and digest, an inner node the
hashes of up to ``FANOUT`` children in order, up to one root. Two replicas with equal roots are intact. Else
the audit compares level by level, only the children of nodes that differ, down to the records.

Records of the second replica take the place that the first one's manifest gives their id, so one lost record
does not shift all that follow. Everything is DataFrame functions; no task sees more than a
range slice of narrow rows or the children of its nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import small, stored

FANOUT = 16
BROADCAST_NODES = 1_000_000


def record(pages: DataFrame) -> DataFrame:
    """(page_id, record): the WARC response record of each page. NULL url or html is empty."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def manifest(records: DataFrame) -> DataFrame:
    """(page_id, copy, position, offset, n_bytes, sha256) in order of page_id, NULL first, then digest.

    ``copy`` numbers the records of one page_id. Positions and offsets come from range slices and their totals, of
    which there are as many as shuffle partitions.
    """
    rows = records.select(
        "page_id", F.sha2(F.col("record").cast("binary"), 256).alias("sha256"), F.octet_length("record").cast("bigint").alias("n_bytes")
    )
    rows = rows.withColumn("origin", F.spark_partition_id())  # lets equal rows fall into several slices
    order = ["page_id", "sha256", "origin"]
    rows = stored(rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "records")
    totals = rows.groupBy("slice").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).orderBy("slice").collect()
    starts, n, b = [], 0, 0
    for r in totals:
        starts.append((r["slice"], n, b))
        n, b = n + r["n"], b + r["b"]
    starts = rows.sparkSession.createDataFrame(starts, "slice int, n0 bigint, b0 bigint")
    inside = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.count("*").over(inside)).withColumn("b", F.sum("n_bytes").over(inside)).join(F.broadcast(starts), "slice")
    rows = rows.select("page_id", (F.col("n0") + F.col("n") - 1).alias("position"), (F.col("b0") + F.col("b") - F.col("n_bytes")).alias("offset"), "n_bytes", "sha256")
    rows = stored(rows, "manifest")
    first = rows.groupBy("page_id").agg(F.min("position").alias("first"))
    named = rows.join(first.withColumnRenamed("page_id", "same_id"), F.col("page_id").eqNullSafe(F.col("same_id")))
    return named.select("page_id", (F.col("position") - F.col("first")).alias("copy"), "position", "offset", "n_bytes", "sha256")


def placed(other: DataFrame, reference: DataFrame) -> DataFrame:
    """Records of a second manifest at the places of the same ids in ``reference``; position NULL for strangers."""
    place = reference.select(F.col("page_id").alias("id"), F.col("copy").alias("no"), "position", "offset")
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("no"))
    return other.drop("position", "offset").join(place, same, "left").drop("id", "no")


def tree(leaves: DataFrame, records: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (node, hash), leaves first, the root alone last, over ``records`` positions."""
    leaf = F.sha2(F.concat_ws(":", "offset", "n_bytes", "sha256"), 256)
    level = stored(leaves.filter("position IS NOT NULL").select(F.col("position").alias("node"), leaf.alias("hash")), "tree")
    levels = [level]
    while records > 1:
        records = -(-records // fanout)
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        joined = F.concat_ws(",", F.transform(children, lambda c: F.concat_ws("=", c["node"].cast("string"), c["hash"])))
        level = level.groupBy(F.floor(F.col("node") / fanout).alias("parent")).agg(F.sha2(joined, 256).alias("hash"))
        level = stored(level.withColumnRenamed("parent", "node"), "tree")
        levels.append(level)
    return levels


def differing(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Positions whose leaves differ or are in one tree only, found from the roots downwards."""
    suspects = None
    for a, b in zip(reversed(one), reversed(two)):
        if suspects is not None:
            parents = small(suspects.withColumnRenamed("node", "parent"), BROADCAST_NODES)
            a, b = (x.withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, "parent", "left_semi").drop("parent") for x in (a, b))
        both = a.join(b.withColumnRenamed("hash", "other"), "node", "full")
        suspects = stored(both.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("node"), "suspects")
    return suspects


def audit(pages: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Per record of either side: page_id, copy, position, offset, n_bytes, sha256, replica_sha256, status.

    Both sides are pages (page_id, url, html). status is intact, altered, missing (in the replica) or strange (only in
    the replica, without a place). A page_id that occurs several times is told apart by the order of digests. Extra columns are
    ignored; an empty side makes all records missing or strange; two empty sides give no rows.
    """
    ours = stored(manifest(record(pages)), "ours")
    theirs = stored(placed(manifest(record(replica)), ours), "theirs")
    count = ours.count()
    bad = differing(tree(ours, count, fanout), tree(theirs, count, fanout), fanout)
    bad = bad.join(theirs.select(F.col("position").alias("node"), F.col("sha256").alias("found")), "node", "left")
    bad = bad.select(F.col("node").alias("position"), "found", F.lit(True).alias("bad"))
    out = ours.join(small(bad, BROADCAST_NODES), "position", "left")
    status = F.when(F.col("bad").isNull(), "intact").when(F.col("found").isNull(), "missing").otherwise("altered")
    known = F.when(F.col("bad").isNull(), F.col("sha256")).otherwise(F.col("found"))
    out = out.select("page_id", "copy", "position", "offset", "n_bytes", "sha256", known.alias("replica_sha256"), status.alias("status"))
    none = F.lit(None)
    strange = theirs.filter("position IS NULL").select(
        "page_id", "copy", none.cast("bigint").alias("position"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("n_bytes"),
        none.cast("string").alias("sha256"), F.col("sha256").alias("replica_sha256"), F.lit("strange").alias("status"),
    )
    return out.unionByName(strange)


def worn_replica(pages: DataFrame) -> DataFrame:
    """A copy of ``pages`` with known damage by page_id: lost, altered and cut records, and renamed ones."""
    html = F.when(F.expr("page_id % 97 = 5"), F.concat(F.col("html"), F.lit("#"))).when(F.expr("page_id % 101 = 11"), F.expr("left(html, 40)")).otherwise(F.col("html"))
    page_id = F.when(F.expr("page_id % 211 = 3"), -F.col("page_id")).otherwise(F.col("page_id"))
    return pages.filter("coalesce(page_id % 103 != 7, true)").select(page_id.alias("page_id"), "url", html.alias("html"))
