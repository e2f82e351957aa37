"""Connected components of a link table, as alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of every node at the least of them (and of the node).

    ``large``: the greater neighbours; else the lesser ones and the node. Neighbours are never gathered: the least is an aggregate
    with a partial step, and a join brings it back.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    hung = both.join(least, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b: long), root being the least node it reaches.

    Rounds go on until nothing changes, about the logarithm of the longest chain; each is settled in the shared folder, and the
    driver sees a count and a checksum. An empty table gives an empty one; repeated links and self links change nothing.
    """
    edges = settle(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = _digest(edges)
    while seen[0]:
        nxt = settle(_star(_star(edges, True), False), "links")
        now = _digest(nxt)
        if now == seen:
            break
        discard(edges)
        edges, seen = nxt, now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
