"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and a join; no group is gathered in one task, and
the edges never reach the driver, which only reads their number and a checksum
to see that nothing changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: From so many links on, the least neighbours are written before the join: of two plain shuffles Spark splits a hub's links.
MANY = 5_000_000


def _star(links: DataFrame, larger: bool, many: bool) -> DataFrame:
    """Links (a, b), a > b. Large star: a node's larger neighbours move to its least; small star: its smaller ones do."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(materialize(least, "least") if many else least, "u")
    if larger:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): every node that has a link, with the least node of its component. ``links`` has columns a, b."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges, seen = materialize(edges, "links"), None
    for _ in range(most_rounds):
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if row == seen or not row[0]:
            break
        seen = row
        edges = materialize(_star(_star(edges, True, row[0] > MANY), False, row[0] > MANY), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
