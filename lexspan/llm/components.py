"""Connected components of an edge table, without collecting any of it.

Large-star and small-star steps alternate until no edge changes: every step joins each node
with the least of its neighbours, which is an aggregation and a join, so a node with very
many neighbours is combined on the map side and split by the skew join. Each round is cut
off by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself. ``edges``: u, v in the directions that count."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


#: Edges in a file of a round's checkpoint, about.
FILE_EDGES = 250_000


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v of one sortable type. Gives ``node, root`` for every node of an edge
    between different nodes; the root is the component's least node."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:  # every round that changes something brings some node nearer to its least one
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # a round gives no more rows than twice the last; few rows make few files
        e = cut(small.coalesce(-(-2 * seen[0] // FILE_EDGES)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
