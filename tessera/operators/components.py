"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("src").agg(F.min("dst").alias("m"))
    least = least.select("src", F.least("src", "m").alias("m"))
    return (
        both.filter(F.col("dst") > F.col("src"))
        .join(least, "src")
        .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.filter("src <> dst").unionByName(least.select("src", F.col("m").alias("dst")))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Weakly connected components of the graph spanned by ``edges(src, dst)``.

    Returns ``(node, component)`` for every node that occurs in an edge; ``component`` is the
    smallest node id reachable.  Edges with a null end and self-loops are ignored (a node whose
    only edge is a self-loop is absent), repeated edges count once, no edges give no rows.

    Each round is two aggregations with map-side combine and two equi-joins whose skewed
    partitions AQE can split; the edge set is rewritten to the shared folder every round, so the
    lineage stays one round long, and the round before is deleted.  The number of rounds is logarithmic
    in the longest path.
    """
    edges = materialize(
        edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        .filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        spent, edges = edges, materialize(_small_star(_large_star(edges)).distinct(), "stars")
        discard(spent)
        after = edges.agg(
            F.count(F.lit(1)), F.sum(F.hash("src", "dst").cast("long")), F.bit_xor(F.xxhash64("src", "dst"))
        ).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
