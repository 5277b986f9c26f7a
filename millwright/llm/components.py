"""Connected components of an edge list, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import remove, written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (u, v), u > v. Large-star links each larger neighbour of a node to the least of its neighbourhood, small-star the rest."""
    if larger:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if larger:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, rounds: int = 100) -> tuple[DataFrame, str]:
    """(node, component) for every node of ``links`` (a, b), component being the least node reachable; and its written path.

    Rounds end when the edge set no longer changes (compared by count and order-free hash); their number grows with the
    logarithm of the nodes, so one that is not through after ``rounds`` raises. Self links and nulls are ignored.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, path = written(edges, "edges")
    mark = None
    for _ in range(rounds):
        new, new_path = written(_star(_star(edges, True), False), "edges")
        remove(links.sparkSession, path)
        edges, path = new, new_path
        row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"the components still change after {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    nodes = roots.select(F.col("u").alias("node"), "component").unionByName(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )
    result, result_path = written(nodes, "components")
    remove(links.sparkSession, path)
    return result, result_path
