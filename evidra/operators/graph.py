"""Closures over reference graphs, which may have cycles: frontiers joined with the edges until nothing is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.session import checkpointed


def reach(seeds: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", by: str | None = None) -> DataFrame:
    """Everything that ``seeds`` reach along edges from ``src`` to ``dst``, seeds included.

    With ``by``, a column of ``seeds``, each of its values has a closure of its own, and all share the rounds.
    Only the newest frontier is joined with the edges in each round; rounds end when it is empty. The edges are
    made once; what was seen is the union of the frontiers, written anew every eighth round.
    """
    own = [by] if by else []
    steps = checkpointed(edges.select(F.col(src).alias("__src"), F.col(dst).alias("__dst")).distinct())
    frontier = checkpointed(seeds.select(*own, F.col(node).alias("node")).distinct())
    seen, rounds = frontier, 0
    while not frontier.isEmpty():
        found = frontier.join(steps, F.col("node") == F.col("__src")).select(*own, F.col("__dst").alias("node")).distinct()
        frontier = checkpointed(found.join(seen, [*own, "node"], "left_anti"))
        seen, rounds = seen.unionByName(frontier), rounds + 1
        seen = seen if rounds % 8 else checkpointed(seen)
    return seen.withColumnRenamed("node", node)


def impact(seeds: DataFrame, edges: DataFrame, node: str = "node", by: str | None = None) -> DataFrame:
    """Seeds and all that refers to them, directly or not: reachability against the edges' direction."""
    return reach(seeds, edges, node, src="dst", dst="src", by=by)


def on_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node) of all nodes that reach themselves.

    Nodes without an edge into or out of them are trimmed, three layers a round; only what is left is closed.
    """
    core = checkpointed(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct())
    size = core.count()
    while size:
        for _ in range(3):
            starts, ends = core.select(F.col("src").alias("n")).distinct(), core.select(F.col("dst").alias("n")).distinct()
            core = core.join(starts, F.col("dst") == F.col("n"), "left_semi").join(ends, F.col("src") == F.col("n"), "left_semi")
        core = checkpointed(core)
        before, size = size, core.count()
        if size == before:
            break
    seeds = core.select(F.col("src").alias("of"), F.col("dst").alias("node"))
    return reach(seeds, core, by="of").where("of = node").select("node")


def disjoint_with_ancestor(parents: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(node) of nodes declared disjoint with one of their ancestors; both inputs are pairs (src, dst)."""
    of = disjoint.select(F.col("src").alias("of")).distinct()
    seeds = parents.join(of, F.col("src") == F.col("of")).select("of", F.col("dst").alias("node"))
    above = reach(seeds, parents, by="of")
    clash = above.join(disjoint.select(F.col("src").alias("s"), F.col("dst").alias("d")), (F.col("of") == F.col("s")) & (F.col("node") == F.col("d")), "left_semi")
    return clash.select(F.col("of").alias("node")).distinct()


def unresolved(roots: DataFrame, imports: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """(iri) reached from ``roots`` over imports and neither known nor resolved by an alias."""
    reached = reach(roots, imports, "iri")
    return reached.join(known, "iri", "left_anti").join(aliases, "iri", "left_anti")
