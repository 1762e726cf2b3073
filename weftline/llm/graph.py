"""Connected components without collecting the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, stage


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component.

    ``edges``: (a, b) of any ordered type; direction, repeats and loops don't
    matter. In each round a node moves to its least neighbour's least
    neighbour, if that is less, and edges between nodes that have met go, so
    that the graph shrinks fast; the rounds grow with the logarithm of its
    longest path. Each round is written to a table, and the result is one; the
    driver only sees counts. Nodes of very many neighbours are joined by broadcast.
    """
    left, total = stage(_undirected(edges), "edges"), None
    while n := left.count():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stage(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"), "degree"), "near")
        onward = near.select(F.col("node").alias("to"), F.col("to").alias("further"), "degree")
        moves = stage(spread_join(near.select("node", "to", F.col("degree").alias("own")), onward, "to", "degree", 2 * n).select("node", F.col("further").alias("to"), F.col("own").alias("degree")), "moves")
        discard(near)
        if total is None:
            total = moves.select("node", F.col("to").alias("component"))
            first = moves
        else:
            sizes = total.groupBy("component").agg(F.count("*").alias("size"))
            step = stage(moves.select(F.col("node").alias("component"), "to").join(sizes, "component"), "step")
            joined = spread_join(total, step, "component", "size", total.count(), "left")
            now = stage(joined.select("node", F.coalesce("to", "component").alias("component")), "components")
            discard(first, step)
            total = first = now
        of = lambda end: moves.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"), "degree")  # noqa: E731, B023
        half = stage(spread_join(left, of("a"), "a", "degree", 2 * n).select("to_a", "b"), "half")
        moved = spread_join(half, of("b"), "b", "degree", 2 * n).select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        fewer = stage(_undirected(moved), "edges")
        discard(left, half, *(() if moves is first else (moves,)))
        left = fewer
    discard(left)
    if total is None:
        return stage(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0), "components")
    total.stage_path = first.stage_path
    return total
