"""Pruning: cascading deletes, in synchronous rounds.

All degrees of a round are those at its start, so the result doesn't depend on an order of deletion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from . import paths
from .kept import forget, keep, keep_counted

KEY = ["graph_id", "node_id"]


def without(graph: PropertyGraph, gone: DataFrame) -> PropertyGraph:
    """The graph without the nodes of ``gone`` (graph_id, node_id) and their edges."""
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    return PropertyGraph(graph.nodes.join(gone, KEY, "left_anti"), edges.select(graph.edges.columns))


def cascade(graph: PropertyGraph, seeds: DataFrame, forwards: bool) -> PropertyGraph:
    """Delete the seeds and, round by round, what hung on the deleted: forwards, a successor with one
    edge or one control edge into it, and a predecessor with one edge in all; backwards, the mirror image.
    Only what is deleted is kept from round to round: degrees are counted among the neighbours of the front.
    """
    near, far = ("src", "dst") if forwards else ("dst", "src")
    e = graph.edges.select("graph_id", "src", "dst", "etype")
    front = keep(seeds.select(*KEY).distinct().join(graph.nodes.select(*KEY), KEY, "left_semi"))
    gone = front
    while not front.isEmpty():
        #: Edges that were there at the start of the round, of the neighbours of the front.
        past = gone.join(front, KEY, "left_anti")
        left = e
        for end in ("src", "dst"):
            left = left.join(past.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
        ahead = left.join(front.withColumnRenamed("node_id", near), ["graph_id", near], "left_semi").select("graph_id", F.col(far).alias("node_id"), F.lit(True).alias("ahead"))
        behind = left.join(front.withColumnRenamed("node_id", far), ["graph_id", far], "left_semi").select("graph_id", F.col(near).alias("node_id"), F.lit(False).alias("ahead"))
        beside = ahead.unionByName(behind).groupBy(*KEY).agg(F.max("ahead").alias("ahead"), F.max(~F.col("ahead")).alias("behind"))
        beside = keep(beside.join(gone, KEY, "left_anti"))
        ends = left.select("graph_id", F.col(far).alias("node_id"), F.lit(1).alias("entry"), (F.col("etype") == "CONTROL").cast("int").alias("control")).unionByName(
            left.select("graph_id", F.col(near).alias("node_id"), F.lit(0).alias("entry"), F.lit(0).alias("control"))
        )
        degrees = ends.join(beside, KEY).groupBy(*KEY, "ahead", "behind").agg(F.sum("entry").alias("total"), F.sum("control").alias("control"), F.count("*").alias("both"))
        next_ = degrees.where("ahead AND (total = 1 OR control = 1) OR behind AND both = 1").select(*KEY)
        new = keep(next_.join(graph.nodes.select(*KEY), KEY, "left_semi"))
        wider = keep(gone.unionByName(new))
        forget(front, gone, beside)
        front, gone = new, wider
    out = without(graph, gone)
    out = PropertyGraph(keep(out.nodes), keep(out.edges))
    forget(front, gone)
    return out


def remove_forwards(graph: PropertyGraph, seeds: DataFrame) -> PropertyGraph:
    return cascade(graph, seeds, True)


def remove_backwards(graph: PropertyGraph, seeds: DataFrame) -> PropertyGraph:
    return cascade(graph, seeds, False)


def typed(name: str):
    return F.coalesce(F.array_contains("types", name), F.lit(False))


def remove_exceptions(graph: PropertyGraph, label: str = "exceptionEdge", unwind: str = "UnwindNode") -> PropertyGraph:
    """Delete what control edges of that label lead to, forwards, then the unwind nodes, backwards."""
    thrown = graph.edges.where((F.col("etype") == "CONTROL") & (F.col("label") == label)).select("graph_id", F.col("dst").alias("node_id"))
    graph = remove_forwards(graph, thrown)
    return remove_backwards(graph, graph.nodes.where(typed(unwind)).select(*KEY))


def remove_leaves(graph: PropertyGraph, control: str = "FixedNode", returns: str = "ReturnNode") -> PropertyGraph:
    """Delete control nodes that lead nowhere and don't return, backwards."""
    leaves = graph.nodes.where((F.col("kind") == "IR") & typed(control) & ~typed(returns)).select(*KEY)
    return remove_backwards(graph, leaves.join(graph.edges.select("graph_id", F.col("src").alias("node_id")), KEY, "left_anti"))


def simplify(graph: PropertyGraph, start: str = "StartNode", returns: str = "ReturnNode") -> PropertyGraph:
    """Without exceptions and dead ends; an error if a start or a return doesn't survive."""
    out = remove_leaves(remove_exceptions(graph))
    for name in (start, returns):
        if out.nodes.where(typed(name)).isEmpty():
            raise ValueError(f"no {name} is left")
    return out


def run_ends(one: DataFrame) -> DataFrame:
    """node, to: where runs of nodes that only lead on end (one: node, to, a row a node); nodes whose run is a cycle have no row.

    By pointer jumping: rounds grow with the logarithm of the longest run, a round has a row a node.
    """
    ends, n = keep_counted(one.select("node", "to"))
    for _ in range(n.bit_length() + 1):
        ahead = ends.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        jumped, moved = keep_counted(ends.join(ahead, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), F.col("moved"))
        forget(ends)
        ends = jumped
        if not moved:
            break
    out = keep(ends.join(one.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to"))
    forget(ends)
    return out


def resolve_placeholders(edges: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Edges (src, dst) whose dst is a placeholder (placeholders: node_id) lead to that placeholder's
    targets instead, until none is left; a cycle of placeholders resolves to what leads out of it.

    Placeholders that only lead to one other placeholder are skipped by ``run_ends``, so that a chain with one way out costs
    a row a placeholder; chains of the rest are followed by ``paths.shortest``.
    """
    marks = keep(placeholders.select(F.col("node_id").alias("dst")).distinct())
    sources = marks.withColumnRenamed("dst", "src")
    e = keep(edges.select("src", "dst").distinct())
    final, first = (e.join(sources, "src", "left_anti").join(marks, "dst", how).select("src", "dst") for how in ("left_anti", "left_semi"))
    out = e.join(sources, "src", "left_semi")
    only = out.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").join(marks, "dst", "left_semi")
    only = keep(only.select(F.col("src").alias("node"), F.col("dst").alias("to")))
    ends = run_ends(only)

    def skipped(rows: DataFrame, c: str) -> DataFrame:
        """``rows`` with the placeholder that ``c`` leads to instead of ``c``; rows that lead into a closed cycle go."""
        stays = rows.join(only.select(F.col("node").alias(c)), c, "left_anti")
        moved = rows.join(ends.select(F.col("node").alias(c), F.col("to").alias("end of run")), c).withColumn(c, F.col("end of run")).drop("end of run")
        return stays.select(rows.columns).unionByName(moved.select(rows.columns))

    mine = out.join(only.select(F.col("node").alias("src")), "src", "left_anti")
    exits = mine.join(marks, "dst", "left_anti").select(F.col("src").alias("last"), F.col("dst").alias("to"))
    first = keep(skipped(first, "dst").distinct())
    steps = keep(skipped(mine.join(marks, "dst", "left_semi").select("src", "dst"), "dst").distinct().select(F.col("src").alias("last"), F.col("dst").alias("to")))
    starts = first.select(F.col("dst").alias("start"), F.col("dst").alias("last")).distinct()
    reach = paths.shortest(starts, steps)
    forget(steps)
    targets = reach.join(exits, "last").select(F.col("start").alias("dst"), "to").distinct()
    return final.unionByName(first.join(targets, "dst").select("src", F.col("to").alias("dst"))).distinct()
