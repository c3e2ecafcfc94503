"""Variable-length paths: all simple paths, or only what they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from .kept import forget, keep


class PathLimit(RuntimeError):
    """There are longer paths than the limit; nothing is cut off silently."""


def hops(graph: PropertyGraph, edge: Column, node: Column | None) -> DataFrame:
    """graph_id, src, dst of the edges a path may use: ``node`` holds for the node it leads to."""
    out = graph.edges.where(edge).select("graph_id", "src", "dst").distinct()
    if node is not None:
        out = out.join(graph.nodes.where(node).select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi")
    return out


def simple_paths(graph: PropertyGraph, starts: DataFrame, edge: Column, node: Column | None = None, max_length: int = 32) -> DataFrame:
    """graph_id, start, path, last: the empty path (last = start) and every path of distinct nodes.

    ``starts`` has graph_id and start. The start is no part of a path, need not satisfy ``node``, and may
    come once in it; all other nodes satisfy ``node`` and all hops ``edge``. The frontier is extended hop
    by hop, a shuffle on (graph_id, last) each; paths beyond ``max_length`` raise PathLimit.
    """
    step = keep(hops(graph, edge, node))
    frontier = starts.select("graph_id", "start").distinct().withColumn("path", F.array().cast("array<long>")).withColumn("last", F.col("start"))
    found = [keep(frontier)]
    for length in range(1, max_length + 2):
        more = found[-1].join(step.withColumnRenamed("src", "last").withColumnRenamed("dst", "to"), ["graph_id", "last"])
        more = more.where(~F.array_contains("path", F.col("to"))).select("graph_id", "start", F.array_append("path", F.col("to")).alias("path"), F.col("to").alias("last"))
        more = keep(more)
        if more.isEmpty():
            break
        if length > max_length:
            raise PathLimit(f"there are paths of more than {max_length} hops; constrain the pattern or raise max_length")
        found.append(more)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def reachable(graph: PropertyGraph, starts: DataFrame, edge: Column, node: Column | None = None, zero: bool = True) -> DataFrame:
    """graph_id, start, last: what paths from each start reach, without the paths; cycles are fine.

    Only what the starts reach is walked, by ``shortest``, whose jumps grow only while that keeps them few. ``zero``: starts
    reach themselves, else only by a path.
    """
    at = lambda c: F.struct("graph_id", F.col(c).alias("node"))
    step = keep(hops(graph, edge, node).select(at("src").alias("last"), at("dst").alias("to")))
    first = starts.select("graph_id", "start").distinct().select(at("start").alias("start"), at("start").alias("last"))
    if not zero:
        first = first.join(step, "last").select("start", F.col("to").alias("last"))
    reach = shortest(first, step)
    forget(step)
    return reach.select("start.graph_id", F.col("start.node").alias("start"), F.col("last.node").alias("last"))


#: Jumps are doubled while there can be at most so many of them for each hop.
GROWTH = 4


def shortest(starts: DataFrame, step: DataFrame) -> DataFrame:
    """start, last, hops: what hops (step: last, to) lead to from each start (starts: start, last), and over how few; starts take none.

    A round goes from what the round before found to what lies up to ``stride`` hops further, by jumps of exactly that many.
    Jumps are doubled with each round, so a long chain takes rounds by the logarithm of its length. Where paths branch that
    much that doubling could give more than ``GROWTH`` jumps for each hop, the stride stays, down to hop by hop.
    """
    jump = keep(step.select("last", "to").where("last IS NOT NULL AND to IS NOT NULL").distinct())
    most = GROWTH * jump.count()
    reach = keep(starts.select("start", "last", F.lit(0).cast("long").alias("hops")).distinct())
    known, stride = 1, 1
    while True:
        front = reach.where(F.col("hops") >= known - stride)
        more = front.join(jump, "last").groupBy("start", F.col("to").alias("last")).agg((F.min("hops") + stride).alias("hops"))
        new = keep(more.join(reach, ["start", "last"], "left_anti").select("start", "last", "hops"))
        if new.isEmpty():
            forget(jump, new)
            return reach
        wider = keep(reach.unionByName(new))
        forget(reach, new)
        reach, known = wider, known + stride
        if most:
            out, into = jump.groupBy("last").agg(F.count("*").alias("n_out")), jump.groupBy(F.col("to").alias("last")).agg(F.count("*").alias("n_in"))
            if (out.join(into, "last").agg(F.sum(F.col("n_out") * F.col("n_in"))).first()[0] or 0) > most:
                most = 0
            else:
                twice = keep(jump.withColumnRenamed("to", "via").join(jump.withColumnRenamed("last", "via"), "via").select("last", "to").distinct())
                forget(jump)
                jump, stride = twice, 2 * stride
