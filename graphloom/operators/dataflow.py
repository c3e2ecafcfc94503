"""Dataflow over control edges: a lattice's values are merged at each node and passed through it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from .kept import Latest, forget, keep, keep_counted, kept_as

KEY = ["graph_id", "node_id"]


@dataclass(frozen=True)
class Analysis:
    """initial: value before any flow, as a Column. merge: aggregate of the values that meet (of a Column).
    flow: value after a node, from the Column of the value before it, over the node's columns."""

    initial: Column
    merge: Callable[[Column], Column]
    flow: Callable[[Column], Column]


def union_of_sets(c: Column) -> Column:
    """Merge of set-valued analyses, sorted."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))


def run(graph: PropertyGraph, analysis: Analysis, backwards: bool = False, rounds: int = 10_000) -> DataFrame:
    """graph_id, node_id, before, after of each node once no value changes.

    Forwards, before is the merge over control predecessors' after; backwards, over successors'. Nodes
    without any start from ``initial``. All nodes of a round use the values of the last one. A round
    only computes the nodes that what changed in the last one leads to, and writes those that change.
    """
    give, take = ("dst", "src") if backwards else ("src", "dst")
    edges = keep(graph.edges.where("etype = 'CONTROL'").select("graph_id", F.col(give).alias("give"), F.col(take).alias("take")).distinct())
    nodes = keep(graph.nodes)
    text = lambda *c: F.to_json(F.struct(*c))
    first, n = keep_counted(nodes.withColumn("before", analysis.initial).withColumn("after", analysis.flow(F.col("before"))).select(*KEY, "before", "after"))
    states = Latest(KEY, first, n)
    #: All nodes with a giver are computed in the first round; later those whose givers changed.
    given, moved = edges, None
    for _ in range(rounds):
        if moved is not None:
            todo = edges.join(moved, ["graph_id", "give"], "left_semi").select("graph_id", "take").distinct()
            given = edges.join(todo, ["graph_id", "take"], "left_semi")
        after = states.of(None if moved is None else given.select("graph_id", F.col("give").alias("node_id")))
        met = given.join(after.select("graph_id", F.col("node_id").alias("give"), "after"), ["graph_id", "give"])
        met = met.groupBy("graph_id", F.col("take").alias("node_id")).agg(analysis.merge(F.col("after")).alias("before"))
        new = nodes.join(met, KEY).withColumn("after", analysis.flow(F.col("before"))).select(*KEY, "before", "after")
        old = states.of(None if moved is None else given.select("graph_id", F.col("take").alias("node_id")))
        new = new.join(old.select(*KEY, text("before", "after").alias("old"), F.col("after").alias("was")), KEY).where(text("before", "after") != F.col("old"))
        new, n = keep_counted(new.select(*KEY, "before", "after", (text("after") != F.to_json(F.struct(F.col("was").alias("after")))).alias("moved")))
        if not n:
            forget(edges, nodes, new)
            return states.close()
        moved = new.where("moved").select("graph_id", F.col("node_id").alias("give"))
        states.add(kept_as(new.drop("moved"), new), n)
    raise RuntimeError(f"not stable after {rounds} rounds")


def forwards(graph: PropertyGraph, analysis: Analysis, rounds: int = 10_000) -> DataFrame:
    return run(graph, analysis, False, rounds)


def backwards(graph: PropertyGraph, analysis: Analysis, rounds: int = 10_000) -> DataFrame:
    return run(graph, analysis, True, rounds)


def gather_types(wanted: list[str], backwards_: bool = False) -> Analysis:
    """Set analysis: the names of ``wanted`` types among the nodes that a path passes."""
    own = F.filter(F.array(*(F.lit(t) for t in wanted)), lambda t: F.array_contains(F.col("types"), t))
    return Analysis(F.array().cast("array<string>"), union_of_sets, lambda before: F.sort_array(F.array_union(before, own)))
