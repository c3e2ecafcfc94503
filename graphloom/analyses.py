"""Analyses made of patterns: what the fields of allocated objects point to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import PropertyGraph
from .operators.kept import keep
from .operators.prune import resolve_placeholders
from .plans.planner import captured, match

#: Node types that only pass a value on, and node types that are no values.
PASSING = ("PiNode", "VirtualInstanceNode", "ValuePhiNode", "VirtualObjectState", "MaterializedObjectState")
NO_VALUES = ("PiNode", "VirtualInstanceNode", "ValuePhiNode", "BeginNode", "MergeNode", "EndNode", "FrameState", "VirtualObjectState", "MaterializedObjectState")


def commits(graph: PropertyGraph) -> DataFrame:
    """graph_id, commit, object: the allocated objects that each commit of allocations makes real."""
    pattern = """digraph { c [label="(?P<commit>)|is('CommitAllocationNode')"]; o [label="(?P<object>)|is('AllocatedObjectNode')"]; c -> o [label="name() = 'commit'"] }"""
    return captured(match(graph, pattern), pattern).distinct()


def points_to(graph: PropertyGraph, field: str = "field", passing: tuple[str, ...] = PASSING, no_values: tuple[str, ...] = NO_VALUES) -> DataFrame:
    """graph_id, object, field, target: the values that stores put into fields of allocated objects.

    A store node has a ``value`` and an ``object`` edge into it, a load an ``object`` edge; both name their field
    in attrs[``field``]. A value reaches its store through any number of passing nodes. A stored load stands for
    all that its objects' field holds, whatever the order; loads of each other end in nothing.
    """
    either = lambda types: " or ".join(f"is('{t}')" for t in types)
    stored = f"""digraph {{ value [label="(?P<value>)|not ({either(dict.fromkeys((*passing, *no_values)))})"]; nop [label="{either(passing)}"]; store [label="(?P<node>)|is('StoreFieldNode')"];
        value -> nop [label="*|is('DATA')"]; nop -> store [label="name() = 'value'"] }}"""
    held = f"""digraph {{ alloc [label="(?P<object>)|is('AllocatedObjectNode')"]; nop [label="{either(passing)}"]; at [label="(?P<node>)|is('StoreFieldNode') or is('LoadFieldNode')"];
        alloc -> nop [label="*|is('DATA')"]; nop -> at [label="name() = 'object'"] }}"""
    values = captured(match(graph, stored), stored).distinct()
    named = graph.nodes.select("graph_id", F.col("node_id").alias("node"), F.col("attrs")[field].alias("field"), F.array_contains("types", "LoadFieldNode").alias("load"))
    places = captured(match(graph, held), held).distinct().join(named, ["graph_id", "node"])
    fields = places.select("graph_id", "node", "object", "field")
    inner = fields.select("graph_id", F.col("node").alias("value"), F.col("object").alias("from_object"), F.col("field").alias("from_field"))
    loads = named.where("load").select("graph_id", F.col("node").alias("value"), F.lit(True).alias("is_load"))
    puts = values.join(fields, ["graph_id", "node"]).join(loads, ["graph_id", "value"], "left").join(inner, ["graph_id", "value"], "left")
    #: Kept, as edges, placeholders and the result all read it; the graph isn't read any more after this.
    puts = keep(puts.where("is_load IS NULL OR from_object IS NOT NULL"))
    #: A field is a placeholder; what asks for it is a node of its own that points to it.
    mark = lambda *by: F.xxhash64("graph_id", *by)
    asks = F.xxhash64("graph_id", "object", "field", F.lit("asks"))
    target = F.when(F.col("is_load"), mark("from_object", "from_field")).otherwise(F.xxhash64("graph_id", "value", F.lit("node")))
    edges = puts.select(asks.alias("src"), mark("object", "field").alias("dst")).unionByName(puts.select(mark("object", "field").alias("src"), target.alias("dst")))
    marks = puts.select(mark("object", "field").alias("node_id")).unionByName(puts.where("is_load").select(mark("from_object", "from_field").alias("node_id")))
    found = resolve_placeholders(edges, marks)
    owners = puts.select("graph_id", "object", "field", asks.alias("src")).distinct()
    ends = puts.where("is_load IS NULL").select(F.col("value").alias("target"), target.alias("dst")).distinct()
    return found.join(owners, "src").join(ends, "dst").select("graph_id", "object", "field", "target").distinct()
