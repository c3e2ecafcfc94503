"""Compiler IR as a property graph: classification of raw successor and usage tables.

successors: graph_id, src, dst, position (null: unnamed). usages: graph_id, src (the value), dst
(its user), input (the name of the user's input). nodes: node_id with types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph, shaped

#: Names of node types that decide the kind of a usage.
END, EXIT, VALUE_PHI, VALUE_PROXY, FRAME, ENDNODE = "LoopEndNode", "LoopExitNode", "ValuePhiNode", "ValueProxyNode", "FrameState", "EndNode"


def has(types: str, name: str):
    return F.coalesce(F.array_contains(types, name), F.lit(False))


def successor_edges(successors: DataFrame) -> DataFrame:
    return successors.select("graph_id", "src", "dst", F.lit("CONTROL").alias("etype"), F.coalesce("position", F.lit("next")).alias("label"), F.lit(None).cast("long").alias("phi_from"))


def usage_edges(usages: DataFrame, nodes: DataFrame, values: str = "values") -> DataFrame:
    """One edge a usage, two for a loop's end, none for an end node's use as an end.

    loopBegin of a LoopEnd: CONTROL "next" backwards and ASSOCIATED; loopBegin of a LoopExit: ASSOCIATED;
    values of a ValuePhi: DATA "from <id>", where ``from`` is the predecessor the value comes from
    (column phi_from of usages); values of a FrameState: ASSOCIATED; an EndNode among ends: dropped; a
    FrameState as stateAfter, the merge of a ValuePhi, and every input of a ValueProxy but its value:
    ASSOCIATED; else DATA with the input's name.
    """
    kinds = lambda end, name: nodes.select("graph_id", F.col("node_id").alias(end), F.col("types").alias(name))
    u = usages.join(kinds("dst", "user"), ["graph_id", "dst"], "left").join(kinds("src", "used"), ["graph_id", "src"], "left")
    u = u.withColumn("phi_from", F.col("phi_from").cast("long") if "phi_from" in usages.columns else F.lit(None).cast("long"))
    name = F.col("input")
    associated = F.struct("src", "dst", F.lit("ASSOCIATED").alias("etype"), name.alias("label"), F.lit(None).cast("long").alias("phi_from"))
    data = F.struct("src", "dst", F.lit("DATA").alias("etype"), name.alias("label"), F.lit(None).cast("long").alias("phi_from"))
    phi = F.struct("src", "dst", F.lit("DATA").alias("etype"), F.concat(F.lit("from "), F.col("phi_from").cast("string")).alias("label"), "phi_from")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("CONTROL").alias("etype"), F.lit("next").alias("label"), F.lit(None).cast("long").alias("phi_from"))
    beside = (name == "stateAfter") & has("used", FRAME) | (name == "merge") & has("user", VALUE_PHI) | (name != "value") & has("user", VALUE_PROXY)
    edges = (
        F.when((name == "loopBegin") & has("user", END), F.array(back, associated))
        .when((name == "loopBegin") & has("user", EXIT), F.array(associated))
        .when((name == values) & has("user", VALUE_PHI) & F.col("phi_from").isNotNull(), F.array(phi))
        .when((name == values) & has("user", FRAME), F.array(associated))
        .when((name == "ends") & has("used", ENDNODE), F.array().cast("array<struct<src:long,dst:long,etype:string,label:string,phi_from:long>>"))
        .when(beside, F.array(associated))
        .otherwise(F.array(data))
    )
    return u.select("graph_id", F.explode(edges).alias("e")).select("graph_id", "e.*")


def ir_graph(nodes: DataFrame, successors: DataFrame, usages: DataFrame) -> PropertyGraph:
    return PropertyGraph.of(nodes, successor_edges(successors).unionByName(usage_edges(usages, nodes)).select("graph_id", "src", "dst", "etype", "label", "phi_from"))


def source_positions(nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, method, bci, location of nodes whose attrs have a position."""
    at = lambda k: F.col("attrs")[k]
    place = F.concat_ws(":", at("src_file"), at("src_line"))
    return shaped(nodes, "graph_id long, node_id long, method_class string, method_name string, attrs map<string,string>", {"graph_id": 0}).where(at("bci").isNotNull()).select(
        "graph_id", "node_id", F.concat_ws(".", "method_class", "method_name").alias("method"), at("bci").cast("int").alias("bci"), place.alias("location")
    )


def accessors(nodes: DataFrame) -> DataFrame:
    """graph_id, node_id with is_invoke, is_constant, is_logic, is_parameter, target_method, const_value, param_index."""
    kind = lambda n: has("types", n)
    method = F.when(kind("Invoke") | F.col("method_name").isNotNull(), F.concat_ws(".", "method_class", "method_name"))
    return nodes.select(
        "graph_id", "node_id", (kind("Invoke") | kind("InvokeNode")).alias("is_invoke"), kind("ConstantNode").alias("is_constant"), kind("LogicNode").alias("is_logic"),
        kind("ParameterNode").alias("is_parameter"), method.alias("target_method"), "const_value", "param_index",
    )
