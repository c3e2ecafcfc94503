"""Property graphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "graph_id long, node_id long, kind string, types array<string>, name string, method_class string, method_name string, const_value string, param_index int, attrs map<string,string>"
EDGES = "graph_id long, eid long, src long, dst long, etype string, eclass string, label string, phi_from long"


def columns(schema: str) -> dict[str, str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return dict(x.strip().split(" ", 1) for x in [*out, part])


def shaped(df: DataFrame, schema: str, defaults: dict) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones get their default or null."""
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(defaults.get(c)).cast(t).alias(c) for c, t in columns(schema).items()))


@dataclass(frozen=True)
class PropertyGraph:
    """nodes and edges of any number of graphs, told apart by graph_id. Node ids are unique in a graph.

    kind: IR or SPECIFIC (derived facts). types: all type names of a node, super-types too. etype: DATA,
    CONTROL, ASSOCIATED or EXTRA, the last with the class name in eclass. Parallel edges and loops are allowed.
    """

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """From tables with some of the columns: node_id and types, src and dst are needed."""
        return PropertyGraph(shaped(nodes, NODES, {"graph_id": 0, "kind": "IR"}), shaped(edges, EDGES, {"graph_id": 0, "etype": "DATA", "label": ""}))

    @staticmethod
    def local(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> PropertyGraph:
        """From lists: (node_id, [types]) and (src, dst, etype, label)."""
        n = spark.createDataFrame([(i, list(t)) for i, t in nodes], "node_id long, types array<string>")
        e = spark.createDataFrame([(k, *x) for k, x in enumerate(edges)], "eid long, src long, dst long, etype string, label string")
        return PropertyGraph.of(n, e.withColumn("eclass", F.when(~F.col("etype").isin("DATA", "CONTROL", "ASSOCIATED"), F.col("etype"))).withColumn("etype", F.when(F.col("eclass").isNull(), F.col("etype")).otherwise("EXTRA")))

    def find(self, node_id: int) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def adjacent(self, node_id: int, label: str | None = None, etype: str | None = None, incoming: bool = False) -> DataFrame:
        """The edges into or out of a node, by label and kind."""
        out = self.edges.where(F.col("dst" if incoming else "src") == node_id)
        out = out.where(F.col("label") == label) if label is not None else out
        return out.where(F.col("etype") == etype) if etype is not None else out

    def degrees(self) -> DataFrame:
        """graph_id, node_id, n_in, n_out, control_in, control_out."""
        control = (F.col("etype") == "CONTROL").cast("long")
        ends = self.edges.select("graph_id", F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"), control.alias("ci"), F.lit(0).alias("co")).unionByName(
            self.edges.select("graph_id", F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("ci"), control.alias("co"))
        )
        return ends.groupBy("graph_id", "node_id").agg(*(F.sum(c).cast("long").alias(n) for c, n in (("i", "n_in"), ("o", "n_out"), ("ci", "control_in"), ("co", "control_out"))))
