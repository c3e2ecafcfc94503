"""Exports: DOT, Datalog facts, tab-separated relations, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..plans.pattern import Pattern, read_pattern
from ..plans.planner import match

#: Fixed values of the exported text.
COLORS = {"DATA": "blue", "CONTROL": "red", "ASSOCIATED": "black", "EXTRA": "purple"}


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def node_key() -> Column:
    return F.concat(F.when(F.col("kind") == "IR", "ir").otherwise("n"), F.col("node_id").cast("string"))


def has(name: str) -> Column:
    return F.coalesce(F.array_contains("types", name), F.lit(False))


def dot_nodes(graph: PropertyGraph) -> DataFrame:
    """graph_id, node_id, line: one DOT statement a node; the shape tells its role."""
    shape = (
        F.when(F.col("kind") == "SPECIFIC", "note").when(F.col("kind") != "IR", "star").when(has("AbstractMergeNode"), "diamond").when(has("StartNode"), "house")
        .when(has("ReturnNode"), "invhouse").when(has("FixedNode"), "box").otherwise("ellipse")
    )
    label = F.coalesce("name", F.col("types")[0], F.lit(""))
    root = F.when((F.col("kind") == "IR") & has("StartNode"), ', root="true"').otherwise(', root="false"')
    return graph.nodes.select("graph_id", "node_id", F.concat(F.lit("  "), quoted(node_key()), F.lit(" [ label="), quoted(label), F.lit(', shape="'), shape, F.lit('"'), root, F.lit(" ];")).alias("line"))


def dot_edges(graph: PropertyGraph) -> DataFrame:
    """graph_id, src, dst, line: one DOT statement an edge; colour, style and weight tell its kind."""
    color = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])[F.col("etype")]
    style = F.when(F.col("etype") == "ASSOCIATED", ', style="dashed"').otherwise(', style=""')
    weight = F.when(F.col("etype") == "CONTROL", ', weight="10"').otherwise(', weight="1"')
    keys = graph.nodes.select("graph_id", "node_id", node_key().alias("key"))
    e = graph.edges.join(keys.select("graph_id", F.col("node_id").alias("src"), F.col("key").alias("a")), ["graph_id", "src"]).join(keys.select("graph_id", F.col("node_id").alias("dst"), F.col("key").alias("b")), ["graph_id", "dst"])
    line = F.concat(F.lit("  "), quoted(F.col("a")), F.lit(" -> "), quoted(F.col("b")), F.lit(" [ label="), quoted(F.coalesce("label", F.lit(""))), F.lit(', color="'), color, F.lit('"'), style, weight, F.lit(" ];"))
    return e.select("graph_id", "src", "dst", line.alias("line"))


def ir_dot_lines(graph: PropertyGraph) -> DataFrame:
    """graph_id, line: the DOT statements of raw IR: nodes by number with number and type, edges with label, colour and style."""
    number = quoted(F.col("node_id").cast("string"))
    nodes = graph.nodes.select("graph_id", F.concat(F.lit("  "), number, F.lit(" [ label="), quoted(F.concat_ws("|", F.col("node_id").cast("string"), F.col("types")[0])), F.lit(" ];")).alias("line"))
    color = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])[F.col("etype")]
    style = F.when(F.col("etype") == "ASSOCIATED", "dashed").otherwise("")
    ends = [quoted(F.col(c).cast("string")) for c in ("src", "dst")]
    line = F.concat(F.lit("  "), ends[0], F.lit(" -> "), ends[1], F.lit(" [ label="), quoted(F.coalesce("label", F.lit(""))), F.lit(", color="), quoted(color), F.lit(", style="), quoted(style), F.lit(" ];"))
    return nodes.unionByName(graph.edges.select("graph_id", line.alias("line")))


def write_dot(graph: PropertyGraph, path: str) -> None:
    """One folder of text lines a graph: header, nodes, edges, end, in this order by file name."""
    spark = graph.nodes.sparkSession
    for name, df in (("1-nodes", dot_nodes(graph).select("graph_id", "line")), ("2-edges", dot_edges(graph).select("graph_id", "line"))):
        df.write.partitionBy("graph_id").text(f"{path}/{name}")
    for name, line in (("0-head", "digraph G {"), ("3-end", "}")):
        spark.createDataFrame([(line,)], "line string").write.text(f"{path}/{name}")


def facts(graph: PropertyGraph) -> DataFrame:
    """graph_id, fact: the graph as Datalog facts. Nodes go by their first type; derived edges are "extra"."""
    label = F.coalesce(F.when(F.col("kind") == "IR", F.col("types")[0]), F.col("name"), F.col("types")[0], F.lit(""))
    nodes = graph.nodes.select("graph_id", F.concat(F.lit("Node("), F.col("node_id").cast("string"), F.lit(","), quoted(label), F.lit(").")).alias("fact"))
    kind = F.lower("etype")
    parts = [F.lit("Edge("), F.col("src").cast("string"), F.lit(","), F.col("dst").cast("string"), F.lit(","), quoted(kind), F.lit(","), quoted(F.coalesce("label", F.lit(""))), F.lit(").")]
    return nodes.unionByName(graph.edges.select("graph_id", F.concat(*parts).alias("fact")))


def write_relations(graph: PropertyGraph, path: str) -> None:
    """Node and Edge as tab-separated tables, texts quoted."""
    how = {"sep": "\t", "quoteAll": "true"}
    graph.nodes.select("graph_id", "node_id", F.coalesce("name", F.lit("")).alias("label")).write.options(**how).csv(f"{path}/Node")
    graph.edges.select("graph_id", "src", "dst", "etype", F.coalesce("label", F.lit("")).alias("label")).write.options(**how).csv(f"{path}/Edge")


def match_points(matches: DataFrame, pattern: Pattern | str, graph: PropertyGraph) -> DataFrame:
    """graph_id, match_id, queryVertexName, query, irVertexId, vertexName: a row for each node of each match.

    match_id is a hash of the match's bindings; irVertexId is null for derived nodes.
    """
    pattern = read_pattern(pattern) if isinstance(pattern, str) else pattern
    arrays = dict(matches.dtypes)
    as_array = lambda v: F.col(f"`{v}`") if arrays[v].startswith("array") else F.array(f"`{v}`")
    points = [F.struct(F.lit(v).alias("queryVertexName"), F.lit(str(x.predicate)).alias("query"), as_array(v).alias("ids")) for v, x in pattern.vertices.items()]
    rows = matches.select("graph_id", F.xxhash64(*(F.to_json(F.struct(as_array(v).alias("x"))) for v in pattern.vertices)).alias("match_id"), F.explode(F.array(*points)).alias("p"))
    rows = rows.select("graph_id", "match_id", "p.queryVertexName", "p.query", F.explode("p.ids").alias("node_id"))
    names = graph.nodes.select("graph_id", "node_id", "kind", F.coalesce("name", F.lit("")).alias("vertexName"))
    return rows.join(names, ["graph_id", "node_id"]).select("graph_id", "match_id", "queryVertexName", "query", F.when(F.col("kind") == "IR", F.col("node_id")).alias("irVertexId"), "vertexName")


def match_json(matches: DataFrame, pattern: Pattern | str, graph: PropertyGraph) -> DataFrame:
    """graph_id, match_id, json: each match's points as one JSON list."""
    fields = ("queryVertexName", "query", "irVertexId", "vertexName")
    points = match_points(matches, pattern, graph)
    return points.groupBy("graph_id", "match_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("json"))


def query_json(graph: PropertyGraph, pattern: Pattern | str, **how) -> DataFrame:
    """graph_id, json {graph: DOT, queryResults: [{vertex: [node, ...]}], queryVertices: {vertex: capture}} of each graph.

    A service call for graphs of one method's size: a graph's whole text is one value.
    """
    pattern = read_pattern(pattern) if isinstance(pattern, str) else pattern
    rows = match(graph, pattern, **how)
    arrays = dict(rows.dtypes)
    as_array = lambda v: F.transform(F.col(f"`{v}`") if arrays[v].startswith("array") else F.array(f"`{v}`"), lambda x: x.cast("string"))
    results = rows.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.to_json(F.struct(*(as_array(v).alias(v) for v in pattern.vertices))))).alias("r"))
    lines = dot_nodes(graph).select("graph_id", F.lit(0).alias("k"), "line").unionByName(dot_edges(graph).select("graph_id", F.lit(1).alias("k"), "line"))
    text = lines.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "\n").alias("t"))
    names = F.to_json(F.create_map(*[F.lit(x) for v, p in pattern.vertices.items() for x in (v, p.predicate.options.capture or "")]))
    dot = F.to_json(F.struct(F.concat(F.lit("digraph G {\n"), F.col("t"), F.lit("\n}\n")).alias("graph")))
    tail = F.concat(F.lit(',"queryResults":['), F.array_join(F.coalesce("r", F.array().cast("array<string>")), ","), F.lit('],"queryVertices":'), names, F.lit("}"))
    return text.join(results, "graph_id", "left").select("graph_id", F.concat(F.regexp_replace(dot, r"\}$", ""), tail).alias("json"))


def control_lines(graph: PropertyGraph) -> DataFrame:
    """graph_id, node_id, line: each node with control edges, with what control leads to."""
    out = graph.edges.where("etype = 'CONTROL'").groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sort_array(F.collect_set(F.struct("dst", F.coalesce("label", F.lit("")).alias("label")))).alias("next"))
    into = graph.edges.where("etype = 'CONTROL'").select("graph_id", F.col("dst").alias("node_id")).distinct()
    rows = graph.nodes.join(out.select("graph_id", "node_id").unionByName(into).distinct(), ["graph_id", "node_id"], "left_semi").join(out, ["graph_id", "node_id"], "left")
    to = F.array_join(F.transform(F.coalesce("next", F.array().cast("array<struct<dst:bigint,label:string>>")), lambda s: F.concat(s["label"], F.lit(":"), s["dst"].cast("string"))), " ")
    return rows.select("graph_id", "node_id", F.concat(F.col("node_id").cast("string"), F.lit(" "), F.coalesce(F.col("types")[0], F.lit("")), F.lit(" -> "), to).alias("line"))
