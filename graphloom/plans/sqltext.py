"""Patterns as SQL text: a second compiler, for any engine with the tables nodes and edges.

The text is one SELECT over the relations that predicates leave of each vertex and edge, with a
recursive CTE for each * edge (whose depth is bounded by the distinct nodes of a path). It reads
nodes(graph_id, node_id, types, ...) and edges(graph_id, src, dst, etype, eclass, label).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions.predicates import CONSTANTS, METHOD, And, Call, Equals, Field, Literal, Mismatch, Name, Node, Not, Or, Predicate, PredicateError, type_of
from ..model import PropertyGraph
from .pattern import Pattern, read_pattern
from .planner import join_order


def literal(value: int | str) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def expression(x: Node, edge: bool) -> str:
    match x:
        case Literal(value):
            return literal(value)
        case Name(name):
            value = CONSTANTS[name][1]
            return str(value).upper() if isinstance(value, bool) else str(value)
        case Field(Call(Name("method"), ()), name) if not edge:
            return {"className": "method_class", "name": "method_name"}[name]
        case Call(Name("is"), (Literal(name),)):
            if not edge:
                return f"coalesce(array_contains(types, {literal(name)}), FALSE)"
            if name in ("DATA", "CONTROL", "ASSOCIATED"):
                return f"coalesce(etype = {literal(name)}, FALSE)"
            return f"coalesce(etype = 'EXTRA' AND eclass = {literal(name)}, FALSE)"
        case Call(Name("name"), ()) if edge:
            return "label"
        case Equals(left, _) if type_of(left) == METHOD:
            return "(method_class IS NOT NULL AND method_name IS NOT NULL)"
        case Equals(left, right):
            return f"coalesce({expression(left, edge)} = {expression(right, edge)}, FALSE)"
        case Not(value):
            return f"(NOT {expression(value, edge)})"
        case And(left, right):
            return f"({expression(left, edge)} AND {expression(right, edge)})"
        case Or(left, right):
            return f"({expression(left, edge)} OR {expression(right, edge)})"
    raise PredicateError(f"{x} has no value {'for an edge' if edge else 'for a node'}")


def condition(p: Predicate, edge: bool) -> str:
    try:
        type_of(p.body)
    except Mismatch:
        return "FALSE"
    return expression(p.body, edge)


def to_sql(pattern: Pattern | str, nodes: str = "nodes", edges: str = "edges") -> str:
    """One row a match; paths and repeated vertices are arrays, as ``planner.match`` gives them. ``nodes``, ``edges``: names of the tables.

    An engine may bound recursion: Spark stops with an error beyond 100 levels or 1,000,000 rows of a * edge
    (spark.sql.cteRecursionLevelLimit, spark.sql.cteRecursionRowLimit), where ``planner.match`` goes on.
    """
    pattern = read_pattern(pattern) if isinstance(pattern, str) else pattern
    pattern.validate()
    number = {v: k for k, v in enumerate(pattern.vertices)}
    ctes, kleene, repeated = [], pattern.kleene, pattern.repeated
    for v, x in pattern.vertices.items():
        ctes.append(f"v{number[v]} AS (SELECT graph_id, node_id FROM {nodes} WHERE {condition(x.predicate, False)})")
    for k, e in enumerate(pattern.edges):
        ctes.append(f"e{k} AS (SELECT DISTINCT graph_id, src, dst FROM {edges} WHERE {condition(e.predicate, True)})")
        if e.predicate.options.kleene:
            w = f"v{number[e.target]}"
            start = f"v{number[e.source]}" if e.source not in kleene else nodes
            ctes.append(
                f"p{k} AS (SELECT graph_id, node_id AS start, CAST(array() AS ARRAY<BIGINT>) AS path, node_id AS last FROM {start} UNION ALL "
                f"SELECT p.graph_id, p.start, array_append(p.path, e.dst), e.dst FROM p{k} p JOIN e{k} e ON e.graph_id = p.graph_id AND e.src = p.last "
                f"JOIN {w} w ON w.graph_id = e.graph_id AND w.node_id = e.dst WHERE NOT array_contains(p.path, e.dst))"
            )
    bound: dict[str, str] = {}
    parts, where, graph = [], [], ""
    index = {id(e): k for k, e in enumerate(pattern.edges)}

    def bind(v: str, value: str) -> None:
        if v in bound:
            where.append(f"{bound[v]} = {value}")
        else:
            bound[v] = value
            if v not in kleene:
                alias = f"n{number[v]}"
                parts.append(f"v{number[v]} {alias}")
                where.append(f"{alias}.node_id = {value} AND {alias}.graph_id = {graph}")

    if not pattern.edges:
        v = next(iter(pattern.vertices))
        parts.append("v0 n0")
        bound[v], graph = "n0.node_id", "n0.graph_id"
    for e in join_order(pattern):
        k = index[id(e)]
        alias = f"{'q' if e.predicate.options.kleene else 's'}{k}"
        first = not parts
        parts.append(f"{'p' if e.predicate.options.kleene else 'e'}{k} {alias}")
        graph = graph or f"{alias}.graph_id"
        if not first:
            where.append(f"{alias}.graph_id = {graph}")
        bind(e.source, f"{alias}.{'start' if e.predicate.options.kleene else 'src'}")
        bind(e.target, f"{alias}.{'last' if e.predicate.options.kleene else 'dst'}")
    columns = [f"q{index[id(kleene[v])]}.path AS `{v}`" if v in kleene else f"{bound[v]} AS `{v}`" for v in pattern.vertices]
    body = f"SELECT DISTINCT {graph} AS graph_id, {', '.join(columns)} FROM {', '.join(parts)}" + (f" WHERE {' AND '.join(where)}" if where else "")
    if repeated:
        keys = ["graph_id", *(f"`{v}`" for v in pattern.vertices if v not in repeated)]
        sets = [f"sort_array({f'array_distinct(flatten(collect_list(`{v}`)))' if v in kleene else f'collect_set(`{v}`)'}) AS `{v}`" for v in repeated]
        body = f"SELECT {', '.join(keys + sets)} FROM ({body}) GROUP BY {', '.join(keys)}"
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body


def match_by_sql(graph: PropertyGraph, pattern: Pattern | str) -> DataFrame:
    """``planner.match`` by way of the text, over views of names of their own, which go once the text is analysed."""
    spark, own = graph.nodes.sparkSession, uuid.uuid4().hex
    nodes, edges = f"nodes_{own}", f"edges_{own}"
    try:
        graph.nodes.createTempView(nodes)
        graph.edges.createTempView(edges)
        return spark.sql(to_sql(pattern, nodes, edges))
    finally:
        spark.catalog.dropTempView(nodes)
        spark.catalog.dropTempView(edges)
