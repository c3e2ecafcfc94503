"""Patterns as join plans.

Each vertex is a filtered scan of nodes, each edge a filtered, distinct scan of edges; the plan
joins them along the connected pattern, and an edge between two bound vertices is a join on both
ends. So matches are homomorphisms (two vertices may be the same node), parallel edges don't
multiply them, and the order and kind of joins are Catalyst's to choose. A vertex that matches
anything isn't joined with nodes: the ends of edges are taken to be nodes.

A * edge u -> w binds w to a path: the nodes after u, none for the empty path. Other edges of w
start where the path ends; w's predicate holds for every node of the path, and isn't asked of u.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import EdgeTarget, NodeTarget, always, to_column
from ..model import PropertyGraph
from ..operators import paths
from .pattern import Edge, Pattern, PatternError, Vertex, read_pattern

G = "graph_id"


@dataclass(frozen=True)
class Sizes:
    """How many nodes satisfy each vertex's predicate, and how many edges each edge's."""

    vertices: dict[str, int]
    edges: dict[Edge, int]


def sizes(graph: PropertyGraph, pattern: Pattern) -> Sizes:
    """Counted in one scan of the nodes and one of the edges."""
    found = {r["vertex"]: r["n"] for r in candidates(graph, pattern).collect()}
    each = list(dict.fromkeys(pattern.edges))
    counts = graph.edges.agg(*(F.count_if(F.coalesce(to_column(e.predicate, EdgeTarget()), F.lit(False))).alias(f"e{k}") for k, e in enumerate(each))).first() if each else []
    return Sizes(found, {e: counts[k] for k, e in enumerate(each)})


def join_order(pattern: Pattern, by: Sizes | None = None) -> list[Edge]:
    """The edges, each with an end that is bound before: closing edges first, then * edges from
    their source, then other edges, and * edges from their end as a last resort.

    With sizes, the start is the vertex of the fewest candidates, and of edges of the same kind the one comes first that
    leaves the fewest rows for each bound node: its edges by that node's candidates, times the share of the other end's."""
    kleene = pattern.kleene
    plain = [v for v in pattern.vertices if v not in kleene] or list(pattern.vertices)
    start = min(plain, key=by.vertices.__getitem__) if by else plain[0]
    bound, left, out = {start}, list(pattern.edges), []
    most = max(by.vertices.values(), default=1) if by else 1

    def cost(e: Edge) -> tuple[int, float]:
        star, a, b = e.predicate.options.kleene, e.source in bound, e.target in bound
        if not a and not b:
            return 9, 0.0
        known, other = (e.source, e.target) if a else (e.target, e.source)
        rows = by.edges[e] / max(by.vertices[known], 1) * by.vertices[other] / max(most, 1) if by else 0.0
        if not star:
            return 0 if a and b else 3 if other in kleene else 2, rows
        return 1 if a else 4, rows

    while left:
        e = min(left, key=cost)
        left.remove(e)
        out.append(e)
        bound |= {e.source, e.target}
    return out


def bindings(graph: PropertyGraph, pattern: Pattern, known_types: Iterable[str] | None = None, max_length: int = 32, by: Sizes | None = None) -> DataFrame:
    """graph_id and a column for each vertex, its node (of a * edge's target: the last one), and
    ``path of v`` for those; one row a match, before repeated vertices are grouped."""
    pattern.validate()
    target = NodeTarget(frozenset(known_types) if known_types is not None else None)
    kleene = pattern.kleene
    nodes = {v: graph.nodes.where(to_column(x.predicate, target)).select(G, F.col("node_id").alias(v)) for v, x in pattern.vertices.items()}
    plain = {v: v not in kleene and not always(x.predicate) for v, x in pattern.vertices.items()}
    order = join_order(pattern, by)
    if not order:
        return nodes[next(iter(pattern.vertices))]
    out: DataFrame | None = None
    bound: set[str] = set()
    for e in order:
        edge = to_column(e.predicate, EdgeTarget())
        if e.predicate.options.kleene:
            if out is None:
                out, bound = nodes[e.source], {e.source}
            if e.source in bound:
                starts = out.select(G, F.col(e.source).alias("start")).distinct()
            else:
                starts = nodes[e.source].select(G, F.col(e.source).alias("start"))
            inner = pattern.vertices[e.target].predicate
            step = paths.simple_paths(graph, starts, edge, None if always(inner) else to_column(inner, target), max_length)
            step = step.select(G, F.col("start").alias(e.source), F.col("path").alias(f"path of {e.target}"), F.col("last").alias(e.target))
        else:
            step = graph.edges.where(edge)
            if e.source == e.target:
                step = step.where("src = dst").select(G, F.col("src").alias(e.source)).distinct()
            else:
                step = step.select(G, F.col("src").alias(e.source), F.col("dst").alias(e.target)).distinct()
        fresh = [v for v in dict.fromkeys((e.source, e.target)) if v not in bound and plain[v]]
        for v in fresh:
            step = step.join(nodes[v], [G, v], "left_semi")
        both = [v for v in dict.fromkeys((e.source, e.target)) if v in bound]
        out = step if out is None else out.join(step, [G, *both])
        bound |= {e.source, e.target}
    return out


def match(graph: PropertyGraph, pattern: Pattern | str, bag: bool = False, known_types: Iterable[str] | None = None, max_length: int = 32, ends: bool = False, by_counts: bool = False) -> DataFrame:
    """The matches of a pattern: graph_id and one column a vertex, distinct.

    A plain vertex is its node id, the target of a * edge the array of its path, a repeated vertex the
    sorted array of all nodes it binds to given the others (with ``bag``, once for each match of the
    others' row, paths in full). ``ends`` keeps ``last of v`` for * edges' targets. ``by_counts`` counts candidates first (a job) and joins
    from the rarest vertex on; without, from the first one.

    Bindings need no distinct: each step is a set over its vertices, and all vertices are kept (a path and
    its start determine its last node). Repeated vertices that only touch plain ones are grouped by these,
    each for itself, before they are joined, so they never multiply each other.
    """
    pattern = read_pattern(pattern) if isinstance(pattern, str) else pattern
    pattern.validate()
    kleene, repeated = pattern.kleene, pattern.repeated
    core, by = core_of(pattern), sizes(graph, pattern) if by_counts else None
    if core:
        rows = bindings(graph, core, known_types, max_length, by)
        for v in repeated:
            near = sorted(pattern.neighbours(v))
            star = Pattern({v: pattern.vertices[v]} | {x: Vertex(x) for x in near}, tuple(e for e in pattern.edges if v in (e.source, e.target)))
            many = bindings(graph, star, known_types, max_length).groupBy(G, *(f"`{x}`" for x in near)).agg((F.collect_list if bag else F.collect_set)(f"`{v}`").alias(v))
            rows = rows.join(many, [G, *near])
        for v in repeated:
            times = [F.size(f"`{x}`") for x in repeated if x != v]
            value = F.flatten(F.array_repeat(F.col(f"`{v}`"), functools.reduce(operator.mul, times))) if bag and times else F.col(f"`{v}`")
            rows = rows.withColumn(f"all of {v}", F.sort_array(value))
    else:
        rows = bindings(graph, pattern, known_types, max_length, by)
    cols = [F.col(f"`all of {v}`").alias(v) if core and v in repeated else F.col(f"`path of {v}`").alias(v) if v in kleene else F.col(f"`{v}`") for v in pattern.vertices]
    lasts = [F.col(f"`{v}`").alias(f"last of {v}") for v in kleene if ends]
    rows = rows.select(G, *cols, *lasts)
    if core or not repeated:
        return rows
    keys = [c for c in rows.columns if c not in repeated and c not in [f"last of {v}" for v in repeated]]
    collect = []
    for v in repeated:
        many = F.collect_list(f"`{v}`") if bag else F.collect_set(f"`{v}`")
        if v in kleene:
            many = F.flatten(F.collect_list(f"`{v}`")) if bag else F.array_distinct(F.flatten(F.collect_list(f"`{v}`")))
        collect.append(F.sort_array(many).alias(v))
    return rows.groupBy(*(f"`{k}`" for k in keys)).agg(*collect)


def core_of(pattern: Pattern) -> Pattern | None:
    """The pattern without its repeated vertices, if they only touch plain ones by plain edges and the rest holds together without them."""
    repeated = set(pattern.repeated)
    mine = [e for e in pattern.edges if {e.source, e.target} & repeated]
    plain = all(not e.predicate.options.kleene and len({e.source, e.target} & repeated) == 1 and e.source != e.target and not {e.source, e.target} & set(pattern.kleene) for e in mine)
    if not repeated or not plain:
        return None
    core = Pattern({v: x for v, x in pattern.vertices.items() if v not in repeated}, tuple(e for e in pattern.edges if e not in mine), pattern.name)
    try:
        core.validate()
    except PatternError:
        return None
    return core


def captured(matches: DataFrame, pattern: Pattern | str) -> DataFrame:
    """Only the captured vertices of matches, by their capture names."""
    pattern = read_pattern(pattern) if isinstance(pattern, str) else pattern
    return matches.select(G, *(F.col(f"`{v}`").alias(name) for name, v in pattern.captures.items()))


def match_all(graph: PropertyGraph, patterns: dict[str, Pattern | str], **how) -> dict[str, DataFrame]:
    """A batch of patterns over one graph; they share its scans, and its cache if it is cached."""
    return {name: match(graph, p, **how) for name, p in patterns.items()}


def candidates(graph: PropertyGraph, pattern: Pattern | str) -> DataFrame:
    """vertex, n: how many nodes satisfy each vertex's predicate, all in one scan."""
    pattern = read_pattern(pattern) if isinstance(pattern, str) else pattern
    counts = [F.sum(to_column(x.predicate, NodeTarget()).cast("long")).alias(v) for v, x in pattern.vertices.items()]
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("vertex"), F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias("n")) for v in pattern.vertices)))
    return graph.nodes.agg(*counts).select(rows.alias("r")).select("r.*")
