import itertools
import random

import pytest
from graphloom.model import PropertyGraph
from graphloom.plans.pattern import PatternError, read_pattern
from graphloom.plans.planner import captured, match
from graphloom.plans.sqltext import match_by_sql


def test_read_and_export():
    text = """digraph Query { // comment
      rankdir = LR; node [shape=box];
      "a" [label="(?P<x>)|is('A')", color="red"]; b [ label = "[]|is(\\"B\\")" ];
      a -> b [label="*|is('DATA')"]; b -> c -> d; }"""
    p = read_pattern(text)
    assert list(p.vertices) == ["a", "b", "c", "d"] and len(p.edges) == 3
    assert p.captures == {"x": "a"} and p.repeated == ["b"] and list(p.kleene) == ["b"]
    again = read_pattern(p.export())
    assert again == p and again.export() == p.export()


@pytest.mark.parametrize("text", ["graph { a }", "digraph { a", "digraph { a -> }", "digraph { subgraph x }", "digraph { a [label=\"\"] }"])
def test_unreadable(text):
    with pytest.raises(ValueError):
        read_pattern(text)


@pytest.mark.parametrize("body", ["a; b", 'a [label="[]|true"]', 'a -> c [label="*|"]; b -> c [label="*|"]; a -> b', 'a -> a [label="*|"]'])
def test_invalid(body):
    with pytest.raises(PatternError):
        read_pattern("digraph {" + body + "}").validate()


def brute(nodes, edges, pattern):
    """Matches by enumeration: {tuple of bindings}; a * edge's target binds a path."""
    types = dict(nodes)
    holds = lambda v, n: pattern[0][v] is None or pattern[0][v] in types[n]
    hop = lambda label: {(s, d) for s, d, _, x in edges if label is None or x == label}
    star = {w for u, w, label, k in pattern[1] if k}

    def paths(start, label, w):
        out, todo = [()], [()]
        while todo:
            p = todo.pop()
            for s, d in hop(label):
                if s == (p[-1] if p else start) and d not in p and holds(w, d):
                    out.append((*p, d)), todo.append((*p, d))
        return out

    names, found = list(pattern[0]), set()
    plain = [v for v in names if v not in star]
    order = [e for e in pattern[1] if e[3]]
    for values in itertools.product(*([n for n in types if holds(v, n)] for v in plain)):
        todo = [({**dict(zip(plain, values, strict=True))}, {})]
        left = list(order)
        while left:
            e = next((x for x in left if x[0] in todo[0][0]), None) if todo else None
            if e is None:
                break
            left.remove(e)
            todo = [({**b, e[1]: p[-1] if p else b[e[0]]}, {**ps, e[1]: p}) for b, ps in todo for p in paths(b[e[0]], e[2], e[1])]
        for b, ps in todo:
            if all((b[u], b[w]) in hop(label) for u, w, label, k in pattern[1] if not k):
                found.add(tuple(ps.get(v, b[v]) for v in names))
    return found


def as_dot(pattern):
    v = "".join(f"{n} [label=\"{'true' if t is None else f'is({chr(39)}{t}{chr(39)})'}\"];" for n, t in pattern[0].items())
    e = "".join(f"{a} -> {b} [label=\"{'*|' if k else ''}{'true' if x is None else f'name() = {chr(39)}{x}{chr(39)}'}\"];" for a, b, x, k in pattern[1])
    return "digraph {" + v + e + "}"


def got(df, pattern):
    return {tuple(tuple(r[v]) if isinstance(r[v], list) else r[v] for v in pattern[0]) for r in df.collect()}


def cases():
    rnd = random.Random(7)
    for _ in range(14):
        n = rnd.randint(2, 4)
        nodes = [(i, [rnd.choice("AB")]) for i in range(n)]
        edges = [(rnd.randrange(n), rnd.randrange(n), "DATA", rnd.choice("ab")) for _ in range(rnd.randint(1, 7))]
        k = rnd.randint(1, 4)
        names = [f"v{i}" for i in range(k)]
        links = []
        for i in range(1, k):
            a, b = names[rnd.randrange(i)], names[i]
            star = rnd.random() < 0.4
            links.append((a, b, rnd.choice(["a", "b", None]), star) if star or rnd.random() < 0.7 else (b, a, rnd.choice(["a", None]), False))
        for _ in range(rnd.randint(0, 1)):
            links.append((rnd.choice(names), rnd.choice(names), rnd.choice(["a", None]), False))
        yield nodes, edges, ({v: rnd.choice(["A", "B", None]) for v in names}, links)


FIXED = [
    # a path that is also entered by a normal edge keeps its own nodes: none here
    ([(0, ["A"]), (1, ["B"])], [(0, 1, "DATA", "a")], ({"v0": "A", "v1": "B", "v2": "A"}, [("v0", "v1", None, False), ("v0", "v2", "b", True), ("v2", "v1", None, False)])),
    # two chained paths, both empty
    ([(1, ["B"]), (3, ["B"])], [(3, 1, "DATA", "a")], ({"v0": "B", "v1": "A", "v2": "A", "v3": "B"}, [("v0", "v1", None, True), ("v1", "v2", None, True), ("v2", "v3", "a", False)])),
]


@pytest.mark.parametrize("nodes, edges, pattern", [*FIXED, *cases()])
def test_against_enumeration(spark, nodes, edges, pattern):
    graph, want = PropertyGraph.local(spark, nodes, edges), brute(nodes, edges, pattern)
    assert got(match(graph, as_dot(pattern)), pattern) == want
    if not any(k for *_, k in pattern[1]):
        assert got(match_by_sql(graph, as_dot(pattern)), pattern) == want


def test_fixed_answers(spark):
    for (nodes, edges, pattern), want in zip(FIXED, [{(0, 1, ())}, {(3, (), (), 1)}], strict=True):
        assert brute(nodes, edges, pattern) == want


def test_paths_by_sql(spark):
    nodes, edges = [(i, ["A"]) for i in range(4)], [(0, 1, "DATA", "a"), (1, 2, "DATA", "a"), (2, 0, "DATA", "a"), (2, 3, "DATA", "a")]
    pattern = ({"u": None, "w": "A", "x": None}, [("u", "w", "a", True), ("w", "x", None, False)])
    graph = PropertyGraph.local(spark, nodes, edges)
    assert got(match_by_sql(graph, as_dot(pattern)), pattern) == brute(nodes, edges, pattern) == got(match(graph, as_dot(pattern)), pattern)


def test_repeated(spark):
    graph = PropertyGraph.local(spark, [(1, ["A"]), (2, ["A"]), (3, ["B"]), (4, ["C"])], [(1, 3, "DATA", "x"), (2, 3, "DATA", "x"), (1, 3, "CONTROL", "y"), (3, 4, "DATA", "z")])
    p = "digraph { s [label=\"[](?P<many>)|is('A')\"]; t [label=\"(?P<one>)|is('B')\"]; s -> t }"
    assert [(r.s, r.t) for r in match(graph, p).collect()] == [([1, 2], 3)]
    assert [r.asDict() for r in captured(match(graph, p), p).collect()] == [{"graph_id": 0, "many": [1, 2], "one": 3}]
    both = "digraph { s [label=\"[]|is('A')\"]; t [label=\"is('B')\"]; c [label=\"[]|is('C')\"]; s -> t; t -> c }"
    assert [(r.s, r.t, r.c) for r in match(graph, both, bag=True).collect()] == [([1, 2], 3, [4, 4])]
    assert [(r.s, r.t, r.c) for r in match(graph, both).collect()] == [([1, 2], 3, [4])]
    assert match(graph, "digraph { s [label=\"[]|is('D')\"]; t; s -> t }").count() == 0
    assert [(r.s, r.t) for r in match_by_sql(graph, p).collect()] == [([1, 2], 3)]


def test_graphs_apart(spark):
    a = PropertyGraph.local(spark, [(1, ["A"]), (2, ["B"])], [(1, 2, "DATA", "x")])
    from pyspark.sql import functions as F

    two = PropertyGraph(a.nodes.unionByName(a.nodes.withColumn("graph_id", F.lit(9).cast("long"))), a.edges.withColumn("graph_id", F.lit(9).cast("long")))
    assert [tuple(r) for r in match(two, "digraph { a -> b }").collect()] == [(9, 1, 2)]


def test_order_by_counts(spark):
    """The rarest vertex is the start, then the edges that leave the fewest rows; the matches stay the same."""
    from graphloom.plans.pattern import read_pattern
    from graphloom.plans.planner import join_order, match, sizes

    nodes = [(i, ["Many"]) for i in range(60)] + [(100 + i, ["Some"]) for i in range(6)] + [(200, ["Rare"])]
    edges = [(i, 100 + i % 6, "DATA", "in") for i in range(60)] + [(100 + i, 200, "DATA", "up") for i in range(6)] + [(i, (i + 1) % 60, "DATA", "near") for i in range(60)]
    g = PropertyGraph.local(spark, nodes, edges)
    p = read_pattern("""digraph { m [label="is('Many')"]; k [label="is('Many')"]; s [label="is('Some')"]; r [label="is('Rare')"]; m -> k [label="name() = 'near'"]; m -> s [label="name() = 'in'"]; s -> r [label="name() = 'up'"] }""")
    by = sizes(g, p)
    assert by.vertices == {"m": 60, "k": 60, "s": 6, "r": 1} and sorted(by.edges.values()) == [6, 60, 60]
    assert [(e.source, e.target) for e in join_order(p, by)] == [("s", "r"), ("m", "s"), ("m", "k")]
    assert [(e.source, e.target) for e in join_order(p)][0] == ("m", "k")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(match(g, p, by_counts=True)) == rows(match(g, p)) and len(rows(match(g, p))) == 60
    starred = """digraph { m [label="is('Many')"]; s [label="[]|is('Some')"]; r [label="is('Rare')"]; m -> s [label="name() = 'in'"]; s -> r [label="*|name() = 'up'"] }"""
    assert rows(match(g, starred, by_counts=True)) == rows(match(g, starred))
