import json
import math

import pytest
from graphloom import analyses
from graphloom.functions.predicates import EdgeTarget, to_column
from graphloom.model import PropertyGraph
from graphloom.operators import dataflow, paths, prune
from graphloom.operators.fixpoint import Attach, Rules, apply_recursively, recursive_matches
from graphloom.plans.planner import candidates
from graphloom.sources import ir, sinks
from pyspark.sql import functions as F


def ids(df, c="node_id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_simple_paths(spark):
    g = PropertyGraph.local(spark, [(i, ["A"]) for i in range(1, 5)], [(1, 2, "DATA", ""), (2, 3, "DATA", ""), (3, 1, "DATA", ""), (3, 4, "DATA", ""), (1, 1, "DATA", "")])
    starts = g.nodes.select("graph_id", F.col("node_id").alias("start"))
    every = F.lit(True)
    assert paths.simple_paths(g, starts, every).where("size(path) > 0").count() == 17
    assert paths.simple_paths(g, starts.where("start = 4"), every).collect()[0].path == []
    with pytest.raises(paths.PathLimit):
        paths.simple_paths(g, starts, every, max_length=2)
    reach = {(r.start, r.last) for r in paths.reachable(g, starts, every).collect()}
    assert reach == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)} | {(4, 4)}
    strict = {(r.start, r.last) for r in paths.reachable(g, starts, every, zero=False).collect()}
    assert strict == reach - {(4, 4)}


def code(spark):
    """start -> a -> b -> return, a -exception-> x -> unwind, b -> dead end."""
    nodes = [(0, ["StartNode", "FixedNode"]), (1, ["FixedNode"]), (2, ["FixedNode"]), (3, ["ReturnNode", "FixedNode"]), (4, ["FixedNode"]), (5, ["UnwindNode", "FixedNode"]), (6, ["FixedNode"]), (7, ["Constant"])]
    c = "CONTROL"
    return PropertyGraph.local(spark, nodes, [(0, 1, c, "next"), (1, 2, c, "next"), (2, 3, c, "next"), (1, 4, c, "exceptionEdge"), (4, 5, c, "next"), (2, 6, c, "false"), (7, 6, "DATA", "x")])


def test_prune(spark):
    g = code(spark)
    assert ids(prune.remove_exceptions(g).nodes) == [0, 1, 2, 3, 6, 7]
    assert ids(prune.simplify(g).nodes) == [0, 1, 2, 3]
    chain = PropertyGraph.local(spark, [(i, ["A"]) for i in range(3)], [(0, 1, "DATA", ""), (1, 2, "DATA", "")])
    assert ids(prune.remove_forwards(chain, spark.sql("SELECT 0L AS graph_id, 1L AS node_id")).nodes) == []
    with pytest.raises(ValueError):
        prune.simplify(chain)


def test_placeholders(spark):
    e = spark.createDataFrame([(1, 10), (10, 11), (11, 2), (11, 10), (3, 4), (12, 12), (5, 12)], "src long, dst long")
    marks = spark.createDataFrame([(10,), (11,), (12,)], "node_id long")
    assert sorted(map(tuple, prune.resolve_placeholders(e, marks).collect())) == [(1, 2), (3, 4)]


def test_placeholders_in_a_long_chain(spark):
    """0 -> 1 -> ... -> 100 -> 101, all but the ends placeholders, and one more way out at 50."""
    e = spark.createDataFrame([(i, i + 1) for i in range(101)] + [(50, 200)], "src long, dst long")
    marks = spark.createDataFrame([(i,) for i in range(1, 101)], "node_id long")
    assert sorted(map(tuple, prune.resolve_placeholders(e, marks).collect())) == [(0, 101), (0, 200)]


def test_rules(spark):
    g = PropertyGraph.local(spark, [(i, ["N"]) for i in range(4)], [(0, 1, "DATA", ""), (1, 2, "DATA", ""), (2, 3, "DATA", "")])
    rules = Rules(F.lit(0).cast("long"), "long")

    @rules.whole("longest", "digraph { a [label=\"(?P<a>)|is('N')\"]; b [label=\"(?P<b>)|is('N')\"]; a -> b }")
    def longest(c):
        return c.with_state("a").groupBy("graph_id", F.col("b").alias("node_id")).agg(F.max(F.col("value of a") + 1).alias("value"))

    @rules.whole("mark", "digraph { a [label=\"(?P<a>)|is('N')\"]; b; a -> b [label=\"is('DATA')\"] }")
    def mark(c):
        return Attach(c.with_state("a").select("graph_id", F.col("a").alias("node_id"), F.col("value of a").alias("depth")), "Depth", "Has")

    out, state, rounds = rules.run(g)
    assert {r.node_id: r.value for r in state.collect()} == {1: 1, 2: 2, 3: 3}
    depth = out.nodes.where("kind = 'SPECIFIC'").collect()
    assert sorted(int(r.attrs["depth"]) for r in depth) == [0, 1, 2] and all(r.node_id < 0 for r in depth)
    assert rounds <= 6 and out.edges.where("eclass = 'Has'").count() == 3
    captured = Rules(F.lit(None).cast("string"))
    captured.capture("leaf", "digraph { a [label=\"(?P<a>)|is('N')\"]; b [label=\"(?P<b>)|is('N')\"]; a -> b }", {"b": F.lit("inner")})
    assert ids(captured.run(g)[1]) == [1, 2, 3]


def test_rules_that_are_not_stable(spark):
    g = PropertyGraph.local(spark, [(i, ["N"]) for i in range(2)], [(0, 1, "DATA", "")])
    rules = Rules(F.lit(0).cast("long"), "long")

    @rules.whole("more", "digraph { a [label=\"(?P<a>)|is('N')\"] }")
    def more(c):
        return c.with_state("a").select("graph_id", F.col("a").alias("node_id"), (F.col("value of a") + 1).alias("value"))

    with pytest.raises(RuntimeError, match="not stable after 3 rounds"):
        rules.run(g, limit=2)


def test_rules_see_what_earlier_ones_wrote(spark):
    """Two rules that write the same node: the later one wins in each round, and the loop ends."""
    g = PropertyGraph.local(spark, [(i, ["N"]) for i in range(2)], [(0, 1, "DATA", "")])
    rules = Rules(F.lit(0).cast("long"), "long")
    for name, value in (("low", 1), ("high", 2)):
        rules.whole(name, "digraph { a [label=\"(?P<a>)|is('N')\"] }")(lambda c, value=value: c.matches.select("graph_id", F.col("a").alias("node_id"), F.lit(value).cast("long").alias("value")))
    _, state, rounds = rules.run(g)
    assert {r.node_id: r.value for r in state.collect()} == {0: 2, 1: 2} and rounds == 2


def test_points_to(spark):
    """A stored parameter, a value behind a phi, a load of another field, and loads of each other."""
    types = {1: "AllocatedObjectNode", 2: "AllocatedObjectNode", 3: "ParameterNode", 4: "ConstantNode", 5: "ValuePhiNode", 6: "StoreFieldNode", 7: "StoreFieldNode", 8: "LoadFieldNode", 9: "StoreFieldNode", 10: "LoadFieldNode", 11: "StoreFieldNode"}
    fields = {6: "f", 7: "f", 8: "f", 9: "g", 10: "h", 11: "h"}
    nodes = spark.createDataFrame([(i, [t], {"field": fields[i]} if i in fields else None) for i, t in types.items()], "node_id long, types array<string>, attrs map<string,string>")
    edges = [(1, 6, "object"), (3, 6, "value"), (1, 7, "object"), (4, 5, "x"), (5, 7, "value"), (1, 8, "object"), (2, 9, "object"), (8, 9, "value"), (2, 10, "object"), (2, 11, "object"), (10, 11, "value")]
    g = PropertyGraph.of(nodes, spark.createDataFrame(edges, "src long, dst long, label string"))
    assert sorted((r.object, r.field, r.target) for r in analyses.points_to(g).collect()) == [(1, "f", 3), (1, "f", 4), (2, "g", 3), (2, "g", 4)]


def test_worklist(spark):
    nodes = spark.createDataFrame([(g, 1, ["Invoke"], "C", m) for g, m in ((1, "b"), (2, "c"), (3, "a"), (4, "a"))], "graph_id long, node_id long, types array<string>, method_class string, method_name string")
    g = PropertyGraph.of(nodes, spark.sql("SELECT 1L AS graph_id, 1L AS src, 1L AS dst"))
    methods = spark.createDataFrame([(1, "C", "a"), (2, "C", "b"), (3, "C", "c"), (4, "C", "d")], "graph_id long, method_class string, method_name string")
    start = spark.sql("SELECT 1L AS graph_id")
    p = "digraph { v [label=\"is('Invoke')\"] }"
    assert [tuple(r) for r in apply_recursively(g, p, methods, start).orderBy("round").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert ids(apply_recursively(g, p, methods, start, F.col("method_name") != "c"), "graph_id") == [1, 2]


def test_worklist_of_a_long_chain(spark):
    """1 calls 2, 2 calls 3, and so on up to 1003, which nobody could reach in 1000 rounds; 5 calls 3 as well, and 2000 isn't called."""
    calls = [(g, 1, ["Invoke"], "C", str(g + 1)) for g in range(1, 1003)] + [(5, 2, ["Invoke"], "C", "3"), (7, 2, ["Other"], "C", "2000")]
    g = PropertyGraph.of(spark.createDataFrame(calls, "graph_id long, node_id long, types array<string>, method_class string, method_name string"), spark.sql("SELECT 1L AS graph_id, 1L AS src, 1L AS dst"))
    methods = spark.createDataFrame([(k, "C", str(k)) for k in [*range(1, 1004), 2000]], "graph_id long, method_class string, method_name string")
    p = "digraph { v [label=\"is('Invoke')\"] }"
    start = spark.sql("SELECT 1L AS graph_id")
    assert sorted(map(tuple, apply_recursively(g, p, methods, start).collect())) == [(k, k - 1) for k in range(1, 1004)]
    with pytest.raises(RuntimeError):
        apply_recursively(g, p, methods, start, rounds=1002)


def test_shortest_against_search(spark):
    """Chains, cycles, trees and random hops, some of which branch too much for doubling."""
    from random import Random

    r = Random(3)
    hops = {"chain": [(k, k + 1) for k in range(40)], "cycle": [(k, (k + 1) % 17) for k in range(17)], "tree": [(k, 2 * k + d) for k in range(1, 30) for d in (0, 1)]}
    hops |= {f"random {n}": [(r.randrange(30), r.randrange(30)) for _ in range(n)] for n in (40, 150)}
    hops["chain, then random"] = hops["chain"] + [(40 + a, 40 + b) for a, b in hops["random 150"]]
    for name, e in hops.items():
        want = set()
        for start in (0, 1, 2):
            dist, front = {start: 0}, [start]
            while front:
                front = [b for a in front for x, b in e if x == a and b not in dist and not dist.update({b: dist[a] + 1})]
            want |= {(start, k, d) for k, d in dist.items()}
        starts = spark.createDataFrame([(k, k) for k in (0, 1, 2)], "start long, last long")
        got = paths.shortest(starts, spark.createDataFrame(e, "last long, to long")).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want, name


def test_dataflow(spark):
    c = "CONTROL"
    g = PropertyGraph.local(spark, [(0, ["A"]), (1, ["B"]), (2, ["C"]), (3, ["D"])], [(0, 1, c, ""), (1, 2, c, ""), (2, 1, c, ""), (2, 3, c, "")])
    seen = {r.node_id: (r.before, r.after) for r in dataflow.forwards(g, dataflow.gather_types(list("ABCD"))).collect()}
    assert seen[0] == ([], ["A"]) and seen[1] == (list("ABC"), list("ABC")) and seen[3] == (list("ABC"), list("ABCD"))
    back = {r.node_id: r.before for r in dataflow.backwards(g, dataflow.gather_types(list("ABCD"))).collect()}
    assert back == {0: list("BCD"), 1: list("BCD"), 2: list("BCD"), 3: []}


def test_ir(spark):
    kinds = {1: ["LoopBeginNode"], 2: ["LoopEndNode"], 3: ["LoopExitNode"], 4: ["ValuePhiNode", "PhiNode"], 5: ["FrameState"], 6: ["EndNode"], 7: ["AddNode"], 8: ["MergeNode"], 9: ["ValueProxyNode", "ProxyNode"], 10: ["MemoryPhiNode", "PhiNode"], 11: ["GuardProxyNode", "ProxyNode"]}
    nodes = spark.createDataFrame([(0, i, t) for i, t in kinds.items()], "graph_id long, node_id long, types array<string>")
    use = [(0, 1, 2, "loopBegin", None), (0, 1, 3, "loopBegin", None), (0, 7, 4, "values", 2), (0, 7, 5, "values", None), (0, 6, 8, "ends", None), (0, 7, 8, "ends", None), (0, 5, 1, "stateAfter", None), (0, 7, 1, "stateAfter", None)]
    use += [(0, 1, 4, "merge", None), (0, 1, 10, "merge", None), (0, 4, 7, "x", None), (0, 3, 9, "proxyPoint", None), (0, 7, 9, "value", None), (0, 3, 11, "proxyPoint", None)]
    g = ir.ir_graph(nodes, spark.createDataFrame([(0, 1, 2, None), (0, 2, 1, "back")], "graph_id long, src long, dst long, position string"), spark.createDataFrame(use, "graph_id long, src long, dst long, input string, phi_from long"))
    found = sorted((r.src, r.dst, r.etype, r.label) for r in g.edges.collect())
    control, beside = [(1, 2, "CONTROL", "next"), (2, 1, "CONTROL", "back"), (2, 1, "CONTROL", "next")], [(1, 2, "loopBegin"), (1, 3, "loopBegin"), (7, 5, "values"), (5, 1, "stateAfter"), (1, 4, "merge"), (3, 9, "proxyPoint")]
    data = [(7, 4, "from 2"), (7, 8, "ends"), (7, 1, "stateAfter"), (1, 10, "merge"), (4, 7, "x"), (7, 9, "value"), (3, 11, "proxyPoint")]
    assert found == sorted([*control, *((a, b, "ASSOCIATED", n) for a, b, n in beside), *((a, b, "DATA", n) for a, b, n in data)])
    assert g.adjacent(1, etype="CONTROL", incoming=True).count() == 2


def test_exports(spark, tmp_path):
    g = code(spark)
    p = "digraph { a [label=\"(?P<s>)|is('StartNode')\"]; w [label=\"is('FixedNode')\"]; a -> w [label=\"*|name() = 'next'\"] }"
    out = json.loads(sinks.query_json(g, p).first().json)
    assert out["queryVertices"] == {"a": "s", "w": ""} and out["graph"].startswith("digraph G {") and {"a": ["0"], "w": ["1", "2", "3"]} in out["queryResults"]
    from graphloom.plans.planner import match

    points = [json.loads(r.json) for r in sinks.match_json(match(g, p), p, g).collect()]
    assert sorted(map(len, points)) == [1, 2, 3, 4] and points[0][0].keys() == {"queryVertexName", "query", "irVertexId", "vertexName"}
    facts = {r.fact for r in sinks.facts(g).collect()}
    assert 'Node(7,"Constant").' in facts and 'Edge(1,4,"control","exceptionEdge").' in facts
    sinks.write_relations(g, f"{tmp_path}/rel")
    assert spark.read.csv(f"{tmp_path}/rel/Edge", sep="\t").count() == 7
    sinks.write_dot(g, f"{tmp_path}/dot")
    assert spark.read.text(f"{tmp_path}/dot/1-nodes").count() == 8
    lines = {r.node_id: r.line for r in sinks.dot_nodes(g).collect()}
    assert 'shape="house", root="true"' in lines[0] and 'shape="invhouse"' in lines[3] and 'shape="ellipse"' in lines[7]
    control = {r.node_id: r.line for r in sinks.control_lines(g).collect()}
    assert control[1] == "1 FixedNode -> next:2 exceptionEdge:4" and control[3] == "3 ReturnNode -> " and 7 not in control
    assert to_column("true", EdgeTarget()) is not None


def test_candidates(spark):
    rows = candidates(code(spark), "digraph { a [label=\"is('StartNode')\"]; b [label=\"is('FixedNode')\"]; c [label=\"'x' = 1\"]; a -> b -> c }")
    assert {r.vertex: r.n for r in rows.collect()} == {"a": 1, "b": 7, "c": 0}


def test_recursive_matches(spark):
    """Matches of reached graphs; a reached graph without any keeps a row."""
    calls = [(1, 1, ["Invoke"], "C", "2"), (1, 2, ["Invoke"], "C", "3"), (2, 1, ["Other"], None, None), (3, 7, ["Invoke"], "D", "9"), (4, 1, ["Invoke"], "C", "1")]
    g = PropertyGraph.of(spark.createDataFrame(calls, "graph_id long, node_id long, types array<string>, method_class string, method_name string"), spark.sql("SELECT 1L AS graph_id, 1L AS src, 1L AS dst"))
    methods = spark.createDataFrame([(k, "C", str(k)) for k in range(1, 5)], "graph_id long, method_class string, method_name string")
    got = recursive_matches(g, "digraph { v [label=\"is('Invoke')\"] }", methods, spark.sql("SELECT 1L AS graph_id"))
    assert sorted(map(tuple, got.select("graph_id", "round", "v").collect()), key=repr) == [(1, 0, 1), (1, 0, 2), (2, 1, None), (3, 1, 7)]


def test_placeholders(spark):
    """Chains with one way out in a row each, closed cycles, cycles with a way out, branches, chains into them."""
    n = 5000
    edges = [(-1, 0), *((k, k + 1) for k in range(n)), (n, -2), (-3, 100_000), *((100_000 + k, 100_000 + (k + 1) % 7) for k in range(7)), (-4, 200_000), (200_000, 200_001), (200_001, 200_000), (200_001, -5), (200_000, -6)]
    edges += [(-7, 300_000), (300_000, 0), (300_000, 100_003), (300_000, -8), (-9, -10), (400_000, 400_000), (-11, 400_000)]
    marks = [*range(n + 1), *range(100_000, 100_007), 200_000, 200_001, 300_000, 400_000]
    got = prune.resolve_placeholders(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(m,) for m in marks], "node_id long"))
    assert sorted(map(tuple, got.collect())) == sorted([(-1, -2), (-4, -5), (-4, -6), (-7, -2), (-7, -8), (-9, -10)])
    ends = prune.run_ends(spark.createDataFrame([e for e in edges if 0 <= e[0] < n] + [(100_000 + k, 100_000 + (k + 1) % 7) for k in range(7)], "node long, to long"))
    assert ends.count() == n and {r.to for r in ends.collect()} == {n}


def test_reach_of_one_start(spark):
    """Only what the start reaches is walked, in a graph whose squares would be far larger."""
    from random import Random

    r = Random(5)
    edges = [(r.randrange(20_000), r.randrange(20_000)) for _ in range(60_000)] + [(30_000 + r.randrange(300), 30_000 + r.randrange(300)) for _ in range(9000)]
    g = PropertyGraph.of(spark.createDataFrame([(0, ["N"])], "node_id long, types array<string>"), spark.createDataFrame(edges, "src long, dst long"))
    out, seen, front = {}, {0}, [0]
    for a, b in edges:
        out.setdefault(a, []).append(b)
    while front:
        front = [b for a in front for b in out.get(a, []) if b not in seen and not seen.add(b)]
    starts = spark.createDataFrame([(0, 0)], "graph_id long, start long")
    assert ids(paths.reachable(g, starts, to_column("true", EdgeTarget())), "last") == sorted(seen)
    first = {b for a, b in edges if a == 0}
    assert first <= set(ids(paths.reachable(g, starts, to_column("true", EdgeTarget()), zero=False), "last"))


def test_numeric(spark):
    """Two nested loops, an arm that can't be taken, an unknown variable, and a cycle without a head."""
    from graphloom.operators import numeric

    step = numeric.step
    parts = [
        (1, 0, 1, [step("assign", "i")]),
        (1, 1, 2, [step("assume", "i", "<", None, 10)]),
        (1, 2, 3, [step("assign", "j", "", {"i": 0}, -1)]),
        (1, 3, 4, [step("assume", "j", "<=", {"limit": 1}, 10)]),
        (1, 4, 3, [step("assign", "j", "", {"j": 1}, 3)]),
        (1, 3, 5, [step("assume", "j", ">", None, 20)]),
        (1, 5, 1, [step("assign", "i", "", {"i": 1}, 1)]),
        (1, 1, 6, [step("assume", "i", ">=", None, 10)]),
        (1, 6, 7, [step("assume", "i", "!=", None, 10)]),
        (1, 0, 8, [step("assume", "n", ">", None, 4), step("assign", "m", "", {"n": -2}, 1), step("forget", "n")]),
        (2, 0, 1, []),
        (2, 1, 0, [step("assign", "k", "", {"k": 1}, 1)]),
        (3, 5, 6, []),
    ]
    flows = None
    for graph, a, b, ops in parts:
        row = spark.range(1).select(F.lit(graph).cast("long").alias("graph_id"), F.lit(a).cast("long").alias("src"), F.lit(b).cast("long").alias("dst"), F.lit(f"{a}").alias("label"), F.array(*ops).cast(f"array<{numeric.STEP}>").alias("steps"))
        flows = row if flows is None else flows.unionByName(row)
    nodes = spark.createDataFrame([(g, k, ["LoopBegin"] if (g, k) in ((1, 1), (1, 3)) else ["N"]) for g in (1, 2, 3) for k in range(9)], "graph_id long, node_id long, types array<string>")
    g = PropertyGraph.of(nodes, flows.select("graph_id", "src", "dst", F.lit("CONTROL").alias("etype"), "label"))
    start = spark.sql("SELECT * FROM VALUES (1L, 0L, map('limit', named_struct('lo', 10D, 'hi', 10D))), (2L, 0L, map('k', named_struct('lo', 0D, 'hi', 0D))), (3L, 0L, NULL) AS t(graph_id, node_id, state)")
    out = numeric.analyse(g, flows.where("size(steps) > 0"), start, F.array_contains("types", "LoopBegin"), patience=6)
    got = {(r.graph_id, r.node_id): {k: (v.lo, v.hi) for k, v in r.state.items() if (v.lo, v.hi) != (-math.inf, math.inf)} for r in out.collect()}
    assert {k[1] for k in got if k[0] == 1} == set(range(9)) and not {k for k in got if k[0] == 3}
    limit, inf = {"limit": (10, 10)}, math.inf
    #: The inner head gives up the outer loop's counter, which no condition of the inner loop holds.
    assert got[1, 1] == {**limit, "i": (0, inf)} and got[1, 2] == {**limit, "i": (0, 9)} and got[1, 6] == {**limit, "i": (10, inf)} and got[1, 7] == {**limit, "i": (11, inf)}
    assert got[1, 3] == {**limit, "i": (0, inf), "j": (-1, 23)} and got[1, 4] == {**limit, "i": (0, inf), "j": (-1, 20)} and got[1, 5] == {**limit, "i": (0, inf), "j": (21, 23)}
    assert got[1, 8] == {**limit, "m": (-inf, -9)}
    assert got[2, 0] == {"k": (0, math.inf)} and got[2, 1] == {"k": (0, math.inf)}
