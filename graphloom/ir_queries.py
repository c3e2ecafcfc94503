"""Registered queries over compiler-like graphs that are derived from the driver tables: ingestion, exports, rules, domains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analyses
from .functions.predicates import PredicateError
from .graph_queries import CONV, RING, SESSION, SQL, TRADE, dot, flat, query
from .model import PropertyGraph
from .operators import domains, polyhedra, prune
from .operators.fixpoint import Rules
from .operators.kept import forget, keep, shared_folder
from .plans import sqltext
from .plans.pattern import PatternError, read_pattern
from .plans.planner import candidates, match
from .sources import ir, sinks, views

# Compiler IR over the events: each event is a node, the type and the inputs of which follow from its number

KINDS = ["LoopBeginNode", "LoopEndNode", "LoopExitNode", "ValuePhiNode", "FrameState", "EndNode", "ValueProxyNode", "AddNode"]
INPUTS = ["loopBegin", "values", "ends", "stateAfter", "merge", "value", "x"]
listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
RAW = f"""
k AS (SELECT {listed(KINDS)} AS kinds, {listed(INPUTS)} AS inputs, count(*) AS n FROM events),
irn AS (SELECT event_id AS node_id, kinds[1 + event_id % 8] AS kind FROM events, k),
iru AS (SELECT event_id AS src, (event_id * 7 + 3) % n AS dst, inputs[1 + event_id * 5 % 7] AS input, event_id % 10 AS phi_from FROM events, k),
irx AS (SELECT u.*, a.kind AS used, b.kind AS usr, CASE
 WHEN input = 'loopBegin' AND b.kind = 'LoopEndNode' THEN 'both' WHEN input = 'loopBegin' AND b.kind = 'LoopExitNode' THEN 'beside'
 WHEN input = 'values' AND b.kind = 'ValuePhiNode' THEN 'phi' WHEN input = 'values' AND b.kind = 'FrameState' THEN 'beside'
 WHEN input = 'ends' AND a.kind = 'EndNode' THEN 'none'
 WHEN input = 'stateAfter' AND a.kind = 'FrameState' OR input = 'merge' AND b.kind = 'ValuePhiNode' OR input <> 'value' AND b.kind = 'ValueProxyNode' THEN 'beside'
 ELSE 'data' END AS how FROM iru u LEFT JOIN irn a ON a.node_id = u.src LEFT JOIN irn b ON b.node_id = u.dst),
ire AS (SELECT event_id AS src, event_id + 1 AS dst, 'CONTROL' AS etype, CASE WHEN event_id % 2 = 0 THEN 'next' ELSE 'trueSuccessor' END AS label, NULL::BIGINT AS phi_from FROM events, k WHERE event_id + 1 < n
 UNION ALL SELECT dst, src, 'CONTROL', 'next', NULL FROM irx WHERE how = 'both'
 UNION ALL SELECT src, dst, 'ASSOCIATED', input, NULL FROM irx WHERE how IN ('both', 'beside')
 UNION ALL SELECT src, dst, 'DATA', 'from ' || phi_from, phi_from FROM irx WHERE how = 'phi'
 UNION ALL SELECT src, dst, 'DATA', input, NULL FROM irx WHERE how = 'data')"""


def code(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, successors, usages) as raw tables."""
    e = views.table(spark, sf, "events").select("event_id", "user_id")
    n, at = e.count(), F.col("event_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    place = F.create_map(F.lit("bci"), (at % 100).cast("string"), F.lit("src_file"), F.concat(F.lit("F"), (at % 3).cast("string")), F.lit("src_line"), (at % 50).cast("string"))
    kind = pick(KINDS, at % 8)
    nodes = e.select(
        F.lit(0).cast("long").alias("graph_id"), at.alias("node_id"), F.when(kind == "ValuePhiNode", F.array(kind, F.lit("PhiNode"))).when(kind == "AddNode", F.array(kind, F.lit("Invoke"))).otherwise(F.array(kind)).alias("types"),
        F.when(kind == "AddNode", F.lit("C")).alias("method_class"), F.when(kind == "AddNode", F.concat(F.lit("m"), F.col("user_id").cast("string"))).alias("method_name"), F.when(at % 4 == 1, place).alias("attrs"),
    )
    successors = e.where(at + 1 < n).select(F.lit(0).cast("long").alias("graph_id"), at.alias("src"), (at + 1).alias("dst"), F.when(at % 2 == 1, F.lit("trueSuccessor")).alias("position"))
    usages = e.select(F.lit(0).cast("long").alias("graph_id"), at.alias("src"), ((at * 7 + 3) % n).alias("dst"), pick(INPUTS, at * 5 % 7).alias("input"), (at % 10).alias("phi_from"))
    return nodes, successors, usages


@query(f"WITH {RAW} SELECT * FROM ire")
def ir_edges(spark, sf):
    return ir.ir_graph(*code(spark, sf)).edges.select("src", "dst", "etype", "label", "phi_from")


@query(f"WITH {RAW} SELECT DISTINCT x.src AS v, x.dst AS phi, s.dst AS next FROM ire x JOIN irn b ON b.node_id = x.dst JOIN ire s ON s.src = x.dst WHERE x.etype = 'DATA' AND b.kind = 'ValuePhiNode' AND s.etype = 'CONTROL'")
def ir_pattern(spark, sf):
    return flat(match(ir.ir_graph(*code(spark, sf)), dot("""v -> phi [label="is('DATA')"]; phi [label="is('PhiNode')"]; phi -> next [label="is('CONTROL')"]""")))


@query(f"WITH {RAW} SELECT node_id, kind = 'AddNode' AS is_invoke, CASE WHEN kind = 'AddNode' THEN 'C.m' || user_id END AS target_method FROM irn JOIN events ON event_id = node_id")
def ir_accessors(spark, sf):
    return ir.accessors(PropertyGraph.of(*code(spark, sf)[:2]).nodes).select("node_id", "is_invoke", "target_method")


@query("SELECT event_id AS node_id, CASE WHEN event_id % 8 = 7 THEN 'C.m' || user_id ELSE '' END AS method, (event_id % 100)::INTEGER AS bci, 'F' || event_id % 3 || ':' || event_id % 50 AS location FROM events WHERE event_id % 4 = 1")
def source_positions(spark, sf):
    return ir.source_positions(code(spark, sf)[0]).drop("graph_id")


# Exports


@query(f"WITH {TRADE} SELECT src, dst, etype, label FROM te")
def relations_round_trip(spark, sf):
    """The tab-separated relations, written and read again."""
    folder = f"{shared_folder(spark)}/relations-{uuid.uuid4().hex}"
    sinks.write_relations(views.trade(spark, sf), folder)
    return spark.read.csv(f"{folder}/Edge", sep="\t", schema="graph_id long, src long, dst long, etype string, label string").drop("graph_id")


@query(f"""WITH {SESSION}, x AS (SELECT src, dst, false AS into FROM se UNION ALL SELECT dst, NULL, true FROM se), l AS (SELECT src, max(dst) AS dst FROM x GROUP BY src)
SELECT src AS node_id, src || ' ' || kind || ' -> ' || coalesce('next:' || dst, '') AS line FROM l JOIN sn ON node_id = src""")
def control_listing(spark, sf):
    return sinks.control_lines(views.session(spark, sf)).drop("graph_id")


def event_types(spark, sf) -> list[str]:
    """The vocabulary of event types, which patterns are made from."""
    return sorted(r[0] for r in views.table(spark, sf, "events").where("event_type IS NOT NULL").select("event_type").distinct().collect())


@query(f"""WITH {SESSION} SELECT kind, 'digraph "G" {{' || chr(10) || '  "a" [ label="(?P<x>)|is(' || chr(39) || kind || chr(39) || ') or not five = 5" ];' || chr(10) || '  "b" [ label="1 = 1" ];' || chr(10) || '  "a" -> "b" [ label="name() = ' || chr(39) || 'next' || chr(39) || '" ];' || chr(10) || '}}' || chr(10) AS dot, true AS same, count(dst) AS n
FROM sn LEFT JOIN se ON src = node_id GROUP BY kind""")
def pattern_export(spark, sf):
    """For each type of event, a pattern as text, whether reading the text gives the same pattern, and how often what was read matches."""
    graph, rows, found = views.session(spark, sf), [], []
    for kind in event_types(spark, sf):
        p = read_pattern(dot(f"""a [label="(?P<x>)|is('{kind}') or not (five = 5)"]; b; a -> b [label="name() = 'next'"]"""))
        again = read_pattern(p.export())
        rows.append((kind, p.export(), again == p))
        found.append(match(graph, again).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n"))
    return spark.createDataFrame(rows, "kind string, dot string, same boolean").join(views.union(found), "kind")


@query(f"""WITH {CONV}, c AS (SELECT conv_id AS graph_id, conv_id * 1048576 + turn AS id, role FROM conversations), e AS (SELECT src // 1048576 AS graph_id, src, dst FROM ce),
lines AS (SELECT graph_id, 0 AS k, '  "ir' || id || '" [ label="' || role || '", shape="ellipse", root="false" ];' AS line FROM c
 UNION ALL SELECT graph_id, 1, '  "ir' || src || '" -> "ir' || dst || '" [ label="next", color="red", style="", weight="10" ];' FROM e),
t AS (SELECT graph_id, 'digraph G {{' || chr(10) || string_agg(line, chr(10) ORDER BY k, line) || chr(10) || '}}' || chr(10) AS t FROM lines GROUP BY graph_id),
r AS (SELECT e.graph_id, string_agg('{{"u":["' || src || '"],"v":["' || dst || '"]}}', ',' ORDER BY '{{"u":["' || src || '"],"v":["' || dst || '"]}}') AS r FROM e JOIN c a ON a.id = src WHERE a.role = 'user' GROUP BY e.graph_id)
SELECT graph_id, '{{"graph":' || to_json(t)::VARCHAR || ',"queryResults":[' || coalesce(r, '') || '],"queryVertices":{{"u":"asks","v":""}}}}' AS json FROM t LEFT JOIN r USING (graph_id)""")
def query_json(spark, sf):
    g = views.conversation(spark, sf)
    own = lambda df, c: df.withColumn("graph_id", F.shiftright(c, 20))
    g = PropertyGraph.of(own(g.nodes, "node_id"), own(g.edges, "src"))
    return sinks.query_json(g, dot("""u [label="(?P<asks>)|is('user')"]; v; u -> v"""))


@query(f"""WITH {RAW} SELECT '  "' || node_id || '" [ label="' || node_id || '|' || kind || '" ];' AS line FROM irn
 UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [ label="' || label || '", color="' || CASE etype WHEN 'DATA' THEN 'blue' WHEN 'CONTROL' THEN 'red' ELSE 'black' END || '", style="' || CASE etype WHEN 'ASSOCIATED' THEN 'dashed' ELSE '' END || '" ];' FROM ire""")
def export_ir_dot(spark, sf):
    return sinks.ir_dot_lines(ir.ir_graph(*code(spark, sf))).select("line")


@query(f"WITH {TRADE} SELECT 'o' AS vertex, count(*) AS n FROM tn WHERE list_contains(types, 'orders') UNION ALL SELECT 'c', count(*) FROM tn WHERE list_contains(types, 'BUILDING') UNION ALL SELECT 'x', count(*) FROM tn")
def candidate_counts(spark, sf):
    return candidates(views.trade(spark, sf), dot("""o [label="is('orders')"]; c [label="is('BUILDING')"]; o -> c -> x"""))


# Options, backward paths, the second backend


@query(SQL["edge_label_filter"])
def optional_no_effect(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""b [label="?|"]; a -> b [label="?|name() = 'nation'"]""")))


@query(SQL["repeated_sources"].replace("AS s,", "AS who,").replace("dst AS n FROM", "dst AS place FROM"))
def combined_options(spark, sf):
    from .plans.planner import captured

    p = dot("""s [label="[](?P<who>)|is('supplier')"]; n [label="(?P<place>)|is('nation')"]; s -> n""")
    return flat(captured(match(views.trade(spark, sf), p), p))


@query(f"WITH RECURSIVE {CONV}, p AS (SELECT node_id AS start, []::BIGINT[] AS path, node_id AS last FROM cn UNION ALL SELECT p.start, list_append(p.path, dst), dst FROM p JOIN ce ON src = p.last) SELECT start AS u, array_to_string(path, ',') AS w, dst AS e FROM p JOIN ce ON src = last JOIN cn ON node_id = dst WHERE role = 'assistant'")
def kleene_backward(spark, sf):
    """The end of the path is bound before its start."""
    return flat(match(views.conversation(spark, sf), dot("""e [label="is('assistant')"]; w -> e; u -> w [label="*|is('CONTROL')"]""")).select("u", "w", "e"))


@query(SQL["kleene_paths"])
def sql_backend_kleene(spark, sf):
    return flat(sqltext.match_by_sql(views.conversation(spark, sf), dot("""u [label="is('user')"]; w; u -> w [label="*|is('CONTROL')"]""")))


def is_error(graph: PropertyGraph, pattern: str) -> bool:
    try:
        match(graph, pattern)
    except (PatternError, PredicateError):
        return True
    return False


@query("SELECT event_type AS name, count(*) AS n, true AS is_error, false AS as_text FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def unknown_name(spark, sf):
    """A name that the predicate language doesn't have is an error, not a match of nothing: the types of events, as names and as text."""
    graph = views.session(spark, sf)
    rows = [(t, is_error(graph, dot(f"""v [label="{t} = 5"]""")), is_error(graph, dot(f"""v [label="'{t}' = 'x'"]"""))) for t in event_types(spark, sf)]
    events = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return events.join(spark.createDataFrame(rows, "name string, is_error boolean, as_text boolean"), "name").select("name", "n", "is_error", "as_text")


NO_PATTERNS = {
    "not connected": """a [label="is('{t}')"]; a -> b; c""",
    "repeated start": """a [label="[]|is('{t}')"]""",
    "two paths into a vertex": """a [label="is('{t}')"]; a -> b [label="*|"]; c -> b [label="*|"]; a -> c""",
    "path to its own source": """a [label="is('{t}')"]; a -> a [label="*|"]""",
    "unknown option": """a [label="(?Q<x>)|is('{t}')"]""",
}


@query("SELECT unnest([" + ", ".join(f"'{k}'" for k in NO_PATTERNS) + "]) AS pattern, event_type AS kind, n, true AS is_error FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type)")
def invalid_patterns(spark, sf):
    """Patterns without a meaning are errors, all of them before any job runs, for each type of event."""
    graph = views.session(spark, sf)
    rows = [(name, t, is_error(graph, dot(body.replace("{t}", t)))) for name, body in NO_PATTERNS.items() for t in event_types(spark, sf)]
    events = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return events.join(spark.createDataFrame(rows, "pattern string, kind string, is_error boolean"), "kind").select("pattern", "kind", "n", "is_error")


# Rules and pruning


@query(f"WITH {TRADE}, v AS (SELECT a.dst AS node_id, 'ordered' AS value FROM te a WHERE a.label = 'customer' UNION ALL SELECT n.dst, 'served' FROM te a JOIN te n ON n.src = a.dst WHERE a.label = 'customer' AND n.label = 'nation') SELECT node_id, max(value) AS value FROM v GROUP BY node_id")
def capture_rule(spark, sf):
    """Values for captured nodes."""
    rules = Rules(F.lit(None).cast("string"))
    rules.capture("service", dot("""o [label="is('orders')"]; c [label="(?P<who>)|is('customer')"]; n [label="(?P<place>)|is('nation')"]; o -> c; c -> n"""), {"who": F.lit("ordered"), "place": F.lit("served")})
    return rules.run(views.trade(spark, sf))[1].select("node_id", "value")


RUNS = """
runs AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) GROUP BY conv_id, g)"""


def methods(spark: SparkSession, sf: str) -> PropertyGraph:
    """Conversations as code: turn 6 is reached by an exception, turn 7 unwinds, the first turn starts and assistants return."""
    g = views.conversation(spark, sf)
    turn = F.col("node_id") % 8
    types = F.filter(F.array(F.lit("FixedNode"), F.when(turn == 0, "StartNode"), F.when(F.array_contains("types", "assistant"), "ReturnNode"), F.when(turn == 7, "UnwindNode")), lambda t: t.isNotNull())
    return PropertyGraph.of(g.nodes.withColumn("types", types), g.edges.withColumn("label", F.when(F.col("dst") % 8 == 6, "exceptionEdge").otherwise("next")))


@query(f"""WITH {RUNS} SELECT c.conv_id * 1048576 + c.turn AS node_id FROM conversations c JOIN runs r ON r.conv_id = c.conv_id AND c.turn BETWEEN lo AND hi
WHERE NOT (hi >= 6 AND lo <= 5 AND (c.turn >= 6 OR lo = 5)) AND NOT (lo >= 6 AND hi = 7)""")
def remove_exceptions(spark, sf):
    return prune.remove_exceptions(methods(spark, sf)).nodes.select("node_id")


@query(f"""WITH {RUNS}, cut AS (SELECT conv_id, lo, CASE WHEN lo <= 5 AND hi >= 6 THEN 5 ELSE hi END AS hi FROM runs WHERE NOT (lo = 5 AND hi >= 6) AND NOT (lo >= 6 AND hi = 7))
SELECT c.conv_id * 1048576 + c.turn AS node_id FROM conversations c JOIN cut r ON r.conv_id = c.conv_id AND c.turn BETWEEN lo AND hi JOIN conversations e ON e.conv_id = r.conv_id AND e.turn = r.hi WHERE e.role = 'assistant'""")
def simplify(spark, sf):
    return prune.simplify(methods(spark, sf)).nodes.select("node_id")


@query("""WITH RECURSIVE f AS (SELECT o_orderkey AS o, o_orderstatus AS status, o_orderpriority AS priority, c_nationkey || ':' || o_orderpriority AS field FROM orders JOIN customer ON c_custkey = o_custkey),
ob AS (SELECT l_orderkey AS o, max(l_suppkey) AS a, max(l_partkey) AS p FROM lineitem GROUP BY 1),
store AS (SELECT f.o, a, p, field FROM f JOIN ob USING (o) WHERE NOT (status = 'P' AND priority = '5-LOW')), load AS (SELECT f.o, a, field FROM f JOIN ob USING (o) WHERE status = 'P' AND priority = '5-LOW'),
link AS (SELECT DISTINCT s.a, s.field, l.a AS b, l.field AS g FROM store s JOIN load l ON l.o = s.o - 1),
r AS (SELECT a, field, p FROM store UNION SELECT k.a, k.field, r.p FROM link k JOIN r ON r.a = k.b AND r.field = k.g)
SELECT 4000000000000 + a AS object, field, 5000000000000 + p AS target FROM r""")
def points_to(spark, sf):
    """Orders store their largest part into a field of their largest supplier; some only load, and the next order stores that as well."""
    t = {n: views.table(spark, sf, n) for n in ("orders", "customer", "lineitem", "part", "supplier")}
    items = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("p"))
    load = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    o = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(items, "o_orderkey").withColumn("load", load)
    o = keep(o.select("o_orderkey", "o_orderpriority", "c_nationkey", "s", "p", "load"))
    here, nop = views.node("orders", "o_orderkey"), F.col("o_orderkey") + 7 * views.BASE
    field = F.create_map(F.lit("field"), F.concat_ws(":", F.col("c_nationkey").cast("string"), "o_orderpriority"))
    urgent = (F.col("o_orderpriority") == "1-URGENT") & ~F.col("load")
    nodes = views.union([
        o.select(here.alias("node_id"), F.array(F.when(F.col("load"), "LoadFieldNode").otherwise("StoreFieldNode")).alias("types"), field.alias("attrs")),
        o.where(urgent).select(nop.alias("node_id"), F.array(F.lit("PiNode")).alias("types"), F.lit(None).cast("map<string,string>").alias("attrs")),
        t["supplier"].select(views.node("supplier", "s_suppkey").alias("node_id"), F.array(F.lit("AllocatedObjectNode")).alias("types"), F.lit(None).cast("map<string,string>").alias("attrs")),
        t["part"].select(views.node("part", "p_partkey").alias("node_id"), F.array(F.lit("ConstantNode")).alias("types"), F.lit(None).cast("map<string,string>").alias("attrs")),
    ])
    edge = lambda df, src, dst, label: df.select(src.alias("src"), dst.alias("dst"), F.lit("DATA").alias("etype"), F.lit(label).alias("label"))
    stores = o.where(~F.col("load")).select(F.col("o_orderkey").alias("next"))
    part = views.node("part", "p")
    edges = views.union([
        edge(o, views.node("supplier", "s"), here, "object"), edge(o.where(urgent), part, nop, "input"), edge(o.where(urgent), nop, here, "value"),
        edge(o.where(~F.col("load") & ~urgent), part, here, "value"),
        edge(o.where("load").join(stores, F.col("next") == F.col("o_orderkey") + 1), here, views.node("orders", "next"), "value"),
    ])
    found = analyses.points_to(PropertyGraph.of(nodes, edges)).drop("graph_id")
    forget(o)
    return found


# Domains


def state_of(names: dict[str, tuple]) -> F.Column:
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(domains.interval(*b) for b in names.values())))


@query("""WITH s AS (SELECT o_orderkey, ceil(o_totalprice) AS p, o_custkey::DOUBLE AS c FROM orders)
SELECT o_orderkey, false AS has_x, true AS has_y, false AS is_top, true AS top_now, c AS y_lo, c + 10 AS y_hi, 'Infinity'::DOUBLE AS z_hi, true AS same, false AS other FROM s""")
def state_bounds(spark, sf):
    """Declaring, forgetting, bounds, tops and equality of states."""
    price, who = F.ceil("o_totalprice").cast("double"), F.col("o_custkey").cast("double")
    s = state_of({"x": (price, price), "y": (who, who + 10)})
    gone = domains.forget(s, "x")
    return views.table(spark, sf, "orders").select(
        "o_orderkey", domains.declared(gone, "x").alias("has_x"), domains.declared(gone, "y").alias("has_y"), domains.is_top(gone).alias("is_top"), domains.is_top(domains.forget(s, "x", "y")).alias("top_now"),
        domains.bound_of(gone, "y")["lo"].alias("y_lo"), domains.bound_of(gone, "y")["hi"].alias("y_hi"), domains.bound_of(gone, "z")["hi"].alias("z_hi"),
        domains.equal_states(gone, domains.put(gone, "z", domains.top())).alias("same"), domains.equal_states(s, gone).alias("other"),
    )


@query("""WITH s AS (SELECT o_orderkey, ceil(o_totalprice)::DOUBLE AS p, o_custkey::DOUBLE AS c FROM orders)
SELECT o_orderkey, least(greatest(floor((p - 10) / 2), c), c + 100) AS x_hi, (p >= 2 * c + 10) AS possible, p = 5000 AS is_5000 FROM s WHERE p >= 2 * c + 10""")
def state_substitute(spark, sf):
    """What x may have been before y := 2 * x + 10, if y is at most the price now."""
    price, who = F.ceil("o_totalprice").cast("double"), F.col("o_custkey").cast("double")
    s = state_of({"x": (who, who + 100), "y": (F.lit(-domains.INF), price)})
    rows = views.table(spark, sf, "orders").select("o_orderkey", price.alias("p"), domains.substitute(s, "y", {"x": 2}, 10).alias("s")).where("s IS NOT NULL")
    return rows.select("o_orderkey", F.col("s")["x"]["hi"].alias("x_hi"), (F.col("s")["y"]["hi"] == domains.INF).alias("possible"), domains.substitute(state_of({"p": (F.col("p"), F.col("p"))}), "p", 5000).isNotNull().alias("is_5000"))


@query("""WITH o AS (SELECT o_custkey, o_orderstatus, ceil(o_totalprice)::DOUBLE AS p FROM orders) SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = count(*) THEN min(p) ELSE '-Infinity'::DOUBLE END AS x_lo,
CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = count(*) THEN max(p) ELSE 'Infinity'::DOUBLE END AS x_hi, max(p) + 1 AS y_hi FROM o GROUP BY o_custkey""")
def state_merge(spark, sf):
    """The join of the states of each customer's orders; open orders don't declare x, so it is unbounded where there is one."""
    price = F.ceil("o_totalprice").cast("double")
    s = state_of({"x": (price, price), "y": (price, price + 1)})
    rows = views.table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "P", domains.forget(s, "x")).otherwise(s).alias("s"))
    m = domains.merge_by(rows, ["o_custkey"], "s")
    return m.select("o_custkey", domains.bound_of(F.col("s"), "x")["lo"].alias("x_lo"), domains.bound_of(F.col("s"), "x")["hi"].alias("x_hi"), domains.bound_of(F.col("s"), "y")["hi"].alias("y_hi"))


@query("""WITH t AS (SELECT l_orderkey, l_returnflag AS v, sum(l_quantity::BIGINT) AS k FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(k || '*' || v, ' + ' ORDER BY v) || ' + ' || (SELECT count(*) FROM lineitem x WHERE x.l_orderkey = t.l_orderkey) AS form FROM t GROUP BY l_orderkey""")
def linear_sums(spark, sf):
    """Sums of linear forms: quantities by return flag, and the number of lines."""
    line = F.struct(F.map_from_arrays(F.array("l_returnflag"), F.array(domains.number(F.col("l_quantity").cast("long")))).alias("terms"), domains.number(1).alias("constant"))
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", line.alias("form"))
    return domains.sum_forms(rows, ["l_orderkey"], "form").select("l_orderkey", domains.form_text(F.col("form")).alias("form"))


RELATIONS = ["<", "<=", ">", ">=", "=", "!="]


@query(f"""WITH s AS (SELECT s_suppkey AS k, {listed(RELATIONS)}[1 + s_suppkey % 6] AS rel, {listed([">=", ">", "<=", "<", "!=", "="])}[1 + s_suppkey % 6] AS neg FROM supplier),
f AS (SELECT *, CASE WHEN k = 0 THEN '' ELSE (k * 2) || '*x + ' END || '-1*y + ' || (k - 5) AS form FROM s) SELECT k, form || ' ' || rel || ' 0' AS holds, form || ' ' || neg || ' 0' AS fails FROM f""")
def linear_constraints(spark, sf):
    """2 * (k * x + 3) against y - k + 11, and its negation."""
    k = F.col("s_suppkey")
    rel = F.element_at(F.array(*map(F.lit, RELATIONS)), (k % 6 + 1).cast("int"))
    left = domains.form_times(domains.form({}, 2), domains.form({"x": k}, 3))
    c = domains.constraint_of(left, rel, domains.form({"y": 1}, 11 - k))
    rows = views.table(spark, sf, "supplier").select(k.alias("k"), c.alias("c"))
    return rows.select("k", domains.constraint_text(F.col("c")).alias("holds"), domains.constraint_text(domains.constraint_negated(F.col("c"))).alias("fails"))


@query(f"""WITH t AS (SELECT conv_id, row_number() OVER w AS k, length(text) AS n, sum(length(text)) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), f AS (SELECT conv_id, n AS first FROM t WHERE k = 1)
SELECT conv_id, 'x' || k AS name, 0::DOUBLE AS lo, (total - first)::DOUBLE AS hi FROM t JOIN f USING (conv_id)""")
def octagon_bounds(spark, sf):
    """Octagons in grouped functions: x1 is 0, and each later variable is at least the one before and at most its turn's length more."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = views.table(spark, sf, "conversations").select("conv_id", F.row_number().over(w).alias("k"), F.length("text").cast("double").alias("n"))
    at = lambda d: F.concat(F.lit("x"), (F.col("k") + d).cast("string"))
    row = lambda a, x, b, y, c: F.struct(F.lit(a).alias("a"), x.alias("x"), F.lit(b).alias("b"), y.alias("y"), c.alias("c"))
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    first, later = F.array(row(1, at(0), 0, none, zero), row(-1, at(0), 0, none, zero)), F.array(row(1, at(0), -1, at(-1), F.col("n") + 0.5), row(-1, at(0), 1, at(-1), zero))
    return domains.octagon_bounds(t.select("conv_id", F.inline(F.when(F.col("k") == 1, first).otherwise(later))), ["conv_id"])


@query("""SELECT s_suppkey, name, 0::DOUBLE AS lo, CASE name WHEN 'x' THEN s_suppkey WHEN 'y' THEN s_suppkey // 3 ELSE s_suppkey // 2 END::DOUBLE AS hi FROM supplier, (VALUES ('x'), ('y'), ('z')) AS n(name)""")
def polyhedron_bounds(spark, sf):
    """Polyhedra in grouped functions: x, y, z >= 0, x + 3 * y + 2 * z <= the supplier's number."""
    form = lambda c, **terms: F.struct(F.create_map(*[v for n, k in terms.items() for v in (F.lit(n), F.lit(float(k)))]).alias("terms"), c.cast("double").alias("c"))
    rows = F.array(*(form(F.lit(0), **{n: -1}) for n in "xyz"), form(F.col("s_suppkey") + 0.5, x=1, y=3, z=2))
    return polyhedra.polyhedron_bounds(views.table(spark, sf, "supplier").select("s_suppkey", F.inline(rows)), ["s_suppkey"])


@query(f"WITH {RING} SELECT node_id, parity FROM rn WHERE node_id = 7")
def find_node(spark, sf):
    return views.ring(spark, sf).find(7).select("node_id", F.element_at("types", 2).alias("parity"))
