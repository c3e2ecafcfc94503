"""Registered graph queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import EdgeTarget, to_column
from .model import PropertyGraph
from .operators import dataflow, domains, numeric, paths, prune
from .operators.fixpoint import Attach, Rules, apply_recursively, recursive_matches
from .operators.kept import forget, keep
from .plans import sqltext
from .plans.planner import captured, match, match_all
from .sources import sinks, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The views as SQL.
TRADE = """
tn AS (
 SELECT 1000000000000 + r_regionkey AS node_id, ['region', 'Entity'] AS types, r_name AS name FROM region
 UNION ALL SELECT 2000000000000 + n_nationkey, ['nation', 'Entity'], n_name FROM nation
 UNION ALL SELECT 3000000000000 + c_custkey, ['customer', 'Entity', c_mktsegment], c_name FROM customer
 UNION ALL SELECT 4000000000000 + s_suppkey, ['supplier', 'Entity'], s_name FROM supplier
 UNION ALL SELECT 5000000000000 + p_partkey, ['part', 'Entity'], p_name FROM part
 UNION ALL SELECT 6000000000000 + o_orderkey, ['orders', 'Entity', o_orderstatus], o_orderkey::VARCHAR FROM orders),
te AS (
 SELECT 2000000000000 + n_nationkey AS src, 1000000000000 + n_regionkey AS dst, 'DATA' AS etype, 'region' AS label FROM nation
 UNION ALL SELECT 3000000000000 + c_custkey, 2000000000000 + c_nationkey, 'DATA', 'nation' FROM customer
 UNION ALL SELECT 4000000000000 + s_suppkey, 2000000000000 + s_nationkey, 'DATA', 'nation' FROM supplier
 UNION ALL SELECT 6000000000000 + o_orderkey, 3000000000000 + o_custkey, 'DATA', 'customer' FROM orders
 UNION ALL SELECT DISTINCT 6000000000000 + l_orderkey, 5000000000000 + l_partkey, 'DATA', 'part' FROM lineitem
 UNION ALL SELECT DISTINCT 6000000000000 + l_orderkey, 4000000000000 + l_suppkey, 'DATA', 'supplier' FROM lineitem)"""
SESSION = """
sn AS (SELECT event_id AS node_id, event_type AS kind, user_id FROM events),
se AS (SELECT * FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id FROM events) WHERE dst IS NOT NULL)"""
CONV = """
cn AS (SELECT conv_id * 1048576 + turn AS node_id, role FROM conversations),
ce AS (SELECT a.conv_id * 1048576 + a.turn AS src, a.conv_id * 1048576 + b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
RING = """
sz AS (SELECT count(*) AS n FROM supplier),
rn AS (SELECT s_suppkey AS node_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Even' ELSE 'Odd' END AS parity FROM supplier),
re AS (SELECT s_suppkey AS src, (s_suppkey + 1) % n AS dst, 'DATA' AS etype, 'step' AS label FROM supplier, sz
 UNION ALL SELECT s_suppkey, s_suppkey * 2 % n, 'CONTROL', 'double' FROM supplier, sz)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flat(df: DataFrame) -> DataFrame:
    """Without graph_id; arrays as sorted-as-given text."""
    return df.select(*(F.array_join(F.transform(f"`{c}`", lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes if c != "graph_id"))


def dot(body: str) -> str:
    return "digraph G {" + body + "}"


# Predicates: scans of one vertex or one edge


@query(f"WITH {TRADE} SELECT node_id AS v FROM tn WHERE list_contains(types, 'customer')")
def single_vertex_is(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""v [label="is('customer')"]""")))


@query(f"WITH {TRADE} SELECT node_id AS v FROM tn WHERE list_contains(types, 'Entity') AND (list_contains(types, 'BUILDING') OR list_contains(types, 'supplier'))")
def subtype_is(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""v [label="is('Entity') and (is('BUILDING') or is('supplier'))"]""")))


@query(f"WITH {RING} SELECT DISTINCT src AS a, dst AS b FROM re WHERE etype = 'CONTROL'")
def edge_kind_filter(spark, sf):
    return flat(match(views.ring(spark, sf), dot("""a; b; a -> b [label="is('CONTROL')"]""")))


@query(f"WITH {TRADE} SELECT DISTINCT src AS a, dst AS b FROM te WHERE label = 'nation'")
def edge_label_filter(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""a -> b [label="name() = 'nation'"]""")))


@query(f"WITH {TRADE} SELECT node_id AS v FROM tn WHERE NOT (list_contains(types, 'part') OR list_contains(types, 'orders')) AND (list_contains(types, 'customer') OR NOT list_contains(types, 'supplier'))")
def and_or_not(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""v [label="not (is('part') or is('orders')) and (is('customer') or not is('supplier'))"]""")))


@query(f"WITH {TRADE} SELECT DISTINCT src AS a, dst AS b FROM te WHERE label <> 'part' AND label <> 'supplier'")
def neq_label(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""a -> b [label="name() != 'part' and name() != 'supplier'"]""")))


@query("SELECT r_regionkey::BIGINT AS v FROM region WHERE FALSE")
def type_mismatch_false(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""v [label="is('region') or 'five' = 5"]""")))


@query(f"WITH {SESSION} SELECT node_id AS v FROM sn WHERE kind = 'purchase' AND user_id % 2 = 0")
def method_access(spark, sf):
    g = views.session(spark, sf)
    even = views.table(spark, sf, "events").select(F.col("event_id").alias("node_id"), (F.col("user_id") % 2 == 0).alias("even"))
    nodes = g.nodes.join(even, "node_id").withColumn("method_class", F.when(F.array_contains("types", "purchase"), F.when(F.col("even"), "shop.Even").otherwise("shop.Odd"))).withColumn("method_name", F.when(F.col("method_class").isNotNull(), F.lit("buy")))
    return flat(match(PropertyGraph.of(nodes, g.edges), dot("""v [label="method().className = 'shop.Even' and method().name = 'buy'"]""")))


@query(f"WITH {TRADE} SELECT node_id AS v FROM tn")
def const_true_pattern(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""v [label="five = 5 and not false"]""")))


# Joins: patterns of several edges


@query(f"WITH {TRADE} SELECT o.src AS o, o.dst AS c, n.dst AS n FROM te o JOIN te n ON o.dst = n.src WHERE o.label = 'customer' AND n.label = 'nation'")
def chain_2hop(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""o [label="is('orders')"]; c [label="is('customer')"]; n [label="is('nation')"]; o -> c [label="name() = 'customer'"]; c -> n [label="name() = 'nation'"]""")))


@query("SELECT 3000000000000 + c_custkey AS c, 4000000000000 + s_suppkey AS s, 2000000000000 + c_nationkey AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey")
def fan_in(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""c [label="is('customer')"]; s [label="is('supplier')"]; n; c -> n; s -> n""")))


@query("WITH p AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT 6000000000000 + l_orderkey AS o, 5000000000000 + l_partkey AS p, 4000000000000 + l_suppkey AS s FROM p JOIN s USING (l_orderkey)")
def fan_out(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""o [label="is('orders')"]; o -> p [label="name() = 'part'"]; o -> s [label="name() = 'supplier'"]""")))


@query("""WITH b AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), a AS MATERIALIZED (SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 6000000000000 + o_orderkey AS o, 3000000000000 + c_custkey AS c, 4000000000000 + s_suppkey AS s, 2000000000000 + c_nationkey AS n FROM a JOIN b ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey""")
def diamond(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""o [label="is('orders')"]; o -> c [label="name() = 'customer'"]; o -> s [label="name() = 'supplier'"]; c -> n [label="name() = 'nation'"]; s -> n [label="name() = 'nation'"]""")))


@query(f"WITH {RING} SELECT DISTINCT a.src AS a, a.dst AS b FROM re a JOIN re b ON a.dst = b.src AND a.src = b.dst")
def two_cycle(spark, sf):
    return flat(match(views.ring(spark, sf), dot("a -> b; b -> a")))


@query(f"WITH {RING} SELECT DISTINCT a.src AS a, a.dst AS b, b.dst AS c FROM re a JOIN re b ON a.dst = b.src JOIN re c ON b.dst = c.src AND c.dst = a.src")
def triangle(spark, sf):
    return flat(match(views.ring(spark, sf), dot("a -> b -> c -> a")))


@query(f"WITH {RING} SELECT DISTINCT src AS a, x.dst AS b FROM (SELECT DISTINCT src FROM re WHERE src = dst) JOIN re x USING (src)")
def self_loop(spark, sf):
    return flat(match(views.ring(spark, sf), dot("a -> a; a -> b")))


@query(f"WITH {RING} SELECT DISTINCT x.src AS a, x.dst AS b FROM re x JOIN re y ON x.src = y.src AND x.dst = y.dst WHERE x.label = 'step' AND y.label = 'double'")
def parallel_pattern_edges(spark, sf):
    return flat(match(views.ring(spark, sf), dot("""a -> b [label="name() = 'step'"]; a -> b [label="name() = 'double'"]""")))


@query(f"WITH {RING}, d AS (SELECT DISTINCT src, dst FROM re) SELECT x.src AS a, x.dst AS b, y.dst AS c FROM d x JOIN d y ON x.src = y.src")
def homomorphism_noninjective(spark, sf):
    return flat(match(views.ring(spark, sf), dot("a -> b; a -> c")))


# Repeated vertices


@query(f"WITH {TRADE} SELECT string_agg(src::VARCHAR, ',' ORDER BY src) AS s, dst AS n FROM (SELECT DISTINCT src, dst FROM te JOIN tn ON node_id = src WHERE list_contains(types, 'supplier')) GROUP BY dst")
def repeated_sources(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""s [label="[]|is('supplier')"]; n [label="is('nation')"]; s -> n""")))


@query(f"WITH {TRADE} SELECT x.src AS o, count(*) AS n_pairs, count(DISTINCT x.dst) AS n_parts FROM te x JOIN te y ON x.src = y.src WHERE x.label = 'part' AND y.label = 'supplier' GROUP BY x.src")
def repeated_bag(spark, sf):
    rows = match(views.trade(spark, sf), dot("""o [label="is('orders')"]; p [label="[]|is('part')"]; s [label="[]|is('supplier')"]; o -> p; o -> s"""), bag=True)
    return rows.select("o", F.size("p").cast("long").alias("n_pairs"), F.size(F.array_distinct("p")).cast("long").alias("n_parts"))


@query(f"WITH {TRADE}, m AS (SELECT a.src AS c, b.src AS s, a.dst AS n, r.dst AS r FROM te a JOIN te b ON a.dst = b.dst JOIN te r ON r.src = a.dst JOIN tn x ON x.node_id = a.src JOIN tn y ON y.node_id = b.src WHERE list_contains(x.types, 'AUTOMOBILE') AND list_contains(y.types, 'supplier')) SELECT n, r, string_agg(DISTINCT c::VARCHAR, ',' ORDER BY c::VARCHAR) AS c, string_agg(DISTINCT s::VARCHAR, ',' ORDER BY s::VARCHAR) AS s FROM m GROUP BY n, r")
def double_repeated(spark, sf):
    return flat(match(views.trade(spark, sf), dot("""c [label="[]|is('AUTOMOBILE')"]; s [label="[]|is('supplier')"]; n; r [label="is('region')"]; c -> n; s -> n; n -> r""")))


# Paths


@query(f"WITH RECURSIVE {CONV}, p AS (SELECT node_id AS start, []::BIGINT[] AS path, node_id AS last FROM cn WHERE role = 'user' UNION ALL SELECT p.start, list_append(p.path, dst), dst FROM p JOIN ce ON src = p.last WHERE NOT list_contains(p.path, dst)) SELECT start AS u, array_to_string(path, ',') AS w FROM p")
def kleene_paths(spark, sf):
    return flat(match(views.conversation(spark, sf), dot("""u [label="is('user')"]; w; u -> w [label="*|is('CONTROL')"]""")))


@query(f"""WITH RECURSIVE {SESSION}, p AS (SELECT node_id AS start, []::BIGINT[] AS path, node_id AS last FROM sn WHERE kind = 'purchase'
 UNION ALL SELECT p.start, list_append(p.path, dst), dst FROM p JOIN se ON src = p.last JOIN sn ON node_id = dst WHERE kind = 'signup')
SELECT start AS u, array_to_string(path, ',') AS w FROM p""")
def kleene_zero(spark, sf):
    return flat(match(views.session(spark, sf), dot("""u [label="is('purchase')"]; w [label="is('signup')"]; u -> w [label="*|is('CONTROL')"]""")))


@query(f"""WITH RECURSIVE {SESSION}, p AS (SELECT node_id AS start, []::BIGINT[] AS path, node_id AS last FROM sn WHERE kind = 'signup'
 UNION ALL SELECT p.start, list_append(p.path, dst), dst FROM p JOIN se ON src = p.last JOIN sn ON node_id = dst WHERE kind IN ('view', 'click') AND NOT list_contains(p.path, dst))
SELECT start AS s, array_to_string(path, ',') AS run, dst AS e FROM p JOIN se ON src = p.last JOIN sn ON node_id = dst WHERE kind = 'purchase'""")
def kleene_then_edge(spark, sf):
    return flat(match(views.session(spark, sf), dot("""s [label="is('signup')"]; run [label="is('view') or is('click')"]; e [label="is('purchase')"]; s -> run [label="*|name() = 'next'"]; run -> e [label="name() = 'next'"]""")))


@query(f"""WITH RECURSIVE {TRADE}, d AS (SELECT DISTINCT src, dst FROM te WHERE label IN ('customer', 'supplier', 'nation')), f AS (SELECT 6000000000000 + o_orderkey AS o FROM orders WHERE o_orderstatus = 'P'),
p AS (SELECT o AS start, o AS last, '' AS path FROM f UNION ALL SELECT p.start, d.dst, CASE WHEN p.path = '' THEN '' ELSE p.path || ',' END || d.dst FROM p JOIN d ON d.src = p.last JOIN tn ON node_id = d.dst WHERE list_contains(types, 'customer') OR list_contains(types, 'supplier'))
SELECT a.start AS o, a.path AS x, b.path AS y, e.dst AS n FROM p a JOIN d e ON e.src = a.last JOIN tn ON node_id = e.dst AND list_contains(types, 'nation') JOIN p b ON b.start = a.start JOIN d g ON g.src = b.last AND g.dst = e.dst WHERE a.path <> b.path""")
def kleene_two_branches_merge(spark, sf):
    g = views.trade(spark, sf)
    rows = match(g, dot("""o [label="is('P')"]; x [label="is('customer') or is('supplier')"]; y [label="is('customer') or is('supplier')"]; n [label="is('nation')"];
        o -> x [label="*|name() != 'part'"]; o -> y [label="*|name() != 'part'"]; x -> n [label="name() = 'nation'"]; y -> n [label="name() = 'nation'"]"""))
    return flat(rows).where("x <> y")


@query(f"WITH RECURSIVE {RING}, p AS (SELECT src AS start, dst AS last FROM re WHERE etype = 'CONTROL' UNION SELECT p.start, dst FROM p JOIN re ON src = p.last WHERE etype = 'CONTROL') SELECT start, last FROM p UNION SELECT node_id, node_id FROM rn")
def reach_cyclic(spark, sf):
    g = views.ring(spark, sf)
    starts = g.nodes.select("graph_id", F.col("node_id").alias("start"))
    return paths.reachable(g, starts, to_column("is('CONTROL')", EdgeTarget())).select("start", "last")


@query(f"WITH {TRADE} SELECT a.src AS o, a.dst AS c, b.dst AS n, r.dst AS r FROM te a JOIN orders ON a.src = 6000000000000 + o_orderkey AND o_orderstatus = 'P' JOIN te b ON b.src = a.dst JOIN te r ON r.src = b.dst JOIN region ON r.dst = 1000000000000 + r_regionkey AND r_name = 'EUROPE' WHERE a.label = 'customer' AND b.label = 'nation' AND r.label = 'region'")
def match_by_counts(spark, sf):
    """From the rarest vertex on, which the pattern names last."""
    p = dot("""o [label="is('P')"]; c [label="is('customer')"]; n [label="is('nation')"]; r [label="is('EUROPE')"]; o -> c [label="name() = 'customer'"]; c -> n [label="name() = 'nation'"]; n -> r [label="name() = 'region'"]""")
    graph = views.trade(spark, sf)
    named = graph.nodes.withColumn("types", F.when(F.array_contains("types", "region"), F.array_append("types", F.col("name"))).otherwise(F.col("types")))
    return flat(match(PropertyGraph(named, graph.edges), p, by_counts=True))


# Batches, backends, rules


@query(f"WITH {TRADE} SELECT 'data' AS pattern, count(*) AS n FROM (SELECT DISTINCT src, dst FROM te WHERE label = 'nation') UNION ALL SELECT 'regions', count(*) FROM tn WHERE list_contains(types, 'region') UNION ALL SELECT 'segments', count(*) FROM tn WHERE list_contains(types, 'MACHINERY')")
def multi_query_batch(spark, sf):
    found = match_all(views.trade(spark, sf), {"data": dot("""a -> b [label="name() = 'nation'"]"""), "regions": dot("""v [label="is('region')"]"""), "segments": dot("""v [label="is('MACHINERY')"]""")})
    return views.union([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("pattern"), "n") for name, df in found.items()])


@query(SQL["diamond"])
def sql_backend(spark, sf):
    return flat(sqltext.match_by_sql(views.trade(spark, sf), dot("""o [label="is('orders')"]; o -> c [label="name() = 'customer'"]; o -> s [label="name() = 'supplier'"]; c -> n [label="name() = 'nation'"]; s -> n [label="name() = 'nation'"]""")))


@query(f"WITH {TRADE} SELECT a.dst AS who, n.dst AS place FROM te a JOIN te n ON n.src = a.dst WHERE a.label = 'customer' AND n.label = 'nation' GROUP BY ALL")
def capture_groups(spark, sf):
    p = dot("""o [label="is('orders')"]; c [label="(?P<who>)|is('customer')"]; n [label="(?P<place>)|is('nation')"]; o -> c; c -> n""")
    return flat(captured(match(views.trade(spark, sf), p), p).distinct())


@query(f"WITH RECURSIVE {RING}, p AS (SELECT node_id AS start, node_id AS last FROM rn UNION SELECT p.start, dst FROM p JOIN re ON src = p.last WHERE label = 'double') SELECT last AS node_id, min(start)::VARCHAR AS value FROM p GROUP BY last")
def fixpoint_label_propagation(spark, sf):
    rules = Rules(F.lit(None).cast("long"), "long")

    @rules.whole("spread", dot("""a [label="(?P<a>)|true"]; b [label="(?P<b>)|true"]; a -> b [label="name() = 'double'"]"""))
    def spread(c):
        rows = c.with_state("a", "b")
        own = lambda v: F.coalesce(F.col(f"value of {v}"), F.col(v))
        return rows.groupBy("graph_id", F.col("b").alias("node_id")).agg(F.least(F.min(own("a")), F.min(own("b"))).alias("value"))

    g = views.ring(spark, sf)
    #: A label takes fewer rounds than there are nodes to get anywhere.
    _, state, _ = rules.run(g, limit=g.nodes.count())
    return g.nodes.join(state, ["graph_id", "node_id"], "left").select("node_id", F.coalesce("value", "node_id").cast("string").alias("value"))


@query("SELECT (3000000000000 + c_custkey) AS source, 'Debtor' AS cls, round(c_acctbal)::BIGINT AS owed FROM customer WHERE c_acctbal < 0")
def attach_derived(spark, sf):
    rules = Rules(F.lit(None).cast("string"))
    balance = views.table(spark, sf, "customer").where("c_acctbal < 0").select(views.node("customer", "c_custkey").alias("x"), F.expr("floor(abs(c_acctbal) + 0.5) * -1").cast("long").alias("owed"))

    @rules.whole("debt", dot("""x [label="(?P<x>)|is('customer')"]"""))
    def debt(c):
        return Attach(c.matches.join(balance, "x").select("graph_id", F.col("x").alias("node_id"), "owed"), "Debtor", "Owes")

    g, _, _ = rules.run(views.trade(spark, sf))
    e = match(g, dot("""a [label="is('customer')"]; d [label="is('Debtor')"]; a -> d [label="is('Owes')"]"""))
    return e.join(g.nodes.select(F.col("node_id").alias("d"), F.col("attrs")["owed"].cast("long").alias("owed")), "d").select(F.col("a").alias("source"), F.lit("Debtor").alias("cls"), "owed")


WORKLIST = """WITH RECURSIVE n AS (SELECT count(DISTINCT user_id) AS n FROM events), u AS (SELECT DISTINCT user_id FROM events), has AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
call AS (SELECT h.user_id AS a, (h.user_id * 3 + 1) % n AS b FROM has h, n), w AS (SELECT 1::BIGINT AS graph_id UNION SELECT b FROM w JOIN call ON a = graph_id JOIN u ON user_id = b)"""


def user_calls(spark, sf):
    """Every user's events are a graph; a purchase calls another user's."""
    g = views.session(spark, sf, by_user=True)
    n = g.nodes.select("graph_id").distinct().count()
    buys = F.array_contains("types", "purchase")
    nodes = g.nodes.withColumn("method_class", F.when(buys, F.lit("user"))).withColumn("method_name", F.when(buys, ((F.col("graph_id") * 3 + 1) % n).cast("string")))
    methods = g.nodes.select("graph_id").distinct().select("graph_id", F.lit("user").alias("method_class"), F.col("graph_id").cast("string").alias("method_name"))
    start = spark.range(1, 2).select(F.col("id").alias("graph_id"))
    return PropertyGraph.of(nodes, g.edges), methods, start


@query(f"{WORKLIST} SELECT graph_id FROM w")
def worklist_multi_graph(spark, sf):
    g, methods, start = user_calls(spark, sf)
    return apply_recursively(g, dot("""v [label="is('purchase')"]"""), methods, start).select("graph_id")


@query(f"{WORKLIST} SELECT graph_id, event_id AS v FROM w LEFT JOIN events ON user_id = graph_id AND event_type = 'purchase'")
def worklist_matches(spark, sf):
    """The matches in each graph that the worklist reaches; a graph without one has a row of nulls."""
    g, methods, start = user_calls(spark, sf)
    return recursive_matches(g, dot("""v [label="is('purchase')"]"""), methods, start).drop("round")


# Dataflow and domains



@query(f"""WITH {CONV}, t AS (SELECT conv_id, turn, role FROM conversations) SELECT b.conv_id * 1048576 + b.turn AS node_id, coalesce(string_agg(DISTINCT a.role, ',' ORDER BY a.role) FILTER (a.turn < b.turn), '') AS before, string_agg(DISTINCT a.role, ',' ORDER BY a.role) AS after
FROM t b JOIN t a ON a.conv_id = b.conv_id AND a.turn <= b.turn AND (SELECT count(*) FROM t c WHERE c.conv_id = b.conv_id AND c.turn BETWEEN a.turn AND b.turn) = b.turn - a.turn + 1 GROUP BY b.conv_id, b.turn""")
def dataflow_forward_union(spark, sf):
    out = dataflow.forwards(views.conversation(spark, sf), dataflow.gather_types(["system", "user", "assistant"]))
    return flat(out.select("node_id", "before", "after"))


@query(f"""WITH {CONV}, t AS (SELECT conv_id, turn, role FROM conversations) SELECT b.conv_id * 1048576 + b.turn AS node_id, coalesce(string_agg(DISTINCT a.role, ',' ORDER BY a.role) FILTER (a.turn > b.turn), '') AS before, string_agg(DISTINCT a.role, ',' ORDER BY a.role) AS after
FROM t b JOIN t a ON a.conv_id = b.conv_id AND a.turn >= b.turn AND (SELECT count(*) FROM t c WHERE c.conv_id = b.conv_id AND c.turn BETWEEN b.turn AND a.turn) = a.turn - b.turn + 1 GROUP BY b.conv_id, b.turn""")
def dataflow_backward_union(spark, sf):
    out = dataflow.backwards(views.conversation(spark, sf), dataflow.gather_types(["system", "user", "assistant"]))
    return flat(out.select("node_id", "before", "after"))


def quantities(spark, sf) -> DataFrame:
    """Each part's and each supplier's interval of quantities, by part and supplier."""
    q = views.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", domains.interval(F.col("l_quantity"), F.col("l_quantity")).alias("q"))
    part = q.groupBy("l_partkey").agg(domains.join_all(F.col("q")).alias("a"))
    supplier = q.groupBy("l_suppkey").agg(domains.join_all(F.col("q")).alias("b"))
    return q.select("l_partkey", "l_suppkey").distinct().join(part, "l_partkey").join(supplier, "l_suppkey")


BOUNDS = "WITH q AS (SELECT l_partkey, l_suppkey, ceil(l_quantity) AS lo, floor(l_quantity) AS hi FROM lineitem), pa AS (SELECT l_partkey, min(lo) AS alo, max(hi) AS ahi FROM q GROUP BY 1), su AS (SELECT l_suppkey, min(lo) AS blo, max(hi) AS bhi FROM q GROUP BY 1), d AS (SELECT DISTINCT l_partkey, l_suppkey FROM q) "


@query(BOUNDS + "SELECT l_partkey, l_suppkey, least(alo, blo)::DOUBLE AS lo, greatest(ahi, bhi)::DOUBLE AS hi FROM d JOIN pa USING (l_partkey) JOIN su USING (l_suppkey)")
def interval_join(spark, sf):
    return quantities(spark, sf).select("l_partkey", "l_suppkey", domains.join(F.col("a"), F.col("b")).alias("i")).select("l_partkey", "l_suppkey", "i.*")


@query(BOUNDS + "SELECT l_partkey, l_suppkey, greatest(alo, blo)::DOUBLE AS lo, least(ahi, bhi)::DOUBLE AS hi FROM d JOIN pa USING (l_partkey) JOIN su USING (l_suppkey)")
def interval_meet(spark, sf):
    return quantities(spark, sf).select("l_partkey", "l_suppkey", domains.meet(F.col("a"), F.col("b")).alias("i")).select("l_partkey", "l_suppkey", "i.*")


@query(BOUNDS + "SELECT l_partkey, l_suppkey, CASE WHEN blo < alo THEN -1e9 ELSE alo END::DOUBLE AS lo, CASE WHEN bhi > ahi THEN 1e9 ELSE ahi END::DOUBLE AS hi FROM d JOIN pa USING (l_partkey) JOIN su USING (l_suppkey)")
def interval_widen(spark, sf):
    i = quantities(spark, sf).select("l_partkey", "l_suppkey", domains.widen(F.col("a"), F.col("b")).alias("i"))
    return i.select("l_partkey", "l_suppkey", F.greatest(F.col("i.lo"), F.lit(-1e9)).alias("lo"), F.least(F.col("i.hi"), F.lit(1e9)).alias("hi"))


@query("SELECT o_orderkey, greatest(least(ceil(o_totalprice), 1000), 101)::DOUBLE AS lo, greatest(least(ceil(o_totalprice), 1000), 101)::DOUBLE * 2 + 7 AS y FROM orders WHERE ceil(o_totalprice) > 100 AND ceil(o_totalprice) <= 1000000")
def state_assume_assign(spark, sf):
    price = F.ceil("o_totalprice").cast("double")
    start = F.map_from_arrays(F.array(F.lit("x")), F.array(domains.interval(F.least(price, F.lit(1000.0)), price)))
    s = domains.assume(domains.assume(start, "x", ">", 100), "x", "<=", 1_000_000)
    s = views.table(spark, sf, "orders").where(F.ceil("o_totalprice") <= 1_000_000).select("o_orderkey", s.alias("s")).where("s IS NOT NULL")
    s = s.select("o_orderkey", domains.assign(F.col("s"), "y", {"x": 2}, 7).alias("s"))
    return s.select("o_orderkey", F.col("s")["x"]["lo"].alias("lo"), F.col("s")["y"]["lo"].alias("y"))


# Pruning


@query(f"WITH {CONV} SELECT node_id FROM cn WHERE node_id NOT IN (SELECT c.conv_id * 1048576 + c.turn FROM conversations c JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') f ON f.conv_id = c.conv_id AND c.turn >= f.turn WHERE (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn BETWEEN f.turn AND c.turn) = c.turn - f.turn + 1) AND node_id NOT IN (SELECT a.conv_id * 1048576 + a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE NOT EXISTS (SELECT 1 FROM conversations z WHERE z.conv_id = a.conv_id AND z.turn = a.turn - 1))")
def prune_forward(spark, sf):
    g = views.conversation(spark, sf)
    return prune.remove_forwards(g, g.nodes.where(F.array_contains("types", "assistant")).select("graph_id", "node_id")).nodes.select("node_id")


@query("""SELECT b.conv_id * 1048576 + b.turn AS node_id FROM conversations b JOIN conversations e ON e.conv_id = b.conv_id AND e.turn >= b.turn AND e.role = 'assistant'
AND NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = e.conv_id AND x.turn = e.turn + 1)
WHERE (SELECT count(*) FROM conversations x WHERE x.conv_id = b.conv_id AND x.turn BETWEEN b.turn AND e.turn) = e.turn - b.turn + 1""")
def remove_leaves(spark, sf):
    return prune.remove_leaves(views.conversation(spark, sf), control="Turn", returns="assistant").nodes.select("node_id")


@query("""WITH RECURSIVE m AS (SELECT s_suppkey AS s, count(*) OVER () AS n FROM supplier), e AS (SELECT s AS src, (s + 1) % n AS dst FROM m UNION SELECT s, s * 2 % n FROM m),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst WHERE r.dst % 3 = 0) SELECT src, dst FROM r WHERE src % 3 <> 0 AND dst % 3 <> 0""")
def placeholder_resolution(spark, sf):
    g = views.ring(spark, sf)
    return prune.resolve_placeholders(g.edges, g.nodes.where("node_id % 3 = 0"))


# Degrees and exports


@query(f"WITH {RING} SELECT node_id, (SELECT count(*) FROM re WHERE dst = node_id) AS n_in, (SELECT count(*) FROM re WHERE src = node_id) AS n_out, (SELECT count(*) FROM re WHERE dst = node_id AND etype = 'CONTROL') AS control_in, (SELECT count(*) FROM re WHERE src = node_id AND etype = 'CONTROL') AS control_out FROM rn")
def degrees(spark, sf):
    return views.ring(spark, sf).degrees().drop("graph_id")


@query(f"""WITH {TRADE} SELECT 'Node(' || node_id || ',"' || types[1] || '").' AS fact FROM tn UNION ALL SELECT 'Edge(' || src || ',' || dst || ',"data","' || label || '").' FROM te""")
def export_facts(spark, sf):
    return sinks.facts(views.trade(spark, sf)).select("fact")


@query(f"""WITH {RING} SELECT '  "ir' || src || '" -> "ir' || dst || '" [ label="' || label || '", color="' || CASE etype WHEN 'DATA' THEN 'blue", style="", weight="1"' ELSE 'red", style="", weight="10"' END || ' ];' AS line FROM re""")
def export_dot_edges(spark, sf):
    return sinks.dot_edges(views.ring(spark, sf)).select("line")


@query(f"""WITH {TRADE} SELECT '  "ir' || node_id || '" [ label="' || name || '", shape="ellipse", root="false" ];' AS line FROM tn""")
def export_dot_nodes(spark, sf):
    return sinks.dot_nodes(views.trade(spark, sf)).select("line")


@query(f"""WITH {TRADE}, m AS (SELECT src AS s, dst AS n FROM te JOIN tn ON node_id = src WHERE list_contains(types, 'supplier')) SELECT 's' AS "queryVertexName", 'is(''supplier'')' AS query, s AS "irVertexId", name AS "vertexName" FROM m JOIN tn ON node_id = s UNION ALL SELECT 'n', '1 = 1', n, name FROM m JOIN tn ON node_id = n""")
def match_points(spark, sf):
    g, p = views.trade(spark, sf), dot("""s [label="is('supplier')"]; n; s -> n""")
    return sinks.match_points(match(g, p), p, g).drop("graph_id", "match_id")


@query(f"WITH {RING} SELECT DISTINCT src, dst, label FROM re WHERE dst = 4")
def incoming_edges(spark, sf):
    return views.ring(spark, sf).adjacent(4, incoming=True).select("src", "dst", "label").distinct()


@query("SELECT url AS page, string_agg(DISTINCT h, ',' ORDER BY h) AS targets FROM (SELECT url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) GROUP BY url")
def web_targets(spark, sf):
    g = views.web(spark, sf)
    rows = match(g, dot("""p [label="is('Page')"]; t [label="is('Target')"]; p -> t [label="name() = 'href'"]"""))
    name = g.nodes.select("node_id", "name")
    rows = rows.join(name.select(F.col("node_id").alias("p"), F.col("name").alias("page")), "p").join(name.select(F.col("node_id").alias("t"), F.col("name").alias("target")).distinct(), "t")
    return rows.groupBy("page").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("targets"))





PROGRAM = ["items", "low", "high"]


def order_lines(spark, sf):
    """Of each order, what its program (``programs``) depends on."""
    return views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.count("*").alias("items"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


def programs(lines):
    """A program a graph: of each row of ``lines``, x := 0; while x < items: if quantity <= 25, z := x + 1, else z := x + 2; x := z. Nodes: 0 start, 1 loop head,
    2 branch, 3 and 4 its arms, 5 their merge, 6 behind the loop."""
    types = F.create_map(*[x for k, t in enumerate(["StartNode", "LoopBeginNode", "IfNode", "BeginNode", "BeginNode", "MergeNode", "LoopExitNode"]) for x in (F.lit(k), F.lit(t))])
    nodes = lines.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("node_id")).withColumn("types", F.array(types[F.col("node_id")]))
    form, limit = numeric.step, F.col("items").cast("double")
    parts = [
        (0, 1, "next", [form("assign", "x")]),
        (1, 2, "trueSuccessor", [form("assume", "x", "<", None, limit)]),
        (1, 6, "falseSuccessor", [form("assume", "x", ">=", None, limit)]),
        (2, 3, "trueSuccessor", [form("assume", "quantity", "<=", None, 25)]),
        (2, 4, "falseSuccessor", [form("assume", "quantity", ">", None, 25)]),
        (3, 5, "next", [form("assign", "z", "", {"x": 1}, 1)]),
        (4, 5, "next", [form("assign", "z", "", {"x": 1}, 2)]),
        (5, 1, "next", [form("assign", "x", "", {"z": 1}), form("forget", "z")]),
    ]
    each = F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(label).alias("label"), F.array(*ops).alias("steps")) for a, b, label, ops in parts))
    steps = lines.select("graph_id", F.inline(each))
    edges = steps.select("graph_id", "src", "dst", F.lit("CONTROL").alias("etype"), "label")
    bounds = domains.interval(F.col("low").cast("double"), F.col("high").cast("double"))
    start = lines.select("graph_id", F.lit(0).alias("node_id"), F.create_map(F.lit("quantity"), bounds).alias("state"))
    return PropertyGraph.of(nodes, edges), steps, start


@query("""WITH o AS (SELECT l_orderkey AS graph_id, count(*) AS items, ceil(min(l_quantity))::DOUBLE AS low, floor(max(l_quantity))::DOUBLE AS high FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, CASE WHEN low <= 25 THEN 1 ELSE 2 END AS least, CASE WHEN high > 25 THEN 2 ELSE 1 END AS most FROM o)
SELECT graph_id, 1 AS node_id, 'x' AS name, 0.0::DOUBLE AS lo, (items - 1 + most)::DOUBLE AS hi FROM s UNION ALL SELECT graph_id, 6, 'x', items, items - 1 + most FROM s UNION ALL SELECT graph_id, 5, 'z', least, items - 1 + most FROM s
UNION ALL SELECT graph_id, 5, 'x', 0, items - 1 FROM s UNION ALL SELECT graph_id, 3, 'quantity', low, least(high, 25) FROM s WHERE low <= 25 UNION ALL SELECT graph_id, 4, 'quantity', greatest(low, 26), high FROM s WHERE high > 25""")
def numeric_loops(spark, sf):
    """Orders of equal items and quantities have equal programs, whatever their number: each program is analysed once, by the least
    of its orders, and all of its orders get what was found."""
    lines = keep(order_lines(spark, sf))
    own = keep(lines.groupBy(*PROGRAM).agg(F.min("graph_id").alias("graph_id")))
    graph, steps, start = programs(own)
    states = numeric.analyse(graph, steps, start, F.array_contains("types", "LoopBeginNode"))
    rows = states.select("graph_id", "node_id", F.explode("state").alias("name", "bounds"))
    wanted = F.concat_ws(" ", F.col("node_id").cast("string"), "name").isin("1 x", "6 x", "5 z", "5 x", "3 quantity", "4 quantity")
    rows = rows.where(wanted).select("graph_id", F.col("node_id").cast("int").alias("node_id"), "name", "bounds.lo", "bounds.hi")
    found = keep(rows.join(own, "graph_id").drop("graph_id"))
    forget(own)
    same = [lines[c].eqNullSafe(found[c]) for c in PROGRAM]
    return lines.join(found, same).select("graph_id", "node_id", "name", "lo", "hi")
