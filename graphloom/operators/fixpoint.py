"""Rules on matches, iterated until nothing changes, and worklists over many graphs."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EDGES, NODES, PropertyGraph, shaped
from ..plans.pattern import Pattern, read_pattern
from ..plans.planner import captured, match
from . import paths
from .kept import forget, keep, keep_counted, kept_as

KEY = ["graph_id", "node_id"]


@dataclass
class Context:
    """What an action sees: the matches' captures, the state so far (graph_id, node_id, value), the graph."""

    matches: DataFrame
    state: DataFrame
    graph: PropertyGraph
    default: Column

    def state_of(self, capture: str) -> Column:
        return F.coalesce(F.col(f"value of {capture}"), self.default)

    def with_state(self, *captures: str) -> DataFrame:
        """The matches with ``value of <capture>`` for each capture: its state, else the default."""
        out = self.matches
        for c in captures:
            s = self.state.select("graph_id", F.col("node_id").alias(c), F.col("value").alias(f"value of {c}"))
            out = out.join(s, ["graph_id", c], "left").withColumn(f"value of {c}", self.state_of(c))
        return out


@dataclass(frozen=True)
class Attach:
    """For each row of ``sources`` (graph_id, node_id, and columns for attrs): exactly one derived node of that class."""

    sources: DataFrame
    cls: str
    edge: str


@dataclass
class Rule:
    """action(Context) -> state updates (graph_id, node_id, value), Attach, both as a tuple, or None."""

    name: str
    pattern: Pattern
    action: Callable[[Context], object]


@dataclass
class Rules:
    """Named queries with actions. ``default`` is the state of a node without one.

        rules = Rules(F.lit(0))
        @rules.whole("name", dot)            # action(context)
        rules.capture("name", dot, {"x": column})   # each captured node gets that value
    """

    default: Column
    value_type: str = "string"
    rules: list[Rule] = field(default_factory=list)

    def whole(self, name: str, dot: str | Pattern):
        pattern = read_pattern(dot) if isinstance(dot, str) else dot

        def add(action: Callable[[Context], object]):
            self.rules.append(Rule(name, pattern, action))
            return action

        return add

    def capture(self, name: str, dot: str | Pattern, values: dict[str, Callable[[Context], Column] | Column]) -> None:
        """Each node that a capture binds to gets the capture's value, a Column over the matches. A node
        with several values gets the largest, as rows have no order."""

        def action(context: Context) -> DataFrame:
            out = None
            for c, value in values.items():
                nodes = F.explode(f"`{c}`") if dict(context.matches.dtypes)[c].startswith("array") else F.col(f"`{c}`")
                got = context.matches.withColumn("value", value(context) if callable(value) else value).select("graph_id", nodes.alias("node_id"), "value")
                out = got if out is None else out.unionByName(got)
            return out.groupBy(*KEY).agg(F.max("value").alias("value"))

        self.rules.append(Rule(name, read_pattern(dot) if isinstance(dot, str) else dot, action))

    def run(self, graph: PropertyGraph, limit: int = 50, graph_only: bool = False, max_length: int = 32) -> tuple[PropertyGraph, DataFrame, int]:
        """(graph, state, rounds) once a round changes nothing; an error if ``limit`` + 1 rounds all change something.

        A round matches all rules on the graph at its start (as before, where the graph hasn't changed); then the
        actions run in order, each seeing the states written before it in the same round. ``graph_only``: changes of
        state alone don't count.
        """
        spark = graph.nodes.sparkSession
        state = spark.createDataFrame([], f"graph_id long, node_id long, value {self.value_type}")
        found, fresh = [], True
        for rounds in range(1, limit + 2):
            changed = False
            if fresh:
                forget(*(m for _, m in found))
                found = [(r, keep(captured(match(graph, r.pattern, max_length=max_length), r.pattern).distinct())) for r in self.rules]
            fresh, before = False, state
            for r, matches in found:
                result = r.action(Context(matches, state, graph, self.default))
                for x in result if isinstance(result, tuple) else (result,):
                    if isinstance(x, Attach):
                        graph, new = attach(graph, x)
                        fresh |= new
                    elif x is not None:
                        state, new = updated(state, x.select(*KEY, F.col("value").cast(self.value_type).alias("value")), len(found) == 1 and not isinstance(result, tuple))
                        changed |= new
            if len(found) > 1 and changed:  # a later rule may have undone what an earlier one did
                changed = not same(before, state)
            if not fresh and (graph_only or not changed):
                forget(*(m for _, m in found))
                return graph, state, rounds
        raise RuntimeError(f"not stable after {limit + 1} rounds")


def updated(state: DataFrame, x: DataFrame, alone: bool) -> tuple[DataFrame, bool]:
    """The state with the values of ``x``, and whether that changed a value. ``alone``: nothing else reads the old table."""
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    joined = state.withColumn("had", F.lit(True)).join(x.select(*KEY, F.col("value").alias("to"), F.lit(True).alias("put")), KEY, "full")
    joined = joined.select(*KEY, F.when(F.col("put"), F.col("to")).otherwise(F.col("value")).alias("value"), (F.col("put").isNotNull() & (F.col("had").isNull() | (text("value") != text("to")))).alias("changed"))
    new, changed = keep_counted(joined, F.col("changed"))
    if alone:
        forget(state)
    return kept_as(new.drop("changed"), new), changed > 0


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two states are equal (values compare as JSON, so maps work too)."""
    text = lambda d, name: d.select(*KEY, F.to_json(F.struct("value")).alias(name))
    return text(a, "x").join(text(b, "y"), KEY, "full").where("NOT x <=> y").isEmpty()


def attach(graph: PropertyGraph, what: Attach) -> tuple[PropertyGraph, bool]:
    """Upsert one derived node of ``what.cls`` for each source: an equal one stays, a different one is replaced.

    The id of a derived node is a hash of its source and class, below zero, so it is the same in any run.
    """
    payload = [c for c in what.sources.columns if c not in KEY]
    attrs = F.create_map(*[x for c in payload for x in (F.lit(c), F.col(c).cast("string"))]) if payload else F.create_map().cast("map<string,string>")
    own = F.xxhash64("graph_id", "node_id", F.lit(what.cls))
    node_id = F.when(own < 0, own).otherwise(-own - 1)
    wanted = keep(what.sources.withColumn("attrs", attrs).groupBy(*KEY).agg(F.max(F.to_json("attrs")).alias("j")).select("graph_id", F.col("node_id").alias("source"), node_id.alias("node_id"), "j"))
    mine = graph.nodes.where((F.col("kind") == "SPECIFIC") & F.array_contains("types", what.cls)).select("graph_id", "node_id", F.to_json("attrs").alias("had"))
    fresh = keep(wanted.join(mine, KEY, "left").where("had IS NULL OR had <> j").drop("had"))
    if fresh.isEmpty():
        return graph, False
    nodes = fresh.select("graph_id", "node_id", F.lit("SPECIFIC").alias("kind"), F.array(F.lit(what.cls)).alias("types"), F.lit(what.cls).alias("name"), F.from_json("j", "map<string,string>").alias("attrs"))
    edges = fresh.select("graph_id", F.col("source").alias("src"), F.col("node_id").alias("dst"), F.lit("EXTRA").alias("etype"), F.lit(what.edge).alias("eclass"), F.lit(what.edge).alias("label"))
    old = graph.edges.join(fresh.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_anti").select(graph.edges.columns)
    return PropertyGraph(
        keep(graph.nodes.join(fresh.select(*KEY), KEY, "left_anti").select(graph.nodes.columns).unionByName(shaped(nodes, NODES, {}))),
        keep(old.unionByName(shaped(edges, EDGES, {}))),
    ), True


def apply_recursively(graph: PropertyGraph, pattern: str | Pattern, methods: DataFrame, start: DataFrame, wanted: Column | None = None, rounds: int | None = None) -> DataFrame:
    """graph_id, round: the graphs (of methods) that a pattern reaches from ``start`` (graph_id), and over how few calls.

    In each graph that is reached the pattern is matched; bound nodes (of paths, the last) that name a target
    method lead to that method's graph (methods: graph_id, method_class, method_name), unless not ``wanted``. The graphs
    are finite, so this ends; with ``rounds`` it is an error if the last of that many still finds a graph.

    All graphs that any nodes' methods could lead to are matched at once, and chains of calls followed by ``paths.shortest``.
    With * edges only graphs that are really reached are matched, round by round: in others, paths may be beyond their limit.
    """
    pattern = read_pattern(pattern) if isinstance(pattern, str) else pattern
    methods = methods.where(wanted) if wanted is not None else methods
    if pattern.kleene:
        return by_rounds(graph, pattern, methods, start, rounds)
    methods = methods.select(F.col("graph_id").alias("to"), "method_class", "method_name").distinct()
    named = lambda nodes: nodes.select("graph_id", "method_class", "method_name").distinct().join(methods, ["method_class", "method_name"]).select(F.col("graph_id").alias("last"), "to").distinct()
    starts = start.select(F.lit(0).alias("start"), F.col("graph_id").alias("last"))
    may = keep(named(graph.nodes.where("method_name IS NOT NULL")))
    reach = paths.shortest(starts, may)
    near = reach.select(F.col("last").alias("graph_id"))
    here = PropertyGraph(*(t.join(near, "graph_id", "left_semi").select(t.columns) for t in (graph.nodes, graph.edges)))
    does = keep(named(callers(here, pattern)))
    if does.count() < may.join(near.withColumnRenamed("graph_id", "last"), "last", "left_semi").count():
        narrower = paths.shortest(starts, does)
        forget(reach)
        reach = narrower
    forget(may, does)
    if rounds is not None and not reach.where(F.col("hops") >= rounds).isEmpty():
        raise RuntimeError(f"not done after {rounds} rounds")
    return reach.select(F.col("last").alias("graph_id"), F.col("hops").cast("int").alias("round"))


def recursive_matches(graph: PropertyGraph, pattern: str | Pattern, methods: DataFrame, start: DataFrame, wanted: Column | None = None, rounds: int | None = None, max_length: int = 32) -> DataFrame:
    """graph_id, round and the pattern's vertices: the matches in every graph that ``apply_recursively`` reaches.

    A reached graph without a match has one row with nulls, so the graphs are the same. All graphs are matched at once.
    """
    pattern = read_pattern(pattern) if isinstance(pattern, str) else pattern
    reached = keep(apply_recursively(graph, pattern, methods, start, wanted, rounds).select("graph_id", F.col("round").alias("calls to it")))
    here = PropertyGraph(*(t.join(reached, "graph_id", "left_semi").select(t.columns) for t in (graph.nodes, graph.edges)))
    found = match(here, pattern, max_length=max_length)
    return reached.join(found, "graph_id", "left").withColumnRenamed("calls to it", "round")


def callers(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """The nodes with a method that a pattern binds, of paths the last."""
    rows = match(graph, pattern)
    types = dict(rows.dtypes)
    last = lambda v: F.col(f"`{v}`") if not types[v].startswith("array") else F.when(F.size(f"`{v}`") > 0, F.element_at(f"`{v}`", -1))
    bound = rows.select("graph_id", F.explode(F.array(*(last(v) for v in pattern.vertices))).alias("node_id")).where("node_id IS NOT NULL").distinct()
    return bound.join(graph.nodes.where("method_name IS NOT NULL"), KEY)


def by_rounds(graph: PropertyGraph, pattern: Pattern, methods: DataFrame, start: DataFrame, rounds: int | None) -> DataFrame:
    """``apply_recursively``, matching only the graphs of the frontier."""
    new = keep(start.select("graph_id").distinct().withColumn("round", F.lit(0)))
    seen = new
    for k in itertools.count(1):
        if rounds is not None and k > rounds:
            raise RuntimeError(f"not done after {rounds} rounds")
        here = PropertyGraph(graph.nodes.join(new, "graph_id", "left_semi"), graph.edges.join(new, "graph_id", "left_semi"))
        calls = callers(here, pattern).select("method_class", "method_name").distinct()
        found = methods.join(calls, ["method_class", "method_name"], "left_semi").select("graph_id").distinct().join(seen, "graph_id", "left_anti")
        new = keep(found.withColumn("round", F.lit(k)))
        if new.isEmpty():
            return seen
        seen = keep(seen.unionByName(new))
