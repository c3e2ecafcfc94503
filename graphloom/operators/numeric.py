"""Numeric analysis of programs as graphs: interval states that flow over control edges.

Each control edge carries the operations of a step or of a branch (assignments of linear forms, assumptions, variables
forgotten), as data, so that programs of any number of graphs are analysed together. States that meet
in a node are joined; at loop heads they are widened, so that every loop is stable after a few rounds,
and bounds that widening gave up are then won back where the loop's own conditions hold them.

Scale: a round moves what changed in the last one over its edges, a join on (graph_id, node), and merges it
variable by variable, so a node with very many ways in makes no large group. States are kept as a table and tables
of changes (``Latest``). Widening bounds the rounds by the longest way between loop heads, not by the numbers in the programs.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from . import domains
from .domains import INF, STATE, let, top
from .kept import Latest, forget, keep_counted

KEY = ["graph_id", "node_id"]
STEP = "struct<act:string,name:string,relation:string,terms:map<string,double>,constant:double>"


def step(act: str, name: str | Column, relation: str = "", terms: dict[str, float] | Column | None = None, constant: float | Column = 0.0) -> Column:
    """One operation: ``assign`` name := constant + sum of terms, ``assume`` name relation (that form), or ``forget`` name."""
    if act not in ("assign", "assume", "forget"):
        raise ValueError(f"{act} is no operation")
    if act == "assume" and relation not in ("=", "!=", "<", "<=", ">", ">="):
        raise ValueError(f"{relation} is no relation")
    if not isinstance(terms, Column):
        flat = [F.lit(x) for v, k in (terms or {}).items() for x in (v, float(k))]
        terms = F.create_map(*flat) if flat else F.create_map()
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (F.lit(act).alias("act"), col(name).alias("name"), F.lit(relation).alias("relation"), terms.alias("terms"), col(constant).cast("double").alias("constant"))
    return F.struct(*values).cast(STEP)


def times(a: Column, k: Column) -> Column:
    """An interval times a number; 0 times infinity is 0."""
    low, high = F.when(k >= 0, a["lo"]).otherwise(a["hi"]), F.when(k >= 0, a["hi"]).otherwise(a["lo"])
    return F.struct(F.when(k == 0, 0.0).otherwise(low * k).alias("lo"), F.when(k == 0, 0.0).otherwise(high * k).alias("hi"))


def bound(state: Column, name: Column) -> Column:
    return F.coalesce(state[name], top())


def form_bounds(state: Column, terms: Column, constant: Column) -> Column:
    start = F.struct(constant.alias("lo"), constant.alias("hi")).cast(domains.INTERVAL)
    part = lambda e: let(bound(state, e["key"]), lambda b: times(b, e["value"]))
    return F.aggregate(F.map_entries(terms), start, lambda sum_, e: let(part(e), lambda p: domains.plus(sum_, p)).cast(domains.INTERVAL))


def limited(now: Column, relation: Column, value: Column) -> Column:
    """An interval under ``relation`` to some number of the interval ``value``, over integers."""
    whole = lambda x, f: F.when(F.abs(x) == INF, x).otherwise(f(x).cast("double"))
    low = F.when(relation.isin("=", ">="), whole(value["lo"], F.ceil)).when(relation == ">", whole(value["lo"], F.floor) + 1).otherwise(F.lit(-INF))
    high = F.when(relation.isin("=", "<="), whole(value["hi"], F.floor)).when(relation == "<", whole(value["hi"], F.ceil) - 1).otherwise(F.lit(INF))
    point = (value["lo"] == value["hi"]) & (relation == "!=")
    ends = lambda x: F.struct(
        F.when(point & (x["lo"] == value["lo"]), x["lo"] + 1).otherwise(x["lo"]).alias("lo"), F.when(point & (x["hi"] == value["hi"]), x["hi"] - 1).otherwise(x["hi"]).alias("hi")
    )
    return let(F.struct(F.greatest(now["lo"], low).alias("lo"), F.least(now["hi"], high).alias("hi")), ends)


def after(state: Column, steps: Column) -> Column:
    """The state after the operations, in their order; null (bottom) if an assumption can't hold."""

    def apply(s: Column, op: Column) -> Column:
        name = op["name"]
        rest = F.map_filter(s, lambda k, _: k != name)
        put = lambda v: F.map_concat(rest, F.map_from_arrays(F.array(name), F.array(v)))
        kept = lambda left: F.when(~domains.is_empty(left), put(left))
        assumed = lambda value: let(limited(bound(s, name), op["relation"], value), kept)
        done = lambda value: F.when(op["act"] == "forget", rest).when(op["act"] == "assign", put(value)).otherwise(assumed(value))
        return F.when(s.isNotNull(), let(form_bounds(s, op["terms"], op["constant"]), done)).cast(STATE)

    return F.aggregate(F.coalesce(steps, F.array().cast(f"array<{STEP}>")), state.cast(STATE), apply)


def narrow(old: Column, new: Column) -> Column:
    """Infinite bounds of ``old`` become those of ``new``."""
    return F.struct(F.when(old["lo"] == -INF, new["lo"]).otherwise(old["lo"]).alias("lo"), F.when(old["hi"] == INF, new["hi"]).otherwise(old["hi"]).alias("hi"))


def analyse(graph: PropertyGraph, steps: DataFrame, start: DataFrame, head: Column, patience: int = 100) -> DataFrame:
    """graph_id, node_id, state: the interval state in which each node is entered; nodes that can't be reached have no row.

    steps: graph_id, src, dst, label, steps (see ``step``), for the control edges that do something; start: graph_id,
    node_id, state. ``head`` (over node columns) names the nodes that are widened, at least one on each cycle; where a cycle has
    none, all nodes are widened after ``patience`` rounds. A null state is bottom, a variable without an entry unbounded.
    """
    flows = graph.edges.where("etype = 'CONTROL'").select("graph_id", "src", "dst", "label").join(steps, ["graph_id", "src", "dst", "label"], "left")
    flows, _ = keep_counted(flows.select("graph_id", "src", "dst", "steps"))
    heads, _ = keep_counted(graph.nodes.where(head).select(*KEY, F.lit(True).alias("head")))
    start, n = keep_counted(start.select(*KEY, F.col("state").cast(STATE).alias("state")).where("state IS NOT NULL"))
    states, front = Latest(KEY, start, n), start
    everywhere = False

    def entered(moved: DataFrame) -> DataFrame:
        """What ``moved`` (graph_id, src, steps, dst, state) brings to the nodes it leads to."""
        sent = moved.select("graph_id", F.col("dst").alias("node_id"), after(F.col("state"), F.col("steps")).alias("state")).where("state IS NOT NULL")
        return domains.merge_by(sent, KEY, "state").select(*KEY, F.col("state").alias("met"))

    def changed(met: DataFrame, how) -> tuple[DataFrame, int]:
        """The nodes of ``met`` whose state becomes another one by how(old, met, head)."""
        old = states.of(met.select(*KEY)).select(*KEY, F.col("state").alias("old"))
        both = met.join(old, KEY, "left").join(heads, KEY, "left").withColumn("head", F.coalesce("head", F.lit(False)) | F.lit(everywhere))
        both = both.select(*KEY, "old", how(F.col("old"), F.col("met"), F.col("head")).cast(STATE).alias("state"))
        return keep_counted(both.where(~domains.equal_states(F.col("old"), F.col("state"))).select(*KEY, "state"))

    for turn in itertools.count(1):
        everywhere = turn > patience
        met, _ = keep_counted(entered(flows.join(front.withColumnRenamed("node_id", "src"), ["graph_id", "src"])))
        #: What comes is joined to what was there, so states only grow.
        grown = lambda old, new, is_head: let(domains.join_states(old, new), lambda j: F.when(is_head, domains.widen_states(old, j)).otherwise(j))
        front, n = changed(met, grown)
        forget(met)
        if not n:
            forget(front)
            break
        states.add(front, n)
    todo, _ = keep_counted(states.of().select(*KEY))
    while True:
        #: States are entered anew from all ways in; loop heads only give up infinite bounds, so this ends as well.
        asked = flows.withColumnRenamed("dst", "node_id").join(todo, KEY, "left_semi").withColumnRenamed("node_id", "dst")
        sources = states.of(asked.select("graph_id", F.col("src").alias("node_id")).distinct()).withColumnRenamed("node_id", "src")
        own = start.join(todo, KEY, "left_semi").select(*KEY, "state")
        sent = asked.join(sources, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id"), after(F.col("state"), F.col("steps")).alias("state"))
        #: A node that nothing reaches any more is bottom.
        none = todo.select(*KEY, F.lit(None).cast(STATE).alias("state"))
        met, _ = keep_counted(domains.merge_by(sent.unionByName(own).unionByName(none), KEY, "state").select(*KEY, F.col("state").alias("met")))
        less = lambda old, new, is_head: F.when(old.isNull() | new.isNull(), F.lit(None)).when(is_head, domains.zip_states(old, new, narrow)).otherwise(new)
        down, n = changed(met, less)
        forget(met)
        if not n:
            forget(down, todo, flows, heads)
            break
        forget(todo)
        following = flows.join(down.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi")
        todo, _ = keep_counted(following.select("graph_id", F.col("dst").alias("node_id")).distinct())
        states.add(down, n)
    return states.close().where("state IS NOT NULL")
