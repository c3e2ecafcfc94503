"""Property graphs over ordinary tables.

Node ids are computed from keys, so views need no lookup: in the trade graph a node is
``KIND * 10**12 + key`` with the kind of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph

KIND = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6}
BASE = 10**12
#: Numbers of turns that a conversation's nodes have room for.
TURNS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: Column | str) -> Column:
    return F.lit(KIND[kind] * BASE) + (F.col(key) if isinstance(key, str) else key).cast("long")


def entities(df: DataFrame, kind: str, key: str, name: Column, *extra: Column) -> DataFrame:
    return df.select(node(kind, key).alias("node_id"), F.array(F.lit(kind), F.lit("Entity"), *extra).alias("types"), name.cast("string").alias("name"))


def links(df: DataFrame, source: tuple[str, str], target: tuple[str, str], label: str) -> DataFrame:
    return df.select(node(*source).alias("src"), node(*target).alias("dst"), F.lit("DATA").alias("etype"), F.lit(label).alias("label"))


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders, linked by their keys."""
    t = {name: table(spark, sf_dir, name) for name in (*KIND, "lineitem")}
    nodes = [
        entities(t["region"], "region", "r_regionkey", F.col("r_name")),
        entities(t["nation"], "nation", "n_nationkey", F.col("n_name")),
        entities(t["customer"], "customer", "c_custkey", F.col("c_name"), F.col("c_mktsegment")),
        entities(t["supplier"], "supplier", "s_suppkey", F.col("s_name")),
        entities(t["part"], "part", "p_partkey", F.col("p_name")),
        entities(t["orders"], "orders", "o_orderkey", F.col("o_orderkey"), F.col("o_orderstatus")),
    ]
    edges = [
        links(t["nation"], ("nation", "n_nationkey"), ("region", "n_regionkey"), "region"),
        links(t["customer"], ("customer", "c_custkey"), ("nation", "c_nationkey"), "nation"),
        links(t["supplier"], ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "nation"),
        links(t["orders"], ("orders", "o_orderkey"), ("customer", "o_custkey"), "customer"),
        links(t["lineitem"], ("orders", "l_orderkey"), ("part", "l_partkey"), "part").distinct(),
        links(t["lineitem"], ("orders", "l_orderkey"), ("supplier", "l_suppkey"), "supplier").distinct(),
    ]
    return PropertyGraph.of(union(nodes), union(edges))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def session(spark: SparkSession, sf_dir: str, by_user: bool = False) -> PropertyGraph:
    """Events; each one leads to the user's next. ``by_user``: every user is a graph of its own."""
    events = table(spark, sf_dir, "events")
    graph = (F.col("user_id") if by_user else F.lit(0)).cast("long").alias("graph_id")
    nodes = events.select(graph, F.col("event_id").alias("node_id"), F.array("event_type", F.lit("Event")).alias("types"), F.col("event_type").alias("name"))
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.select(graph, F.col("event_id").alias("src"), following.alias("dst"), F.lit("CONTROL").alias("etype"), F.lit("next").alias("label")).where("dst IS NOT NULL")
    return PropertyGraph.of(nodes, edges)


def conversation(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns; each one leads to the next of its conversation."""
    turns = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * TURNS + F.col("turn")
    nodes = turns.select(at.alias("node_id"), F.array("role", F.lit("Turn")).alias("types"), F.col("role").alias("name"))
    here = turns.select(at.alias("src"), (at + 1).alias("dst"), (F.col("turn") + 1).alias("turn"), "conv_id")
    edges = here.join(turns.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return PropertyGraph.of(nodes, edges.select("src", "dst", F.lit("CONTROL").alias("etype"), F.lit("next").alias("label")))


def ring(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Suppliers 0 to N - 1 in a ring, with chords s -> 2s: cycles, a loop at 0 and two edges 1 -> 2."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    n = s.count()
    nodes = s.select(F.col("s").alias("node_id"), F.array(F.lit("Supplier"), F.when(F.col("s") % 2 == 0, "Even").otherwise("Odd")).alias("types"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("name"))
    edges = s.select(F.col("s").alias("src"), ((F.col("s") + 1) % n).alias("dst"), F.lit("DATA").alias("etype"), F.lit("step").alias("label")).unionByName(
        s.select(F.col("s").alias("src"), (F.col("s") * 2 % n).alias("dst"), F.lit("CONTROL").alias("etype"), F.lit("double").alias("label"))
    )
    return PropertyGraph.of(nodes, edges)


def web(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Pages and what their links name; ids are hashes of the names."""
    pages = table(spark, sf_dir, "pages")
    refs = pages.select("url", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    nodes = pages.select(F.xxhash64("url").alias("node_id"), F.array(F.lit("Page")).alias("types"), F.col("url").alias("name")).unionByName(
        refs.select(F.xxhash64("href").alias("node_id"), F.array(F.lit("Target")).alias("types"), F.col("href").alias("name")).distinct()
    )
    return PropertyGraph.of(nodes, refs.select(F.xxhash64("url").alias("src"), F.xxhash64("href").alias("dst"), F.lit("href").alias("label")))
