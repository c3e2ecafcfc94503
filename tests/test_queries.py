import pytest

import __spark_entry__ as entry
from graphloom import graph_queries

from .conftest import SMALL, rows_of


def test_all_have_sql():
    assert graph_queries.SQL.keys() == graph_queries.QUERIES.keys()
    assert graph_queries.QUERIES.items() <= entry.queries().items()


@pytest.mark.parametrize("name", graph_queries.QUERIES)
def test_query(spark, oracle, name):
    assert rows_of(graph_queries.QUERIES[name](spark, SMALL)) == oracle(graph_queries.SQL[name])


def test_labels_take_more_than_51_rounds(spark, tmp_path):
    """With 59 suppliers, doubling makes one cycle of 58 nodes."""
    import duckdb

    spark.createDataFrame([(k,) for k in range(59)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(graph_queries.SQL["fixpoint_label_propagation"]).fetchall()
    got = graph_queries.QUERIES["fixpoint_label_propagation"](spark, str(tmp_path)).select("node_id", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["o", "c", "s", "n"]


def test_numeric_loops_by_shuffled_joins(spark, oracle):
    """Tables too large to broadcast, with partitions that are merged at run time, as from sf0.1 on."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert rows_of(graph_queries.QUERIES["numeric_loops"](spark, SMALL)) == oracle(graph_queries.SQL["numeric_loops"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fan_in_gives_every_pair(spark):
    """A row for each customer and supplier of a nation, by enumeration."""
    c = spark.read.parquet(f"{SMALL}/customer.parquet").select("c_custkey", "c_nationkey").collect()
    s = spark.read.parquet(f"{SMALL}/supplier.parquet").select("s_suppkey", "s_nationkey").collect()
    want = sorted((3 * 10**12 + k, 4 * 10**12 + j, 2 * 10**12 + n) for k, n in c for j, m in s if n == m)
    assert sorted((r.c, r.s, r.n) for r in graph_queries.QUERIES["fan_in"](spark, SMALL).collect()) == want


def test_points_to_derives_its_graph_once(spark):
    """What the result still reads are kept tables, so the tables and the patterns over them aren't gone through again."""
    assert not [f for f in graph_queries.QUERIES["points_to"](spark, SMALL).inputFiles() if SMALL in f]


def test_numeric_loops_analyses_equal_programs_once(spark, tmp_path, monkeypatch):
    """40 orders of 3 programs: 3 starts, the rows of all orders."""
    import duckdb

    lines = [(k, q) for k in range(40) for q in ([10.0], [10.0, 30.0], [26.0, 26.5, 50.0])[k % 3]]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT graph_id, node_id, name, lo, hi FROM ({graph_queries.SQL['numeric_loops']})").fetchall()
    started, analyse = [], graph_queries.numeric.analyse
    monkeypatch.setattr(graph_queries.numeric, "analyse", lambda graph, steps, start, *rest: started.append(start.count()) or analyse(graph, steps, start, *rest))
    got = graph_queries.QUERIES["numeric_loops"](spark, str(tmp_path)).select("graph_id", "node_id", "name", "lo", "hi").collect()
    assert sorted(map(tuple, got)) == sorted(want) and started == [3]
