"""Approximate nearest neighbours by cosine: an NN-descent graph, searched greedily.

Index: equal vectors are one node. A node starts with the nearest nodes of a few blocks, cut from orders by random
projections; then, round by round, the neighbours (and reverse neighbours) of a node are introduced to each other by
Spark joins, each keeps the ``degree`` nearest it has met, and pairs that met before don't meet again. It ends
when a round brings fewer than ``settled`` of all list entries. Every row is indexed; nothing is fitted on a sample.

Search: a query starts from its own node, if it is indexed, and from the nearest of ``entries`` nodes. Each round reads
the lists of the ``expand`` nearest nodes of its beam that haven't been read, scores what they name, and keeps the
``beam`` nearest; it ends when the whole beam has been read. The nearest of the beam are scored again with the original vectors, in double precision.

Scale: a round of the build moves at most 4 * ``sample`` codes (a byte a component) to each node and a bounded list back; a round of
the search moves ``expand`` lists of at most 2 * ``degree`` ids a query, and the codes they name. Reverse
lists are bounded too (by sampling in the build, by nearness in the search), before they are shuffled, so a node that is a neighbour of very many
makes no large group. Joins are sort-merge joins. The driver gets counts, and ``entries`` codes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Shelf, table

LINK = "node long, id long, sim float, fresh boolean"
BEAM = "array<struct<sim:float,node:long,done:boolean>>"


@dataclass
class Index:
    """vectors: node, vec, code, members (the least ids with this vector); graph: node, to (the nodes a search goes on to)."""

    vectors: DataFrame
    graph: DataFrame
    entry_nodes: np.ndarray
    entry_codes: np.ndarray
    shelf: Shelf


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def units(codes: np.ndarray) -> np.ndarray:
    """Rows of signed bytes (or of any numbers) as unit vectors."""
    x = codes.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bytes_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A binary column of codes of equal length as a matrix of signed bytes."""
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.int8).reshape(-1, dim)


def encoded(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec, members) with ``code``: the components as signed bytes, the largest being 127."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                codes = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec", "members", "code"])

    return vectors.mapInArrow(run, "vec array<double>, members array<long>, code binary")


def first_links(vectors: DataFrame, dim: int, degree: int, projections: int, block: int, seed: int) -> DataFrame:
    """node, id, sim, fresh: for each node, the nearest of a block of each of ``projections`` orders by a random direction."""
    directions = np.random.default_rng(seed).normal(size=(dim, projections)).astype(np.float32)
    take = max(1, degree // 2)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                at = units(bytes_matrix(b.column(1), dim)) @ directions
                for k in range(projections):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k), pa.int32()), pa.array(at[:, k]), b.column(0), b.column(1)], names=["turn", "at", "node", "code"])

    def nearest(nodes: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        ids, x = np.concatenate(nodes), units(np.concatenate(codes))
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        n = min(take, len(ids) - 1)
        best = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n else np.empty((len(ids), 0), np.int64)
        found = np.take_along_axis(sims, best, 1).ravel()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(ids[best].ravel()), pa.array(found), pa.array(np.ones(len(found), bool))], names=["node", "id", "sim", "fresh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, nodes, codes, size = None, [], [], 0
        for b in batches:
            turns = b.column(0).to_numpy()
            ids, matrix = b.column(2).to_numpy(), bytes_matrix(b.column(3), dim)
            cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)]
            for i, j in itertools.pairwise(cuts):
                while i < j:
                    if size and (turns[i] != turn or size >= block):
                        yield nearest(nodes, codes)
                        nodes, codes, size = [], [], 0
                    turn, to = turns[i], min(j, i + block - size)
                    nodes.append(ids[i:to]), codes.append(matrix[i:to])
                    size, i = size + to - i, to
        if size:
            yield nearest(nodes, codes)

    dealt = vectors.select("node", "code").mapInArrow(project, "turn int, at float, node long, code binary").repartitionByRange("turn", "at", "node").sortWithinPartitions("turn", "at", "node")
    return dealt.mapInArrow(run, LINK)


def nearest_lists(links: DataFrame, degree: int) -> DataFrame:
    """node, nbrs: the ``degree`` nearest of each node's links, the nearest first. A pair known as met stays so."""
    each = links.groupBy("node", "id").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= degree)
    return ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "sim", "fresh"))).alias("nbrs"))


def introduced(lists: DataFrame, codes: DataFrame, dim: int, degree: int, sample: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(links that the introductions of one round bring, the lists' links with what was introduced marked as met)."""
    chosen = F.transform(F.slice(F.sort_array(F.transform(F.filter("nbrs", lambda x: x["fresh"]), lambda x: F.struct(F.xxhash64(x["id"], "node", F.lit(turn)).alias("h"), x["id"].alias("id")))), 1, sample), lambda x: x["id"])
    marked = lists.withColumn("chosen", chosen)
    old = F.transform(F.filter("nbrs", lambda x: ~x["fresh"]), lambda x: x["id"])
    ahead = marked.select("node", F.explode("chosen").alias("id"), F.lit(True).alias("fresh")).unionByName(marked.select("node", F.explode(old).alias("id"), F.lit(False).alias("fresh")))
    back = ahead.select(F.col("id").alias("center"), F.col("node").alias("member"), "fresh")
    lot = Window.partitionBy("center", "fresh").orderBy(F.xxhash64("member", F.lit(turn)), "member")
    back = back.withColumn("lot", F.row_number().over(lot)).where(F.col("lot") <= sample).drop("lot")
    meeting = ahead.select(F.col("node").alias("center"), F.col("id").alias("member"), "fresh").unionByName(back)
    worst = lists.select(F.col("node").alias("member"), F.when(F.size("nbrs") >= degree, F.element_at("nbrs", -1)["sim"]).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    known = codes.select(F.col("node").alias("member"), "code").join(worst, "member", "left").select("member", "code", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"))
    groups = meeting.join(known.hint("merge"), "member").groupBy("center").agg(F.collect_list(F.struct("member", "fresh", "worst", "code")).alias("all")).where(F.exists("all", lambda x: x["fresh"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                column = b.column(0).slice(i, 1000)
                flat = column.flatten()
                member, fresh, worst = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                x = units(bytes_matrix(flat.field(3), dim))
                ends = np.cumsum(column.value_lengths().to_numpy())
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for lo, hi in itertools.pairwise([0, *ends.tolist()]):
                    #: One of each member, fresh if it comes as fresh.
                    order = np.lexsort((~fresh[lo:hi], member[lo:hi])) + lo
                    order = order[np.r_[True, member[order[1:]] != member[order[:-1]]]]
                    new = order[fresh[order]]
                    sims = x[new] @ x[order].T
                    sims[new[:, None] == order[None, :]] = -3
                    one, two = np.nonzero(sims > worst[new][:, None])
                    out.append((member[new[one]], member[order[two]], sims[one, two]))
                    #: Fresh ones met each other above.
                    two, one = np.nonzero((sims.T > worst[order][:, None]) & ~fresh[order][:, None])
                    out.append((member[order[two]], member[new[one]], sims[one, two]))
                if out:
                    node, other, sim = (np.concatenate([o[k] for o in out]) for k in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(sim), pa.array(np.ones(len(sim), bool))], names=["node", "id", "sim", "fresh"])

    links = groups.select("all").mapInArrow(run, LINK)
    met = marked.select("node", "chosen", F.explode("nbrs").alias("x")).select("node", "x.id", "x.sim", (F.col("x.fresh") & ~F.array_contains("chosen", F.col("x.id"))).alias("fresh"))
    return links, met


def build(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = 32, sample: int = 20, rounds: int = 15, settled: float = 0.02, projections: int = 4, block: int = 1024, entries: int = 512, members: int = 6, seed: int = 1
) -> Index | None:
    """The index of ``rows``; None if no vector is usable.

    Rows without id or usable vector (see ``usable``), and vectors of another length than most, take no part. Rows
    that repeat an id and its vector are one. Of equal vectors, the ``members`` least ids are kept: as many neighbours, less one, can be asked for.
    """
    shelf = Shelf(rows.sparkSession, "ann")
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    size = good.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if size is None:
        return None
    dim = size["dim"]
    good = good.where(F.size("vec") == dim).distinct()
    few = good.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("nth") <= members)
    distinct = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    vectors = shelf.keep(encoded(distinct).withColumn("node", F.monotonically_increasing_id()), "vectors")
    codes = vectors.select("node", "code")
    lists = shelf.keep(nearest_lists(first_links(codes, dim, degree, projections, block, seed), degree), "lists0")
    entry = codes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(entries).collect()
    for k in range(1, rounds + 1):
        links, met = introduced(lists, codes, dim, degree, sample, k)
        lists = shelf.keep(nearest_lists(met.unionByName(links), degree), f"lists{k}")
        shelf.drop(f"lists{k - 1}")
        fresh, total = lists.select(F.sum(F.size(F.filter("nbrs", lambda x: x["fresh"]))), F.sum(F.size("nbrs"))).first()
        if (fresh or 0) <= settled * (total or 0):
            break
    ahead = lists.select("node", F.explode("nbrs").alias("x")).select("node", F.col("x.id").alias("to"), "x.rank", "x.sim")
    #: Of the reverse neighbours, those to which the node is nearest.
    near = Window.partitionBy("to").orderBy("rank", F.desc("sim"), "node")
    back = ahead.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= degree).select(F.col("to").alias("node"), F.col("node").alias("to"))
    graph = shelf.keep(ahead.select("node", "to").unionByName(back).groupBy("node").agg(F.collect_set("to").alias("to")), "graph")
    matrix = np.frombuffer(b"".join(bytes(r["code"]) for r in entry), np.int8).reshape(-1, dim)
    return Index(vectors, graph, np.array([r["node"] for r in entry], np.int64), matrix, shelf)


def search(index: Index, queries: DataFrame, k: int = 5, beam: int = 192, expand: int = 64, again: int = 64) -> DataFrame:
    """node (the query's), near: for each node of ``queries`` (node) the k + 1 nearest rows found, itself among them, as (score, vec_id), the nearest first.

    score: cosine of the original vectors in double precision. Ties go to the smaller id.
    """
    shelf, dim = index.shelf, index.entry_codes.shape[1]
    entry_nodes, entry_units = index.entry_nodes, units(index.entry_codes)
    codes = index.vectors.select("node", "code")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                sims, beams = units(bytes_matrix(b.column(1), dim)) @ entry_units.T, []
                for node, row in zip(b.column(0).to_pylist(), sims, strict=True):
                    first = [i for i in np.argsort(-row, kind="stable")[:16].tolist() if entry_nodes[i] != node]
                    beams.append([{"sim": 1.0, "node": node, "done": False}, *({"sim": float(row[i]), "node": int(entry_nodes[i]), "done": False} for i in first)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(beams, ARROW_BEAM), pa.array([True] * len(b))], names=["query", "code", "beam", "open"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by query: its own first, with its code and beam, then the nodes that its lists named, with their codes."""
        own, nodes, names, done = None, [], [], []

        def close() -> None:
            query, code, old = own
            had = {x["node"]: (x["sim"], x["done"]) for x in old}
            #: What was to be read has been read now.
            todo = [x["node"] for x in sorted(old, key=lambda x: (-x["sim"], x["node"])) if not x["done"]][:expand]
            for n in todo:
                had[n] = (had[n][0], True)
            fresh = [i for i, n in enumerate(nodes) if n not in had]
            if fresh:
                sims = units(np.frombuffer(b"".join(names[i] for i in fresh), np.int8).reshape(-1, dim)) @ units(np.frombuffer(code, np.int8)[None, :])[0]
                had |= {nodes[i]: (s, False) for i, s in zip(fresh, sims.tolist(), strict=True)}
            best = sorted(had.items(), key=lambda x: (-x[1][0], x[0]))[:beam]
            done.append((query, code, [{"sim": s, "node": n, "done": d} for n, (s, d) in best], any(not d for _, (_, d) in best)))

        def batch() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), ARROW_BEAM, pa.bool_()), strict=True)], names=["query", "code", "beam", "open"])
            done.clear()
            return out

        for b in batches:
            for query, node, code, old in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node is None:
                    if own is not None:
                        close()
                        if len(done) >= 256:
                            yield batch()
                    own, nodes, names = (query, code, old), [], []
                else:
                    nodes.append(node), names.append(code)
        if own is not None:
            close()
        if done:
            yield batch()

    state = "query long, code binary, beam " + BEAM + ", open boolean"
    beams = shelf.keep(queries.select("node").distinct().join(codes, "node").mapInArrow(start, state), "beams0")
    ended = []
    for turn in itertools.count(1):
        todo = F.slice(F.array_sort(F.filter("beam", lambda x: ~x["done"]), lambda x, y: F.when(x["sim"] != y["sim"], F.when(x["sim"] > y["sim"], -1).otherwise(1)).otherwise(F.when(x["node"] < y["node"], -1).when(x["node"] > y["node"], 1).otherwise(0))), 1, expand)
        front = beams.where("open").select("query", F.explode(todo).alias("x")).select("query", F.col("x.node").alias("node"))
        named = front.join(index.graph.hint("merge"), "node").select("query", F.explode("to").alias("node")).distinct()
        found = named.join(codes.hint("merge"), "node").select("query", "node", "code", F.lit(None).cast(BEAM).alias("beam"))
        dealt = beams.where("open").select("query", F.lit(None).cast("long").alias("node"), "code", "beam").unionByName(found)
        after = shelf.keep(dealt.repartition("query").sortWithinPartitions("query", F.asc_nulls_first("node")).mapInArrow(scored, state), f"beams{turn}")
        ended.append(after.where("NOT open"))
        beams = after
        if beams.where("open").isEmpty():
            break
    final = ended[0]
    for x in ended[1:]:
        final = final.unionByName(x)
    return exact(index, final, k, again)


ARROW_BEAM = pa.list_(pa.struct([("sim", pa.float32()), ("node", pa.int64()), ("done", pa.bool_())]))
NEAR = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))


def cosines(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of ``a`` with each row in double precision, whatever the sizes of the components."""
    a, rows = a / np.abs(a).max(), rows / np.abs(rows).max(axis=1, keepdims=True)
    return np.einsum("ij,j->i", rows, a) / (np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(np.einsum("i,i->", a, a)))


def exact(index: Index, beams: DataFrame, k: int, again: int) -> DataFrame:
    """node, near of each beam (query, beam: the nearest first), scored by the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, done = None, [], []

        def close() -> None:
            query, vec = own
            scores = cosines(np.array(vec), np.array([r[0] for r in rows])).tolist()
            all_ = sorted((-s, i) for s, (_, ids) in zip(scores, rows, strict=True) for i in ids)
            done.append((query, [{"score": -s, "vec_id": i} for s, i in all_[: k + 1]]))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), NEAR), strict=True)], names=["node", "near"])
            done.clear()
            return out

        for b in batches:
            for query, own_row, vec, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own_row:
                    if own is not None:
                        close()
                        if len(done) >= 1000:
                            yield batch()
                    own, rows = (query, vec), []
                rows.append((vec, ids))
        if own is not None:
            close()
        if done:
            yield batch()

    #: A query is the nearest of its own beam, so it is always among these.
    wanted = beams.select("query", F.explode(F.slice("beam", 1, again)).alias("x")).select("query", F.col("x.node").alias("node"))
    wanted = wanted.unionByName(beams.select("query", F.col("query").alias("node"))).distinct()
    dealt = wanted.join(index.vectors.select("node", "vec", "members").hint("merge"), "node").select("query", (F.col("node") == F.col("query")).alias("own"), "vec", "members")
    return dealt.repartition("query").sortWithinPartitions("query", F.desc("own")).mapInArrow(run, "node long, near array<struct<score:double,vec_id:long>>")


def nearest(rows: DataFrame, wanted: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``rows`` for which ``wanted`` (over its columns) holds.

    Candidates are all rows of another id. Rows that ``build`` leaves out are neither queries nor candidates; rows that repeat an id
    and its vector count once. Fewer than k candidates give fewer rows; an empty table none. Ties go to the smaller id. Other columns are ignored.
    """
    index = build(rows, id_col, vec_col, members=k + 1, **options)
    result = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return rows.sparkSession.createDataFrame([], result)
    asked = rows.where(wanted).select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("query_id").isNotNull() & usable(F.col("vec")))
    asked = index.shelf.keep(asked.distinct().join(index.vectors.select("node", "vec").hint("merge"), "vec").select("query_id", "node"), "asked")
    found = index.shelf.keep(search(index, asked, k), "found")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(found.hint("merge"), "node").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
