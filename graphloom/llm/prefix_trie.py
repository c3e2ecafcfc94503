"""The prefix trie of rebuilt conversations, merged family by family.

A family is a base conversation (its id is a multiple of ``family``) and those that are rebuilt on it: each takes the base's
first turns and goes on with its own. Families are cogrouped by base id, a task streams through
its families one after the other, rebuilds their conversations and builds each family's small trie; only the
combined nodes of a family are shuffled and merged with those of other families.

A node is a sequence of turns, known by its length and a 120-bit rolling hash of its turns' digests. Each node names one of its
members, the one with the smallest hash of its id, as the owner of its path: nodes of one owner form one
downward path, and as owners are random, a root-to-leaf walk meets only about the logarithm of the
number of conversations of them. Sums over subtrees are then sums of a path (a running window) and of the few levels
of paths that hang on it, a round each.

Scale: texts become digests and word counts in the scan and never move. What is shuffled is a row of
48 bytes a turn once, and family nodes, which are combined before. A family's trie is handed on
when it has more than ``hold`` nodes, as partial nodes merge like those of other families; so a task holds no more than that,
the base's first turns and one conversation's place, however long conversations are. Members that end
in a node are hashed as blocks of sorted ids, streamed through one SHA-256 (which can't be
split), never as one list.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Shelf, table

#: The rolling hash: two lanes modulo a prime, each with a base of its own.
PRIME = (1 << 61) - 1
BASES = (0x1234_5678_9ABC_DEF1 % PRIME, 0x0FED_CBA9_8765_4321 % PRIME)
#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["a", "b", "depth"]
FAMILY = pa.schema([
    ("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int64()), ("up_a", pa.int64()), ("up_b", pa.int64()), ("words", pa.int64()),
    ("n", pa.int64()), ("first", pa.int64()), ("rank", pa.int64()), ("owner", pa.int64()), ("ends", pa.list_(pa.int64())),
])
FAMILY_SQL = "a long, b long, depth long, up_a long, up_b long, words long, n long, first long, rank long, owner long, ends array<long>"
#: Ids that end in a node are hashed in blocks of 2 ** BLOCK neighbouring numbers.
BLOCK = 12


def shared_turns(conv_id: int, most: int = 4) -> int:
    """How many turns a conversation takes from its base: unsigned crc32 of its decimal id modulo ``most``."""
    return zlib.crc32(str(conv_id).encode()) % most


def rank_of(conv_id: int) -> int:
    """A hash of the id that decides who owns a path."""
    return int.from_bytes(hashlib.blake2b(str(conv_id).encode(), digest_size=7).digest(), "big")


class Trie:
    """A family's trie under way: nodes by (hash, depth), each with its parent, words, members, least member, owner and ends."""

    def __init__(self):
        self.nodes: dict[tuple[int, int, int], list] = {}
        self.at = (0, 0, 0)
        self.member = (0, 0)

    def visit(self, node: tuple[int, int, int], up: tuple[int, int], words: int) -> None:
        conv_id, rank = self.member
        found = self.nodes.get(node)
        if found is None or not found[6]:
            self.nodes[node] = [*node, *up, words, 1, conv_id, rank, conv_id, found[10] if found else []]
        else:
            found[6] += 1
            found[7] = min(found[7], conv_id)
            found[8], found[9] = min((found[8], found[9]), (rank, conv_id))
        self.at = node

    def begin(self, conv_id: int) -> None:
        self.member = (conv_id, rank_of(conv_id))
        self.visit((0, 0, 0), (0, 0), 0)

    def turn(self, one: int, two: int, words: int) -> None:
        a, b, depth = self.at
        self.visit(((a * BASES[0] + one + 1) % PRIME, (b * BASES[1] + two + 1) % PRIME, depth + 1), (a, b), words)

    def end(self) -> None:
        found = self.nodes.get(self.at)
        if found is None:  # handed on meanwhile: no member more, only its end
            found = self.nodes[self.at] = [*self.at, None, None, None, 0, None, None, None, []]
        found[10].append(self.member[0])

    def take(self) -> list[list]:
        rows, self.nodes = list(self.nodes.values()), {}
        return rows


def family_tries(turns: DataFrame, most: int, hold: int) -> DataFrame:
    """The combined nodes of each family; turns: base, conv_id, turn, one, two, words.

    Conversations of a family come one after the other, the base first, each in the order of its turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, done = Trie(), []
        family = conv = None
        head: list[tuple[int, int, int]] = []
        skip = seen = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), FAMILY.types, strict=True)], schema=FAMILY)
            done.clear()
            return out

        for b in batches:
            for base, conv_id, one, two, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv_id != conv:
                    if conv is not None:
                        trie.end()
                    if base != family:
                        done += trie.take()
                        family, head = base, []
                    conv, seen = conv_id, 0
                    skip = shared_turns(conv_id, most) if conv_id != base else 0
                    trie.begin(conv_id)
                    for t in head[:skip]:
                        trie.turn(*t)
                if conv_id == base and len(head) < most - 1:
                    head.append((one, two, words))
                seen += 1
                if seen > skip:
                    trie.turn(one, two, words)
                if len(trie.nodes) >= hold:
                    done += trie.take()
                if len(done) >= min(hold, 20_000):
                    yield batch()
        if conv is not None:
            trie.end()
            done += trie.take()
            yield batch()

    dealt = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "one", "two")
    return dealt.select("base", "conv_id", "one", "two", "words").mapInArrow(run, FAMILY_SQL)


def path_sums(nodes: DataFrame, shelf: Shelf) -> DataFrame:
    """``nodes`` (owner, depth, up_owner, leaf, saved) with n_leaves and saved_tokens, the sums of leaf and saved over subtrees.

    Paths hand their totals to the node they hang on, level by level of paths; then each path is summed from its end.
    """
    paths = nodes.groupBy("owner").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min(F.struct("depth", "up_owner")).alias("top"))
    paths = shelf.keep(paths.select("owner", "leaf", "saved", F.col("top.up_owner").alias("up_owner"), (F.col("top.depth") - 1).alias("up_depth")), "paths")
    ups = paths.where("up_owner IS NOT NULL").select("owner", "up_owner", "up_depth")
    moving = paths.select("owner", "leaf", "saved")
    rounds = []
    for k in itertools.count():
        #: What the path has to give one level up: to the node it hangs on, and to the path of that node.
        given = shelf.keep(moving.join(ups, "owner").select("up_owner", "up_depth", "leaf", "saved"), f"given{k}")
        if given.isEmpty():
            break
        rounds.append(given)
        moving = given.groupBy(F.col("up_owner").alias("owner")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    own = nodes.withColumns({"below leaf": F.lit(0).cast("long"), "below saved": F.lit(0).cast("long")})
    if rounds:
        hung = rounds[0]
        for r in rounds[1:]:
            hung = hung.unionByName(r)
        hung = hung.groupBy(F.col("up_owner").alias("owner"), F.col("up_depth").alias("depth")).agg(F.sum("leaf").alias("below leaf"), F.sum("saved").alias("below saved"))
        own = nodes.join(hung, ["owner", "depth"], "left").na.fill(0, ["below leaf", "below saved"])
    below = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = {"n_leaves": F.sum(F.col("leaf") + F.col("below leaf")).over(below), "saved_tokens": F.sum(F.col("saved") + F.col("below saved")).over(below)}
    return own.withColumns(sums).drop("below leaf", "below saved")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """a, b, depth, ends_sha256 of the nodes in which conversations end (ends: a, b, depth, conv_id): SHA-256 of their ids, ascending, joined by commas."""
    block = F.shiftright("conv_id", BLOCK)
    blocks = ends.groupBy(*NODE, block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [()] * 4
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*NODE, "ends_sha256"])
            done.clear()
            return out

        for b in batches:
            for a, b_, depth, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (a, b_, depth) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (a, b_, depth), hashlib.sha256(ids.encode())
            yield batch()
        if node is not None:
            done.append((*node, digest.hexdigest()))
            yield batch()

    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return dealt.select(*NODE, "ids").mapInArrow(run, "a long, b long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4, hold: int = 100_000, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns come in the order of ``turn``, null first; turns of equal number by the digest of role and text (repeated
    rows are turns of their own). Null roles and texts count as empty. Rows without conversation id belong to none and are
    left out; of ids below zero, the base is the multiple of ``family`` next to it towards zero. An empty table gives no
    node, not even a root. Texts of any length are digested whole; other columns are ignored.
    """
    shelf = Shelf(conversations.sparkSession, "trie")
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda k: F.conv(F.substring("digest", k, 15), 16, 10).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = rows.select((F.col("conv_id") - F.col("conv_id") % family).alias("base"), "conv_id", "turn", part(1).alias("one"), part(16).alias("two"), "words")
    tries = shelf.keep(family_tries(turns, most, hold), "families")
    merged = tries.groupBy(*NODE).agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.max("words").alias("words"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.min(F.when(F.col("owner").isNotNull(), F.struct("rank", "owner"))).alias("own")
    )
    merged = shelf.keep(merged.select(*NODE, "up_a", "up_b", "n_convs", "conv_id", F.col("own.owner").alias("owner"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "nodes")
    up = {"a": F.col("up_a"), "b": F.col("up_b"), "depth": F.col("depth") - 1}
    children = merged.where("depth > 0").groupBy(*(c.alias(k) for k, c in up.items())).agg(F.count("*").alias("n_children"))
    parents = merged.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("up_owner"))
    ends = hashed_ends(tries.select(*NODE, F.explode("ends").alias("conv_id")))
    full = merged.join(children, NODE, "left").join(ends, NODE, "left").join(parents, ["up_a", "up_b", "depth"], "left")
    none = F.sha2(F.lit(""), 256)
    full = full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
        "owner", F.when(F.col("up_owner") != F.col("owner"), F.col("up_owner")).alias("up_owner"), F.col("n_children").isNull().cast("long").alias("leaf"), "saved",
    )
    full = shelf.keep(full, "full")
    return path_sums(full, shelf).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 is a fold over the digits of the id, eight shifts each.
ORACLE = r"""
WITH t AS (
    SELECT conv_id, text, sha256(len(role)::VARCHAR || ':' || role || text) AS digest,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(role)::VARCHAR || ':' || role || text)) AS i
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
k AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
        [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, x: list_reduce([xor(c, x)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384::BIGINT * (a & 1)))
    ), 4294967295::BIGINT) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
),
r AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, text, digest FROM (
        SELECT k.conv_id, 0 AS own, i, text, digest FROM k JOIN t ON t.conv_id = k.base AND t.i <= k.h
        UNION ALL SELECT k.conv_id, 1, i, text, digest FROM k JOIN t ON t.conv_id = k.conv_id AND t.i > k.h
    )
),
p AS (
    SELECT conv_id, d, text, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM r
    UNION ALL SELECT conv_id, 0, '', 'root' FROM k
),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved FROM p GROUP BY key, d),
u AS (SELECT n.key, q.key AS up FROM n JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
c AS (SELECT up AS key, count(*) AS n_children FROM u GROUP BY up),
s AS (
    SELECT p.key, sum((c.key IS NULL)::INT)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
    FROM n LEFT JOIN c ON c.key = n.key JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.key
),
e AS (
    SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(key, d) AS key FROM p GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM n LEFT JOIN u ON u.key = n.key LEFT JOIN n m ON m.key = u.up LEFT JOIN c ON c.key = n.key JOIN s ON s.key = n.key LEFT JOIN e ON e.key = n.key
"""
