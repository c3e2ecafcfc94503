import collections
import hashlib
import random
import re
import zlib

import pytest
from graphloom.llm import prefix_trie

from ..conftest import SMALL, rows_of

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "ends_sha256", "n_children", "n_convs", "n_leaves", "parent_conv_id", "saved_tokens"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_trie(rows, family=20, most=4):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    nodes = collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        rebuilt = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(rebuilt) + 1):
            nodes[rebuilt[:d]].append((c, len(rebuilt)))
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in members if n == len(k)))
        parent = min(nodes[k[:-1]])[0] if k else None
        out.append((min(members)[0], len(k), hashlib.sha256(ends.encode()).hexdigest(), children[k], len(members), leaves[k], parent, saved[k]))
    return NAMES, sorted(out, key=repr)


def test_op13_sql(spark, oracle):
    assert rows_of(prefix_trie.op13_prefix_trie(spark, SMALL)) == oracle(prefix_trie.ORACLE)


@pytest.mark.parametrize("hold", [3, 100_000])
def test_against_plain(spark, hold):
    """Nulls anywhere, ties, repeated rows, absent bases, turnless conversations, ids below zero, deep tries, common turns."""
    rnd = random.Random(hold)
    rows = []
    for c in [*range(60), 85, 86, 87, 88, 99, 1_000_003, -1, -5, -20, -23, -25, 40_000_000_000]:
        for turn in range(rnd.randrange(1, 9)):
            rows.append((c, rnd.choice([None, turn, turn, 0]), rnd.choice([None, "user", "bot"]), rnd.choice([None, "", "hi", "hi there", "a\tb c d", " x "])))
    rows += [(c, k, "u", "same words here") for c in range(100, 180) for k in range(rnd.randrange(1, 12))]
    rows += [(200, k, "u", f"t {k}") for k in range(500)] + [(200 + c, k, "u", f"t {k}") for c in (1, 2, 7) for k in range(300 + 20 * c)]
    rows += [rows[5]] * 3 + [(None, 1, "u", "no conversation")] * 2
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", a string, n long, owner long").repartition(5)
    assert rows_of(prefix_trie.prefix_trie(table, hold=hold)) == plain_trie(rows)


def test_empty(spark):
    for rows in ([], [(None, 1, "u", "x")]):
        assert prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_ends_of_many_blocks(spark):
    ids = [*range(-9000, 9000, 7), 1 << 40]
    ends = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 5)], "a long, b long, depth long, conv_id long").repartition(7)
    want = {3: ",".join(map(str, sorted(ids))), 4: "5"}
    assert {r.depth: r.ends_sha256 for r in prefix_trie.hashed_ends(ends).collect()} == {d: hashlib.sha256(x.encode()).hexdigest() for d, x in want.items()}
