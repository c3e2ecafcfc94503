"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized, closed with an end id and cut: whole blocks of ``capacity`` ids are
windows of their own, the remainder is cut into pieces of at most ``max_piece`` ids. The
pieces of up to ``group`` remainders' pieces go to k windows by multiway differencing: each
partial partition is a vector of k window sums, the two with the largest spread are merged
with opposing imbalances (largest sum of one onto the smallest of the other) until one is
left, whose windows are near-equal. k starts at the least possible count and rises whenever
the fullest window exceeds the capacity.

Scale: everything happens where the rows are read; no shuffle, no state beyond one group of
pieces (a few numbers each) and one batch of texts. Sequence ids combine the number of the
input partition with a counter, so a rerun of a lost task gives the same ids.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters of a run.
LONG = 4096
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of item numbers whose sums are near-equal (multiway Karmarkar-Karp).

    Each partial partition holds only its used windows, largest sum first; the others are 0.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    #: node -> (left, right) or an item; windows are trees of nodes, so merging is O(windows).
    left, right = np.full(2 * len(sizes) + 1, -1), np.full(2 * len(sizes) + 1, -1)
    nodes = len(sizes)
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        over = len(a) + len(b) - k  # windows in which both have items: the smallest of each side meet the largest of the other
        if over > 0:
            meet = np.arange(over)
            ids = np.arange(nodes, nodes + over)
            left[ids], right[ids] = an[len(a) - 1 - meet], bn[len(b) - over + meet]
            sums = a[len(a) - 1 - meet] + b[len(b) - over + meet]
            nodes += over
            sums, ids = np.concatenate([a[: len(a) - over], b[: len(b) - over], sums]), np.concatenate([an[: len(a) - over], bn[: len(b) - over], ids])
        else:
            sums, ids = np.concatenate([a, b]), np.concatenate([an, bn])
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order], ids[order]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-int(spread), tick, sums, ids))
        tick += 1
    windows = []
    for root in heap[0][3] if heap else []:
        items, stack = [], [int(root)]
        while stack:
            x = stack.pop()
            if left[x] < 0:
                items.append(x)
            else:
                stack += [int(right[x]), int(left[x])]
        windows.append(items)
    return windows


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, each of at most ``capacity``; every size must be at most that."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


def id_source(path: str, end_id: int = 0):
    """text -> its ids and ``end_id``, exactly as the vocabulary file's own library gives them.

    The ranks of a byte-level BPE file are read once per worker; special strings inside a text
    become their special id, as that library's default does. Texts with a run of LONG characters
    that may be one pre-token take a path without recursion, whose cost doesn't grow with a run's square.
    """
    from .bpe import LongEncoder, tiktoken_encoding

    #: Passes shorter runs, each once, and stops where a long one begins.
    short_runs = re.compile(rf"(?:\S{{1,{LONG - 1}}}+(?!\S)|\s{{1,{LONG - 1}}}+(?!\s))*+").match
    enc, slow = tiktoken_encoding(path), []

    def ids(text: str | None) -> np.ndarray:
        if not text:
            return np.array([end_id], "<u4")
        if len(text) >= LONG and short_runs(text).end() < len(text):
            if not slow:
                slow.append(LongEncoder(path))
            found = slow[0](text)
        else:
            found = enc.encode_to_numpy(text, allowed_special="all")
        return np.append(found, end_id).astype("<u4")

    return ids


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, max_piece: int = 256, group: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Rows without id keep a null doc_id; repeated rows
    are packed as often as they occur. An empty table gives no piece. Texts of any length are
    cut into blocks. Columns other than the two named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base, sequences = id_source(tokenizer), TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []

        def flush() -> list[tuple]:
            nonlocal sequences
            out = []
            for window in pack([p[2] for p in waiting], capacity):
                at = 0
                for i in window:
                    out.append((*waiting[i], base + sequences, at))
                    at += waiting[i][2]
                sequences += 1
            waiting.clear()
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=ARROW)

        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = source(text.as_py())
                n, view = len(ids), memoryview(ids).cast("B")
                whole = n - n % capacity
                for at in range(0, whole, capacity):
                    rows.append((doc, at, capacity, zlib.crc32(view[4 * at : 4 * (at + capacity)]), n, base + sequences, 0))
                    sequences += 1
                for at in range(whole, n, max_piece):
                    size = min(max_piece, n - at)
                    waiting.append((doc, at, size, zlib.crc32(view[4 * at : 4 * (at + size)]), n))
                if len(waiting) >= group:
                    rows += flush()
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
        if waiting:
            yield batch(flush())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
