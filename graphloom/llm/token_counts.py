"""Token counts of whole texts by rank-synchronous array merging (see ``bpe.RankMerger``).

Scale: a map over the scan; nothing is shuffled. Memory is one block of texts and a bounded
table of pre-tokens per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import tokenizer_path
from .shared import table

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def blocks(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about ``chars`` together, one text at least."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of each row.

    Null counts as empty: 0 bytes, 0 tokens. Rows without id keep a null doc_id, repeated rows are
    counted each, an empty table gives an empty result, and other columns are ignored. Texts of any
    length are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import TokenCounter

        count = TokenCounter(tokenizer)
        for b in batches:
            texts = b.column(2).to_pylist()
            n = [x for i, j in blocks(texts, block_chars) for x in count(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
