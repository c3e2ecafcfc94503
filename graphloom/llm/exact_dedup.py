"""Exact deduplication by distributed MSD radix partitioning.

A text is a byte string. Round 0 splits all rows by their first ``width`` bytes, each later
round splits the groups that are left by the next bytes, and the digit gets ``growth`` times
wider each time, so the longest text takes a logarithmic number of rounds. That makes the digit of
a late round as long as the rest of most texts: what is left there are groups with a common
beginning of thousands of bytes, nearly always copies, and the round compares their whole rests at
once. A group leaves as soon as it is a singleton or its texts have ended. Rows are equal because all their bytes
were equal; no digest decides anything (the SHA-256 of the result is only reported).

Scale: a round makes one partially aggregated count per (group, digit), kept as a table of the
groups with two rows or more, and one equi-join of the rows with it. Both inputs of the join
are plain scans of a sort-merge join at every size, so adaptive execution splits a hot group
over many tasks. Rows of singletons never move again.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Shelf, table

KEYS = ["grp", "ended", "digit"]


def normalised(text: str) -> Column:
    """The column as it is compared: null as the empty text, A-Z in lower case."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, growth: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal
    texts, the row with the largest id stays. Rows without id: they are only kept if no row of
    the group has an id (keep_id is null then). Rows that repeat an id and its text get the same
    verdict. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    shelf = Shelf(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.lit(0).cast("long").alias("grp"), F.col("norm").cast("binary").alias("rest")
    )
    settled, rest = [], rows
    for k in range(64):
        dealt = rest.select(
            "doc_id", "text_sha256", "grp", F.expr(f"substring(rest, 1, {width})").alias("digit"),
            (F.octet_length("rest") <= width).alias("ended"), F.expr(f"substring(rest, {width + 1})").alias("rest"),
        )
        groups = dealt.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where("n > 1")
        groups = shelf.keep(groups.withColumn("label", F.monotonically_increasing_id()), f"groups{k}")
        done = F.col("n").isNull() | F.col("ended")
        joined = dealt.join(groups.hint("merge"), KEYS, "left").select(
            "doc_id", "text_sha256", done.alias("done"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.col("label").alias("grp"), F.when(~done, F.col("rest")).alias("rest"),
        )
        joined = shelf.keep(joined, f"rows{k}")
        shelf.drop(f"groups{k}")
        settled.append(joined.where("done"))
        rest = joined.where("not done").select("doc_id", "text_sha256", "grp", "rest")
        if rest.isEmpty():
            break
        width *= growth
    else:
        raise RuntimeError("texts of more bytes than there can be")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
