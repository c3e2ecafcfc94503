"""Fill-in-the-middle documents from a run-length encoding of character classes.

A unit kind says what the characters of each class do: a character of an EACH class ends a unit, the last
character of a run of a WHOLE class ends one, characters of a NONE class end none (what follows the last end is
the last unit). A text is kept as its maximal runs of one class, with the number of units that end before each run. The
place of a cut after u units is found without looking at the text again: a binary search gives
the run in which unit u ends, and its offset in the run follows from the counts.

Scale: a map over the scan; nothing is shuffled. Memory is a block of texts and their runs. ``restored_text`` is a
Column, so output is turned back inside the JVM.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .token_counts import blocks

SENTINELS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
NONE, EACH, WHOLE = 0, 1, 2
#: The characters that count as blanks.
BLANKS = " \t\n\v\f\r"
#: Unit kind -> (characters of class 1, what class 0 does, what class 1 does).
#: line: ``[^\n]*\n|[^\n]+``; char: every code point; word: ``[blanks]*[others]+|[blanks]+``.
KINDS = {"line": ("\n", NONE, EACH), "char": ("", EACH, EACH), "word": (BLANKS, WHOLE, NONE)}


@dataclass
class Runs:
    """The maximal class runs of a text: where each starts, what its class does, and how many units end before it."""

    start: np.ndarray
    does: np.ndarray
    before: np.ndarray
    size: int
    n: int

    def offset(self, units: int) -> int:
        """Code points of the first ``units`` units."""
        if units <= 0:
            return 0
        if units >= self.n:
            return self.size
        run = int(np.searchsorted(self.before, units, "left")) - 1  # the last run with fewer ends before it: unit ``units`` ends in it
        if self.does[run] == EACH:
            return int(self.start[run]) + units - int(self.before[run])
        return int(self.start[run + 1]) if run + 1 < len(self.start) else self.size


def runs_of(texts: list[str], kind: str) -> list[Runs]:
    """The runs of each text; one pass over the code points of all."""
    members, *does = KINDS[kind]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    cls = np.zeros(len(points), np.int8)
    for c in members:
        cls |= points == ord(c)
    new = np.zeros(len(points) + 1, bool)
    new[1:-1] = cls[1:] != cls[:-1]
    new[ends - sizes] = True  # of an empty text at the end, the place behind the last one
    start = np.flatnonzero(new[:-1])
    what = np.array(does, np.int8)[cls[start]]
    length = np.diff(np.r_[start, len(points)])
    ended = np.where(what == EACH, length, what == WHOLE)
    total = np.cumsum(ended)
    first = np.searchsorted(start, np.r_[ends - sizes, len(points)], "left")
    out = []
    for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        base = int(total[i - 1]) if i else 0
        if i == j or not sizes[k]:
            out.append(Runs(start[:0], what[:0], total[:0], 0, 0))
            continue
        own = int(total[j - 1]) - base
        out.append(Runs(start[i:j] - (ends[k] - sizes[k]), what[i:j], np.r_[0, total[i : j - 1] - base], int(sizes[k]), own + (what[j - 1] == NONE)))
    return out


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can't be misread: none is empty, equal to or inside another, and none begins as another (or itself) ends."""
    for (i, a), (k, b) in itertools.product(enumerate(sentinels), repeat=2):
        if not a or (i != k and b in a) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
            raise ValueError(f"sentinels {a!r} and {b!r} could be misread beside each other")
    return sentinels


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers that depend on the seed and the id only (no id: the empty text)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def fill_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, block_chars: int = 4_000_000
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of each row.

    Two numbers drawn for the id cut the text after whole units (see KINDS) into prefix, middle and suffix.
    form: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle, each behind its sentinel; ``plain`` is the
    text as it is, for empty texts, texts that contain a sentinel, and all but ``percent`` of 100.

    Null counts as empty: n is 0, the form plain. Rows without id are drawn as the empty id; repeated rows give equal
    rows, an empty table none; texts of any length are cut whole, and other columns are ignored.
    """
    if unit not in KINDS:
        raise ValueError(f"unknown unit {unit!r}")
    p_mark, s_mark, m_mark = checked(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in blocks(texts, block_chars):
                rows = []
                for doc_id, text, runs in zip(ids[i:j], texts[i:j], runs_of(texts[i:j], unit), strict=True):
                    h1, h2, h3, h4 = draws(seed, doc_id)
                    if not text or h3 % 100 >= percent or p_mark in text or s_mark in text or m_mark in text:
                        rows.append((doc_id, runs.n, "plain", None, None, text))
                        continue
                    one, two = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
                    x, y = runs.offset(one), runs.offset(two)
                    psm = h4 % 100 >= spm_percent
                    parts = (p_mark, text[:x], s_mark, text[y:], m_mark, text[x:y]) if psm else (s_mark, text[y:], p_mark, text[:x], m_mark, text[x:y])
                    rows.append((doc_id, runs.n, "psm" if psm else "spm", x, y - x, "".join(parts)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def restored_text(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was cut, from the output and its form."""
    p_mark, s_mark, m_mark = map(re.escape, checked(sentinels))
    #: Before the first sentinel stands nothing, so part 0 is empty.
    parts = F.split(output, f"{p_mark}|{s_mark}|{m_mark}", -1)
    moved = F.concat(F.when(form == "psm", parts[1]).otherwise(parts[2]), parts[3], F.when(form == "psm", parts[2]).otherwise(parts[1]))
    return F.when(form == "plain", output).otherwise(moved)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
t AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[25:32])::BIGINT AS h4
    FROM h
),
c AS (
    SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS one, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS two,
        text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain
    FROM t
),
p AS (
    SELECT *, array_to_string(lines[1:one], '') AS pre, array_to_string(lines[one + 1:two], '') AS mid, array_to_string(lines[two + 1:n], '') AS suf FROM c
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
    sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
