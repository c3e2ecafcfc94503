import hashlib
import random
import re

import pytest
from graphloom.llm import fill_middle
from pyspark.sql import functions as F

from ..conftest import SMALL, rows_of
from .helpers import TEXTS, no_documents, odd_documents

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+"}


def test_op12_sql(spark, oracle):
    assert rows_of(fill_middle.op12_fill_middle(spark, SMALL)) == oracle(fill_middle.ORACLE)


@pytest.mark.parametrize("kind", PATTERNS)
def test_offsets_are_those_of_the_units(kind):
    rnd = random.Random(3)
    texts = ["", *("".join(rnd.choice("ab\n\n \té\U0001f600") for _ in range(rnd.randrange(30))) for _ in range(400)), "", "\n", "\n\n\n", "x", " ", "a" * 9000, "\n" * 9000, ""]
    for text, runs in zip(texts, fill_middle.runs_of(texts, kind), strict=True):
        units = re.findall(PATTERNS[kind], text)
        assert "".join(units) == text and runs.n == len(units) and runs.size == len(text)
        at = [0]
        for u in units:
            at.append(at[-1] + len(u))
        assert [runs.offset(k) for k in range(len(units) + 1)] == at


def plain_version(doc_id, text, kind, percent, spm):
    text = text or ""
    units = re.findall(PATTERNS[kind], text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in fill_middle.SENTINELS) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    one, two = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("kind,percent,spm", [("line", 100, 50), ("char", 60, 0), ("word", 90, 100)])
def test_odd_documents(spark, kind, percent, spm):
    more = [(k, t) for k, t in enumerate(["a<P>b\nc", "<\nS>", "<S", "x\n<M>", "\n\n", "a\n\nb", "<P", "P>\nS><\n", "\U0001f600\n" * 700, "a" * 300, " " * 300], 100)]
    docs = odd_documents(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    cut = fill_middle.fill_middle(docs, unit=kind, percent=percent, spm_percent=spm)
    cut = cut.withColumn("back", fill_middle.restored_text(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in cut.collect()), key=repr)
    assert got == sorted(((i, t or "", *plain_version(i, t, kind, percent, spm)) for i, t in [*TEXTS, *more]), key=repr)
    assert fill_middle.fill_middle(no_documents(spark)).count() == 0


def test_sentinels():
    assert fill_middle.checked(("<fim_a>", "<fim_b>", "<fim_c>"))
    for bad in (("", "a", "b"), ("ab", "ba", "c"), ("aa", "b", "c"), ("<x>", "<x>", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fill_middle.checked(bad)
    with pytest.raises(ValueError):
        fill_middle.fill_middle(None, unit="page")
