import collections

import corpus_pipeline
import public_tokenizers
from graphloom.llm import near_dedup
from tokenizers import Tokenizer

from ..conftest import SMALL
from .helpers import odd_documents, small
from .test_documents import brute_classes


def test_stages(spark):
    """Each stage against a plain version of its decision."""
    docs, seen = small(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        seen.append((name, before, docs))
        if name != "packing":
            assert docs.columns == before.columns
    assert [n for n, *_ in seen] == ["quality classifier", "language ID", "exact dedup", "MinHash near-dedup", "packing"]
    rows = [{r.doc_id: r.text or "" for r in b.collect()} for _, b, _ in seen]
    labels = {r.doc_id: r.quality for r in small(spark, "labels").collect()}
    assert sum(labels.get(i) == 1 for i in rows[0].keys() - rows[1].keys()) <= 0.02 * len(labels)
    assert len(rows[2]) >= 0.98 * len(rows[1])
    groups = collections.defaultdict(list)
    for i, t in rows[2].items():
        groups["".join(c.lower() if c.isascii() else c for c in t)].append(i)
    assert set(rows[3]) == {max(g) for g in groups.values()}
    assert set(rows[4]) == set(brute_classes(rows[3]).values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in rows[4].values())
    packed = seen[-1][2].collect()
    assert sum(r.length for r in packed) == total and {r.doc_id for r in packed} == set(rows[4])


def test_run_leaves_its_last_tables_only(spark):
    from graphloom.llm.shared import shared_folder

    files = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(shared_folder(spark)), spark._jsc.hadoopConfiguration())
    there = lambda: {x.getPath().getName() for x in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)))}
    before = there()
    out = corpus_pipeline.run(spark, SMALL)
    assert len(there() - before) == 1 and out.count() > 0


def test_rows_of_one_id(spark):
    """Rows are judged by their own text, with an id or without; of rows that repeat an id and its text one stays."""
    rows = [(5, "aaa"), (5, "bbb"), (9, "aaa"), (None, "ccc"), (None, "bbb"), (None, "ddd"), (None, "ddd"), (7, "eee"), (7, "EEE"), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, `row key` string, n_chars long")
    got = corpus_pipeline.by_text(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got.collect()) == [(0, "ccc"), (0, "ddd"), (5, "bbb"), (7, "eee"), (8, ""), (9, "aaa")]
    near = corpus_pipeline.by_likeness(spark, docs, SMALL)
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in near.collect()) == [(0, "ccc"), (0, "ddd"), (5, "aaa"), (5, "bbb"), (7, "eee"), (8, "")]


def test_odd_documents(spark):
    docs = odd_documents(spark).select(*small(spark).columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() >= 0
    empty = small(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
    assert near_dedup.near_duplicates(small(spark).where("false")).count() == 0


def test_other_threads_keep_their_tables(spark):
    """An operator's query in a second thread of the driver, while the pipeline runs."""
    import threading

    from graphloom.llm import exact_dedup

    want = sorted(map(tuple, exact_dedup.op10_exact_dedup(spark, SMALL).collect()))
    found, going = [], threading.Event()

    def beside():
        out = exact_dedup.op10_exact_dedup(spark, SMALL)
        going.set()
        done.wait(600)
        found.append(sorted(map(tuple, out.collect())))

    done = threading.Event()
    thread = threading.Thread(target=beside)
    thread.start()
    rows = corpus_pipeline.run(spark, SMALL)
    assert going.wait(600)
    done.set()
    thread.join()
    assert found == [want] and rows.count() > 0
