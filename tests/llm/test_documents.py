import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from graphloom.llm import exact_dedup, fingerprints, grams, language_id, near_dedup, quality
from graphloom.llm.shared import Shelf
from pyspark.sql import functions as F

from ..conftest import SMALL, rows_of
from .helpers import TEXTS, no_documents, odd_documents, small

MEDIUM = "/root/testdata/sf0.01"


# Exact deduplication


def test_op10_sql(spark, oracle):
    assert rows_of(exact_dedup.op10_exact_dedup(spark, SMALL)) == oracle(exact_dedup.ORACLE)


def test_op10_odd(spark):
    out = collections.defaultdict(list)
    for r in exact_dedup.exact_dedup(odd_documents(spark)).collect():
        out[r.doc_id].append(r)
    assert [(r.keep_id, r.group_size, r.kept) for r in out[1]] == [(6, 4, False)] and len(out[5]) == 2
    assert out[2][0].keep_id == out[3][0].keep_id == 3 and out[3][0].group_size == 2
    assert out[None][0].kept and out[None][0].keep_id is None
    assert exact_dedup.exact_dedup(no_documents(spark)).count() == 0


def test_op10_prefixes(spark):
    """Texts that end where a digit ends, that are prefixes of others, that differ in the last byte only."""
    base = "ab" * 3000
    texts = [base[:n] for n in (0, 1, 2, 3, 4, 7, 8, 9, 63, 64, 65, 511, 512, 513, 4096, 6000)] * 2 + [base[:-1] + "x", base[:-1] + "y", base[:-1] + "Y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.lower()].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    for width, growth in ((1, 2), (4, 4), (64, 8)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, width=width, growth=growth).collect()}
        assert got == want


# Near-duplicates


def edited(words, share, rnd):
    return [rnd.choice(["alpha", "beta", "gamma", w + "x"]) if rnd.random() < share else w for w in words]


def test_aligned_is_lcs():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(15))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert near_dedup.aligned(a, b, 20) == t[-1, -1]


def test_aligned_in_a_band():
    """Sequences of many and of few repetitions against a table of the band."""
    rnd = random.Random(7)
    for letters in (2, 5, 1000):
        for _ in range(60):
            a, band = [rnd.randrange(letters) for _ in range(rnd.randrange(5, 60))], rnd.randrange(1, 12)
            b = [x if rnd.random() > 0.2 else rnd.randrange(letters) for x in a if rnd.random() > 0.05]
            t = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    t[i + 1, j + 1] = max(t[i, j] + 1 if x == y and abs(i - j) <= band else 0, t[i, j + 1], t[i + 1, j])
            assert t[-1, -1] <= near_dedup.aligned(a, b, band) or a[0] == b[0] or a[-1] == b[-1]
    a = list(range(1_000_000))
    assert near_dedup.aligned(a, [-1, *a[:-1]], 10) == 999_999
    assert near_dedup.aligned([1, 2] * 10_000 + [3], [4] + [1, 2] * 10_000, 50) == 20_000


def test_aligned_repetitions():
    """Few differences, many differences, and masks without room, against each other; a million repeated words in seconds."""
    import time

    rnd, few, room = random.Random(11), near_dedup.FEW, near_dedup.MASKS
    cases = []
    for letters in (1, 2, 3):
        for _ in range(150):
            a = [rnd.randrange(letters) for _ in range(rnd.randrange(150))]
            b = [rnd.randrange(letters) if rnd.random() < 0.2 else x for x in a if rnd.random() > 0.1]
            cases.append((a, b, abs(len(a) - len(b)) + rnd.randrange(1, 40)))
    found = []
    try:
        for near_dedup.FEW, near_dedup.MASKS in ((256, room), (-1, room), (-1, 0), (5, 100)):
            found.append([near_dedup.aligned(*c) for c in cases])
    finally:
        near_dedup.FEW, near_dedup.MASKS = few, room
    assert found[0] == found[1] == found[2] == found[3]
    km, began = near_dedup.Kmers(5), time.time()
    for word in ("cat ", "the cat "):
        a, b = km("x start " + word * 500_000 + "end one"), km("y begin " + word * 499_990 + "and two")
        assert near_dedup.similarity(a, b, 0.8) > 0.99
    assert time.time() - began < 60


def test_band_loses_no_link():
    rnd = random.Random(6)
    for _ in range(200):
        a = [rnd.randrange(10**6) for _ in range(60)]
        b = [x for x in a if rnd.random() > 0.08] + [rnd.randrange(10**6) for _ in range(rnd.randrange(8))]
        n = near_dedup.aligned(a, b, 10_000)
        full = n / (len(a) + len(b) - n)
        banded = near_dedup.similarity(np.array(a), np.array(b), 0.8)
        assert (banded >= 0.8) == (full >= 0.8)


def brute_classes(texts, least=0.8):
    km = near_dedup.Kmers(5)
    seqs = {i: km(t or "") for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (texts[i] or "") == (texts[j] or "") or near_dedup.similarity(seqs[i], seqs[j], least) >= least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op9_finds_all_links(spark):
    """Families of variants, chains of edits, a passage that many share: classes as by comparing all pairs."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(4):
        base = [word() for _ in range(150)]
        texts += [edited(base, share, rnd) for share in [0.0, *[0.01] * 6, *[0.03] * 6]]
        chain = base
        for _ in range(4):
            chain = edited(chain, 0.012, rnd)
            texts.append(chain)
    texts += [[word() for _ in range(40)] + passage + [word() for _ in range(20)] for _ in range(25)]
    docs = {k: " ".join(t) for k, t in enumerate(texts)}
    docs |= {k + 1000: docs[k] for k in range(0, 40, 3)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_classes(docs)


@pytest.mark.parametrize("sketches, least_share", [(2, 0.9), (24, 0.99)])
def test_op9_share_of_links(spark, sketches, least_share):
    """Of the similar pairs that share a sketch, most are in one class even if a bucket has many clusters and no good pivot,
    and with few sketches, so with few further chances; and nothing else is joined."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        heads = [base, *(edited(base, share, rnd) for share in (0.02, 0.03, 0.05, 0.06))]
        texts += heads + [edited(h, rnd.choice([0.005, 0.01, 0.02, 0.03]), rnd) for h in heads for _ in range(9)]
        texts += [base[: rnd.randrange(85, 120)] for _ in range(6)]
    docs = {k: " ".join(t) for k, t in enumerate(texts)}
    km = near_dedup.Kmers(5)
    seqs = {k: km(t) for k, t in docs.items()}
    keys = {k: set(near_dedup.long_keys([near_dedup.sketches_of(near_dedup.labelled(x), near_dedup.seeds_of(sketches), 2)])) for k, x in seqs.items()}
    links = [(i, j) for j in docs for i in range(j) if keys[i] & keys[j] and (docs[i] == docs[j] or near_dedup.similarity(seqs[i], seqs[j], 0.8) >= 0.8)]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, sketches=sketches, several=2).collect()}
    share = sum(got[i] == got[j] for i, j in links) / len(links)
    assert len(links) > 500 and share >= least_share, share
    full = brute_classes(docs)
    assert all(full[k] == full[got[k]] for k in docs)


def test_op9_unspaced_scripts(spark):
    """Without blanks, a letter is a word: copies with a few letters changed are found."""
    rnd = random.Random(14)
    text = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(300))
    rows = [(1, text), (2, text[:100] + "中" + text[101:]), (3, "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(300)))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_op9_rows_of_one_id(spark):
    """Of rows that share an id, each is judged by its own text; one row of a class is kept."""
    base = " ".join(f"word{k}" for k in range(100))
    rows = [(5, base), (5, base + " more"), (9, base), (None, "alone"), (None, base)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.copies) for r in got) == [(0, 0, 1), (0, 5, 3), (5, 5, 1), (5, 5, 3), (9, 5, 3)]
    assert sum(r.kept for r in got if r.class_id == 5) == 1 and len({r.text_sha256 for r in got}) == 3


def test_op9_classes_of_long_chains(spark):
    """A chain of 1000 linked nodes in random order is one class, beside a short one."""
    chain = list(range(1000))
    random.Random(12).shuffle(chain)
    links = spark.createDataFrame([*zip(chain, chain[1:]), (2001, 2000), (2001, 2002)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.classes(links, Shelf(spark, "chain")).collect()}
    assert got == {k: 0 for k in chain} | {k: 2000 for k in (2000, 2001, 2002)}


def test_op9_short_texts(spark):
    """Texts of 8 and 9 words, and of up to 24, with a word more at an end, are linked as by comparing all pairs."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for n in (1, 4, 7, *[8] * 6, 9, 10, 11, 12, 14, 16, 19, 20):
        base = [word() for _ in range(n)]
        texts += [base, [word(), *base], [*base, word()], [*base, *(word() for _ in range(n // 5))]]
    texts += [["a"] * n for n in (8, 9, 11)]
    docs = {k: " ".join(t) for k, t in enumerate(texts)}
    km = near_dedup.Kmers(5)
    keys = {k: set(near_dedup.short_keys(near_dedup.labelled(km(t)), 0.8, 16)) for k, t in docs.items()}
    near = [(i, j) for j in docs for i in range(j) if min(len(km(docs[i])), len(km(docs[j]))) < 16 and near_dedup.similarity(km(docs[i]), km(docs[j]), 0.8) >= 0.8]
    assert len(near) > 20 and all(keys[i] & keys[j] for i, j in near)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == brute_classes(docs)


def test_op9_small(spark):
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    rows = near_dedup.op9_minhash(spark, SMALL).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_op9_odd(spark):
    out = collections.defaultdict(list)
    for r in near_dedup.near_duplicates(odd_documents(spark)).collect():
        out[r.doc_id].append(r)
    assert out[6][0].class_id == out[5][0].class_id == out[5][1].class_id == 1 and out[1][0].kept
    assert out[2][0].class_id == out[3][0].class_id == 2 and out[None][0].kept and len(out[5]) == 2
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0


# Fingerprints


def spots(text):
    words, out = re.sub(r"[\W_]", " ", text.lower()).split(), set()
    anchors = set(fingerprints.ANCHORS)
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in anchors][:2] if w in anchors else []
        if len(chain) == 2:
            out.add((w, *chain))
    return out or {text}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_op7_brute(spark):
    texts = [r.text or "" for r in small(spark).orderBy("doc_id").collect()]
    rows = sorted(fingerprints.op7_fingerprints(spark, SMALL).collect())
    assert len(rows) == len(texts)
    for k, r in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(spots(t), spots(edit))) and r.near_next == pytest.approx(jaccard(spots(t), spots(after)))
        assert len(r.fingerprint.split()) == len(spots(t)) and (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)


def test_op7_odd(spark):
    rows = fingerprints.fingerprints(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS) and {r.n_chars for r in rows if r.doc_id in (2, 3)} == {0}
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 5, 6)}) == 1
    assert fingerprints.fingerprints(no_documents(spark)).count() == 0
    one = fingerprints.fingerprints(odd_documents(spark).where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_spread_ids(spark):
    ids = [-(10**15), -5, 0, 1, 2, 3, 10**18]
    docs = spark.createDataFrame([(i, f"text number {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(docs).collect()}
    assert got == {i: f"text number {(k + 1) % len(ids)}" for k, i in enumerate(ids)}


def test_ranges_are_even(spark):
    """An outlying id, and rows without id, don't put all rows into one range; every row keeps its follower."""
    rows = [(k, f"text {k}") for k in range(3000)] + [(1 << 60, "far"), (-(1 << 61), "low")] + [(None, f"none {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split = fingerprints.ranges(docs.select(F.col("doc_id").isNotNull().cast("int").alias("lane"), F.coalesce("doc_id", F.abs(F.xxhash64("text"))).alias("at")))
    sizes = [r["count"] for r in split.groupBy("lane", "start").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 8 * fingerprints.RANGE_ROWS
    got = {r.text: r.next_text for r in fingerprints.with_next(docs).collect()}
    assert len(got) == len(rows) and got["low"] == "text 0" and got["text 5"] == "text 6" and got["text 2999"] == "far"
    seen, t = [], "low"
    for _ in rows:
        seen.append(t)
        t = got[t]
    assert t == "low" and len(set(seen)) == len(rows)


def test_similar_pairs(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(400).collect()}
    own = {i: frozenset(spots(t)) for i, t in texts.items()}
    sets = set(own.values())
    names = {s: min(i for i in own if own[i] == s) for s in sets}
    want = {(min(names[a], names[b]), max(names[a], names[b])) for a in names for b in names if a != b and jaccard(a, b) >= 0.7}
    got = fingerprints.similar_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 0.7).collect()
    assert {(r.a, r.b) for r in got if r.likeness < 1} == want
    assert sum(r.likeness == 1 for r in got) == len(texts) - len(sets)


def test_distance(spark):
    df = spark.createDataFrame([("the one two three four of",)], "t string")
    near, far = df.select(fingerprints.signatures(F.col("t"), 2, 1).alias("a"), fingerprints.signatures(F.col("t"), 2, 2).alias("b")).first()
    want = df.select(F.array(F.hash(F.lit("the one two"))).alias("a"), F.array(F.hash(F.lit("the two four"))).alias("b")).first()
    assert (near, far) == (want.a, want.b)


# Languages


def test_op4_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = language_id.op4_language_id(spark, MEDIUM).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_op4_brute(spark):
    """Predictions against a plain search of all language sets, each mixture by many rounds in double precision."""
    docs = small(spark)
    model = language_id.fit(docs.where(~language_id.is_held_out()))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    letters, langs = grams.letter_table(), range(len(model.langs))
    got = {r.doc_id: r for r in language_id.op4_language_id(spark, SMALL).collect()}
    same = main = 0
    for i, t in texts.items():
        c = grams.gram_counts([t], model.buckets, letters)[0].astype(float)
        n = c.sum()
        if not n:
            assert got[i].lang_pred == "und" and got[i].score == 0
            same, main = same + 1, main + 1
            continue
        best = None
        for k in range(1, len(langs) + 1):
            for chosen in itertools.combinations(langs, k):
                p = model.probs[:, chosen]
                share = np.full(k, 1 / k)
                for _ in range(100):
                    share = share * ((c / (p @ share)) @ p) / n
                score = c @ np.log(p @ share) - (k - 1) * (0.5 * np.log(max(n, 2)) + 0.01 * n)
                if best is None or score > best[0]:
                    best = (score, chosen, share)
        want = model.langs[best[1][best[2].argmax()]]
        main += want == got[i].lang_pred
        same += want == got[i].lang_pred and abs(best[2].max() - got[i].score) < 0.02
    assert main >= 0.99 * len(texts) and same >= 0.95 * len(texts), (main, same, len(texts))


def test_op4_ties(spark):
    """Of languages that explain a text equally well, the first by name."""
    docs = spark.createDataFrame([(k, "same words here", lang) for k, lang in enumerate(["b", "a", "c"])], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()} == {("a", 1.0)}
    assert language_id.fit(docs, cells=3 * 64).buckets == 64
    with pytest.raises(ValueError):
        language_id.fit(docs, cells=47)


def test_op4_many_languages(spark):
    """Of 400 languages every one can be predicted, the rarest and those that mix too; a text of two languages gets both."""
    rnd = random.Random(8)
    letters = [chr(c) for c in range(0x61, 0x17F) if chr(c).isalpha() and chr(c) == chr(c).lower()]
    voices = {f"l{k:03}": ["".join(rnd.choices(rnd.sample(letters, 14), k=rnd.randrange(2, 7))) for _ in range(40)] for k in range(400)}
    say = lambda lang, n: " ".join(rnd.choices(voices[lang], k=n))
    rows = [(lang, say(lang, 60)) for lang in voices for _ in range(1 if lang == "l123" else rnd.randrange(2, 5))]
    model = language_id.fit(spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert len(model.langs) == 400
    asked = [("l123", say("l123", 40)), *((lang, say(lang, 40)) for lang in rnd.sample(sorted(voices), 99))]
    mixed = [(a, b, f"{say(a, 60)} {say(b, 40)}") for a, b in (rnd.sample(sorted(voices), 2) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate([*(t for _, t in asked), *(t for *_, t in mixed)])), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in range(100)] == [lang for lang, _ in asked]
    sets = [{x.split(":")[0] for x in got[100 + k].languages.split()} for k in range(20)]
    assert sum(s == {a, b} for s, (a, b, _) in zip(sets, mixed, strict=True)) >= 18
    #: The same texts taken together.
    texts = [*(t for _, t in asked[:30]), *(t for *_, t in mixed[:10])]
    counts = grams.gram_counts(texts, model.buckets, grams.letter_table())
    alone, _ = language_id.mixtures(counts, model)
    few = language_id.TOGETHER
    try:
        language_id.TOGETHER = 1000
        together, _ = language_id.mixtures(counts, model)
    finally:
        language_id.TOGETHER = few
    assert (alone.argmax(axis=1) == together.argmax(axis=1)).all() and ((alone > 0) == (together > 0)).all(axis=1).mean() >= 0.9


def test_unknown_languages_go(spark):
    """Noise, and text unlike all that was learned, go; the documents stay."""
    rnd = random.Random(15)
    noise = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(60)) for _ in range(5)]
    odd = [*noise, "это русский текст, который совсем не похож на другие " * 5, "这是中文文本" * 20, "", None, "12 34"]
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = language_id.fit(docs)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    assert language_id.keep_known(df, model, 0.3).count() == 0
    with_letters = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert language_id.keep_known(docs, model, 0.3).count() == with_letters


def test_op4_learns_from_its_part_only(spark):
    docs = small(spark)
    changed = docs.withColumn("lang", F.when(language_id.is_held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (language_id.fit(d.where(~language_id.is_held_out())) for d in (docs, changed))
    assert a.langs == b.langs and np.allclose(a.probs, b.probs)


def test_mixture():
    rnd = np.random.default_rng(1)
    probs = rnd.dirichlet(np.full(512, 0.1), 3).T + 1e-9
    model = language_id.Model(["a", "b", "c"], probs / probs.sum(axis=0), 512)
    draw = lambda w: rnd.multinomial(3000, model.probs @ w / (model.probs @ w).sum())
    share, n = language_id.mixtures(np.array([draw(np.array(w)) for w in ([1, 0, 0], [0.6, 0.4, 0], [0.2, 0.3, 0.5])], np.float32), model)
    assert np.allclose(share, [[1, 0, 0], [0.6, 0.4, 0], [0.2, 0.3, 0.5]], atol=0.06) and share[0, 0] == 1 and share[1, 2] == 0


def test_op4_odd(spark):
    docs = odd_documents(spark)
    out = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs), language_id.is_held_out()).collect()}
    assert out[2].lang_pred == out[3].lang_pred == out[7].lang_pred == "und" and out[1].lang_pred == "en" and out[1].score == 1
    none = language_id.fit(no_documents(spark))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.keep_known(docs, language_id.fit(docs), 0.3).columns == docs.columns
    assert language_id.predict(no_documents(spark), none).count() == 0 and language_id.keep_known(docs, none, 0.3).count() == 0


def test_grams_by_hand():
    letters = grams.letter_table()
    one = grams.gram_counts(["ab c", "", "A-b"], 1 << 12, letters)
    assert one.sum(axis=1).tolist() == [3, 0, 2]
    assert (grams.gram_counts(["xyz", "q"], 64) == np.vstack([grams.gram_counts([t], 64) for t in ("xyz", "q")])).all()


# Quality


def test_op6_on_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    out = [r for r in quality.op6_quality(spark, MEDIUM).collect() if r.doc_id in labels]
    good, bad = ([r for r in out if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(r.keep for r in good) / len(good) > 0.98 and sum(not r.keep for r in bad) / len(bad) > 0.9


def test_weak_model():
    rnd, k = random.Random(2), len(quality.LABELLERS)
    patterns, truth = collections.Counter(), collections.defaultdict(list)
    for _ in range(5000):
        good = rnd.random() < 0.8
        v = "".join(rnd.choices("bg-", (2, 70, 28) if good else (50, 20, 30))[0] for _ in range(k))
        patterns[v] += 1
        truth[v].append(good)
    post = quality.weak_model(patterns)
    right = sum((post[v] >= 0.5) == g for v, gs in truth.items() for g in gs)
    assert right > 4900 and quality.weak_model({}) == {}


def test_op6_brute(spark):
    """The query against plain loops: votes of each text, expectation-maximisation over them, and the trained scorer applied gram by gram."""
    docs = small(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    cast = {i: quality.votes(quality.measures(t)) for i, t in texts.items()}
    post, prior, bad, good = {}, 0.85, [-3.0] * len(quality.LABELLERS), [0.3] * len(quality.LABELLERS)
    for _ in range(60):
        for i, v in cast.items():
            odds = math.log(prior / (1 - prior)) + sum(bad[k] if c == "b" else good[k] if c == "g" else 0 for k, c in enumerate(v))
            post[i] = 1 / (1 + math.exp(-max(-30, min(30, odds)))) if set(v) != {"-"} else 0.85
        all_good = sum(post.values())
        all_bad = len(post) - all_good
        prior = min(0.98, max(0.02, (all_good + 1) / (len(post) + 2)))
        for k in range(len(bad)):
            rate = lambda vote, of, total: (sum(of(post[i]) for i, v in cast.items() if v[k] == vote) + 0.5) / (total + 5)  # noqa: B023, E731
            for votes, letter, low, high in ((bad, "b", -6, -1), (good, "g", 0, 2)):
                votes[k] = min(high, max(low, math.log(rate(letter, lambda p: p, all_good) / rate(letter, lambda p: 1 - p, all_bad))))
    _, weights = quality.fit(docs)
    for r in quality.op6_quality(spark, SMALL).collect():
        t = texts[r.doc_id]
        assert r.votes == cast[r.doc_id] and abs(r.weak_good - post[r.doc_id]) < 1e-6 and r.keep == (r.score >= 0.5)
        x = quality.features([t], [quality.measures(t)], len(weights) - 1)[0]
        plain = sum(float(a) * float(b) for a, b in zip(x, weights, strict=False)) + float(weights[-1])
        assert abs(r.score - (1 / (1 + math.exp(-plain)) if t.strip() else 0)) < 1e-3


def test_op6_odd(spark):
    docs = odd_documents(spark)
    model = quality.fit(docs)
    out = collections.defaultdict(list)
    for r in quality.classify(docs, model).collect():
        out[r.doc_id].append(r)
    assert not out[2][0].keep and out[2][0].score == 0 and len(out[5]) == 2 and out[5][0] == out[5][1]
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.classify(no_documents(spark), quality.fit(no_documents(spark))).count() == 0


def test_op7_runs_of_anchors(spark):
    """Signatures against a plain version, and a run of a million anchors."""
    rnd = random.Random(5)
    words = ["the", "of", "und", "la", "a", "cat", "dog", "x1", "The", "sat!"]
    texts = ["", "the", "the of", "the of cat", "the cat the", *(" ".join(rnd.choice(words) for _ in range(rnd.randrange(40))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, distance in ((2, 1), (1, 1), (2, 2)):
        chains = []
        for k, t in enumerate(texts):
            w = re.findall(r"\w+", t.lower())
            for i, anchor in enumerate(w):
                content = [x for x in w[i + 1 :] if x not in fingerprints.ANCHORS][: length * distance]
                if anchor in fingerprints.ANCHORS and len(content) == length * distance:
                    chains.append((k, " ".join([anchor, *content[distance - 1 :: distance]])))
        plain = spark.createDataFrame(chains, "doc_id long, chain string").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.hash("chain"))).alias("want"))
        both = docs.join(plain, "doc_id", "left").select("doc_id", fingerprints.signatures(F.col("text"), length, distance).alias("got"), F.coalesce("want", F.array(F.hash("text"))).alias("want"))
        assert both.where("got <> want").isEmpty()
    long = spark.createDataFrame([("the " * 1_000_000 + "cat sat",), ("the cat sat",)], "text string")
    assert len({tuple(r[0]) for r in long.select(fingerprints.signatures(F.col("text"))).collect()}) == 1
