import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from graphloom.llm import packing, pieces, token_counts
from graphloom.llm.bpe import LongEncoder, RankMerger, TokenCounter
from tokenizers import Tokenizer

from .helpers import TEXTS, no_documents, odd_documents, small

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=1500, seed=1):
    rnd = random.Random(seed)
    pick = lambda: rnd.choice([rnd.randrange(32, 127), rnd.randrange(97, 105), 32, 10, 0x3000, 0x2581, rnd.randrange(0xA0, 0x2000), rnd.randrange(0x4E00, 0x4E80), rnd.randrange(0x10000, 0x10FFFF)])
    texts = ["".join(chr(pick()) for _ in range(rnd.randrange(60))) for _ in range(n)]
    return [*texts, "", "a" * 3000, "ab" * 500, " " * 40 + "x", "\n\n  y", "a<|endoftext|>b<|endoftext|>", "<s>x</s><unk><0x41>", "it's we'll I'd"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_counts_are_the_librarys(library):
    texts = odd_texts()
    assert TokenCounter(BPE)(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(BPE, remember=10)(texts[:50]) == TokenCounter(BPE)(texts[:50])


def test_merging_is_pairwise_merging(library):
    words = [w.encode() for w in ("aaaa", "aaaaa", "lower", " newest", "abababab", "x")]
    assert RankMerger(BPE).counts(words).tolist() == [len(library.encode(w.decode(), add_special_tokens=False).ids) for w in words]


def test_op1(spark, library):
    out = {(r.doc_id, r.n_bytes): r for r in token_counts.token_counts(odd_documents(spark), BPE).collect()}
    for i, t in TEXTS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        r = out[i, len((t or "").encode())]
        assert (r.n_tokens, r.over_limit) == (n, n > 1024)
    assert token_counts.token_counts(no_documents(spark), BPE).count() == 0
    texts = {r.doc_id: r.text or "" for r in small(spark).collect()}
    rows = token_counts.op1_token_counts(spark, "/root/testdata/sf0.001").collect()
    want = dict(zip(texts, (len(x.ids) for x in library.encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((i, len(t.encode()), want[i], want[i] > 1024) for i, t in texts.items())


def test_ids_are_the_librarys(library):
    ids = packing.id_source(BPE)
    for t, e in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        assert ids(t).tolist() == [*e.ids, 0]


@pytest.fixture(scope="module")
def long_texts():
    rnd = random.Random(9)
    n = 2_000_000
    return [" " * n, "\n" * n, "x" + " " * n + "y", " \n\t" * (n // 3) + "end", "a" * n, "ab" * (n // 2), "中" * n, "".join(chr(rnd.randrange(0x4E00, 0x9F00)) for _ in range(300_000)), "<|endoftext|>" + "-=" * 100_000 + "<|endoftext|>", "ACGT" * 5000 + "".join(rnd.choices("acgt", k=200_000))]


def test_long_runs(library, long_texts):
    """Millions of blanks, line ends, one letter, letters of an unspaced script: counts and ids are the library's."""
    ids, count = packing.id_source(BPE), TokenCounter(BPE)
    for t in long_texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(t)[:-1].tolist() == want, t[:10]
        assert count([t]) == [len(want)]
    short = odd_texts(300, seed=3)
    slow = LongEncoder(BPE)
    assert [slow(t).tolist() for t in short] == [x.ids for x in library.encode_batch(short, add_special_tokens=False)]


def test_op8_long_runs(spark, library, long_texts):
    docs = list(enumerate(long_texts[:6]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert sum(check_pieces(docs, packing.packed(df, BPE).collect(), library)) > 0


def check_pieces(docs, rows, library):
    """Every id of every document lies in exactly one piece, sequences are gapless and full enough."""
    want = sorted((i, len(ids := [*library.encode(t or "", add_special_tokens=False).ids, 0]), ids) for i, t in docs if i is not None)
    have: dict = {}
    for r in rows:
        have.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, n, ids in want:
        mine = sorted(have[i, n], key=lambda r: r.start)
        copies = sum(w[:2] == (i, n) for w in want)
        covered = np.zeros(n, int)
        for r in mine:
            covered[r.start : r.start + r.length] += 1
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert (covered == copies).all()
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        sizes.append(at)
    return sizes


def test_op8(spark, library):
    assert sum(check_pieces(TEXTS, packing.packed(odd_documents(spark), BPE).collect(), library)) > 0
    assert packing.packed(no_documents(spark), BPE).count() == 0
    docs = [(r.doc_id, r.text) for r in small(spark).collect()]
    sizes = check_pieces(docs, packing.op8_packing(spark, "/root/testdata/sf0.001").collect(), library)
    assert 1 - sum(sizes) / (1024 * len(sizes)) < 0.02


def test_differencing():
    rnd = random.Random(3)
    for k in (1, 2, 3, 7, 40):
        sizes = [rnd.randint(1, 256) for _ in range(5 * k)]
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert len(sums) <= k and max(sums) - min(sums) <= max(sizes) / 4
    assert [sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)] in ([16, 14], [14, 16])
    assert packing.pack([], 10) in ([], [[]]) and len(packing.pack([6, 6, 6], 10)) == 3
    assert all(sum(w) <= 1 for w in packing.differencing([1], 4))


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_the_librarys(processor):
    texts, encode = odd_texts(seed=2), pieces.Encoder(PIECES)
    got, want = encode(texts), processor.encode(texts)
    assert [x.tolist() for x in got] == want
    assert [encode.model.decode(x.tolist()) for x in got] == [processor.decode(w) for w in want]


def test_long_units(processor):
    """Texts without blanks: one letter, two, words run together, an unspaced script, letters that no piece has."""
    rnd = random.Random(10)
    texts = ["a" * 30_000, "ab" * 10_000, "the" * 10_000 + "end", "".join(chr(rnd.randrange(0x4E00, 0x9F00)) for _ in range(100_000)), "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=50_000)), "中文字" * 30_000, "\U0001f600" * 20_000, "=-" * 20_000, "x" * 255 + " " + "x" * 256 + " " + "x" * 257, ""]
    assert [x.tolist() for x in pieces.Encoder(PIECES)(texts)] == processor.encode(texts)


def test_runs_of_blanks(processor):
    texts = [" " * n + "the" * (n % 2) for n in range(70)]
    assert [x.tolist() for x in pieces.Encoder(PIECES)(texts)] == processor.encode(texts)


def test_op5(spark, processor):
    docs = odd_documents(spark)
    ids = pieces.encoded(docs, PIECES)
    assert sorted((str(r.doc_id), r.ids) for r in ids.collect()) == sorted((str(i), processor.encode(t or "")) for i, t in TEXTS)
    back = pieces.decoded(ids, PIECES)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in TEXTS)
    for r in pieces.digests(docs, PIECES).collect():
        assert r.round_trip
    assert pieces.digests(no_documents(spark), PIECES).count() == 0
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    for r in pieces.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        want = processor.encode(texts[r.doc_id] or "")
        assert (r.n_ids, r.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<i4").tobytes())) and r.round_trip


def test_op5_long_units_alone():
    """Batches whose new units are all long, after known short ones too."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for first in ([], ["the cat sat"]):
        for text in ("a" * 300, " " * 300, "\n" * 300, "the cat sat " + "a" * 300, "中" * 1000, "\U0001f600" * 400, "x" * 257 + " " + "y" * 258, "a" * 255, "", None):
            encode = pieces.Encoder(PIECES)
            encode(first)
            assert [x.tolist() for x in encode([text])] == [library.encode(text or "")]


@pytest.mark.parametrize("text", ["a" * 300, " " * 300])
def test_one_row(spark, text):
    """A table of one row with one long unit, for every operator on documents."""
    from graphloom.llm import exact_dedup, fill_middle, fingerprints, language_id, near_dedup, quality

    docs = spark.createDataFrame([(1, text, "en", "s", 300)], "doc_id long, text string, lang string, source string, n_chars long")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [r.ids for r in pieces.encoded(docs, PIECES).collect()] == [library.encode(text)]
    assert [r.round_trip for r in pieces.digests(docs, PIECES).collect()] == [pieces.decoded(pieces.encoded(docs, PIECES), PIECES).collect()[0].text == text]
    for out in (token_counts.token_counts(docs, BPE), packing.packed(docs, BPE), language_id.predict(docs, language_id.fit(docs)), fingerprints.fingerprints(docs), near_dedup.near_duplicates(docs), exact_dedup.exact_dedup(docs), fill_middle.fill_middle(docs)):
        assert out.count() >= 1
    assert quality.keep_good(docs, quality.fit(docs)).count() <= 1


def test_runs_are_passed_once(library):
    """Lines of thousands of letters: time in proportion to the text."""
    import time

    text = ("中" * 4000 + "\n") * 100
    ids, began = packing.id_source(BPE), time.time()
    assert ids(text)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids
    assert time.time() - began < 10
