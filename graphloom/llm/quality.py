"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation
over all documents' vote patterns estimates how often each labeller is right about good and about
bad texts, and gives each pattern the posterior that its text is good. Posterior labels of a
bounded sample train a linear scorer over hashed character 3-grams, which scores every text.

Scale: votes are made in one scan and aggregated to their distinct patterns (at most
3^labellers rows, whatever the corpus). The sample bound is ``train_docs``. Scoring is a map
with one weight vector in the closure; nothing else is shuffled.
"""

from __future__ import annotations

import bisect
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .shared import table
from .token_counts import blocks

#: Very common words of the languages, as one set.
COMMON = frozenset(
    "the of and to in a is that it for was on are as with be by at this from or an have not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le "
    "le la les et des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont".split()
)
LABELLERS = ("upper", "symbols", "shouting", "word_length", "common_words", "repeated_lines", "stuttering", "distinct_words", "digits", "plain_words", "length")
PLAIN = re.compile(r"(?<!\S)[^\W\d_]+[.,;:?!]?(?!\S)")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
BINS = (0.005, 0.02, 0.06, 0.12, 0.25, 0.5, 0.8, 2, 3, 9, 14)
SCHEMA = "doc_id long, weak_good double, score double, keep boolean, votes string"


def measures(text: str) -> tuple[float, ...]:
    """What the labellers look at: number of words, then shares in the order of LABELLERS but the last."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words = text.lower().split()
    n = len(words)
    if not n:
        return (0,) * len(LABELLERS)
    letters, chars = max(1, int(raw[65:91].sum() + raw[97:123].sum())), max(1, int(raw.sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        n, raw[65:91].sum() / letters, raw[SYMBOLS].sum() / chars, raw[33] / n, (chars - n) / n, sum(map(COMMON.__contains__, words)) / n,
        1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0, sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n,
        raw[48:58].sum() / chars, len(PLAIN.findall(text)) / n,
    )


def votes(m: tuple[float, ...]) -> str:
    """One letter a labeller: g(ood), b(ad) or - (no vote). An empty text is bad by length alone."""
    n, upper, symbols, shout, mean, common, repeated, stutter, variety, digits, plain = m
    if not n:
        return "-" * (len(LABELLERS) - 1) + "b"
    cast = (
        (upper > 0.5, False), (symbols > 0.06, False), (shout > 0.15, False), (mean > 14 or mean < 2, 3 <= mean <= 9), (n >= 20 and common < 0.02, common > 0.1),
        (repeated > 0.4, False), (stutter > 0.1, False), (n >= 50 and variety < 0.12, False), (digits > 0.2, False), (plain < 0.6, plain > 0.85), (n < 2, n >= 20),
    )
    return "".join("b" if bad else "g" if good else "-" for bad, good in cast)


def weak_model(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior of being good of each vote pattern, by expectation-maximisation over all patterns.

    Each labeller has two rates for each of its votes: how often it casts it on good and on bad
    texts. A pattern without a vote keeps the first prior. Starts from labellers that seldom call a good
    text bad but miss many bad ones; the bounds of the odds keep a labeller from turning around.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    v = np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in k] for k in keys], float)
    good, bad = v > 0, v < 0
    prior, silent = 0.85, ~(good | bad).any(axis=1)
    #: Log odds of good against bad that a labeller's vote adds; silence adds nothing, since silences go together.
    says_bad, says_good = np.full(v.shape[1], -3.0), np.full(v.shape[1], 0.3)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + bad @ says_bad + good @ says_good
        post = np.where(silent, 0.85, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        g, b = weight * post, weight * (1 - post)
        prior = np.clip((g.sum() + 1) / (weight.sum() + 2), 0.02, 0.98)
        rate = lambda votes, w: (w @ votes + 0.5) / (w.sum() + 5)
        says_bad = np.clip(np.log(rate(bad, g) / rate(bad, b)), -6, -1)
        says_good = np.clip(np.log(rate(good, g) / rate(good, b)), 0, 2)
    return dict(zip(keys, post.tolist(), strict=True))


def features(texts: list[str], measured: list[tuple[float, ...]], buckets: int) -> np.ndarray:
    """Shares of the hashed 3-grams (case and signs count), square-rooted, and the hashed bin of each
    measure. The lengths of short texts are less, so that a few grams weigh less than the bias."""
    counts = grams.gram_counts(texts, buckets)
    out = np.sqrt(counts / (counts.sum(axis=1, keepdims=True) + 100))
    for row, m in zip(out, measured, strict=True):
        for k, x in enumerate(m[1:]):
            row[zlib.crc32(b"%d:%d" % (k, bisect.bisect(BINS, x))) % buckets] += 0.3
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 20.0, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a logistic scorer for soft labels."""
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = 0.9 * step - rate * 0.1 * (x.T @ ((p - y) / len(y)).astype(np.float32) + decay * w)
        w = w + step
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096, train_docs: int = 4096) -> tuple[dict[str, float], np.ndarray]:
    """(posterior of each vote pattern, scorer). Patterns are counted over all documents; the scorer
    learns from those documents, about ``train_docs``, whose hashed id and text fall below that share."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("string").alias("id"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(measures(t)) for t in b.column(0).to_pylist()], pa.string())], names=["votes"])

    patterns = {r["votes"]: r["n"] for r in rows.select("text").mapInArrow(vote, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior = weak_model(patterns)
    share = min(1_000_000, int(np.ceil(1_000_000 * train_docs / max(1, sum(patterns.values())))))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            measured = [measures(t) for t in texts]
            for i, j in blocks(texts, 300_000):
                x = features(texts[i:j], measured[i:j], buckets)
                used = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [b.column(1)[i:j], pa.array([posterior.get(votes(m), 0.5) for m in measured[i:j]]), pa.array(used, pa.list_(pa.int16())), pa.array([r[u] for r, u in zip(x, used, strict=True)], pa.list_(pa.float32()))],
                    names=["key", "y", "at", "x"],
                )

    #: Rows that repeat an id and its text count once, so that no group of copies can outgrow the bound.
    key = F.xxhash64("id", "text", F.lit(6))
    chosen = rows.where(F.pmod(key, F.lit(1_000_000)) < share).groupBy(key.alias("key")).agg(F.first("text").alias("text")).select("text", "key")
    #: About train_docs rows come to the driver; sorted, so that the scorer doesn't depend on the order in which tasks end.
    got = chosen.mapInArrow(sample, "key long, y double, at array<short>, x array<float>").toArrow().sort_by("key")
    y = got.column("y").to_numpy()
    x = np.zeros((len(y), buckets), np.float32)
    for row, at, value in zip(x, got.column("at").to_pylist(), got.column("x").to_pylist(), strict=True):
        row[at] = value
    return posterior, train(x, y)


def score_all(texts: list[str], measured: list[tuple[float, ...]], weights: np.ndarray) -> np.ndarray:
    """The scorer's probability that each text is good; 0 for texts without a word."""
    score = np.zeros(len(texts))
    for i, j in blocks(texts, 300_000):
        score[i:j] = 1 / (1 + np.exp(-np.clip(features(texts[i:j], measured[i:j], len(weights) - 1) @ weights[:-1] + weights[-1], -30, 30)))
    score[[not t.strip() for t in texts]] = 0.0
    return score


def classify(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """doc_id, weak_good (posterior of its votes), score (of the trained scorer, 0 to 1), keep, votes.

    Null counts as the empty text, which is never kept (score 0). Repeated rows get equal answers, an
    empty table none, texts are read whole, and columns other than id and text are ignored.
    """
    posterior, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            measured = [measures(t) for t in texts]
            cast, score = [votes(m) for m in measured], score_all(texts, measured, weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([posterior.get(c, 0.5) for c in cast]), pa.array(score), pa.array(score >= keep_from), pa.array(cast, pa.string())], names=["doc_id", "weak_good", "score", "keep", "votes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, that ``classify`` keeps."""
    weights, at = model[1], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(score_all(texts, [measures(t) for t in texts], weights) >= keep_from))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs))
