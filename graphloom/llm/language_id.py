"""Language identification as inference of a multilingual mixture.

Each learned language is a smoothed distribution over hashed letter 3-grams. A document is a
mixture of languages: expectation-maximisation finds the proportions that make its grams most
likely. The language set is chosen by penalised likelihood: languages join in the order of
their proportions as long as the likelihood rises by more than the penalty. The prediction is
the largest proportion of the chosen set, which is the score.

Scale: fitting counts the languages (one small aggregation), then sums the gram counts of at most about ``docs_per_lang``
documents of each inside the tasks; what reaches the driver is an array a language. Every language is learned: where there are
very many, grams are hashed to fewer buckets, so that the model (a float a language and bucket, sent to the tasks) stays within ``cells``.
Prediction is a map over the scan. Of few languages, the mixtures of many texts are found at once; of many, each text's
alone, over its own grams and only the languages that still have a share of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .shared import table
from .token_counts import blocks

UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string"


#: Up to so many languages, texts are taken together.
TOGETHER = 64


@dataclass
class Model:
    langs: list[str]
    probs: np.ndarray  # buckets x languages
    buckets: int

    @cached_property
    def log(self) -> np.ndarray:
        return np.log(self.probs)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 4096, docs_per_lang: int = 2000, smooth: float = 0.5, cells: int = 1 << 24) -> Model:
    """Gram distributions of all languages in ``labelled``; rows without text or language teach nothing, an empty table no language.

    ``docs_per_lang`` bounds the sample: of a language with more documents, those whose hashed id and text fall below the
    fitting share (about that many) are read, whole. ``cells`` bounds the model: ``buckets`` is halved while there are more languages times
    buckets; languages for which 16 buckets are too many are an error, none is left out.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    #: One more than there may be tells that there are too many.
    counted = sizes.limit(cells // 16 + 1).collect()
    if len(counted) > cells // 16:
        raise ValueError(f"more than {cells // 16} languages; raise cells")
    langs = sorted(r["lang"] for r in counted)
    while buckets > 16 and buckets * len(langs) > cells:
        buckets //= 2
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), buckets)
    share = [(r["lang"], min(1_000_000, int(np.ceil(1_000_000 * docs_per_lang / r["n"])))) for r in counted]
    shares = F.broadcast(labelled.sparkSession.createDataFrame(share, "lang string, `fitting share` long"))  # a row a language, at most cells / 16
    sample = rows.join(shares, "lang").where(F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit(4)), F.lit(1_000_000)) < F.col("fitting share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = grams.letter_table(), {}

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "counts"])
            total.clear()
            return out

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in blocks(texts, 300_000):
                for name, row in zip(names[i:j], grams.gram_counts(texts[i:j], buckets, letters), strict=True):
                    total[name] = total.get(name, 0) + row.astype(np.float64)
                if len(total) > 1000:
                    yield batch()
        if total:
            yield batch()

    partial = sample.mapInArrow(count, "lang string, counts array<double>").select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0")
    summed = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    counts, at = np.full((buckets, len(langs)), smooth), {x: k for k, x in enumerate(langs)}
    found = summed.toArrow()  # a row a language, cells numbers at most
    for lang, where, n in zip(found.column(0).to_pylist(), found.column(1), found.column(2), strict=True):
        counts[where.values.to_numpy(), at[lang]] += n.values.to_numpy()
    return Model(langs, (counts / counts.sum(axis=0)).astype(np.float32), buckets)


def mixtures(counts: np.ndarray, model: Model, rounds: int = 12, per_language: float = 0.5, per_gram: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the chosen language set, grams) of each row of ``counts``.

    Penalty of a set of k languages for n grams: (k - 1) * (per_language * ln n + per_gram * n). Sets grow in the order of
    the proportions in the mixture of all languages, until even the most likely mixture there can be couldn't pay for one more.
    """
    probs = model.probs.astype(np.float32)
    n, k = counts.sum(axis=1), probs.shape[1]
    if not k:
        return np.zeros((len(counts), 0)), n
    single = counts @ model.log
    best = single.argmax(axis=1)
    out = np.zeros((len(counts), k))
    out[np.arange(len(counts)), best] = 1.0
    if k < 2 or not len(counts):
        return out, n
    penalty = per_language * np.log(np.maximum(n, 2)) + per_gram * n
    if k <= TOGETHER:
        choose(counts, probs, single.max(axis=1), penalty, np.arange(k), rounds, out)
    else:
        for i in np.flatnonzero(n).tolist():
            own = np.flatnonzero(counts[i])
            few, left = counts[i : i + 1, own], remaining(counts[i, own], probs[own], rounds)
            at = np.append(left, best[i]) if best[i] not in left else left
            choose(few, probs[np.ix_(own, at)], single[i : i + 1, best[i]], penalty[i : i + 1], at, rounds, out[i : i + 1])
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12), n


def remaining(c: np.ndarray, probs: np.ndarray, rounds: int) -> np.ndarray:
    """The languages that keep a share of a text (c: counts of its grams) in the mixture of all: those that explain less than a thousandth of a gram go."""
    at, size = np.arange(probs.shape[1]), c.sum()
    share = np.full(len(at), 1 / len(at), np.float32)
    least = min(1e-3 / size, 0.01 / len(at))
    for _ in range(rounds):
        share = share * ((c / (probs @ share + np.float32(1e-30))) @ probs) / size
        if (share < least).any():
            keep = share >= least
            at, probs, share = at[keep], probs[:, keep], share[keep] / share[keep].sum()
    return at


def choose(counts: np.ndarray, probs: np.ndarray, score: np.ndarray, penalty: np.ndarray, at: np.ndarray, rounds: int, out: np.ndarray) -> None:
    """Write the proportions of the chosen sets into ``out``, where a set of several languages wins. probs: grams x languages, which are columns ``at`` of ``out``."""
    k = probs.shape[1]

    def mixed_by(c: np.ndarray, share: np.ndarray) -> np.ndarray:
        return c / (share @ probs.T + np.float32(1e-30))

    def em(c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share, size = start.astype(np.float32), np.maximum(c.sum(axis=1, keepdims=True), 1)
        for _ in range(rounds):
            share = share * (mixed_by(c, share) @ probs) / size
        return share, np.einsum("ij,ij->i", c, np.log(share @ probs.T + np.float32(1e-30)))

    #: Only where the mixture of all languages gains more than the least penalty can a set win.
    full, reach = em(counts, np.full((len(counts), k), 1 / k))
    mixed = np.flatnonzero(reach - score > penalty)
    if not len(mixed):
        return
    c, order = counts[mixed], np.argsort(-full[mixed], axis=1, kind="stable")
    #: The likelihood is concave in the proportions, so its slopes bound what any mixture can reach.
    most = reach[mixed] + (mixed_by(c, full[mixed]) @ probs).max(axis=1) - c.sum(axis=1)
    score, fee = score[mixed], penalty[mixed]
    for size in range(2, k + 1):
        go = most - (size - 1) * fee > score
        if not go.all():
            mixed, c, order, most, score, fee = mixed[go], c[go], order[go], most[go], score[go], fee[go]
        if not len(mixed):
            return
        start = np.zeros((len(mixed), k), np.float32)
        np.put_along_axis(start, order[:, :size], 1 / size, axis=1)
        share, likely = em(c, start)
        won = likely - (size - 1) * fee > score
        score = np.where(won, likely - (size - 1) * fee, score)
        rows = np.zeros((int(won.sum()), out.shape[1]))
        rows[:, at] = share[won]
        out[mixed[won]] = rows


def predict(docs: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the chosen set with shares) of each row.

    Null texts and texts without a letter: ``und`` with score 0, as is everything if no language
    was learned. Equal shares: the first language by name. Repeated rows get equal answers, an
    empty table none. Texts of any length are counted whole, in blocks of texts. Columns other than id and text are never inputs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = grams.letter_table()
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            pred, score, sets = [], [], []
            for i, j in blocks(texts, 300_000):
                share, n = mixtures(grams.gram_counts(texts[i:j], model.buckets, letters), model)
                for row, grams_in in zip(share, n, strict=True):
                    if not grams_in or not model.langs:
                        pred.append(UNKNOWN), score.append(0.0), sets.append("")
                        continue
                    top = int(row.argmax())
                    pred.append(model.langs[top]), score.append(float(min(1.0, row[top])))
                    sets.append(" ".join(f"{model.langs[x]}:{row[x]:.3f}" for x in np.argsort(-row, kind="stable") if row[x] > 0.0005))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    held = held_out if held_out is not None else F.lit(None).cast("boolean")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def evidence(counts: np.ndarray, share: np.ndarray, model: Model) -> np.ndarray:
    """By how much the mixture of each row makes a gram of it more likely (natural log, on average) than if all were equally
    likely: above 0 for text in the learned languages, below for noise and for languages unlike them. 0 without a gram."""
    n = counts.sum(axis=1)
    some = np.flatnonzero(share.any(axis=0))
    likely = np.einsum("ij,ij->i", counts, np.log(share[:, some].astype(np.float32) @ model.probs[:, some].T.astype(np.float32) + np.float32(1e-30)))
    return np.where(n > 0, likely / np.maximum(n, 1) + np.log(model.buckets), 0.0)


def keep_known(docs: DataFrame, model: Model, least_share: float, least_evidence: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose mixture has more than that evidence (see ``evidence``) and whose main language has
    at least that share. Null texts, texts without a letter and all rows, where no language was learned, go."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = grams.letter_table()
        for b in batches:
            texts, keep = [t or "" for t in b.column(at).to_pylist()], []
            for i, j in blocks(texts, 300_000):
                counts = grams.gram_counts(texts[i:j], model.buckets, letters)
                share, n = mixtures(counts, model)
                known = evidence(counts, share, model) > least_evidence if model.langs else n < 0
                keep += ((n > 0) & known & (share.max(axis=1, initial=0) >= least_share)).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~is_held_out())), is_held_out())
