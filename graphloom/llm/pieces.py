"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into units (a run of blanks and what follows it: no piece crosses the start of a
unit), and between two letters that follow each other in no piece. The new parts of a batch are one
concatenated text: its suffix array is built, every piece finds its range of occurrences by binary
search, and the occurrences are edges from their first position to their end. Edges are sorted by
end position and relaxed in that order, all parts' edges of one offset at once; long parts (few, as
texts without blanks have many places to cut) one edge after the other, with a table of decisions.

The models are BPE models, so what an edge relaxes is not a score: the encoding of a text's
prefix is unique, and an edge extends the encoding before it exactly if its piece and the last
piece before it are what encoding both together gives. That is decided by walking back through
the merges along the touching sides of the two pieces, for all edges of a position at once. So
the result is the library's own encoding, not an approximation of it.

Scale: a map over the scan. Units seen before are looked up in a table per worker, bounded in number and length.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import tokenizer_path
from .shared import table
from .token_counts import blocks

BLANK = "▁"
NEVER = np.int64(1 << 40)
#: Letters of a part that is relaxed alone; decisions and letters of a unit that a worker remembers.
LONG, DECISIONS, SHORT_UNIT = 256, 1_000_000, 64
SCHEMA = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


class PairTable:
    """(left, right) -> number, by open addressing over arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        keys = left.astype(np.int64) << 20 | right
        self.bits = max(4, int(np.ceil(np.log2(max(2, 3 * len(keys))))))
        self.keys, self.values, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER), 1
        mask = (1 << self.bits) - 1
        for key, at, v in zip(keys.tolist(), self.slots(keys).tolist(), value.tolist(), strict=True):
            steps = 1
            while self.keys[at] >= 0:
                at, steps = (at + 1) & mask, steps + 1
            self.keys[at], self.values[at], self.probes = key, v, max(self.probes, steps)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, NEVER if it has none."""
        keys = left << 20 | right
        at = self.slots(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], NEVER)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out


class PieceModel:
    """A BPE model file: its pieces with the merges that make them.

    Symbols are numbered: pieces by their ids, then letters that only occur inside pieces, then one
    number for every other letter.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or kinds & {4, 5} or 6 not in kinds:
            raise ValueError(f"{path}: only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        self.size = len(model.pieces)
        self.bytes_of = [b""] * self.size
        self.byte_id = [0] * 256
        rank: dict[str, tuple[float, int]] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                rank[p.piece] = (-p.score, i)
                self.bytes_of[i] = p.piece.encode()
            elif p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
            elif p.type == 2:
                self.bytes_of[i] = " ⁇ ".encode()
        if any(BLANK in p[1:] and p.strip(BLANK) for p in rank):
            raise ValueError(f"{path}: a piece has a blank inside")
        letters = sorted({c for p in rank for c in p})
        extra = {c: self.size + k for k, c in enumerate(c for c in letters if c not in rank)}
        self.other = self.size + len(extra)
        self.letter_ids = {c: rank[c][1] if c in rank else extra[c] for c in letters}
        symbol = lambda s: rank[s][1] if s in rank else extra.get(s)
        #: Order of merging: 0, 1, ... by score; letters are there from the start.
        order = {p: k for k, (p, _) in enumerate(sorted(((p, r) for p, r in rank.items() if len(p) > 1), key=lambda x: x[1]))}
        n = self.other + 1
        self.made = np.full(n, -1, np.int64)  # when the symbol is made
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        pairs, usable = [], []
        for p in sorted(order, key=len):
            cuts = [(a, b) for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None]
            pairs += [(a, b, order[p]) for a, b in cuts]
        self.table = PairTable(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        for p in order:
            parts, i = self.merge(p, order, symbol), rank[p][1]
            if len(parts) == 1:
                a, b = parts[0][1]
                self.left[i], self.right[i], self.made[i] = symbol(a), symbol(b), order[p]
                usable.append(p)
        usable += letters
        #: Pieces as rows of letter numbers (from 1), for the binary search.
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        self.longest = max(map(len, usable))
        self.found = np.zeros((len(usable), -(-self.longest // 4) * 4), np.uint64)
        for row, p in zip(self.found, usable, strict=True):
            row[: len(p)] = [self.code[c] for c in p]
        self.length = np.array([len(p) for p in usable], np.int64)
        self.ids = np.array([symbol(p) for p in usable], np.int64)
        #: Pairs of letters that are side by side in a piece.
        beside = {self.code[a] << 20 | self.code[b] for p in order for a, b in itertools.pairwise(p)}
        self.beside = np.array(sorted(beside), np.int64)
        self.decided: dict[int, bool] = {}
        self.letters = np.zeros(0x110000, np.uint64)
        self.letters[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)

    @staticmethod
    def merge(p: str, order: dict[str, int], symbol) -> list:
        """The symbols that merging leaves of ``p``: [(text, (left, right) or None)]."""
        parts: list = [(c, None) for c in p]
        while len(parts) > 1:
            ranks = [order.get(a[0] + b[0], 1 << 40) for a, b in itertools.pairwise(parts)]
            best = min(ranks)
            if best == 1 << 40:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], (parts[k][0], parts[k + 1][0]))]
        return parts

    def compatible(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether encoding u's and t's text together gives u, t."""
        ok = np.ones(len(u), bool)
        at = np.arange(len(u))
        u, t = u.copy(), t.copy()
        until_u, until_t = np.full(len(u), NEVER), np.full(len(u), NEVER)
        while len(at):
            merge = self.table.find(u, t)
            #: A merge that both sides live to see. Where two merges are the same, the one further left is first.
            clash = (merge < until_u) & (merge <= until_t) & (merge < NEVER)
            ok[at[clash]] = False
            made_u, made_t = self.made[u], self.made[t]
            go = ~clash & ((made_u >= 0) | (made_t >= 0))
            at, u, t, until_u, until_t, made_u, made_t = (x[go] for x in (at, u, t, until_u, until_t, made_u, made_t))
            back = made_u > made_t  # undo the later one
            until_u, until_t = np.where(back, made_u, until_u), np.where(back, until_t, made_t)
            u, t = np.where(back, self.right[u], u), np.where(back, t, self.left[t])
        return ok

    def ranges(self, words: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place in the suffix array of each piece. words[i]: the four letters from i on."""
        depth = self.found.shape[1] // 4

        def search(bound: np.ndarray, beyond: bool) -> np.ndarray:
            """The first suffix that is not less than (``beyond``: greater than) each bound."""
            low, high = np.zeros(len(bound), np.int64), np.full(len(bound), len(order), np.int64)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                at = order[np.minimum(mid, len(order) - 1)]
                less, same = np.zeros(len(bound), bool), np.ones(len(bound), bool)
                for k in range(depth):
                    suffix = words[at + 4 * k]
                    less |= same & (suffix < bound[:, k])
                    same &= suffix == bound[:, k]
                if beyond:
                    less |= same
                low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
            return low

        top = self.found.copy()
        top[np.arange(top.shape[1])[None, :] >= self.length[:, None]] = 0xFFFF
        return search(pack_letters(self.found), False), search(pack_letters(top), True)

    def suffix_array(self, words: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``place`` in the order of the texts that start there, as far as pieces reach: sorted by four
        letters, then by pairs of ranks, twice as far each time."""
        span, rank = 4, None
        while True:
            key = words if rank is None else rank << 32
            if rank is not None:
                key[:-span] |= rank[span:]
                span *= 2
            order = np.argsort(key)
            inside = key[order]
            if span >= self.found.shape[1]:
                mask = np.zeros(len(words), bool)
                mask[place] = True
                return order[mask[order]]
            rank = np.empty(len(words), np.int64)
            rank[order] = np.cumsum(np.r_[0, inside[1:] != inside[:-1]])

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as little-endian int32 bytes."""
        joined = "".join(units)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        whole = np.repeat(np.arange(len(units)), lengths)
        key = self.letters[points].astype(np.int64)
        pair = key[:-1] << 20 | key[1:]
        apart = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] != pair if len(self.beside) else np.ones(len(pair), bool)
        first_of = np.flatnonzero(np.r_[True, (whole[1:] != whole[:-1]) | apart][: len(points)])
        part_unit = whole[first_of]
        sizes = np.diff(np.r_[first_of, len(points)])
        ends = np.cumsum(sizes + 1) - 1  # a 0 stands behind each part
        starts = ends - sizes
        unit = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(points)) + unit
        n = int(ends[-1]) + 1 if len(ends) else 1
        codes = np.zeros(n + self.found.shape[1] + 4, np.uint64)
        codes[place] = self.letters[points]
        words = codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]
        first, last = self.ranges(words, order := self.suffix_array(words, place))
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        begin = order[np.repeat(first, count) + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)]
        unknown = place[codes[place] == 0]
        begin = np.concatenate([begin, unknown])
        end = np.concatenate([begin[: len(piece)] + self.length[piece], unknown + 1])
        symbol = np.concatenate([self.ids[piece], np.full(len(unknown), self.other)])
        origin = np.empty(n, np.int64)
        origin[place], origin[ends] = starts[unit], starts
        step = end - origin[begin]
        by = np.argsort(step.astype(np.int16) if len(step) and step.max() < 1 << 15 else step, kind="stable")
        begin, end, symbol, step = begin[by], end[by], symbol[by], step[by]
        fresh = begin == origin[begin]
        last_symbol, came = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        long = np.zeros(n, bool)
        for k in np.flatnonzero(sizes > LONG).tolist():
            long[starts[k] : ends[k] + 1] = True
        slow = long[begin]
        long_last, long_came = self.relax_long(begin[slow], end[slow], symbol[slow], fresh[slow])
        begin, end, symbol, step, fresh = (x[~slow] for x in (begin, end, symbol, step, fresh))
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else np.empty(0, np.int64)
        for i, j in itertools.pairwise([*cuts.tolist(), len(step)]):
            b, e, s, take = begin[i:j], end[i:j], symbol[i:j], fresh[i:j].copy()
            rest = np.flatnonzero(~take)
            take[rest[self.compatible(last_symbol[b[rest]], s[rest])]] = True
            last_symbol[e[take]], came[e[take]] = s[take], b[take]
        #: Back from the ends, one symbol a round.
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, own = ends.copy(), np.arange(len(sizes))
        going = (at > starts) & (sizes <= LONG)
        at, own = at[going], own[going]
        while len(at):
            found.append((own, came[at], last_symbol[at]))
            at = came[at]
            going = at > starts[own]
            at, own = at[going], own[going]
        for k in np.flatnonzero(sizes > LONG).tolist():
            trace, x = [], int(ends[k])
            while x > starts[k]:
                trace.append((long_came[x], long_last[x]))
                x = long_came[x]
            one = np.array(trace, np.int64)
            found.append((np.full(len(one), k), one[:, 0], one[:, 1]))
        own, at, ids = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        by = np.lexsort((at, own))
        own, at, ids = part_unit[own[by]], at[by] - own[by], ids[by]  # places as in the joined text
        cut = np.searchsorted(own, np.arange(len(units) + 1))
        flat, spelled = ids.astype("<i4").tobytes(), np.r_[0, np.cumsum(ids >= self.size)]
        out = [flat[4 * i : 4 * j] for i, j in itertools.pairwise(cut.tolist())]
        for k in np.flatnonzero(spelled[cut[1:]] > spelled[cut[:-1]]).tolist():
            one = []
            for a, s in zip(at[cut[k] : cut[k + 1]].tolist(), ids[cut[k] : cut[k + 1]].tolist(), strict=True):
                one += [s] if s < self.size else [self.byte_id[b] for b in joined[a].encode("utf-8", "surrogatepass")]
            out[k] = np.array(one, "<i4").tobytes()
        return out

    def relax_long(self, begin: np.ndarray, end: np.ndarray, symbol: np.ndarray, fresh: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
        """The last symbol and where it begins, by place, of edges in the order of their ends."""
        last: dict[int, int] = {}
        came: dict[int, int] = {}
        decided = self.decided
        for b, e, s, first in zip(begin.tolist(), end.tolist(), symbol.tolist(), fresh.tolist(), strict=True):
            if not first:
                pair = last[b] << 20 | s
                if (ok := decided.get(pair)) is None:
                    if len(decided) > DECISIONS:
                        decided.clear()
                    ok = decided[pair] = bool(self.compatible(np.array([last[b]]), np.array([s]))[0])
                if not ok:
                    continue
            last[e], came[e] = s, b
        return last, came

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of fallback ids are joined, the dummy prefix goes, marks become blanks."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(BLANK).replace(BLANK, " ")


def pack_letters(codes: np.ndarray) -> np.ndarray:
    """Rows of 16-bit letter numbers, four to a 64-bit word, so that words compare as the letters do."""
    shifts = np.array([48, 32, 16, 0], np.uint64)
    return np.stack([(codes[:, k : k + 4] << shifts).sum(axis=1, dtype=np.uint64) for k in range(0, codes.shape[1], 4)], axis=1)


@functools.cache
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Texts -> ids, with a bounded table of units."""

    def __init__(self, path: str, remember: int = 700_000):
        self.model, self.remember, self.known = model_of(path), remember, {}
        self.units = re.compile(rf"{BLANK}+[^{BLANK}]*").findall

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [self.units(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        known = self.known
        missing = list({u for u in set(itertools.chain.from_iterable(parts)) if u not in known})
        fresh = dict(zip(missing, self.model.encode_units(missing), strict=True)) if missing else {}
        #: Once the table is full, rare units are encoded again in each batch, as long ones always are; the frequent ones came early.
        if len(known) + len(fresh) <= self.remember:
            known.update((u, x) for u, x in fresh.items() if len(u) <= SHORT_UNIT)
            fresh = {u: x for u, x in fresh.items() if len(u) > SHORT_UNIT}
        get = known.__getitem__ if not fresh else lambda u: known.get(u) or fresh[u]
        return [np.frombuffer(b"".join(map(get, p)), "<i4") for p in parts]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 5_000_000) -> DataFrame:
    """doc_id, ids of each row: what the model's own library gives, without begin and end ids.

    Null and empty texts have no ids. Rows without id keep a null doc_id, repeated rows give equal
    rows, an empty table none, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [x for i, j in blocks(texts, block_chars) for x in encode(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model_of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 5_000_000) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256, round_trip of each row: encoded and
    decoded in one pass, so that the ids needn't travel. round_trip: the decoded text is the text, with the
    blank mark read as a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(model)
        for b in batches:
            texts, rows = b.column(1).to_pylist(), []
            for i, j in blocks(texts, block_chars):
                for t, ids in zip(texts[i:j], encode(texts[i:j]), strict=True):
                    back = encode.model.decode(ids.tolist())
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "").replace(BLANK, " ")))
            columns = [b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, DIGEST.types[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=DIGEST)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
