"""Byte-level BPE: vocabulary files and rank-synchronous merging of many pre-tokens at once."""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: Fixed values of the byte-level file format: its pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """byte -> the letter that stands for it in a byte-level file: printable ones themselves, the others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


@functools.cache
def read_file(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """(token bytes -> id, merges in rank order, special string -> id) of a byte-level BPE .json file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    back = {c: b for b, c in byte_letters().items()}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    to_bytes = lambda s: bytes(back[c] for c in s)
    vocab = {to_bytes(s): i for s, i in data["model"]["vocab"].items() if s not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
    return vocab, [(to_bytes(a), to_bytes(b)) for a, b in pairs], special


@functools.cache
def tiktoken_encoding(path: str):
    """The same vocabulary in a faster library. Its ranks are the ids, which rise in merge order in such files."""
    import tiktoken

    vocab, merges, special = read_file(path)
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(made) or len(set(made)) != len(made) or min(made, default=0) < 256:
        raise ValueError(f"{path}: ids are not in merge order")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=special)


def special_strings(special: dict[str, int]) -> regex.Pattern | None:
    return regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None


class RankMerger:
    """Counts the symbols that are left of each byte sequence once no pair can be merged.

    All sequences lie in one ragged array. Each round finds every sequence's lowest-rank pair
    and merges all its occurrences, in all sequences at the same time; sequences without a
    mergeable pair leave the array. A merge can only make pairs of a higher rank than its own,
    so the rounds give what merging one pair after the other gives. Between two bytes that follow
    each other in no token a sequence is cut in two, as no merge can reach across; so a long
    pre-token without blanks, too, is many short sequences.
    """

    def __init__(self, path: str):
        vocab, merges, self.special = read_file(path)
        self.first = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        self.neighbours = np.zeros(1 << 16, bool)
        for t in vocab:
            self.neighbours[[a << 8 | b for a, b in itertools.pairwise(t)]] = True
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        #: Open addressing; ``probes`` is the longest run of any key.
        self.bits = int(np.ceil(np.log2(max(2, 6 * len(keys)))))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank, self.slot_made = np.full(1 << self.bits, NEVER, np.int32), np.zeros(1 << self.bits, np.int32)
        self.probes, mask = 1, (1 << self.bits) - 1
        for rank, (key, at, new) in enumerate(zip(keys.tolist(), self.slots(keys).tolist(), made.tolist(), strict=True)):
            steps = 1
            while self.slot_key[at] >= 0:
                at, steps = (at + 1) & mask, steps + 1
            self.slot_key[at], self.slot_rank[at], self.slot_made[at] = key, rank, new
            self.probes = max(self.probes, steps)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, or -1."""
        keys = a << 20 | b
        at = self.slots(keys)
        out = np.where(self.slot_key[at] == keys, at, -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_key[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slot_key[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """The number of symbols of each sequence."""
        raw, own, starts = self.cut(sequences)
        sizes = np.zeros(len(starts))
        for part, number, _ in self.rounds(raw, starts):
            sizes[part] = number
        return np.bincount(own[starts], sizes, len(sequences)).astype(np.int64)

    def ids(self, sequences: list[bytes]) -> list[np.ndarray]:
        """The symbols of each sequence."""
        raw, own, starts = self.cut(sequences)
        done = list(self.rounds(raw, starts))
        if not done:
            return [np.empty(0, np.int64) for _ in sequences]
        part, number, sym = (np.concatenate([d[k] for d in done]) for k in range(3))
        at = np.cumsum(number) - number
        order = np.argsort(part, kind="stable")
        number, at = number[order], at[order]
        flat = sym[np.repeat(at - (np.cumsum(number) - number), number) + np.arange(number.sum())]
        return np.split(flat, np.cumsum(np.bincount(own[starts], number, len(sequences)).astype(np.int64))[:-1])

    def cut(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, the sequence of each, and where parts start: at a sequence's start and between bytes that no token has side by side."""
        raw = np.frombuffer(b"".join(sequences), np.uint8)
        own = np.repeat(np.arange(len(sequences)), np.fromiter(map(len, sequences), np.int64, len(sequences)))
        apart = ~self.neighbours[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        return raw, own, np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | apart][: len(raw)])

    def rounds(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(parts, the number of symbols of each, these symbols) of the parts that are done after each round."""
        sym = self.first[raw]
        seq = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(raw)]))
        slot = np.full(len(sym), -1, np.int64)  # of the pair that starts here
        fresh = np.flatnonzero(seq[:-1] == seq[1:])
        while len(sym):
            slot[fresh] = self.find(sym[fresh], sym[fresh + 1])
            rank = np.where(slot >= 0, self.slot_rank[slot], NEVER)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            least = np.minimum.reduceat(rank, starts)
            live = least < NEVER
            keep = np.repeat(live, sizes)
            if not live.all():
                yield seq[starts[~live]], sizes[~live], sym[~keep]
            chosen = (rank == np.repeat(least, sizes)) & keep
            at = np.flatnonzero(chosen)
            run = at - np.arange(len(at))  # equal in a run of neighbours: a pair of equal symbols overlaps itself
            begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][: len(run)])
            nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            at = at[(nth & 1) == 0]
            sym[at] = self.slot_made[slot[at]]
            keep[at + 1] = False
            new = np.zeros(len(sym), bool)
            new[at] = True
            slot[at] = -1
            sym, seq, slot, new = sym[keep], seq[keep], slot[keep], new[keep]
            new[:-1] |= new[1:]  # the pair before a merged symbol is new as well
            slot[new] = -1
            fresh = np.flatnonzero(new[:-1] & (seq[:-1] == seq[1:]))


class TokenCounter:
    """Token counts of texts. Pre-tokens seen before are looked up; new ones are merged in one batch."""

    def __init__(self, path: str, remember: int = 800_000):
        self.merger, self.remember, self.known = RankMerger(path), remember, {}
        self.split, self.special = regex.compile(PATTERN).findall, special_strings(self.merger.special)

    def __call__(self, texts: Iterable[str | None]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            pieces = [text or ""]
            if self.special and text and self.special.search(text):
                pieces = self.special.split(text)
            extra.append(len(pieces) - 1)
            parts.append(self.split(pieces[0]) if len(pieces) == 1 else list(itertools.chain.from_iterable(map(self.split, pieces))))
        if len(self.known) > self.remember:
            self.known = {}
        new: set[str] = set()
        for p in parts:
            new.update(p)
        missing = list(new - self.known.keys())
        if missing:
            self.known.update(zip(missing, self.merger.counts([x.encode() for x in missing]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, p)) + e for p, e in zip(parts, extra, strict=True)]


class LongEncoder:
    """Ids of texts with pre-tokens of any length, each different pre-token merged once."""

    def __init__(self, path: str):
        self.merger, self.split = RankMerger(path), regex.compile(PATTERN).findall
        self.special = special_strings(self.merger.special)

    def __call__(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [self.plain(text[at : m.start()]), np.array([self.merger.special[m[0]]])]
            at = m.end()
        return np.concatenate([*out, self.plain(text[at:])])

    def plain(self, text: str) -> np.ndarray:
        parts = self.split(text)
        known = list(dict.fromkeys(parts))
        ids = dict(zip(known, self.merger.ids([x.encode() for x in known]), strict=True))
        return np.concatenate([np.empty(0, np.int64), *map(ids.__getitem__, parts)])
