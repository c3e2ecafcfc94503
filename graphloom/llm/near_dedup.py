"""Near-duplicate detection by Order MinHash with banded alignment.

A text is its sequence of k-mers (``words`` consecutive words; a shorter text is one k-mer; in
scripts without blanks, a letter is a word). Each of ``sketches`` sketches takes the ``several``
k-mers, labelled by their occurrence, with the smallest hashes of its own and keeps them in text
order. Texts that share a sketch are in one bucket: like a set sketch it wants common k-mers, and
unlike one it wants them in the same order. Texts of less than ``short`` k-mers, for which
sketches miss links, and those near them in length also get the keys of a prefix filter, which
misses none. Similarity = aligned / (all k-mers of both - aligned), where a banded alignment finds
the longest common subsequence of whole texts; ``least`` or more is a link. The band is wide
enough that no alignment of that similarity leaves it, so it costs no link.

Scale: equal texts are one node, known by digest. A bucket's most central node is its pivot, and
its other members are compared with that one only, so a group of copies makes as many pairs as it
has members. What a pivot doesn't settle is dealt again to buckets of that pivot, by sketches of
what a member has beyond the pivot (and, for what lies almost whole inside the pivot, of the member
itself, by classes of lengths); these buckets have pivots of their own. From then on members that
fail are dealt by sketches of twice as many k-mers each time, so what isn't alike parts, and the
search ends when no bucket has two members that haven't met. There is no cap on partners, buckets
or rounds; each round is linear in the members left. Links become classes by minimum labels with
pointer jumping, in tables. Joins are sort-merge joins of kept tables, which adaptive execution
splits where a key is hot; nothing but counts comes to the driver.

A pair of similarity ``least`` or more can be missed if it shares no bucket, or if its members part
at every pivot they share; the README has the measured share of links kept.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Shelf, table

MIX = np.uint64(0x9E3779B97F4A7C15)
VERIFIED = pa.schema([("node", pa.int64()), ("pivot", pa.int64()), ("similar", pa.float64()), ("again", pa.list_(pa.int64()))])
#: Letters of scripts that are written without blanks.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


class Kmers:
    """The k-mer sequence of a text as 64-bit numbers. Words are letters and digits, lower-cased; a letter of UNSPACED is a word."""

    def __init__(self, words: int, remember: int = 400_000):
        self.words, self.remember, self.known = words, remember, {}
        self.spaced, self.unspaced, self.mixed = re.compile(r"\w+").findall, re.compile(f"[{UNSPACED}]").search, re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+").findall
        self.number = lambda w: zlib.crc32(w) | (zlib.adler32(w) << 32)

    def __call__(self, text: str) -> np.ndarray:
        text = text.lower()
        words = self.spaced(text) if text.isascii() or not self.unspaced(text) else self.mixed(text)
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.remember:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.number(w.encode())
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        ids = scramble(ids * MIX)
        k = min(self.words, len(ids))
        out = np.zeros(len(ids) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * np.uint64(0x100000001B3) + ids[j : j + len(out)]
        return scramble(out)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer mixed with the number of its earlier occurrences."""
    order = np.argsort(kmers, kind="stable")
    run = kmers[order]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    nth = np.empty(len(kmers), np.uint64)
    nth[order] = np.arange(len(kmers)) - np.repeat(first, np.diff(np.r_[first, len(kmers)]))
    with np.errstate(over="ignore"):
        return kmers + nth * np.uint64(0xA24BAED4963EE407)


def seeds_of(sketches: int, first: int = 1) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scramble(np.arange(first, first + sketches, dtype=np.uint64) * MIX)


def sketches_of(x: np.ndarray, seeds: np.ndarray, several: int, cells: int = 2_000_000) -> np.ndarray:
    """One key a seed: its ``several`` k-mers of ``x`` (labelled) with the smallest hashes, in text order. Of so few k-mers that
    all are taken, one key for all seeds. ``cells``: hashes held at once."""
    if not len(x):
        return np.empty(0, np.uint64)
    if len(x) <= several:
        seeds, chosen = seeds[:1], x[None, :]
    else:
        chosen, step = np.empty((len(seeds), several), np.uint64), max(1, cells // len(x))
        for i in range(0, len(seeds), step):
            with np.errstate(over="ignore"):
                h = (x[None, :] ^ seeds[i : i + step, None]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            chosen[i : i + step] = x[np.sort(np.argpartition(h, several - 1, axis=1)[:, :several], axis=1)]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(chosen.shape[1], 0x100000001B3, np.uint64))
        return scramble((scramble(chosen ^ seeds[:, None]) * powers).sum(axis=1, dtype=np.uint64) ^ seeds)


def long_keys(keys: list[np.ndarray]) -> list[int]:
    """Keys of sketches as even numbers: the odd ones are those of ``short_keys``."""
    return [x & ~1 for x in np.concatenate(keys).view(np.int64).tolist()]


def short_keys(x: np.ndarray, least: float, short: int, take: int = 1) -> list[int]:
    """Odd keys of ``x`` (labelled) of which any two texts of similarity ``least`` share one, where one of them has less than ``short`` k-mers.

    A link has at least ``need`` = least * n labelled k-mers in common, so ``take`` of the n - need + take smallest
    hashes of either side (a prefix filter); a key is a set of so many. None for texts too long for a link with a short one.
    """
    n, need = len(x), math.ceil(least * len(x) - 1e-9)
    if not n or need >= short or take > need:
        return []
    with np.errstate(over="ignore"):
        first = np.sort(scramble((x ^ scramble(np.array([MIX]))[0]) * MIX))[: n - need + take]
        chosen = np.array(list(itertools.combinations(first.tolist(), take)), np.uint64)
        keys = scramble((chosen * np.cumprod(np.full(take, 0x100000001B3, np.uint64))).sum(axis=1, dtype=np.uint64))
    return [k | 1 for k in keys.view(np.int64).tolist()]


def differences(a: list[int], b: list[int], band: int, most: int) -> int | None:
    """How many elements of both are outside the longest common subsequence (as in ``aligned``), if at most ``most``, else None.

    With each difference more, the furthest place on each diagonal is found from those beside it; equal stretches are passed in leaps.
    """
    goal = len(a) - len(b)
    if abs(goal) > band:
        return None
    x, y, far = np.array(a, np.uint64), np.array(b, np.uint64), {}

    def passed(i: int, j: int) -> int:
        leap = 8
        while i < len(a) and j < len(b) and a[i] == b[j]:
            unlike = x[i : i + leap][: len(b) - j] != y[j : j + leap][: len(a) - i]
            if (k := int(unlike.argmax())) or unlike[0]:
                return i + k
            i, j, leap = i + len(unlike), j + len(unlike), 2 * leap
        return i

    for d in range(most + 1):
        edge = d if d <= band else band - (d - band) % 2
        for k in range(-edge, edge + 1, 2):
            i = max(far.get(k + 1, -1), far[k - 1] + 1 if k - 1 in far else -1) if d else 0
            if 0 <= i <= len(a) and 0 <= i - k <= len(b):
                far[k] = passed(i, i - k)
        if far.get(goal, -1) == len(a):
            return d
    return None


#: Differences looked for first where k-mers repeat; bytes of bit masks that an alignment may keep.
FEW, MASKS = 256, 1 << 26


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose matches lie within ``band`` of the diagonal.

    Common ends are matched first. Where most k-mers occur once, the rest is a longest rising run of
    places; else, beyond FEW differences, it is aligned bit-parallel: a row is the 2 * band + 1 bits of the
    band, and the places of a k-mer are a mask of bits made once for the next ``band`` rows.
    """
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    common, a, b = i + j, a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return common
    at: dict[int, list[int]] = {}
    for k, x in enumerate(a):
        at.setdefault(x, []).append(k)
    if sum(len(at.get(y, ())) for y in b) <= 8 * len(b):
        ends: list[int] = []
        for k, y in enumerate(b):
            for place in reversed(at.get(y, ())):
                if -band <= place - k <= band:
                    m = bisect_left(ends, place)
                    ends[m : m + 1] = [place]
        return common + len(ends)
    if (apart := differences(a, b, band, FEW)) is not None:
        return common + (len(a) + len(b) - apart) // 2
    found, row, low, high = 0, 0, 0, 0  # row: a bit for each place from low on, 0 where a match ends
    step = max(band, 4096)
    for k, y in enumerate(b):
        if k % step == 0:  # masks: places from base on, as far as the next rows reach
            base, top, masks, room = max(0, k - band), k + step + band, {}, MASKS
        if low < k - band:  # places that leave the band
            gone = min(k - band, high) - low
            found += gone - (row & (1 << gone) - 1).bit_count()
            row, low = row >> gone, low + gone
        to = min(len(a), k + band + 1)
        if to > high:
            row |= (1 << to - low) - (1 << high - low)
            high = to
        if (mask := masks.get(y)) is not None:
            hit = mask >> low - base & row
        elif places := at.get(y):
            first, last = bisect_left(places, low), bisect_right(places, high - 1)
            if last - first <= 32:
                hit = 0
                for place in places[first:last]:
                    hit |= 1 << place - low
            elif room > 0:
                masks[y] = bits(places[bisect_left(places, base) : bisect_right(places, top)], base)
                room -= masks[y].bit_length() // 8
                hit = masks[y] >> low - base
            else:
                hit = bits(places[first:last], low)
            hit &= row
        else:
            continue
        row = ((row + hit) | (row - hit)) & (1 << high - low) - 1
    return common + found + high - low - row.bit_count()


def bits(places: list[int], base: int) -> int:
    """A number with a bit for each place, counted from ``base``."""
    out = np.zeros(places[-1] - base + 1, np.uint8)
    out[np.array(places) - base] = 1
    return int.from_bytes(np.packbits(out, bitorder="little").tobytes(), "little")


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """aligned / (|a| + |b| - aligned); 0.0 where the lengths alone keep it below ``least``."""
    low, high = sorted((len(a), len(b)))
    if not low or low < least * high:
        return 0.0
    #: Elements left out on both sides at similarity ``least``.
    band = int((1 - least) / (1 + least) * (low + high)) + 1
    n = aligned(a.tolist(), b.tolist(), band)
    return n / (low + high - n)


def again(x: np.ndarray, beyond: np.ndarray, pivot: int, level: int, least: float, seeds: np.ndarray, several: int, short: int) -> list[int]:
    """Keys of the buckets in which a node goes on; x: its labelled k-mers, beyond: those that the pivot lacks.

    Buckets of the pivot: after the first, two of the k-mers beyond it, and for a node almost inside
    it ``several`` of its own and its length (classes grow by 1 / least; two neighbouring ones, so that
    linked nodes share one). The two shares overlap. After further pivots: of all its k-mers,
    2 ** level times ``several``. Buckets of short texts: sets of one more of the first k-mers each time.
    """
    own = scramble(np.array([pivot * 2 + 1], np.int64).view(np.uint64) ^ MIX)
    keys = []
    if level:
        keys.append(sketches_of(x, seeds, several << min(level, 40)) ^ own)
    else:
        if len(beyond) > 0.05 * len(x):
            keys.append(sketches_of(beyond, seeds, 2) ^ scramble(own + np.uint64(1)))
        if len(beyond) < 0.15 * len(x):
            size, inside = int(math.log(len(x)) / math.log(1 / least)), sketches_of(x, seeds, several)
            keys += [inside ^ scramble(own + np.uint64(2 + size + k)) for k in (0, 1)]
    return long_keys(keys) + short_keys(x, least, short, level + 2)


def verified(pairs: DataFrame, texts: DataFrame, level: int, least: float, several: int, short: int, deals: int) -> DataFrame:
    """node, pivot, similar of each pair of nodes (pairs: node, pivot), and the buckets in which the node goes on (see ``again``):
    after the first pivots for all nodes, later for those that aren't linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seeds, share = (None, None, None), seeds_of(deals, 1 << 20), least / (1 + least)
        for batch in batches:
            rows = []
            for node, pivot, x, y in zip(*batch.columns, strict=True):
                node, pivot, a = node.as_py(), pivot.as_py(), np.frombuffer(x.as_buffer(), np.uint64)
                if last[0] != pivot:
                    b = np.frombuffer(y.as_buffer(), np.uint64)
                    last = (pivot, b, np.sort(labelled(b)))
                _, b, sorted_b = last
                p = labelled(a)
                there = sorted_b[np.minimum(np.searchsorted(sorted_b, p), len(b) - 1)] == p
                #: Aligned k-mers are common ones, so too few of these make no link.
                similar = similarity(a, b, least) if there.sum() >= share * (len(a) + len(b)) - 1e-9 else 0.0
                rows.append((node, pivot, similar, [] if level and similar >= least else again(p, p[~there], pivot, level, least, seeds, several, short)))
            columns = zip(*rows, strict=True) if rows else [()] * len(VERIFIED)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, VERIFIED.types, strict=True)], schema=VERIFIED)

    one, two = texts.select("node", F.col("kmers").alias("x")), texts.select(F.col("node").alias("pivot"), F.col("kmers").alias("y"))
    if not level:  # later rounds have few pairs: these are broadcast where their measured size allows
        one, two = one.hint("merge"), two.hint("merge")
    return pairs.join(one, "node").join(two, "pivot").select("node", "pivot", "x", "y").mapInArrow(run, "node long, pivot long, similar double, again array<long>")


def classes(links: DataFrame, shelf: Shelf) -> DataFrame:
    """node, label of every linked node: the smallest node it is connected with.

    A round gives a node the smallest label around it, and its label's node too, then jumps to the label's
    label. Labels only fall, so it ends; passing labels on to roots makes rounds grow with the logarithm
    of a chain's length (measured: 10 at most for 2000 nodes in random order).
    """
    both = shelf.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = shelf.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels0")
    for k in itertools.count(1):
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = shelf.keep(labels.join(near.hint("merge"), "node"), f"met{k}")
        own, root = met.select("node", "label", F.least("label", "near").alias("to")), met.select(F.col("label").alias("node"), F.lit(None).cast("long").alias("label"), F.col("near").alias("to"))
        least = shelf.keep(own.unionByName(root).groupBy("node").agg(F.min("label").alias("label"), F.min("to").alias("to")), f"least{k}")
        jumped = least.join(least.select(F.col("node").alias("to"), F.col("to").alias("beyond")).hint("merge"), "to").select("node", F.least("to", "beyond").alias("new"), "label")
        jumped = shelf.keep(jumped, f"jump{k}")
        labels = jumped.select("node", F.col("new").alias("label"))
        if jumped.where("new <> label").isEmpty():
            break
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, sketches: int = 24, several: int = 5, short: int = 16, deals: int = 12) -> DataFrame:
    """doc_id, class_id, kept, copies, n_links, text_sha256 of each row: classes of texts linked by similarity or equal.

    class_id is the smallest id of the class, and its row is the one that is kept. copies: rows with
    this very text; n_links: links of this text with other texts that were verified. Null counts as empty;
    texts without a word are only linked with equal texts. Rows without id join the class of their
    text and are kept only if nothing in it has an id. Texts of any length are compared whole. Rows that repeat an id and its text are kept
    or dropped together; of texts of one class that share the smallest id, that with the smallest
    digest is kept. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers, seeds = Kmers(words), seeds_of(sketches)
        for b in batches:
            sizes, keys = [], []
            for t in b.column(2):
                x = labelled(kmers(t.as_py()))
                sizes.append(len(x)), keys.append(long_keys([sketches_of(x, seeds, several)]) + short_keys(x, least, short))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "sketch"])

    seen = shelf.keep(rows.select("doc_id", "key", "text").mapInArrow(sketched, "doc_id long, key binary, n long, sketch array<long>"), "sketches")
    nodes = seen.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = shelf.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    #: Buckets of several nodes.
    each = nodes.select("node", "n", F.explode("sketch").alias("bucket"))
    sizes = shelf.keep(each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    cand = shelf.keep(each.join(sizes.hint("merge"), "bucket"), "cand")
    central = shelf.keep(cand.groupBy("node").agg(F.sum("size").alias("central"), F.max("n").alias("n")), "central")
    shelf.drop("sizes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers = Kmers(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kmers(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["node", "kmers"])

    #: The k-mers of candidate nodes, one row a node.
    wanted = shelf.keep(central.select("node").join(nodes.hint("merge"), "node").select("node", "key", "first"), "wanted")
    texts = rows.join(wanted.hint("merge"), "key").where("doc_id <=> first").dropDuplicates(["node"]).select("node", "text")
    texts = shelf.keep(texts.mapInArrow(spread, "node long, kmers binary"), "texts")

    members = cand.select("bucket", "node", F.lit(True).alias("open"))
    decided = None
    for level in itertools.count():
        members = shelf.keep(members.join(central.hint("merge"), "node"), f"members{level}")
        #: Of short texts, the one with the fewest k-mers is the pivot: what shares as many k-mers with it is as near to it.
        rank = F.when(F.col("bucket").bitwiseAND(1) == 1, -F.col("n")).otherwise(F.col("central"))
        pivots = members.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), (-F.col("node")).alias("minus"), "open")).alias("top"), F.count("*").alias("size"), F.max("open").alias("any_open"))
        pivots = pivots.where("size > 1 AND any_open").select("bucket", (-F.col("top.minus")).alias("pivot"), F.col("top.open").alias("pivot_open"))
        pivots = shelf.keep(pivots, f"pivots{level}")
        pairs = members.join(pivots.hint("merge"), "bucket").where("node <> pivot AND (open OR pivot_open)").select("node", "pivot").distinct()
        if decided is not None:
            pairs = pairs.join(decided.select("node", "pivot").hint("merge"), ["node", "pivot"], "left_anti")
        pairs = shelf.keep(pairs, f"pairs{level}")
        if pairs.isEmpty():
            break
        found = shelf.keep(verified(pairs, texts, level, least, several, short, deals), f"verified{level}")
        shelf.drop(f"members{level}", f"pivots{level}")
        decided = found if decided is None else decided.unionByName(found)
        members = found.select("node", (F.col("similar") < least).alias("open"), F.explode("again").alias("bucket"))
        members = members.groupBy("bucket", "node").agg(F.max("open").alias("open"))
    if decided is None:
        found = None
    else:
        links = shelf.keep(decided.where(F.col("similar") >= least).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "links")
        labels = classes(links, shelf)
        counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        named = shelf.keep(labels.join(nodes.select("node", "first", "key").hint("merge"), "node").join(counts, "node"), "named")
        heads = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", "key")).alias("head"))
        heads = shelf.keep(heads.select("label", F.col("head.first").alias("class_id"), F.col("head.key").alias("head")), "heads")
        found = shelf.keep(named.join(heads.hint("merge"), "label").select("node", "class_id", "head", "n_links"), "found")
    out = seen.select("doc_id", "key").join(nodes.select("key", "node", "first", "copies").hint("merge"), "key")
    none = F.lit(None)
    out = out.withColumns({"class_id": none.cast("long"), "head": none.cast("binary"), "n_links": none.cast("long")}) if found is None else out.join(found.hint("merge"), "node", "left")
    class_id = F.when(F.col("n_links").isNull(), F.col("first")).otherwise(F.col("class_id"))
    kept = F.col("doc_id").eqNullSafe(class_id) & (F.coalesce("head", "key") == F.col("key"))
    out = out.select(
        "doc_id", class_id.alias("class_id"), kept.alias("kept"), "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.lower(F.hex("key")).alias("text_sha256")
    )
    out = shelf.keep(out, "result")
    shelf.drop_all_but("result")
    return out


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
