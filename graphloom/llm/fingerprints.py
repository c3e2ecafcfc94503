"""SpotSigs document fingerprints, in DataFrame functions only.

An anchor is a very common word. Each anchor starts a chain: itself and the next content words
(words that are no anchors), ``distance`` apart. The hashes of a text's chains are its
signature set, which is its fingerprint; a text without a whole chain has the hash of the text
itself as its only signature. Likeness is the Jaccard coefficient of two sets.

``similar_pairs`` joins by fingerprint: signature sets are partitioned by their length, so that
sets that differ too much in length never meet, candidates share one of the signatures that a
pair of the wanted likeness cannot all lack (the rarest ones first), and Jaccard is computed
only where the lengths allow the likeness.

Scale of ``with_next``: the text moves once, dealt by ranges of ids that hold about
``RANGE_ROWS`` documents each (about ``MAX_RANGES`` ranges at most, which bounds the table of their
first ids that is broadcast). Ranges are of equal width; one with too many rows, as ids may lie
anywhere, is split into narrower ones until none has, and rows without id are dealt by the digest
of their text. No global sort, no task with all rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Shelf, table

#: Very common words of four languages.
ANCHORS = (
    "the of and to in is that it for was are with "
    "der die und den das ist nicht ein "
    "de la que el los se por una "
    "le les et des est une pour dans"
).split()
RANGE_ROWS, MAX_RANGES, PARTS = 64, 65_536, 64
MARK, JOINED = "\x01", "\x02"


def one_of(names: list[str]) -> str:
    """A pattern for any of the words, grouped by first letter so that a mismatch is found at once."""
    groups: dict[str, list[str]] = {}
    for w in sorted(set(names)):
        groups.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in groups.items()) + ")"


def once(value: Column, use) -> Column:
    """use(value), where ``value`` is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def signatures(text: Column, length: int = 2, distance: int = 1, anchors: list[str] = ANCHORS) -> Column:
    """The sorted signature set of a text: array<int>. Equal texts have equal sets; case and signs don't count."""
    clean = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")
    marked = F.regexp_replace(clean, f" (?={one_of(anchors)} )", f" {MARK}")
    #: Anchors in a row become one word, so that each run is passed once for each chain over it, however long it is.
    runs = F.regexp_replace(marked, f"({MARK}[^ ]+) (?={MARK})", f"$1{JOINED}")
    spans = F.regexp_extract_all(runs, F.lit(f" {MARK}(?=([^ ]+(?:(?: {MARK}[^ ]+)?+ [^{MARK} ]+){{{length * distance}}}) )"), F.lit(1))
    chains = F.transform(spans, lambda s: F.regexp_replace(s, f" {MARK}[^ ]+", ""))
    if distance > 1:
        chains = F.transform(chains, lambda s: F.array_join(F.filter(F.split(s, " "), lambda _, k: k % distance == 0), " "))
    #: Each anchor of the run starts a chain with the same content words.
    spread = F.transform(chains, lambda s: once(F.split(s, " ", 2), lambda x: F.transform(F.array_distinct(F.split(x[0], f"{JOINED}{MARK}")), lambda w: F.hash(F.concat(w, F.lit(" "), x[1])))))
    found = F.sort_array(F.array_distinct(F.flatten(spread)))
    return once(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.hash(text))))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two signature sets; 0 without comparing them where their lengths alone keep it below ``least``."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    jaccard = once(F.size(F.array_intersect(a, b)), lambda common: common / (low + high - common))
    return F.when(low < F.lit(least) * high, F.lit(0.0)).otherwise(jaccard)


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: its signatures as 8 hexadecimal digits each."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), " ")


def ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (lane, at) with ``start``, the first place of the range that the row is in: ranges of equal width in each lane,
    and ever narrower ones (by PARTS) where a range has more than 8 times its share of rows and more than one place."""
    spark = rows.sparkSession
    lanes = rows.groupBy("lane").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).collect()
    total = sum(x["n"] for x in lanes)
    share = max(RANGE_ROWS, -(-total // MAX_RANGES))
    width = {x["lane"]: max(1, -(-(x["high"] - x["low"] + 1) // max(1, x["n"] // share))) for x in lanes}
    place = "decimal(38,0)"
    cell = lambda low, w: F.call_function("div", F.col("at").cast("decimal(20,0)") - low, w).cast(place) * w + low
    start = F.lit(None).cast(place)
    for x in lanes:
        start = F.when(F.col("lane") == x["lane"], cell(F.lit(x["low"]).cast("decimal(20,0)"), F.lit(width[x["lane"]]).cast("decimal(20,0)")).cast(place)).otherwise(start)
    rows = rows.withColumn("start", start)
    while any(w > 1 for w in width.values()):
        heavy = rows.groupBy("lane", "start").agg(F.count("*").alias("n")).where(F.col("n") > 8 * share).collect()
        width = {k: max(1, -(-w // PARTS)) for k, w in width.items()}
        if not heavy:
            break
        #: At most total / (8 * share) rows, so MAX_RANGES / 8.
        split = spark.createDataFrame([(x["lane"], x["start"], Decimal(width[x["lane"]])) for x in heavy], f"lane int, start {place}, width decimal(20,0)")
        rows = rows.join(F.broadcast(split), ["lane", "start"], "left")
        rows = rows.withColumn("start", F.when(F.col("width").isNotNull(), cell(F.col("start"), F.col("width")).cast(place)).otherwise(F.col("start"))).drop("width")
    return rows


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sigs, next_text, next_sigs: each row and the one that follows it by id (after the last: the first).

    Rows without id come first, by the digest of their text; rows of one id follow each other by text (they
    share a task, however many). A single row follows itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    #: Texts are only read for ranges if a row needs a digest.
    at = F.col("doc_id") if rows.where("doc_id IS NULL").isEmpty() else F.coalesce("doc_id", digest)
    rows = ranges(rows.select("doc_id", "text", F.col("doc_id").isNotNull().cast("int").alias("lane"), at.alias("at")))
    #: A row a range.
    firsts = rows.groupBy("lane", "start").agg(F.min("at").alias("first")).orderBy("lane", "start").collect()
    to = [(r["lane"], r["start"], r["first"], k, (k - 1) % len(firsts)) for k, r in enumerate(firsts)]
    known = F.broadcast(spark.createDataFrame(to, "lane int, start decimal(38,0), first long, number long, before long"))
    main = F.struct(F.col("number").alias("to"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("before").alias("to"), F.lit(True).alias("copy"))
    dealt = rows.join(known, ["lane", "start"]).withColumn("where", F.explode(F.when(F.col("at") == F.col("first"), F.array(main, copy)).otherwise(F.array(main))))
    dealt = dealt.select("doc_id", "text", "lane", "at", "where.to", "where.copy").repartition("to").withColumn("sigs", signatures(F.col("text")))
    w = Window.partitionBy("to").orderBy("copy", "lane", "at", "text")
    return dealt.select("doc_id", "text", "copy", "sigs", F.lead("text").over(w).alias("next_text"), F.lead("sigs").over(w).alias("next_sigs")).where("NOT copy").drop("copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document. Null counts as empty; empty texts share one fingerprint. Whole texts
    of any length are used; an empty table gives an empty result; other columns are ignored.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    out = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    head = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    out = out.withColumn("edited", F.concat(head, F.substring("next_text", F.lit(1), half))).withColumn("edited_sigs", signatures(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def length_class(n: Column, least: float) -> Column:
    """Number of the length partition: borders grow by 1 / ``least``, so like sets lie in the same or neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / least)) + F.lit(1e-9)).cast("long")


def similar_pairs(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, likeness) of the pairs of distinct fingerprints, each named by its smallest id, and
    with ``copies_of`` rows (a = b's fingerprint, likeness 1) for the other ids of a fingerprint.

    Rows without id are left out, as nothing can name them.
    """
    shelf = Shelf(docs.sparkSession, "spots")
    sets = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(F.coalesce(F.col(text_col), F.lit(""))).alias("sigs"))
    sets = shelf.keep(sets, "sets")
    distinct = shelf.keep(sets.groupBy("sigs").agg(F.min("id").alias("id")), "distinct")
    copies = sets.join(distinct.withColumnRenamed("id", "a").hint("merge"), "sigs").where("a <> id").select("a", F.col("id").alias("b"), F.lit(1.0).alias("likeness"))
    each = distinct.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = shelf.keep(each.groupBy("sig").agg(F.count("*").alias("df")), "often")
    ranked = each.join(often, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "sig")))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).withColumn("part", length_class(F.col("n"), least))
    prefix = shelf.keep(prefix.select("id", "n", "sig", "part"), "prefix")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "sig", "part")
    close = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - 1e-9
    order = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))
    pairs = shelf.keep(left.join(right, ["sig", "part"]).where(order & close).select("a", "b").distinct(), "pairs")
    one, two = distinct.select(F.col("id").alias("a"), F.col("sigs").alias("sigs_a")), distinct.select(F.col("id").alias("b"), F.col("sigs").alias("sigs_b"))
    joined = pairs.join(one, "a").join(two, "b").withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b"), least)).where(F.col("likeness") >= least)
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness").unionByName(copies)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
