"""Inputs that every operator must take."""

LONG = "the quick brown fox of the north is running to a far place " * 4000

TEXTS = [
    (1, "The cat sat on the mat and the dog lay by the door of the house in the sun."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "The cat sat on the mat and the dog lay by the door of the house in the sun."),
    (5, "The cat sat on the mat and the dog lay by the door of the house in the sun."),
    (6, "THE CAT sat on the mat and the dog lay by the door of the house in the sun."),
    (None, "no id here, but a text of some words that is long enough"),
    (7, "!!! ??? 123"),
    (9, "a" * 300),
    (10, " " * 300),
    (11, "cat " * 20_000),
    (12, "the " * 20_000 + "cat sat"),
    (13, "<select><table><td>" * 2000),
    (14, ("中" * 4000 + "\n") * 5),
    (8, "éè \U0001f600 中文 <|endoftext|> <s> \t\n x"),
]


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those operators make."""
    rows = [(i, t, None if i == 3 else "en", None, 0, "x", 1, "y", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, n long, key string, kept long")


def no_documents(spark):
    return odd_documents(spark).where("false")


def small(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
