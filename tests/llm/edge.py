"""Rows that every text operator must take."""

LONG = "The quick brown fox, number 7, jumps over it. " * 6000


def rows(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names in use elsewhere."""
    some = [
        (1, "a plain text of some words", "en", "k", 1),
        (2, None, "en", "k", 2),
        (3, "", None, "k", 3),
        (4, LONG, "en", None, 4),
        (5, "a plain text of some words", "en", "k", 5),
        (5, "a plain text of some words", "en", "k", 5),
        (None, "one without a number", "fr", "k", 6),
        (7, " \n\t ", "de", "k", 7),
        (8, "ß ñ 漢字 \U0001f600 " * 9, "de", "k", None),
    ]
    return spark.createDataFrame(some, "doc_id long, text string, lang string, key string, fp int")


def none(spark):
    return rows(spark).limit(0)
