"""Documents that every operator must take: nulls, empties, long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Longish words follow one another, and another. " * 3000
ODD = [
    (1, None, None, "a", None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "one two  three", "en", None, 3), (5, "one two three", "en", "b", 3), (6, "One Two Three", "en", "b", 3),
    (7, LONG, "en", "c", 1), (8, LONG, "en", "c", 1), (8, LONG, "en", "c", 1), (None, "one two three", "en", "b", 3), (None, None, None, None, None), (9, "É́ naïve <|endoftext|> '日本語' don't 1234 😀", "fr", "d", 9),
    (10, "x" * 5000, "en", "d", 1), (11, "\x1c\x00 odd\r\nline ▁▁ x", "en", "d", 1), (12, "a b c d e f g", "en", "d", 1), (13, "a b c d e f h", "en", "d", 1),
]


def odd_documents(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    clash = ("n_tokens", "fp", "key", "kept", "keep_id", "row", "rid", "src", "__key", "score", "component_id", "length", "label", "hash", "part")
    return docs.withColumns({c: F.lit("clash") for c in clash})


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
