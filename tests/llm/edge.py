"""Tables with the cases that every operator must survive."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, host string, fingerprint string"


def odd_documents(spark):
    long = "word other " * 60_000
    rows = [
        (1, "The cat sat on the mat and looked out of the window at the rain", "en", "a"), (2, "The cat sat on the mat and looked out of the window at the rain", "en", "a"),
        (2, "The cat sat on the mat and looked out of the window at the rain", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "en", None),
        (None, "a text without an id", "de", "a"), (None, None, None, None), (6, long, "en", "a"), (7, "é 日本 \U00020bb7 ß <|endoftext|> \x00 ▁x", "fr", "c"), (8, "one", "en", "a"), (9, "12 34 !!", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, 0.5, "x", "h", "f") for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
