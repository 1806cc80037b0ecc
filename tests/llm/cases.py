"""A small table of documents with the odd cases, and helpers."""

from pyspark.sql import types as T

#: Names the operators use for columns of their own.
CLASHING = ("score", "lang_pred", "shard", "slot", "spans", "node", "n", "size", "_row", "_hash", "_text", "_key", "piece")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)
SENTENCE = "the quick brown fox jumps over the lazy dog and runs away from the old house"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
TEXTS = [
    (1, SENTENCE, "en", "a"),
    (2, SENTENCE, "en", "b"),  # tie
    (2, SENTENCE, "en", "b"),  # repeated row
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n", "de", "a"),
    (None, "der schnelle braune fuchs springt über den faulen hund und läuft weg", "de", "a"),
    (None, None, None, None),
    (6, "1234 5678 !!", "en", "c"),
    (7, LONG, "en", "a"),
    (8, "x" * 70_000, "en", "a"),
    (9, "日本語 Ünïcode 😀 <|endoftext|> don't", "fr", "c"),
    (10, SENTENCE + " today", "en", "a"),
]


def documents(spark, rows=TEXTS):
    full = [(i, t, g, s, len(t) if t is not None else None, *["x"] * len(CLASHING)) for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
