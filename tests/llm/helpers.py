"""Rows that every corpus operator must stand: nulls, empty and long texts, ties, repeats, other columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use within
        T.StructField("size", T.StringType()),
        T.StructField("key_id", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box up old jars of liquid amber near the river bank today"
TEXTS = [
    (0, None, "en", "a"),
    (1, "", "en", "a"),
    (2, " \n\t ", "de", "b"),
    (3, PROSE, "en", None),
    (3, PROSE, "en", None),
    (4, PROSE.upper(), None, "b"),
    (5, PROSE + " extra", "en", "c"),
    (6, "one", "en", "c"),
    (7, "one two", "fr", "c"),
    (None, PROSE, "en", "a"),
    (None, None, None, None),
    (8, "\n".join(["same line here", "another line", "same line here", "", "closing words"] * 3), "en", "a"),
    (9, "été Übung ÇA  nbsp \U0001f600 smile " * 30, "fr", "é"),
    (10, "ab cd " * 30_000, "en", "z"),
    (11, "### $$$ %%% &&& ||| <<< >>> *** " * 20, "en", "z"),
    (12, " ".join(f"w{i}" for i in range(300)), "es", "z"),
    (13, "\n".join(f"line {i} of a text" for i in range(40)), "es", "z"),
    (14, "prefix line\n" + "\n".join(f"line {i} of a text" for i in range(10, 30)) + "\ntail", "es", "a"),
]


def edge_docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "x", "y", "z", None) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
