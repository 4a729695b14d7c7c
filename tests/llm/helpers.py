"""Rows with the cases that every operator must stand."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("size", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n_values", T.StringType()),
    ]
)


def doc(i, text, source="s0", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", "z")


def awkward(prose):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    long = " ".join(prose(k) for k in range(400))
    rows = [doc(i, prose(i), f"s{i % 5}") for i in range(40)]
    rows += [doc(100, None), doc(101, ""), doc(102, " \n\t "), doc(103, "one"), doc(None, prose(7), None, None), doc(None, None, None, None), doc(104, long, "s1"), doc(105, "\n".join(["same line here again."] * 50), "s2")]
    return [*rows, rows[0], rows[0], doc(3, prose(9), "s4")]


def sentence(k):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    return " ".join(words[(k * 7 + j * j) % len(words)] + str((k * 31 + j) % 97) for j in range(30)) + "."
