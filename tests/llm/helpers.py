"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Long words here. " * 6000
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "same text here", None, "a", 1), (3, "same text here", None, "a", 1), (4, "same text here", "en", "b", 1),
    (None, "same text here", "en", "b", 1), (None, "no id", None, None, None), (5, LONG, "en", "a", 9), (6, " \t\n", "en", "c", 3), (7, "é😀 ñ　x", "es", "c", 3), (8, LONG, "en", "a", 9),
]


def edge(spark):
    """With extra columns whose names operators use themselves."""
    return spark.createDataFrame(EDGE, DOCS).withColumns({"kept": F.lit(1), "digest": F.lit("x"), "score": F.lit("s"), "fp": F.lit(0), "row": F.lit("r"), "size": F.lit(0), "length": F.lit(1)})


def empty(spark):
    return edge(spark).limit(0)


def real(spark):
    from conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark):
    from conftest import SF

    return spark.read.parquet(f"{SF}/labels.parquet")
