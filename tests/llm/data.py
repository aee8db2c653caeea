"""Small documents that hold the awkward cases every operator must take."""

from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts, first_id: int = 0):
    rows = [(first_id + i, t, None if i % 3 else "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
