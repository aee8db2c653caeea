"""Document exports to pages, with failures as rows of their own.

An export is one JSON document of what a PDF reader gives: pages with their size,
number of images, recognised text and text items (string, size, matrix).  Files are
read by Spark (``exports``) and parsed in the JVM, so the columns that a query does
not use are pruned from the JSON as well.  A document that cannot be read gives one
issue and no pages, a page without text one issue, and the read goes on.

Defined results: null, blank or broken content is DOCUMENT_UNREADABLE, a document of
no pages DOCUMENT_EMPTY, a page with neither native nor recognised text
PAGE_UNREADABLE (it stays among the pages, with no method); missing sizes give items
without a region; an empty table gives empty tables.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import geometry as g

EXPORT = "pages array<struct<page_number int, width double, height double, image_count int, ocr_text string, items array<struct<content string, width double, height double, transform array<double>>>>>, _broken string"
DIGITAL_CHARS, NATIVE_CHARS = 80, 40  # of a page that is digital; of one that needs no recognition


def exports(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """document_id (the path) and content of all exports below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("document_id"), F.col("content").cast("string").alias("content"))


def _normalised(values: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for, of arrays of strings; white space to one blank, trimmed."""
    return values.map(lambda a: None if a is None else [" ".join(unicodedata.normalize("NFKC", x or "").split()) for x in a])


def scanned(files: DataFrame) -> DataFrame:
    """document_id, pages, failure of each export (document_id, content)."""
    parsed = F.from_json(F.col("content"), EXPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    d = files.select("document_id", F.trim(F.coalesce("content", F.lit(""))).alias("_c"), parsed.alias("_p"))
    unreadable = (F.col("_c") == "") | F.col("_p._broken").isNotNull() | F.col("_p.pages").isNull()
    failure = F.when(unreadable, "DOCUMENT_UNREADABLE").when(F.size("_p.pages") == 0, "DOCUMENT_EMPTY")
    return d.select("document_id", F.col("_p.pages").alias("pages"), failure.alias("failure"))


def pages(files: DataFrame) -> DataFrame:
    """document_id, page, width, height, image_count, chars, mode, method and items (content, normalised, region) of readable documents."""
    normalised = F.pandas_udf(_normalised, "array<string>")
    # No filter before the pages are dealt out: it would be pushed down and parse the document again for each of its terms.
    readable = F.when(F.col("failure").isNull(), F.col("pages"))
    d = scanned(files).select("document_id", F.posexplode_outer(readable).alias("_at", "p")).filter("_at is not null")
    d = d.select("document_id", F.col("p.page_number").alias("page"), "p.width", "p.height", F.coalesce("p.image_count", F.lit(0)).alias("image_count"), "p.ocr_text", F.coalesce("p.items", F.array().cast("array<struct<content:string,width:double,height:double,transform:array<double>>>")).alias("_i"))
    d = d.withColumn("_n", normalised(F.transform("_i", lambda i: i["content"])))
    item = lambda i, k: F.struct(i["content"].alias("content"), F.get(F.col("_n"), k).alias("normalised"), _clamped(i, F.col("width"), F.col("height")).alias("region"))
    chars = F.aggregate("_n", F.lit(0), lambda n, s: n + F.length(s))
    images = F.col("image_count") > 0
    mode = F.when((F.col("chars") >= DIGITAL_CHARS) & images, "HYBRID").when(F.col("chars") >= DIGITAL_CHARS, "DIGITAL").when(images, "SCAN").otherwise("UNREADABLE")
    method = F.when(F.col("chars") >= NATIVE_CHARS, "NATIVE").when(F.trim("ocr_text") != "", "OCR")
    d = d.withColumn("chars", chars).withColumns({"mode": mode, "method": method, "items": F.transform("_i", item)})
    return d.select("document_id", "page", "width", "height", "image_count", "chars", "mode", "method", "items")


def _clamped(i, page_width, page_height):
    """An item's box within the page: its matrix gives place and least height."""
    m, tall = i["transform"], F.greatest(F.coalesce(i["height"], F.lit(0.0)), F.lit(1.0))
    x, y = g.clamp(F.get(m, F.lit(4)) / page_width), g.clamp(1 - (F.get(m, F.lit(5)) + tall) / page_height)
    width = F.greatest(F.lit(0.0), F.least(1 - x, i["width"] / page_width))
    height = F.greatest(F.lit(0.0), F.least(1 - y, F.greatest(tall, F.abs(F.get(m, F.lit(3)))) / page_height))
    return F.when((F.size(m) >= 6) & (page_width > 0) & (page_height > 0), g.region(x, y, width, height))


def issues(files: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """document_id, page, code: one row of each failed document, and of each page without text.

    A document is parsed once for both.  Only pages without recognised text are asked
    for their native one, and only texts beyond ASCII go to Python, as NFKC leaves
    ASCII as it is.  Where the files' ``pages`` are kept already, ``read`` gives them.
    """
    if read is not None:
        lost = read.filter("method is null").select("document_id", "page", F.lit("PAGE_UNREADABLE").alias("code"))
        return scanned(files).filter("failure is not null").select("document_id", F.lit(None).cast("int").alias("page"), F.col("failure").alias("code")).unionByName(lost)
    empty = F.array().cast("array<string>")
    failed = F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col("failure").alias("code"), F.lit(None).cast("array<string>").alias("texts")))
    silent = F.filter("pages", lambda p: ~F.coalesce(F.trim(p["ocr_text"]) != "", F.lit(False)))
    texts = lambda p: F.coalesce(F.transform(p["items"], lambda i: F.coalesce(i["content"], F.lit(""))), empty)
    asked = F.transform(silent, lambda p: F.struct(p["page_number"].alias("page"), F.lit("PAGE_UNREADABLE").alias("code"), texts(p).alias("texts")))
    found = F.when(F.col("failure").isNotNull(), failed).otherwise(asked)
    d = scanned(files).select("document_id", F.explode_outer(found).alias("i")).select("document_id", "i.*").filter("code is not null")
    size = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))
    ascii = F.forall("texts", lambda t: F.octet_length(t) == F.length(t))
    plain = F.transform("texts", lambda t: F.trim(F.regexp_replace(t, r"[\t\n\x0B\f\r\x1C-\x1F ]+", " ")))
    d = d.withColumn("chars", F.when(ascii, size(plain))).filter(F.coalesce(F.col("chars") < NATIVE_CHARS, F.lit(True)))
    d = d.withColumn("_n", F.pandas_udf(_normalised, "array<string>")(F.when(F.col("chars").isNull(), F.col("texts"))))
    return d.filter(F.col("texts").isNull() | (F.coalesce("chars", size("_n")) < NATIVE_CHARS)).select("document_id", "page", "code")
