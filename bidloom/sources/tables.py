"""Readers and writers: tables, document files, JSON manifests, immutable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.operators import keyed

REGION = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])
TEXT_ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("normalized_text", T.StringType()), T.StructField("order", T.IntegerType()), T.StructField("region", REGION)])
PARSED_PAGE = T.StructType(
    [T.StructField("document_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("image_count", T.IntegerType()), T.StructField("text_items", T.ArrayType(TEXT_ITEM))]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, sha256 and document_id (first 16 hex digits) of all files below ``path``; contents stay with Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    digest = F.sha2("content", 256)
    return files.select("path", "length", digest.alias("sha256"), F.substring(digest, 1, 16).alias("document_id"))


def parsed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Parsed pages as JSON lines under a fixed schema; anything else fails the read."""
    return spark.read.schema(PARSED_PAGE).option("mode", "FAILFAST").json(path)


def page_modes(pages: DataFrame, enough: int = 80) -> DataFrame:
    """chars and mode of parsed pages: enough text is DIGITAL, with images HYBRID; else images are SCAN, nothing is UNREADABLE."""
    chars = F.aggregate("text_items", F.lit(0), lambda n, i: n + F.length(F.coalesce(i["normalized_text"], F.lit(""))))
    images = F.col("image_count") > 0
    mode = F.when((F.col("chars") >= enough) & images, "HYBRID").when(F.col("chars") >= enough, "DIGITAL").when(images, "SCAN").otherwise("UNREADABLE")
    return pages.withColumn("chars", chars).withColumn("mode", mode)


def manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def overlay(detected: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field the override where there is one; confidence becomes OPERATOR on overridden rows."""
    o = overrides.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_o_{f}") for f in fields))
    joined = detected.join(o, F.col(key) == F.col("_k"), "left")
    changes = {f: F.coalesce(f"_o_{f}", f) for f in fields} | {"confidence": F.when(F.col("_k").isNotNull(), "OPERATOR").otherwise(F.col("confidence"))}
    return joined.withColumns(changes).select(*detected.columns)


def append_immutable(existing: DataFrame | None, incoming: DataFrame, path: str, keys: list[str], values: list[str]) -> None:
    """Appends rows of new keys; a known key with other values fails before anything is written."""
    if existing is not None:
        if keyed.merge_state(existing, incoming, keys, values).filter("state = 'CONFLICT'").limit(1).count():
            raise ValueError(f"rows with known {keys} but other values")
        incoming = keyed.append_immutable(existing, incoming, keys, values)
    incoming.write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def package_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document a row, for exchange."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("package"))


def page_methods(pages: DataFrame, enough: int = 40) -> tuple[DataFrame, DataFrame]:
    """(pages with their reading method, issues) of scanned pages (document, page, native_chars, ocr_chars, failed).

    A page with enough text is NATIVE, else OCR where that found text.  A document
    that failed has no pages and one issue; a page without text one of its own.
    """
    broken = pages.filter("failed").select("document").distinct()
    sound = pages.join(broken, "document", "left_anti")
    method = F.when(F.col("native_chars") >= enough, "NATIVE").when(F.col("ocr_chars") > 0, "OCR")
    d = sound.withColumn("method", method)
    issues = broken.select("document", F.lit(None).cast("int").alias("page"), F.lit("DOCUMENT_UNREADABLE").alias("code"))
    return d.filter("method is not null"), issues.unionByName(d.filter("method is null").select("document", F.col("page").cast("int").alias("page"), F.lit("PAGE_UNREADABLE").alias("code")))


def previews(pages: DataFrame, raw: DataFrame, few: int = 40, full_page: int = 20) -> DataFrame:
    """document, text, chars, inspected, with_text (pages of 20 characters or more), ocr_mean (null without OCR).

    ``pages``: document, page, content, ocr_confidence; ``raw``: document, content,
    whose shown strings '(...) Tj' stand in for a text layer that is nearly empty.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page", F.trim(F.coalesce("content", F.lit(""))).alias("c"))))  # the sampled pages of one document
    g = pages.groupBy("document").agg(ordered.alias("_p"), F.count("*").alias("inspected"), F.count_if(F.length(F.trim("content")) >= full_page).alias("with_text"), F.avg("ocr_confidence").alias("ocr_mean"))
    g = g.withColumn("text", F.array_join(F.filter(F.transform("_p", lambda x: x["c"]), lambda c: c != ""), "\n"))
    strings = F.array_join(F.regexp_extract_all("content", F.lit(r"\(([^()]*)\)\s*Tj"), F.lit(1)), " ")
    d = g.join(raw.select("document", strings.alias("_raw")), "document", "left")
    best = F.when(F.length("text") < few, F.coalesce("_raw", "text")).otherwise(F.col("text"))
    return d.select("document", best.alias("text"), F.length(best).alias("chars"), "inspected", "with_text", "ocr_mean")


def inventory(pages: DataFrame, digests: DataFrame, first_pages: int = 3) -> DataFrame:
    """sha256, document_id (16 hex digits of it), pages, chars, items and the text of the first pages of each document."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("page") <= first_pages, F.struct("page", "content")))), lambda x: x["content"]), "\n")
    g = pages.groupBy("document").agg(F.count("*").alias("pages"), F.sum(F.length("content")).alias("chars"), F.sum("items").alias("items"), text.alias("first_text"))
    return digests.join(g, "document", "left").select("document", "sha256", F.substring("sha256", 1, 16).alias("document_id"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("first_text", F.lit("")).alias("first_text"))


def overlaid_manifest(detected: DataFrame, overrides: DataFrame, key: str, fields: list[str], settled_risk: str) -> DataFrame:
    """``overlay``, and one risk less on the overridden rows (column risks)."""
    known = overrides.select(F.col(key).alias("_m")).distinct()
    d = overlay(detected, overrides, key, fields).join(known, F.col(key) == F.col("_m"), "left")
    return d.withColumn("risks", F.when(F.col("_m").isNotNull(), F.array_remove("risks", settled_risk)).otherwise(F.col("risks"))).drop("_m")


def with_defaults(state: DataFrame, arrays: list[str]) -> DataFrame:
    """Stored state with missing arrays as empty ones."""
    kinds = dict(state.dtypes)
    return state.withColumns({a: F.coalesce(F.col(a), F.array().cast(kinds[a])) for a in arrays})


def snapshot_outputs(snapshots: DataFrame, key: str, arrays: dict[str, str]) -> dict[str, DataFrame]:
    """One table an output (name -> array of structs) of nested snapshots, each row with its snapshot's key and place."""
    return {name: snapshots.select(key, F.posexplode(column).alias("seq", "_x")).select(key, "seq", "_x.*") for name, column in arrays.items()}


def from_packages(packages: DataFrame, schema: str, content: str = "package") -> DataFrame:
    """Rows of exchanged JSON documents under a fixed schema; anything else fails the read."""
    return packages.select(F.from_json(content, schema, {"mode": "FAILFAST"}).alias("_p")).select("_p.*")


def compact_request(pages: DataFrame) -> DataFrame:
    """document, page, mode and items of an extraction request: boxes to four places, no text of scanned pages."""
    place = lambda b, f: F.round(b[f], 4).alias(f)
    short = lambda i: F.struct(i["item_id"].alias("item_id"), F.when(F.col("mode") != "SCAN", i["content"]).alias("content"), F.struct(*(place(i["box"], f) for f in ("x", "y", "width", "height"))).alias("box"))
    return pages.select("document", "page", "mode", F.transform("items", short).alias("items"))


def full_records(compact: DataFrame) -> DataFrame:
    """Full lines of compact extractions (document, page, sections, lines): an array of one value is the value, an empty one null; section keys become ids.

    ``sections`` is a map key -> title; a line is a struct section, quantity, unit (arrays of one value at most).
    """
    ids = F.transform_values("sections", lambda k, v: F.concat(F.lit("section_"), F.substring(F.sha2(F.concat_ws(":", F.col("document").cast("string"), k, v), 256), 1, 18)))
    d = compact.withColumn("_ids", ids).select("document", "page", "_ids", F.posexplode("lines").alias("seq", "l"))
    one = lambda a: F.try_element_at(a, F.lit(1))
    return d.select("document", "page", "seq", F.try_element_at("_ids", F.col("l.section")).alias("section_id"), one(F.col("l.quantity")).alias("quantity"), one(F.col("l.unit")).alias("unit"))
