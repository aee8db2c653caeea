"""Tables of a database: partitioned scans with what the database can do pushed down, and appends that never overwrite.

A scan reads ranges of a numeric key in parallel; its bounds are one small query.
Filters and columns reach the database through Spark; order and limit do where the
dialect has them, so ``first`` asks for the best rows in the database itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators import keyed


def _quoted(name: str) -> str:
    if not name or not all(c.isalnum() or c == "_" for c in name):
        raise ValueError(f"not a plain name: {name!r}")
    return f'"{name}"'


def _literal(value: object) -> str:
    if value is None or isinstance(value, bool):
        raise ValueError("compare with IS NULL or a number instead")
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def scan(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table; by ranges of ``key``, a numeric column, in ``parts`` partitions where one is named (rows without a key are in the first)."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return reader.option("dbtable", _quoted(table)).load()
    bounds = reader.option("query", f"SELECT MIN({_quoted(key)}) AS lo, MAX({_quoted(key)}) AS hi FROM {_quoted(table)}").load().first()
    lo, hi = (0, 0) if bounds[0] is None else (int(bounds[0]), int(bounds[1]))
    ranged = {"partitionColumn": _quoted(key), "lowerBound": str(lo), "upperBound": str(max(hi, lo + 1)), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=_quoted(table), **ranged, **options).load()


def first(spark: SparkSession, url: str, table: str, equal: dict[str, object], order: list[tuple[str, bool]], limit: int = 1, **options: str) -> DataFrame:
    """The first rows where columns equal values, in an order of (column, descending), found by the database."""
    where = " AND ".join(f"{_quoted(c)} = {_literal(v)}" for c, v in equal.items()) or "1 = 1"
    by = ", ".join(_quoted(c) + (" DESC" if down else "") for c, down in order)
    sql = f"SELECT * FROM {_quoted(table)} WHERE {where} ORDER BY {by} FETCH FIRST {int(limit)} ROWS ONLY"
    return spark.read.format("jdbc").options(url=url, dbtable=f"({sql}) AS picked", **options).load()


def append_new(df: DataFrame, url: str, table: str, keys: list[str], values: list[str], **options: str) -> int:
    """Appends the rows of keys that the table lacks and says how many; a known key with other values fails before anything is written."""
    stored = scan(df.sparkSession, url, table, **options)
    if keyed.merge_state(stored, df, keys, values).filter("state = 'CONFLICT'").limit(1).count():
        raise ValueError(f"rows with known {keys} but other values")
    fresh = df.join(stored.select(*keys), keys, "left_anti").select(df.columns)
    n = fresh.count()
    if n:
        fresh.write.format("jdbc").options(url=url, dbtable=_quoted(table), **options).mode("append").save()
    return n


def create(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Writes a table that is not there yet."""
    df.select(*(F.col(c) for c in df.columns)).write.format("jdbc").options(url=url, dbtable=_quoted(table), **options).mode("errorifexists").save()
