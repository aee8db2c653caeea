"""Small helpers that several operators of this subpackage need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder, so lost executors lose no work.

    The folder is the cluster's spark.checkpoint.dir.  A local session without
    one gets a temporary folder; on a cluster, where that is not shared, it fails.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def keyed(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null as empty) and the columns, with k, z, th: a key without nulls that only rows of one id and one text share."""
    text = F.coalesce("text", F.lit(""))
    key = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("k"), F.isnull("doc_id").alias("z"), F.xxhash64(text).alias("th")]
    return docs.select("doc_id", text.alias("text"), *columns, *key)


def looked_up(rows: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the columns of their class (``key``, copies, ...).

    Classes of over a thousandth of all rows, of which there are less than a
    thousand, are broadcast, so no class is one task; the rest is a shuffle join.
    """
    classes = cut(classes)
    bound = F.lit(rows.count() / 1000)
    hot = classes.filter(F.col("copies") > bound)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(classes.filter(F.col("copies") <= bound), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
