"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local master gets one of its own
    (as in tests); on a cluster it is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder's name under spark.checkpoint.dir."""
    return f"{scratch_dir(spark)}/quern-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet under spark.checkpoint.dir and reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{x}`").alias(x) for x in df.columns])


def word_count(text: Column) -> Column:
    """Words in a text (null: 0), without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def prefix_before(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` within `groups` in the order of (bucket, *order), as two levels.

    Each (groups, bucket) is summed and sorted for itself and only the bucket totals are summed up per group, so that
    no task sorts a whole group. The callers choose buckets whose order agrees with the wanted one.
    """
    keys = [*groups, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(totals, keys).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")
