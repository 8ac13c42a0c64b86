"""Writers of corpora and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, one object a row, in folders by `by`."""
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """Parquet, in folders by `by`, sorted inside each file by `order`."""
    out = df.sortWithinPartitions(*order) if order else df
    (out.write.mode("overwrite").partitionBy(*by) if by else out.write.mode("overwrite")).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def upserted(rows: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """rows in their order with updates of equal key in their place; an update of an unknown key fails the job."""
    values = [c for c in rows.columns if c not in (key, order)]
    new = updates.select(F.col(key).alias("_key"), F.struct(*values).alias("_new"))
    both = rows.join(new, rows[key] == new["_key"], "full")
    known = F.when(F.col(key).isNull(), F.raise_error(F.concat(F.lit("unknown key "), F.col("_key").cast("string")))).otherwise(F.col(key))
    return both.select(known.alias(key), F.col(order), *[F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in values]).select(*rows.columns)


def manifest(df: DataFrame, parts: int = 1) -> DataFrame:
    """name (the last `parts` parts of the path), sha256 of files read as binaryFile."""
    return df.select(F.substring_index("path", "/", -parts).alias("name"), F.sha2("content", 256).alias("sha256"))
