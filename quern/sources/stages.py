"""Stages that run again only if what they read has changed, and grids of result files that an index names."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "stage string, checksum string, digest string, path string, at timestamp"


class Stage(NamedTuple):
    """A stage's stored output, what its content sums up to, and whether it ran now."""

    df: DataFrame
    digest: str
    ran: bool


def digest(df: DataFrame) -> str:
    """A checksum of a table's rows, in whatever order they lie, and of its columns."""
    row = F.to_json(F.struct(*[F.col(f"`{x}`") for x in df.columns]), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(row, F.lit(i)).cast("decimal(38,0)")) for i in (1, 2)]
    return hashlib.sha256(f"{df.schema.simpleString()}|{df.agg(F.count('*'), *sums).collect()[0]}".encode()).hexdigest()


def records(spark: SparkSession, folder: str) -> DataFrame | None:
    """What has run, a row (RECORD) per run that came to its end."""
    try:
        return spark.read.schema(RECORD).parquet(f"{folder}/records")
    except AnalysisException:
        return None


def staged(spark: SparkSession, folder: str, name: str, inputs: dict[str, DataFrame | Stage], build: Callable[..., DataFrame], version: str = "1") -> Stage:
    """The output of stage `name`: stored, if it has run before on inputs of the same content, else build(**inputs), stored now.

    `version` is the code's: another one makes the stage run again. Inputs that are stages pass on their stored outputs and
    the digests of these, so a stage whose predecessor ran again without another result does not. Outputs go to folders of
    their own and are recorded when they are whole: what a lost run left is never read, and its stage runs again.
    """
    known = {k: x.digest if isinstance(x, Stage) else digest(x) for k, x in sorted(inputs.items())}
    checksum = hashlib.sha256(f"{name}|{version}|{known}".encode()).hexdigest()
    before = records(spark, folder)
    found = [] if before is None else before.where((F.col("stage") == name) & (F.col("checksum") == checksum)).orderBy(F.desc("at")).select("path", "digest").take(1)
    if found:
        return Stage(spark.read.parquet(found[0][0]), found[0][1], False)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    build(**{k: x.df if isinstance(x, Stage) else x for k, x in inputs.items()}).write.parquet(path)
    made = spark.read.parquet(path)
    mark = digest(made)
    spark.createDataFrame([(name, checksum, mark, path)], "stage string, checksum string, digest string, path string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/records")
    return Stage(made, mark, True)


def _uri(path: Column) -> Column:
    """A file's URI with as few slashes as a listing gives it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def listed_files(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """index's rows (json_path: a file or folder under root, and more) with `file`, the URI of each file found there. A listing
    of root finds them; rows whose path is null, `none` or missing have none and are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select(_uri(F.col("path")).alias("file"))
    inside = F.substring_index("file", root.strip("/").split(":", 1)[-1].lstrip("/") + "/", -1)
    files = files.withColumn("json_path", F.explode(F.array(inside, F.regexp_replace(inside, "/[^/]*$", ""))))
    wanted = index.where("json_path IS NOT NULL AND lower(json_path) <> 'none'").withColumn("json_path", F.regexp_replace("json_path", "/+$", ""))
    return wanted.join(files, "json_path")


def finished(spark: SparkSession, progress: str, judge: str) -> DataFrame:
    """cell (the folder's URI), done of every progress.json that the glob `progress` finds: done if judge's status there is
    `done` or missing. A file that is no JSON stops nothing; cells without one are not named."""
    found = spark.read.text(progress, wholetext=True).select(F.regexp_replace(_uri(F.col("_metadata.file_path")), "/[^/]*$", "").alias("cell"), F.try_parse_json("value").alias("v"))
    status = F.expr(f"try_variant_get(v, '$.judges.{judge}.status', 'string')")
    return found.select("cell", (status.isNull() | (status == "done")).alias("done"))


def cell_files(spark: SparkSession, root: str, index: DataFrame, kinds: list[str], judge: str | None = None, progress: str | None = None) -> DataFrame:
    """index's rows of the given kinds (kind, json_path and more) with `file`, where a file is there. With progress (a glob of
    progress.json files) those in or below a cell whose judge is not done are left out."""
    rows = listed_files(spark, root, index.where(F.col("kind").isin(kinds)))
    if progress is None:
        return rows
    undone = finished(spark, progress, judge or "").where("NOT done").select("cell")
    above = F.expr("transform(sequence(1, size(split(file, '/'))), n -> substring_index(file, '/', n))")
    stopped = rows.select("file", F.explode(above).alias("cell")).join(undone, "cell", "left_semi").select("file")
    return rows.join(stopped, "file", "left_anti")


def indexed_cells(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """cell_files() with question_id, correct of every detail in the files. Only these files are opened; their list, as long as
    the index, passes the driver, as the paths of a read do. No files, no rows."""
    shape = "details array<struct<question_id: string, correct: string>>"
    paths = [r[0] for r in rows.select("file").distinct().collect()]
    if paths:
        found = spark.read.schema(shape).option("multiLine", True).json(paths).select(_uri(F.col("_metadata.file_path")).alias("file"), F.explode("details").alias("d"))
    else:
        found = spark.createDataFrame([], "file string, d struct<question_id: string, correct: string>")
    return rows.join(found, "file").select(*[x for x in rows.columns if x != "file"], "d.question_id", F.lower("d.correct").isin("true", "1").alias("correct"))
