"""Cold archive of raw JSON files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trackside.sources import files

# Many small files per record group keep listing cheap; each file stays one whole row.
_FOLDER = r"^(.*)/[^/]+$"
_NAME = r"([^/]+)$"
LARGEST_FILE = 1 << 30


def archive_json(spark: SparkSession, root: str, dst: str | None = None) -> DataFrame:
    """Pack every JSON file below ``root`` into compressed Parquet, then delete the originals.

    Files are read whole (``file``, ``content``) and kept under their folder relative to
    ``root``. A batch becomes part of the archive, and originals go, only after it holds as many files as were
    read. Files below the archive folder are skipped. A file is one value, so it must stay below
    ``LARGEST_FILE`` bytes: larger ones raise before anything is written. Returns (partition, files).
    """
    root = root.rstrip("/")
    dst = (dst or f"{root}/archive").rstrip("/")
    source = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .text(root, wholetext=True)
        # The path comes URL-encoded, except that a plus sign stands for itself.
        .select(
            "value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path")
        )
    )
    base = F.regexp_replace(F.lit(root), r"^[a-z0-9]+:/*", "/")
    below = F.regexp_replace(F.lit(dst), r"^[a-z0-9]+:/*", "/")
    source = source.where(~F.startswith(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), F.concat(below, F.lit("/"))))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    too_large = listed.load(root).where(F.col("length") > LARGEST_FILE).select("path").limit(1).collect()
    if too_large:
        raise ValueError(f"{too_large[0].path} is too large to be archived as one value")
    folder = F.regexp_replace(F.regexp_extract("path", _FOLDER, 1), r"^[a-z0-9]+:/*", "/")
    relative = F.ltrim(F.expr("substring(folder, length(base) + 1)"), F.lit("/"))
    packed = (
        source.withColumns({"folder": folder, "base": base})
        .withColumn("partition", F.when(relative == "", F.lit(".")).otherwise(relative))
        .select("partition", F.regexp_extract("path", _NAME, 1).alias("file"), F.col("value").alias("content"), "path")
    )
    # Names that begin with an underscore are invisible to readers of the archive.
    name = uuid.uuid4().hex
    aside, batch = f"{dst}/_unfinished-{name}", f"{dst}/batch={name}"
    read = Observation()
    packed.observe(read, F.count(F.lit(1)).alias("files")).write.option("compression", "gzip").parquet(aside)
    if spark.read.parquet(aside).count() != read.get["files"]:
        raise RuntimeError("archive is incomplete, originals kept")
    files.rename(spark, aside, batch)
    stored = spark.read.parquet(batch)
    report = stored.groupBy("partition").agg(F.count(F.lit(1)).alias("files"))
    files.delete_files(spark, (row.path for row in stored.select("path").toLocalIterator()))
    return report


def read_archive(spark: SparkSession, dst: str) -> DataFrame:
    return spark.read.parquet(dst)
