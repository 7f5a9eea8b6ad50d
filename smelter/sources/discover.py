"""Find source files below given paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension -> reader kind. The source formats that are accepted.
SUPPORTED = {
    "csv": "csv", "tsv": "tsv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "xml": "xml", "xlsx": "xlsx",
    "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "bmp": "image",
}


def reader_kind(path: str) -> str | None:
    """Which reader a path needs, by its extension; None if unsupported."""
    return SUPPORTED.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower())


def discover_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Supported files below the paths (folders are walked recursively), with size and modification time.

    Only the file listing is read: the content column is never selected. Spark leaves out empty files.
    """
    listings = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p)
                .select("path", "modificationTime", "length") for p in paths]
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (reduce(DataFrame.unionByName, listings)
            .withColumn("extension", extension)
            .where(F.col("extension").isin(*SUPPORTED))
            .select("path", "extension", F.col("modificationTime").alias("modified"), "length")
            .distinct())


def source_list(spark: SparkSession, paths: list[str]) -> list[tuple[str, object]]:
    """(path, modified) of every source, sorted by path. One entry per file, so metadata-sized."""
    rows = discover_sources(spark, paths).select("path", "modified").orderBy("path").toLocalIterator()
    return [(r["path"], r["modified"]) for r in rows]
