"""Authored metric definitions: one JSON or YAML file each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.metric import Metric, metrics_frame


def load_metrics(spark: SparkSession, folder: str) -> list[Metric]:
    """Definitions of a folder: the JSON files in name order, then the YAML files."""
    files = (spark.read.option("recursiveFileLookup", False).text(folder, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), "value")
             .where(F.lower("path").rlike(r"\.(json|ya?ml)$"))
             .orderBy(~F.lower("path").endswith(".json"), "path").toLocalIterator())
    metrics = []
    for row in files:
        if row["path"].lower().endswith(".json"):
            body = json.loads(row["value"])
        else:
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("YAML metric definitions need PyYAML") from error
            body = yaml.safe_load(row["value"])
        metrics.append(Metric.from_dict(body))
    return metrics


def override_proposed(proposed: DataFrame, authored: DataFrame) -> DataFrame:
    """Metric tables: an authored definition replaces the proposed one of the same id."""
    return proposed.join(authored.select("metric"), "metric", "left_anti").unionByName(authored)


__all__ = ["load_metrics", "metrics_frame", "override_proposed"]
