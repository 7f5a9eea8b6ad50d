"""Governance as tables: lineage, personal data, contracts and quality, and the verdict over them.

Audit tables hold a few rows per table, column, metric or panel of a run, each with the stage that wrote them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small_frame

AUDIT_SCHEMAS = {
    "lineage": "stage string, stage_no int, output string, sources array<string>, logic string",
    "pii": "stage string, stage_no int, column string, class string, action string",
    "contract": "stage string, stage_no int, name string, honored boolean, violations array<string>",
    "quality": "stage string, stage_no int, check string, result string, detail string",
    "dropped": "stage string, stage_no int, table string, column string",
}
RESULTS = ("pass", "warn", "fail")


def audit_frame(spark: SparkSession, kind: str, rows: Sequence[tuple] = ()) -> DataFrame:
    return small_frame(spark, list(rows), AUDIT_SCHEMAS[kind])


def inherit(*stages: DataFrame) -> DataFrame:
    """Rows of all upstream stages together: a stage extends what it was given."""
    return reduce(DataFrame.unionByName, stages)


def lineage_outputs(lineage: DataFrame) -> DataFrame:
    return lineage.select("output").distinct()


def lineage_roots(lineage: DataFrame) -> DataFrame:
    """Sources that nothing in the lineage produces."""
    sources = lineage.select(F.explode("sources").alias("root")).distinct()
    return sources.join(lineage_outputs(lineage).withColumnRenamed("output", "root"), "root", "left_anti")


def pii_disposition(pii: DataFrame, dropped: DataFrame) -> DataFrame:
    """What became of each personal-data column: dropped on the way to gold, masked, or carried on."""
    gone = dropped.select(F.concat_ws(".", "table", "column").alias("column"), F.lit(True).alias("_gone")).distinct()
    return (pii.join(gone, "column", "left")
            .withColumn("disposition", F.when(F.col("_gone"), "dropped in gold")
                        .when(F.col("action") == "masked", "masked").otherwise("flagged, carried forward"))
            .drop("_gone"))


def pii_register(pii: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row per personal-data column: class, the stage that first flagged it, disposition."""
    first = W.partitionBy("column").orderBy("stage_no", "class")
    once = pii.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank")
    return pii_disposition(once, dropped).select("column", "class", F.col("stage").alias("first_stage"), "disposition")


def contract_rows(quality: DataFrame, name: str, stage: str | None = None) -> DataFrame:
    """The contract of each stage: honored unless one of its checks failed."""
    rows = quality if stage is None else quality.where(F.col("stage") == stage)
    failed = F.array_sort(F.collect_list(F.when(F.col("result") == "fail", F.col("check"))))
    return (rows.groupBy("stage", "stage_no").agg(failed.alias("violations"))
            .select("stage", "stage_no", F.concat(F.lit(f"{name}."), "stage", F.lit("@1")).alias("name"),
                    (F.size("violations") == 0).alias("honored"), "violations"))


def quality_scoreboard(quality: DataFrame) -> DataFrame:
    """Checks passed, warned and failed per stage, and in total (stage ``total``)."""
    counts = [F.count_if(F.col("result") == r).cast("long").alias(r) for r in RESULTS]
    return (quality.rollup("stage").agg(F.grouping("stage").alias("_all"), *counts)
            .select(F.when(F.col("_all") == 1, "total").otherwise(F.col("stage")).alias("stage"), *RESULTS))


def conformance_summary(conformance: DataFrame) -> DataFrame:
    """How many metrics there are, how many conform, and which must not be summed up."""
    return conformance.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "pass").cast("long").alias("passed"),
        F.array_sort(F.collect_list(F.when(~F.col("guard_ok"), F.col("metric")))).alias("guarded"))


def governance_verdict(contracts: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: are all contracts honored, how many checks failed, is the run governed, and what is wrong?"""
    no_text = F.lit(None).cast("string")
    broken = F.when(~F.col("honored"), F.concat(F.lit("contract "), "name", F.lit(" violated: "),
                                                F.array_join("violations", ", ")))
    facts = (contracts.select("honored", F.lit(0).alias("failed"), broken.alias("issue"))
             .unionByName(quality.select(F.lit(True).alias("honored"),
                                         F.when(F.col("result") == "fail", 1).otherwise(0).alias("failed"),
                                         no_text.alias("issue"))))
    summary = facts.agg(F.coalesce(F.bool_and("honored"), F.lit(True)).alias("all_honored"),
                        F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("failed_checks"),
                        F.array_sort(F.collect_list("issue")).alias("broken"))
    failed = F.when(F.col("failed_checks") > 0,
                    F.array(F.concat(F.col("failed_checks").cast("string"), F.lit(" quality check(s) failed"))))
    return summary.select("all_honored", "failed_checks",
                          (F.col("all_honored") & (F.col("failed_checks") == 0)).alias("governed"),
                          F.concat("broken", F.coalesce(failed, F.array().cast("array<string>"))).alias("issues"))


def report_rows(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lineage (metric to report) and quality (was it answered?) of the receipts of a list of questions."""
    number = F.col("question_no").cast("string")
    lineage = receipts.where("answered").select(
        F.concat(F.lit("report.q"), number).alias("output"), F.array(F.concat(F.lit("metric."), "metric")).alias("sources"),
        F.concat("aggregation", F.lit(" over gold; "), "note").alias("logic"))
    quality = receipts.select(
        F.concat(F.lit("Q"), number, F.lit(" answered")).alias("check"),
        F.when(F.col("answered"), "pass").otherwise("warn").alias("result"),
        F.coalesce("metric", F.lit("no metric matches")).alias("detail"))
    return lineage, quality


def model_rows(evaluation: DataFrame, target: str, trained_on: str) -> tuple[DataFrame, DataFrame]:
    """Lineage (gold to model) and quality of a fitted model: a warning when held-out R2 is negative or undefined."""
    test = evaluation.where("split = 'test'")
    lineage = test.select(F.lit(f"model.{target}").alias("output"), F.array(F.lit(trained_on)).alias("sources"),
                          F.lit(f"ridge regression of {target}").alias("logic"))
    quality = test.select(F.lit(f"model predicts {target}").alias("check"),
                          F.when(F.col("r2") >= 0, "pass").otherwise("warn").alias("result"),
                          F.concat_ws(" ", F.lit("test R2"), F.col("r2").cast("string"), F.lit("RMSE"),
                                      F.col("rmse").cast("string")).alias("detail"))
    return lineage, quality


def access_policy(spark: SparkSession, roles: Mapping[str, Mapping], restricted: Sequence[str]) -> DataFrame:
    return small_frame(spark, [(role, str(spec["metrics"]), "*" if spec["dims"] == "*" else ",".join(spec["dims"]), list(spec["panels"]),
          list(restricted) if spec["metrics"] == "public" else []) for role, spec in roles.items()],
        "role string, metrics string, dims string, panels array<string>, hidden_owners array<string>")


def governance_report(audit: Mapping[str, DataFrame], conformance: DataFrame | None = None,
                      policy: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything the audit tables say, as named tables."""
    lineage, pii, contract, quality = audit["lineage"], audit["pii"], audit["contract"], audit["quality"]
    report = {
        "edges": lineage,
        "edge_count": lineage.agg(F.count(F.lit(1)).alias("edges")),
        "outputs": lineage_outputs(lineage),
        "roots": lineage_roots(lineage),
        "pii": pii_register(pii, audit["dropped"]),
        "contracts": contract,
        "scoreboard": quality_scoreboard(quality),
        "reconciliation": quality.where(F.col("check").contains(" reconciles ")),
        "verdict": governance_verdict(contract, quality),
    }
    if conformance is not None:
        report["conformance"] = conformance_summary(conformance)
    if policy is not None:
        report["access_policy"] = policy
    return report
