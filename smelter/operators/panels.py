"""KPI and breakdown panels, and who may see them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import col, quoted
from ..plans.metric import Metric, metric_column
from ..sources.landing import land_table
from ..session import small_frame

# The access model. "*" is everything, "public" all but restricted owners.
DEFAULT_ROLES = {
    "admin": {"metrics": "*", "dims": "*", "panels": ["kpi", "breakdown"]},
    "analyst": {"metrics": "*", "dims": "*", "panels": ["kpi", "breakdown"]},
    "leadership": {"metrics": "*", "dims": [], "panels": ["kpi"]},
    "viewer": {"metrics": "public", "dims": [], "panels": ["kpi"]},
}
RESTRICTED_OWNERS = ("finance-cdm", "payments-cdm")


def kpi_panels(fact: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """(metric, value): all metrics of one fact in a single pass."""
    totals = fact.agg(*[metric_column(m).cast("double").alias(m.metric) for m in metrics])
    return totals.unpivot([], [quoted(m.metric) for m in metrics], "metric", "value")


def breakdown_panels(fact: DataFrame, metrics: Sequence[Metric], dim: str, top: int = 10) -> DataFrame:
    """(metric, dim, dim_value, rank, value): the highest values of every metric of one fact, in one grouping."""
    grouped = (fact.groupBy(col(dim).cast("string").alias("dim_value"))
               .agg(*[metric_column(m).cast("double").alias(m.metric) for m in metrics]))
    cells = grouped.unpivot(["dim_value"], [quoted(m.metric) for m in metrics], "metric", "value")
    ranking = W.partitionBy("metric").orderBy(F.desc("value"), F.asc("dim_value"))
    return (cells.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top)
            .select("metric", F.lit(dim).alias("dim"), "dim_value", "rank", "value"))


def visible_to(panels: DataFrame, roles: Mapping[str, Mapping] = DEFAULT_ROLES,
               restricted: Sequence[str] = RESTRICTED_OWNERS) -> DataFrame:
    """Add ``visible_to``: the roles that may read a panel, from its kind, dimension and metric owner.

    The role table is fixed and small, so each role is one condition per row instead of a join.
    """
    owner = F.coalesce("owner", F.lit(""))

    def allowed(spec: Mapping) -> Column:
        ok = F.col("kind").isin(*spec["panels"]) if spec["panels"] else F.lit(False)
        if spec["metrics"] == "public":
            ok = ok & ~owner.isin(*restricted)
        if spec["dims"] != "*":
            own = F.coalesce(F.col("dim").isin(*spec["dims"]), F.lit(False)) if spec["dims"] else F.lit(False)
            ok = ok & ((F.col("kind") != "breakdown") | own)
        return ok

    return panels.withColumn("visible_to", F.array_compact(F.array(
        *[F.when(allowed(spec), F.lit(role)) for role, spec in roles.items()])))


def panels_for_role(panels: DataFrame, role: str) -> DataFrame:
    return panels.where(F.array_contains("visible_to", role))


def panel_catalog(spark: SparkSession, metrics: Sequence[Metric], dims_by_fact: Mapping[str, Sequence[str]]) -> DataFrame:
    """(panel_id, kind, metric, title, dim, unit, owner): a KPI per metric, and a breakdown by its fact's first
    dimension, numbered in metric order."""
    rows = []
    for m in sorted(metrics, key=lambda x: x.metric):
        if not m.fact:
            continue
        title = m.label or m.metric
        rows.append((f"p{len(rows) + 1}", "kpi", m.metric, title, None, m.unit, m.owner))
        dims = dims_by_fact.get(m.fact, [])
        if dims:
            rows.append((f"p{len(rows) + 1}", "breakdown", m.metric, f"{title} by {dims[0]}", dims[0], m.unit, m.owner))
    return small_frame(spark, rows, "panel_id string, kind string, metric string, title string, dim string, unit string, owner string")


def refresh_panels(spark: SparkSession, facts: Mapping[str, tuple[DataFrame, Sequence[str]]],
                   metrics: Sequence[Metric], path: str | None = None, cadence: str = "daily",
                   roles: Mapping[str, Mapping] = DEFAULT_ROLES, now: datetime | None = None,
                   restricted: Sequence[str] = RESTRICTED_OWNERS) -> DataFrame:
    """Recompute every panel from current gold, in long form (one row per KPI, one per breakdown value), stamped
    with cadence and time. With a path the stored panels are overwritten. Running it again is the refresh."""
    stamp = now or datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
    data = None
    for name, (fact, dims) in facts.items():
        own = [m for m in metrics if m.fact == name]
        if not own:
            continue
        parts = [kpi_panels(fact, own).select(F.lit("kpi").alias("kind"), "metric", F.lit(None).cast("string")
                                              .alias("dim_value"), F.lit(1).alias("rank"), "value")]
        if dims:
            parts.append(breakdown_panels(fact, own, dims[0])
                         .select(F.lit("breakdown").alias("kind"), "metric", "dim_value", "rank", "value"))
        for part in parts:
            data = part if data is None else data.unionByName(part)
    catalog = visible_to(panel_catalog(spark, metrics, {n: d for n, (_, d) in facts.items()}), roles, restricted)
    panels = (catalog.join(data, ["kind", "metric"])
              .withColumn("cadence", F.lit(cadence)).withColumn("refreshed_at", F.lit(stamp)))
    return land_table(panels, path) if path else panels


def mask_pii(df: DataFrame, disposition: Mapping[str, str], salt: str = "") -> DataFrame:
    """Apply the disposition of personal-data columns: ``dropped`` removes a column, ``masked`` replaces its
    values by a digest (equal values stay equal), ``flagged`` keeps it."""
    dropped = [c for c, action in disposition.items() if action == "dropped"]
    masked = [c for c, action in disposition.items() if action == "masked"]
    unknown = set(disposition.values()) - {"dropped", "masked", "flagged"}
    if unknown:
        raise ValueError(f"unknown disposition: {', '.join(sorted(unknown))}")
    rest = df.drop(*dropped)
    return rest.select(*[F.sha2(F.concat(F.lit(salt), col(c).cast("string")), 256).alias(c) if c in masked else col(c)
                         for c in rest.columns])
