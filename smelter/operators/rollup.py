"""Rolling a daily fact up to coarser grains, under the guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..plans.metric import GRAINS, SKETCH_SUFFIX, TRUNC_UNIT, GuardError, Metric, metric_column


def _period(day: str, grain: str):
    if grain not in GRAINS:
        raise GuardError(f"unknown grain {grain!r}; known: {', '.join(GRAINS)}")
    return F.date_trunc(TRUNC_UNIT[grain], col(day)).cast("date").alias("period")


def rollup_metric(fact: DataFrame, metric: Metric, grain: str, day: str, dims: Sequence[str] = (),
                  sketch: str = "hll") -> DataFrame:
    """A metric per period and dimension values.

    Sums are summed, minima and maxima taken again, ratios, averages and derived metrics recomputed from
    their components. A distinct count is recomputed if the fact keeps the counted column, merged from
    sketches if it keeps those (``sketch`` says of which kind), and refused otherwise.
    """
    groups = [_period(day, grain), *[col(d) for d in dims]]
    if metric.aggregation == "count_distinct" and metric.measure not in fact.columns:
        stored = f"{metric.measure}{SKETCH_SUFFIX}"
        if stored not in fact.columns:
            raise GuardError(f"{metric.metric}: distinct counts cannot be summed to {grain}; "
                             f"build the fact with a sketch of {metric.measure}")
        return distinct_rollup(fact, stored, metric.metric, groups, sketch)
    return fact.groupBy(*groups).agg(metric_column(metric))


def distinct_rollup(fact: DataFrame, sketch_col: str, name: str, groups: Sequence, sketch: str = "hll") -> DataFrame:
    """Merge sketches and read off the estimate."""
    if sketch == "hll":
        merged = F.hll_sketch_estimate(F.hll_union_agg(col(sketch_col)))
    else:
        merged = F.theta_sketch_estimate(F.theta_union_agg(col(sketch_col)))
    return fact.groupBy(*groups).agg(merged.alias(name))
