"""Ridge regression on gold: features, fit, evaluation, batch scoring.

The rows stay distributed: one aggregation yields the Gram matrix (features x features), which is all the
driver needs to solve for the weights.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import numeric_or_zero
from ..functions.names import col, quoted
from ..plans.contract import GoldContract
from ..session import durable, small_frame
from .wide_ridge import WIDE, WideModel, category_baselines, fit_wide_ridge, score_wide

BIAS = "_bias"
MAX_FEATURES = 2048  # the Gram matrix is solved on the driver; beyond that the weights are a table
_DENSE_LIMIT = 15
_POSITION_MASK = (1 << 33) - 1


class TooManyFeatures(ValueError):
    """More features than the driver solves for: :func:`~.wide_ridge.fit_wide_ridge` has no such limit."""


@dataclass(frozen=True)
class FeatureSchema:
    """Frozen feature order: bias, numbers, one indicator per category but the first (the baseline)."""

    target: str
    numeric: list[str]
    categorical: dict[str, list[str]]
    baseline: dict[str, str | None]

    @property
    def feature_names(self) -> list[str]:
        return [BIAS, *self.numeric, *[f"{c}={v}" for c, vs in self.categorical.items() for v in vs]]

    def input_spec(self) -> dict:
        return {"numeric": list(self.numeric),
                "categorical": {c: ([self.baseline[c]] if self.baseline.get(c) is not None else []) + list(vs)
                                for c, vs in self.categorical.items()}}


@dataclass(frozen=True)
class LinearModel:
    schema: FeatureSchema
    weights: list[float]
    lam: float
    trained_on: str = ""
    version: str = "v1"

    @property
    def target(self) -> str:
        return self.schema.target

    @property
    def hash(self) -> str:
        return "sha256:" + hashlib.sha256(json.dumps(self.weights).encode()).hexdigest()[:16]

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.schema.feature_names, self.weights))

    def to_json(self) -> str:
        return json.dumps({"kind": "ridge_ols", **asdict(self), "hash": self.hash})

    @classmethod
    def from_json(cls, text: str) -> "LinearModel":
        body = json.loads(text)
        return cls(FeatureSchema(**body["schema"]), body["weights"], body["lam"], body["trained_on"], body["version"])


# --- split -------------------------------------------------------------------

def with_row_index(df: DataFrame, order: Sequence[str], index: str = "_index") -> tuple[DataFrame, int]:
    """Number all rows 0..n-1 in the given order without a single-task sort; returns the rows and n.

    Rows are range-partitioned on all order columns (a heavy leading value is split by the others, and equal
    order values by a hash of the row), numbered within their partition, and shifted by the sizes of the
    partitions before. The partitioning is stored once, so a lost task cannot change it between the two uses.
    """
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    ordering = [*[col(c).asc_nulls_first() for c in order], F.xxhash64(*[col(c) for c in hashable]).asc()]
    ranged = (df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))))
    stored = durable(ranged)
    offsets, total = [], 0
    for row in stored.groupBy("_part").count().orderBy("_part").collect():  # one row per partition
        offsets.append((row["_part"], total))
        total += row["count"]
    starts = small_frame(df.sparkSession, offsets, "_part int, _start long")
    indexed = stored.join(starts, "_part").withColumn(index, F.col("_start") + F.col("_pos"))
    return indexed.drop("_part", "_pos", "_start"), total


def holdout(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """Add ``is_train`` and ``is_test``: every ``k``-th row in the given order is held out. If that leaves
    either side empty, all rows serve both."""
    indexed, total = with_row_index(df, order)
    if total <= 1 or k <= 1:
        return indexed.drop("_index").withColumn("is_train", F.lit(True)).withColumn("is_test", F.lit(True))
    test = F.col("_index") % k == 0
    return indexed.withColumn("is_test", test).withColumn("is_train", ~test).drop("_index")


# --- features ----------------------------------------------------------------

def category_vocabulary(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(column, value, is_baseline): the distinct categories; the first in sort order is the baseline, unless it
    is the only one."""
    cells = df.select(*[col(c).cast("string").alias(c) for c in categorical]).unpivot(
        [], [quoted(c) for c in categorical], "column", "value")
    values = cells.where(F.col("value").isNotNull()).distinct()
    bounds = values.groupBy("column").agg(F.min("value").alias("lowest"), F.count(F.lit(1)).alias("n"))
    # One row per categorical column, so broadcasting it is safe however many values there are.
    return values.join(F.broadcast(bounds), "column").select(
        "column", "value", ((F.col("value") == F.col("lowest")) & (F.col("n") > 1)).alias("is_baseline"))


def build_schema(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str) -> FeatureSchema:
    """Freeze the feature order. Raises when there are more features than the driver can solve for."""
    categories: dict[str, list[str]] = {c: [] for c in categorical}
    baseline: dict[str, str | None] = {c: None for c in categorical}
    if categorical:
        vocabulary = category_vocabulary(df, categorical)
        rows = vocabulary.limit(MAX_FEATURES + len(categorical) + 1).collect()
        if len(rows) > MAX_FEATURES + len(categorical):
            raise TooManyFeatures(f"more than {MAX_FEATURES} categories")
        for r in sorted(rows, key=lambda r: (r["column"], r["value"])):
            if r["is_baseline"]:
                baseline[r["column"]] = r["value"]
            else:
                categories[r["column"]].append(r["value"])
    schema = FeatureSchema(target, list(numeric), categories, baseline)
    if len(schema.feature_names) > MAX_FEATURES:
        raise TooManyFeatures(f"more than {MAX_FEATURES} features")
    return schema


def _feature_columns(schema: FeatureSchema) -> list[Column]:
    indicators = [F.when(col(c).cast("string") == v, 1.0).otherwise(0.0)
                  for c, vs in schema.categorical.items() for v in vs]
    return [F.lit(1.0), *[numeric_or_zero(n) for n in schema.numeric], *indicators]


def build_features(df: DataFrame, schema: FeatureSchema, keep: Sequence[str] = ()) -> DataFrame:
    """The feature matrix, one column per feature in frozen order, after the ``keep`` columns."""
    return df.select(*[col(k) for k in keep],
                     *[c.alias(n) for n, c in zip(schema.feature_names, _feature_columns(schema))])


def _sparse_row(schema: FeatureSchema) -> Column:
    """Non-zero entries (index, value) of a row; the target follows the last feature."""
    entries = [F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("v"))]
    entries += [F.struct(F.lit(i).alias("i"), numeric_or_zero(n).alias("v"))
                for i, n in enumerate(schema.numeric, start=1)]
    at = 1 + len(schema.numeric)
    for c, vs in schema.categorical.items():
        if vs:
            places = F.create_map(*[F.lit(x) for i, v in enumerate(vs) for x in (v, at + i)])
            entries.append(F.struct(F.try_element_at(places, col(c).cast("string")).alias("i"), F.lit(1.0).alias("v")))
        at += len(vs)
    entries.append(F.struct(F.lit(at).alias("i"), numeric_or_zero(schema.target).alias("v")))
    return F.filter(F.array(*entries), lambda e: e["i"].isNotNull() & (e["v"] != 0))


def gram_cells(df: DataFrame, schema: FeatureSchema) -> DataFrame:
    """(i, j, value) with i <= j: sums of products of features, the target counting as the last feature.

    Few features: one global aggregate. Many: only the non-zero entries of a row are paired, so the work per
    row depends on the number of columns and not on the number of categories; cells combine map-side.
    """
    size = len(schema.feature_names) + 1
    if size <= _DENSE_LIMIT:
        x = [*_feature_columns(schema), numeric_or_zero(schema.target)]
        row = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)])
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        sums = row.agg(*[F.coalesce(F.sum(F.col(f"x{i}") * F.col(f"x{j}")), F.lit(0.0)).alias(f"{i}_{j}")
                         for i, j in pairs])
        cells = sums.unpivot([], [f"{i}_{j}" for i, j in pairs], "cell", "value")
        place = F.split("cell", "_")
        return cells.select(place[0].cast("int").alias("i"), place[1].cast("int").alias("j"), "value")
    entries = F.col("e")
    pairs = F.flatten(F.transform(entries, lambda a: F.transform(
        F.filter(entries, lambda b: b["i"] >= a["i"]),
        lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["v"]).alias("product")))))
    found = (df.select(_sparse_row(schema).alias("e")).select(F.inline(pairs))
             .groupBy("i", "j").agg(F.sum("product").alias("value")))
    # Every cell is a row, also those that no row of the data has a part in.
    every = (df.sparkSession.range(size).select(F.col("id").cast("int").alias("i"))
             .select("i", F.explode(F.sequence(F.col("i"), F.lit(size - 1))).alias("j")))
    return every.join(found, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))


def fit_ridge(df: DataFrame, schema: FeatureSchema, lam: float = 1.0, trained_on: str = "") -> LinearModel:
    """Minimize squared error plus ``lam`` times the squared weights; the bias is not penalized."""
    size = len(schema.feature_names)
    gram = np.zeros((size + 1, size + 1))
    for r in gram_cells(df, schema).collect():  # features x features, bounded by MAX_FEATURES
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["value"]
    penalty = np.full(size, float(lam))
    penalty[0] = 0.0
    left, right = gram[:size, :size] + np.diag(penalty), gram[:size, size]
    try:
        weights = np.linalg.solve(left, right)
    except np.linalg.LinAlgError:
        weights = np.linalg.lstsq(left, right, rcond=None)[0]
    return LinearModel(schema, [float(w) for w in weights], float(lam), trained_on)


# --- use ---------------------------------------------------------------------

def score(df: DataFrame, model: LinearModel, output: str = "prediction") -> DataFrame:
    """Add predictions. Unseen categories count as the baseline, missing numbers as 0. Works on streams too."""
    weights = iter(model.weights)
    total = F.lit(next(weights))
    for n in model.schema.numeric:
        total = total + F.lit(next(weights)) * numeric_or_zero(n)
    for c, vs in model.schema.categorical.items():
        if vs:
            table = F.create_map(*[F.lit(x) for v in vs for x in (v, next(weights))])
            total = total + F.coalesce(F.try_element_at(table, col(c).cast("string")), F.lit(0.0))
    return df.withColumn(output, total)


def regression_metrics(df: DataFrame, actual: str, predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """n, r2, rmse, mae (4 places). Without variance r2 is 1 for a perfect fit and 0 otherwise."""
    y, p = numeric_or_zero(actual), col(predicted)
    sums = df.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((y - p) * (y - p)), F.lit(0.0)).alias("res"),
        F.coalesce(F.sum(F.abs(y - p)), F.lit(0.0)).alias("dev"), (F.var_pop(y) * F.count(F.lit(1))).alias("tot"))
    r2 = (F.when(F.col("n") == 0, None).when(F.col("tot") > 1e-12, 1 - F.col("res") / F.col("tot"))
          .when(F.col("res") < 1e-9, 1.0).otherwise(0.0))
    return sums.select(*[col(b) for b in by], "n", F.round(r2, 4).alias("r2"),
                       F.round(F.sqrt(F.try_divide("res", "n")), 4).alias("rmse"),
                       F.round(F.try_divide("dev", "n"), 4).alias("mae"))


def evaluate(split: DataFrame, model: LinearModel | WideModel) -> DataFrame:
    """Metrics on the training and the held-out rows of :func:`holdout`, in one pass."""
    sides = F.array_compact(F.array(F.when(F.col("is_train"), F.lit("train")), F.when(F.col("is_test"), F.lit("test"))))
    predict = score_wide if isinstance(model, WideModel) else score
    scored = predict(split, model).withColumn("split", F.explode(sides))
    return regression_metrics(scored, model.target, by=["split"])


def input_violations(df: DataFrame, schema: FeatureSchema, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, problem, value): rows whose inputs scoring would silently replace."""
    problems = []
    for n in schema.numeric:
        value = col(n).cast("string")
        problems.append(F.when(col(n).try_cast("double").isNull(),
                               F.struct(F.lit(n).alias("feature"), F.lit("missing number").alias("problem"),
                                        value.alias("value"))))
    for c, allowed in schema.input_spec()["categorical"].items():
        value = col(c).cast("string")
        known = F.coalesce(value.isin(*allowed), F.lit(False)) if allowed else F.lit(False)
        problems.append(F.when(~known, F.struct(F.lit(c).alias("feature"), F.lit("unknown category").alias("problem"),
                                                value.alias("value"))))
    return df.select(*[col(k) for k in keep], F.inline(F.array_compact(F.array(*problems))))


def train(fact: DataFrame, contract: GoldContract, target: str | None = None, lam: float = 1.0,
          k: int = 5) -> tuple[LinearModel | WideModel, DataFrame]:
    """Fit on a gold fact: predict ``target`` (default: the last measure) from the other measures and the
    dimensions. Returns the model and its train and test metrics. With more features than ``MAX_FEATURES`` the model is a
    :class:`~.wide_ridge.WideModel`, solved by conjugate gradients."""
    if not contract.measures:
        raise ValueError(f"{contract.table} has no measure to predict")
    goal = target if target in contract.measures else contract.measures[-1]
    numeric = [m for m in contract.measures if m != goal]
    split = holdout(fact, [contract.grain, *contract.dims], k)
    source, training = f"gold.{contract.table}", split.where("is_train")
    try:
        model = fit_ridge(training, build_schema(split, numeric, contract.dims, goal), lam, source)
    except TooManyFeatures:
        model = fit_wide_ridge(training, numeric, contract.dims, goal, lam, trained_on=source,
                               baseline=category_baselines(split, contract.dims))
    return model, evaluate(split, model)


__all__ = ["BIAS", "FeatureSchema", "LinearModel", "MAX_FEATURES", "TooManyFeatures", "build_features", "build_schema",
           "category_vocabulary", "evaluate", "fit_ridge", "gram_cells", "holdout", "input_violations",
           "regression_metrics", "score", "train", "with_row_index"]
