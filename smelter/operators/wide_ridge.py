"""Ridge regression with any number of categories: the weights are a table, found by conjugate gradients.

:mod:`.learn` solves features x features on the driver and refuses beyond its limit. Here nothing that grows with the
number of categories reaches the driver: the normal equations are a table of non-zero cells, a step of the solver is one
equi-join and one aggregate over it, and only the step's scalars are read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import numeric_or_zero
from ..functions.names import col
from ..session import durable, small_frame

BIAS_AT, NUMERIC_AT, TARGET_AT = -2, -1, -3  # groups of features; a categorical column's group is its position
ROUNDS = 500
WIDE = "ridge_wide"


@dataclass(frozen=True)
class WideModel:
    """``weights`` is (feature_group int, feature string, weight double): group -2 is the bias, -1 the numbers, and n the
    n-th categorical column, whose ``feature`` is the category. ``baseline`` holds the category without a weight."""

    target: str
    numeric: list[str]
    categorical: list[str]
    baseline: dict[str, str | None]
    weights: DataFrame
    lam: float
    rounds: int
    trained_on: str = ""

    def coefficients(self) -> DataFrame:
        """(feature, weight) under the names of the narrow model: ``_bias``, the number's name, ``column=category``."""
        name = F.col("feature")
        for at, c in enumerate(self.categorical):
            name = F.when(F.col("feature_group") == at, F.concat(F.lit(f"{c}="), "feature")).otherwise(name)
        return self.weights.select(name.alias("feature"), "weight")

    @property
    def hash(self) -> str:
        """A digest of all weights, whatever their order."""
        digest = self.weights.agg(F.bit_xor(F.xxhash64("feature_group", "feature", "weight"))).first()[0] or 0
        return f"xxh64:{digest & (1 << 64) - 1:016x}"

    def to_json(self) -> str:
        """All but the weights, which are a table."""
        return json.dumps({"kind": WIDE, "target": self.target, "numeric": self.numeric, "categorical": self.categorical,
                           "baseline": self.baseline, "lam": self.lam, "rounds": self.rounds, "trained_on": self.trained_on})

    @classmethod
    def from_json(cls, text: str, weights: DataFrame) -> "WideModel":
        body = json.loads(text)
        body.pop("kind")
        return cls(weights=weights, **body)


def category_baselines(df: DataFrame, categorical: Sequence[str]) -> dict[str, str | None]:
    """The first category of each column in sort order, or None where there is only one; one aggregate, no distinct."""
    if not categorical:
        return {}
    bounds = df.agg(*[F.struct(F.min(col(c).cast("string")).alias("low"), F.max(col(c).cast("string")).alias("high"))
                      .alias(str(at)) for at, c in enumerate(categorical)]).first()
    return {c: b["low"] if b["low"] != b["high"] else None for c, b in zip(categorical, bounds)}


def _entries(numeric: Sequence[str], categorical: Sequence[str], baseline: dict[str, str | None], target: str) -> Column:
    """A row's non-zero entries (g, v, x); the target is a group of its own."""
    def entry(group: int, value: Column, x: Column, there: Column | None = None) -> Column:
        made = F.struct(F.lit(group).alias("g"), value.alias("v"), x.cast("double").alias("x"))
        return made if there is None else F.when(there, made)

    made = [entry(BIAS_AT, F.lit("_bias"), F.lit(1.0)), entry(TARGET_AT, F.lit(""), numeric_or_zero(target))]
    made += [entry(NUMERIC_AT, F.lit(n), numeric_or_zero(n)) for n in numeric]
    for at, c in enumerate(categorical):
        value = col(c).cast("string")
        known = value.isNotNull() if baseline[c] is None else value.isNotNull() & (value != F.lit(baseline[c]))
        made.append(entry(at, value, F.lit(1.0), known))
    return F.filter(F.array(*made), lambda e: e.isNotNull())


def normal_cells(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], baseline: dict[str, str | None],
                 target: str) -> DataFrame:
    """(g, v, g2, v2, value): sums of products of each feature with each feature that shares a row with it, and with the
    target. A row's work depends on its number of columns only, and a cell that a third of all rows fall into is added
    up in the tasks before it is shuffled."""
    rows = df.select(_entries(numeric, categorical, baseline, target).alias("e"))
    pairs = F.flatten(F.transform(F.filter("e", lambda a: a["g"] != TARGET_AT), lambda a: F.transform(
        F.filter("e", lambda b: (b["g"] == TARGET_AT) | (b["g"] > a["g"]) | ((b["g"] == a["g"]) & (b["v"] >= a["v"]))),
        lambda b: F.struct(a["g"].alias("g"), a["v"].alias("v"), b["g"].alias("g2"), b["v"].alias("v2"),
                           (a["x"] * b["x"]).alias("product")))))
    return rows.select(F.inline(pairs)).groupBy("g", "v", "g2", "v2").agg(F.sum("product").alias("value"))


def _met(cells: DataFrame, state: DataFrame) -> DataFrame:
    """Each cell with the direction of its second feature. The bias and the numbers meet every category there is, so their
    few rows (one a column) are broadcast; categories are joined by key, where the adaptive skew join splits a category
    that most others share rows with."""
    direction = state.select(F.col("g").alias("g2"), F.col("v").alias("v2"), "p")
    few, many = F.col("g2") < 0, F.col("g2") >= 0
    return (cells.where(few).join(F.broadcast(direction.where(few)), ["g2", "v2"])
            .unionByName(cells.where(many).join(direction.where(many), ["g2", "v2"])))


def fit_wide_ridge(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, lam: float = 1.0,
                   tolerance: float = 1e-10, max_rounds: int = ROUNDS, trained_on: str = "",
                   baseline: dict[str, str | None] | None = None) -> WideModel:
    """Minimize squared error plus ``lam`` times the squared weights (not the bias's), as :func:`~.learn.fit_ridge` does.

    Conjugate gradients, scaled by the diagonal, from zero weights. It ends when the scaled residual is ``tolerance`` of
    the right side; if ``max_rounds`` steps do not reach that it raises, and never returns weights that are not solved
    for. Missing numbers count as 0, missing categories as the baseline. A table without rows has a bias of 0 alone.
    Repeated rows count each time. ``baseline`` names each column's category without a weight where ``df`` is
    only a part of the rows (default: the first one of ``df``). Features that no other value moves (all zero, ``lam`` 0) weigh 0.
    """
    spark = df.sparkSession
    numeric, categorical = list(numeric), list(categorical)
    baseline = category_baselines(df, categorical) if baseline is None else baseline
    half = durable(normal_cells(df, numeric, categorical, baseline, target))
    sides = half.where(F.col("g2") == TARGET_AT).select("g", "v", F.col("value").alias("b"))
    half = half.where(F.col("g2") != TARGET_AT)
    same = (F.col("g") == F.col("g2")) & (F.col("v") == F.col("v2"))
    diagonal = half.where(same).select("g", "v", F.col("value").alias("d"))
    mirrored = half.where(~same).select(F.col("g2").alias("g"), F.col("v2").alias("v"), F.col("g").alias("g2"),
                                        F.col("v").alias("v2"), "value")
    cells = durable(half.unionByName(mirrored))

    penalized = F.col("g") != BIAS_AT
    d = F.col("d") + F.when(penalized, F.lit(float(lam))).otherwise(0.0)
    scaled = F.when(F.col("d") > 0, F.col("r") / F.col("d")).otherwise(0.0)
    state = durable(diagonal.join(sides, ["g", "v"]).select("g", "v", d.alias("d"), F.lit(0.0).alias("x"), F.col("b").alias("r"))
                    .withColumn("p", scaled))
    start = state.agg(F.sum(F.col("r") * scaled)).first()[0] or 0.0
    left, rounds = start, 0
    while left > tolerance * tolerance * start:
        if rounds == max_rounds:
            raise ValueError(f"not solved after {max_rounds} steps: the residual is {(left / start) ** 0.5:.1e} of the start")
        moved = (_met(cells, state).groupBy("g", "v").agg(F.sum(F.col("value") * F.col("p")).alias("q")))
        penalty = F.when(penalized, F.lit(float(lam)) * F.col("p")).otherwise(0.0)
        step = durable(state.join(moved, ["g", "v"]).withColumn("q", F.col("q") + penalty))
        curve = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not curve > 0:
            break  # the rest lies where no row moves the error, so any weights there are as good
        length = left / curve
        residual = F.col("r") - F.lit(length) * F.col("q")
        at = step.withColumns({"x": F.col("x") + F.lit(length) * F.col("p"), "r": residual})
        after = at.agg(F.sum(F.col("r") * scaled)).first()[0]
        state = at.select("g", "v", "d", "x", "r", (scaled + F.lit(after / left) * F.col("p")).alias("p"))
        left, rounds = after, rounds + 1
    weights = state.select(F.col("g").alias("feature_group"), F.col("v").alias("feature"), F.col("x").alias("weight"))
    if df.isEmpty():
        weights = small_frame(spark, [(BIAS_AT, "_bias", 0.0)], "feature_group int, feature string, weight double")
    return WideModel(target, numeric, categorical, baseline, durable(weights), float(lam), rounds, trained_on)


def score_wide(df: DataFrame, model: WideModel, output: str = "prediction") -> DataFrame:
    """Add predictions: one left join with each categorical column's weights, which are unique, so rows stay as they are
    and a category that holds much of the table is split by the adaptive skew join. Unseen and missing categories count
    as the baseline, missing numbers as 0; columns of any name are kept."""
    plain = {(r["feature_group"], r["feature"]): r["weight"]
             for r in model.weights.where(F.col("feature_group") < 0).collect()}  # the bias and one row a number
    total = F.lit(plain.get((BIAS_AT, "_bias"), 0.0))
    for n in model.numeric:
        total = total + F.lit(plain.get((NUMERIC_AT, n), 0.0)) * numeric_or_zero(n)
    taken, kept = {c.lower() for c in df.columns}, [col(c) for c in df.columns]
    prefix = "_w"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    scored = df.withColumn(f"{prefix}sum", total)
    for at, c in enumerate(model.categorical):
        table = model.weights.where(F.col("feature_group") == at).select(
            F.col("feature").alias(f"{prefix}key"), F.col("weight").alias(f"{prefix}add"))
        scored = (scored.join(table, col(c).cast("string") == F.col(f"{prefix}key"), "left")
                  .withColumn(f"{prefix}sum", F.col(f"{prefix}sum") + F.coalesce(f"{prefix}add", F.lit(0.0)))
                  .drop(f"{prefix}key", f"{prefix}add"))
    return scored.select(*[k for k, name in zip(kept, df.columns) if name != output], F.col(f"{prefix}sum").alias(output))


__all__ = ["WideModel", "category_baselines", "fit_wide_ridge", "normal_cells", "score_wide"]
