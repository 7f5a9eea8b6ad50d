"""Gradient-boosted trees over small integer features, trained by Spark aggregates and scored as SQL expressions.

Training reads one table of candidates: every level of a tree is one grouped sum of gradients by (node, feature,
value), of a size that depends on features and values alone. A tree becomes nested conditions, so scoring needs no
join and no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features are integers from 0 to this; larger values count as this.
MOST = 31


@dataclass
class Split:
    feature: int
    at_most: int
    low: "Split | float"
    high: "Split | float"


@dataclass
class Ensemble:
    start: float = 0.0
    trees: list[Split | float] = field(default_factory=list)

    def margin(self, features: Column) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree_value(tree, features)
        return total

    def probability(self, features: Column) -> Column:
        return 1 / (1 + F.exp(-self.margin(features)))


def tree_value(tree: Split | float, features: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    goes_low = F.element_at(features, tree.feature + 1) <= tree.at_most
    return F.when(goes_low, tree_value(tree.low, features)).otherwise(tree_value(tree.high, features))


def _node(tree: Split | float | None, features: Column, path: int = 1) -> Column:
    """The number of the leaf that a row falls in: the root is 1, children of n are 2n and 2n + 1."""
    if not isinstance(tree, Split):
        return F.lit(path)
    goes_low = F.element_at(features, tree.feature + 1) <= tree.at_most
    return F.when(goes_low, _node(tree.low, features, 2 * path)).otherwise(_node(tree.high, features, 2 * path + 1))


def _best_split(cells: dict, penalty: float, least: float, rate: float) -> Split | float:
    """The split of one node that lowers the loss most, with leaf values; the leaf value if none does."""
    some_feature = next(iter(cells.values()))
    g_all, h_all = sum(g for g, _ in some_feature.values()), sum(h for _, h in some_feature.values())

    def leaf(g: float, h: float) -> float:
        return -rate * g / (h + penalty)
    best, found = 1e-6, None
    for feature in sorted(cells):
        g_low = h_low = 0.0
        values = sorted(cells[feature])
        for value in values[:-1]:
            g, h = cells[feature][value]
            g_low, h_low = g_low + g, h_low + h
            g_high, h_high = g_all - g_low, h_all - h_low
            if min(h_low, h_high) < least:
                continue
            gain = g_low ** 2 / (h_low + penalty) + g_high ** 2 / (h_high + penalty) - g_all ** 2 / (h_all + penalty)
            if gain > best:
                best, found = gain, Split(feature, value, leaf(g_low, h_low), leaf(g_high, h_high))
    return leaf(g_all, h_all) if found is None else found


def fit(rows: DataFrame, rounds: int = 12, depth: int = 2, rate: float = 0.4, penalty: float = 1.0,
        least: float = 0.5) -> Ensemble:
    """Fit to ``rows`` (features array<int>, label 0/1) under the logistic loss; a column ``n``, if there, says how many
    equal rows one stands for. Store ``rows`` before: each level of each tree reads them once. Without rows of both
    labels the ensemble is a constant."""
    weight = F.col("n") if "n" in rows.columns else F.lit(1)
    positive, n = rows.agg(F.coalesce(F.sum(F.col("label") * weight), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    model = Ensemble(math.log((positive + 0.5) / (n - positive + 0.5)))
    if positive in (0, n):
        return model
    features = F.col("features")
    for _ in range(rounds):
        p = model.probability(features)
        tree: Split | float | None = None
        for level in range(depth):
            sums = (rows.select(_node(tree, features).alias("node"), ((p - F.col("label")) * weight).alias("g"), (p * (1 - p) * weight).alias("h"),
                                F.posexplode(features).alias("feature", "value"))
                    .groupBy("node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
            nodes: dict = {}
            for r in sums:
                nodes.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["value"]] = (r["g"], r["h"])
            if level == 0:
                tree = _best_split(nodes[1], penalty, least, rate)
            elif isinstance(tree, Split):
                tree.low = _best_split(nodes[2], penalty, least, rate)
                tree.high = _best_split(nodes[3], penalty, least, rate)
        model.trees.append(tree)
        if not isinstance(tree, Split):
            break
    return model
