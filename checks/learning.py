"""Features, Gram matrix, ridge fit, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from smelter.operators import (LinearModel, build_features, category_vocabulary, fit_ridge, fit_wide_ridge, gram_cells,
                               holdout, input_violations, regression_metrics, score, score_wide)
from smelter.operators.learn import FeatureSchema, build_schema, evaluate

from .gold import ORDERS_FACT_SQL, orders_fact, rounded
from .registry import query, table

_KEYS = ["o_orderdate_day", "o_orderstatus", "o_orderpriority"]
_STATUS, _PRIORITY = ["O", "P"], ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SCHEMA = FeatureSchema("o_totalprice", ["orders_count"], {"o_orderstatus": _STATUS, "o_orderpriority": _PRIORITY},
                       {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
_FEATURES = (['1.0::DOUBLE AS "_bias"', 'CAST(orders_count AS DOUBLE) AS orders_count']
             + [f"""CASE WHEN o_orderstatus = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderstatus={v}" """
                for v in _STATUS]
             + [f"""CASE WHEN o_orderpriority = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority={v}" """
                for v in _PRIORITY])


@query("holdout_split", f"""SELECT o_orderdate_day, o_orderstatus, o_orderpriority,
    (row_number() OVER (ORDER BY o_orderdate_day, o_orderstatus, o_orderpriority) - 1) % 5 = 0 AS is_test
    FROM ({ORDERS_FACT_SQL})""")
def holdout_split(spark, sf_dir):
    return holdout(orders_fact(spark, sf_dir), _KEYS).select(*_KEYS, "is_test")


@query("category_vocab", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, {c} = (SELECT min({c}) FROM orders) AS is_baseline
        FROM (SELECT DISTINCT {c} FROM orders)""" for c in ("o_orderstatus", "o_orderpriority")))
def category_vocab(spark, sf_dir):
    return category_vocabulary(orders_fact(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


@query("feature_matrix", f"""SELECT o_orderdate_day, o_orderstatus, o_orderpriority, {', '.join(_FEATURES)}
    FROM ({ORDERS_FACT_SQL})""")
def feature_matrix(spark, sf_dir):
    fact = orders_fact(spark, sf_dir)
    schema = build_schema(fact, ["orders_count"], ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return build_features(fact, schema, _KEYS)


_LONG = f"""SELECT row_number() OVER () AS r, {', '.join(_FEATURES)}, o_totalprice / 1000 AS y FROM ({ORDERS_FACT_SQL})"""
_X = ['"_bias"', "orders_count", *[f'"o_orderstatus={v}"' for v in _STATUS], *[f'"o_orderpriority={v}"' for v in _PRIORITY],
      "y"]


@query("gram_cells", f"WITH x AS ({_LONG}) " + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, round(sum({_X[i]} * {_X[j]}) / count(*), 3) AS value FROM x"
    for i in range(len(_X)) for j in range(i, len(_X))))
def gram(spark, sf_dir):
    """Per row and with the target in thousands, so that the digits compared do not depend on the table's size."""
    fact = orders_fact(spark, sf_dir).withColumn("o_totalprice", F.col("o_totalprice") / 1000)
    n = fact.count()
    return gram_cells(fact, SCHEMA).withColumn("value", F.round(F.col("value") / n, 3))


_FIXED = LinearModel(SCHEMA, [100.0, 150000.0, -20.0, 35.5, 1.0, 2.0, 3.0, 4.5], 1.0)
_PREDICTION = """100.0 + 150000.0 * orders_count + CASE o_orderstatus WHEN 'O' THEN -20.0 WHEN 'P' THEN 35.5 ELSE 0.0 END
    + CASE o_orderpriority WHEN '2-HIGH' THEN 1.0 WHEN '3-MEDIUM' THEN 2.0 WHEN '4-NOT SPECIFIED' THEN 3.0
      WHEN '5-LOW' THEN 4.5 ELSE 0.0 END"""


@query("score_orders", f"""SELECT o_orderdate_day, o_orderstatus, o_orderpriority,
    CAST({_PREDICTION} AS DOUBLE) AS prediction FROM ({ORDERS_FACT_SQL})""")
def score_orders(spark, sf_dir):
    return score(orders_fact(spark, sf_dir), _FIXED).select(*_KEYS, "prediction")


@query("regression_metrics", f"""SELECT o_orderstatus, count(*) AS n, round(1 - sum((y - p) * (y - p)) /
    (var_pop(y) * count(*)), 4) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae
    FROM (SELECT o_orderstatus, o_totalprice AS y, CAST({_PREDICTION} AS DOUBLE) AS p FROM ({ORDERS_FACT_SQL}))
    GROUP BY o_orderstatus""")
def metrics_by_status(spark, sf_dir):
    return regression_metrics(score(orders_fact(spark, sf_dir), _FIXED), "o_totalprice", by=["o_orderstatus"])


_N = len(_X) - 1


def _solved_sql(rows: str) -> str:
    """CTEs that end in ``solved`` (i, weight): the normal equations of ``rows`` with penalty 1, eliminated column by column."""
    sides = " UNION ALL ".join(
        f"SELECT {i} AS i, " + ", ".join(f"sum({_X[i]} * {_X[j]})" + (" + 1" if i == j and i else "") + f" AS c{j}" for j in range(_N + 1))
        + " FROM rows_used" for i in range(_N))
    steps = [f"rows_used AS ({rows})", f"s0 AS MATERIALIZED ({sides})"]
    for k in range(_N):
        cells = ", ".join(f"CASE WHEN s.i = {k} THEN p.c{j} / p.c{k} ELSE s.c{j} - s.c{k} * p.c{j} / p.c{k} END AS c{j}"
                          for j in range(_N + 1))
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT s.i, {cells} FROM s{k} s, s{k} p WHERE p.i = {k})")
    return ", ".join([*steps, f"solved AS (SELECT i, c{_N} AS weight FROM s{_N})"])


_NUMBERED = f"""SELECT (row_number() OVER (ORDER BY o_orderdate_day, o_orderstatus, o_orderpriority) - 1) % 5 = 0 AS is_test,
    o_orderdate_day, o_orderstatus, o_orderpriority, {', '.join(_FEATURES)}, o_totalprice AS y FROM ({ORDERS_FACT_SQL})"""
_NAMES = ["_bias", "orders_count", *[f"o_orderstatus={v}" for v in _STATUS], *[f"o_orderpriority={v}" for v in _PRIORITY]]
_WEIGHED = " + ".join(f"{_X[i]} * (SELECT weight FROM solved WHERE i = {i})" for i in range(_N))


@query("ridge_coefficients", f"""WITH numbered AS MATERIALIZED ({_NUMBERED}), {_solved_sql("SELECT * FROM numbered WHERE NOT is_test")}
    SELECT CASE i {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))} END AS feature, round(weight, 2) AS weight
    FROM solved""")
def ridge_coefficients(spark, sf_dir):
    """Learned from the training rows."""
    split = holdout(orders_fact(spark, sf_dir), _KEYS)
    model = fit_ridge(split.where("is_train"), SCHEMA)
    weights = F.create_map(*[F.lit(x) for pair in model.coefficients().items() for x in pair])
    return rounded(split.select(F.explode(weights).alias("feature", "weight")).distinct(), "weight")


@query("ridge_evaluation", f"""WITH numbered AS MATERIALIZED ({_NUMBERED}), {_solved_sql("SELECT * FROM numbered WHERE NOT is_test")},
    scored AS (SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, y, {_WEIGHED} AS p FROM numbered)
    SELECT split, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2,
        round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae FROM scored GROUP BY split""")
def ridge_evaluation(spark, sf_dir):
    split = holdout(orders_fact(spark, sf_dir), _KEYS)
    return evaluate(split, fit_ridge(split.where("is_train"), SCHEMA))


@query("ridge_predictions", f"""WITH numbered AS MATERIALIZED ({_NUMBERED}), {_solved_sql("SELECT * FROM numbered")}
    SELECT o_orderdate_day, o_orderstatus, o_orderpriority, round({_WEIGHED}, 2) AS prediction FROM numbered""")
def ridge_predictions(spark, sf_dir):
    fact = orders_fact(spark, sf_dir)
    return rounded(score(fact, fit_ridge(fact, SCHEMA)).select(*_KEYS, "prediction"), "prediction")


# With one categorical column its weights can be eliminated, which leaves two equations for the bias and the month.
_CUSTOMERS = """t AS MATERIALIZED (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, CAST(month(o_orderdate) AS DOUBLE) AS a, o_totalprice / 1000 AS y
        FROM orders),
    w AS MATERIALIZED (SELECT c, CAST(count(*) AS DOUBLE) AS n, sum(a) AS sa, sum(y) AS sy FROM t
        WHERE c <> (SELECT min(c) FROM t) GROUP BY c),
    m AS (SELECT tot.n - k.nn AS m11, tot.sa - k.na AS m12, tot.saa + 1 - k.aa AS m22, tot.sy - k.ny AS r1, tot.say - k.ay AS r2
        FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(a) AS sa, sum(a * a) AS saa, sum(y) AS sy, sum(a * y) AS say FROM t) tot,
            (SELECT sum(n * n / (n + 1)) AS nn, sum(n * sa / (n + 1)) AS na, sum(sa * sa / (n + 1)) AS aa,
                sum(n * sy / (n + 1)) AS ny, sum(sa * sy / (n + 1)) AS ay FROM w) k),
    s AS MATERIALIZED (SELECT (r1 * m22 - r2 * m12) / (m11 * m22 - m12 * m12) AS b,
        (m11 * r2 - m12 * r1) / (m11 * m22 - m12 * m12) AS a FROM m),
    customers AS MATERIALIZED (SELECT w.c, (w.sy - s.b * w.n - s.a * w.sa) / (w.n + 1) AS weight FROM w, s)"""


def _customers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"),
                                                   F.month("o_orderdate").alias("month"), (F.col("o_totalprice") / 1000).alias("price"))
    return orders, fit_wide_ridge(orders, ["month"], ["customer"], "price", tolerance=1e-13)


@query("ridge_wide_coefficients", f"""WITH {_CUSTOMERS} SELECT '_bias' AS feature, round(b, 3) AS weight FROM s
    UNION ALL SELECT 'month', round(a, 3) FROM s UNION ALL SELECT 'customer=' || c, round(weight, 3) FROM customers""")
def ridge_wide_coefficients(spark, sf_dir):
    """A weight for every customer, so the features grow with the table."""
    return rounded(_customers(spark, sf_dir)[1].coefficients(), "weight", places=3)


@query("ridge_wide_predictions", f"""WITH {_CUSTOMERS} SELECT o_orderkey, round(s.b + s.a * t.a + coalesce(weight, 0), 3) AS prediction
    FROM t CROSS JOIN s LEFT JOIN customers USING (c)""")
def ridge_wide_predictions(spark, sf_dir):
    orders, model = _customers(spark, sf_dir)
    return rounded(score_wide(orders, model).select("o_orderkey", "prediction"), "prediction", places=3)


@query("input_spec_violations", f"""SELECT o_orderdate_day, o_orderstatus, feature, problem, value FROM (
    SELECT o_orderdate_day, o_orderstatus, 'o_orderpriority' AS feature, 'unknown category' AS problem,
        o_orderpriority AS value FROM ({ORDERS_FACT_SQL}) WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT o_orderdate_day, o_orderstatus, 'orders_count', 'missing number', NULL FROM ({ORDERS_FACT_SQL})
        WHERE o_orderstatus = 'P')""")
def violations(spark, sf_dir):
    """Priorities the schema has not seen, and counts taken away from status P."""
    narrow = FeatureSchema("o_totalprice", ["orders_count"], {"o_orderpriority": ["2-HIGH"]},
                           {"o_orderpriority": "1-URGENT"})
    fact = orders_fact(spark, sf_dir).withColumn("orders_count", F.when(F.col("o_orderstatus") != "P", F.col("orders_count")))
    return input_violations(fact, narrow, ["o_orderdate_day", "o_orderstatus"])
