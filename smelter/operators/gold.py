"""Gold: daily facts, conformed dimensions, and the proof that sums survived."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col, quoted
from ..plans.metric import SKETCH_SUFFIX
from ..sources.landing import land_table

MONTH = "_month"
_DIGITS = 38


def build_daily_fact(silver: DataFrame, grain: str, dims: Sequence[str], measures: Sequence[str], name: str,
                     distinct_cols: Sequence[str] = (), exact: bool = False, sketch: str = "hll") -> DataFrame:
    """One row per day and dimension values: summed measures and ``<name>_count``.

    A missing day stays a group, so sums still reconcile. ``exact`` adds fractional measures up as decimals wide
    enough for their data (see ``decimal_scales``) and stores the sum as a double: totals are then independent of the
    order of addition. ``distinct_cols`` adds one mergeable sketch per column (``<column>_sketch``, HLL or Theta) for
    distinct counts at coarser grains.
    """
    day = F.to_date(col(grain)).alias(f"{grain}_day")
    whole = exact_sums(silver, measures) if exact else {}
    sums = [whole.get(m, F.sum(col(m))).alias(m) for m in measures]
    build = F.hll_sketch_agg if sketch == "hll" else F.theta_sketch_agg
    sketches = [build(col(c)).alias(f"{c}{SKETCH_SUFFIX}") for c in distinct_cols]
    return (silver.groupBy(day, *[col(d) for d in dims])
            .agg(*sums, F.count(F.lit(1)).alias(f"{name}_count"), *sketches))


def decimal_scales(df: DataFrame, measures: Sequence[str]) -> dict[str, int]:
    """How many decimals each fractional measure's sum can keep in 38 digits, from its largest value and the rows.

    A measure with NaN or infinite values, or too large for 38 digits, is left out: it is summed as doubles.
    """
    return {m: scale for m, (scale, _) in _scales(df, measures).items()}


def _scales(df: DataFrame, measures: Sequence[str]) -> dict[str, tuple[int, bool]]:
    """The scale of each measure's sum, and whether all its values are hundredths of at most 15 digits: one pass."""
    fractional = [f.name for f in df.schema.fields if f.name in set(measures) and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not fractional:
        return {}
    rows, *found = df.agg(F.count(F.lit(1)), *[F.struct(
        F.coalesce(F.max(F.abs(col(m).cast("double"))), F.lit(0.0)).alias("top"),
        F.coalesce(F.bool_and(_are_hundredths(m)), F.lit(True)).alias("hundredths")).alias(f"m{i}") for i, m in enumerate(fractional)]).first()
    scales = {}
    for m, (top, hundredths) in zip(fractional, found):
        if math.isfinite(top):
            before_point = (math.floor(math.log10(top)) + 1 if top else 0) + len(str(rows))
            if before_point <= _DIGITS:
                scale = _DIGITS - max(before_point, 0)
                scales[m] = (scale, hundredths and scale >= 2)
    return scales


def exact_sums(df: DataFrame, measures: Sequence[str]) -> dict[str, Column]:
    """An aggregate for each fractional measure that fits a decimal: its values' exact sum, as a double.

    Doubles that stand for hundredths, as amounts of money do, add up as longs, which costs a small part of what
    decimals of 38 digits cost; the sum is the same.
    """
    return {m: (_sum_of_hundredths(m) if hundredths else _decimal_sum(m, scale)).cast("double")
            for m, (scale, hundredths) in _scales(df, measures).items()}


def _hundredths(measure: str) -> Column:
    return F.rint(col(measure).cast("double") * 100)


def _are_hundredths(measure: str) -> Column:
    """True where a double is the one nearest to a number of two decimals and at most 15 digits, which a double tells apart."""
    return (F.abs(_hundredths(measure)) < 1e15) & (_hundredths(measure) / 100 == col(measure).cast("double"))


def _sum_of_hundredths(measure: str) -> Column:
    """The sum in two parts, so that no sum of longs runs over: 2 ** 43 rows would be needed."""
    whole, low_bits = _hundredths(measure).cast("long"), 20
    high = F.sum(F.shiftright(whole, low_bits)).cast("decimal(20,0)") * F.lit(1 << low_bits).cast("decimal(7,0)")
    low = F.sum(whole.bitwiseAND(F.lit((1 << low_bits) - 1).cast("long"))).cast("decimal(20,0)")
    return (high + low) * F.lit("0.01").cast("decimal(2,2)")


def _decimal_sum(measure: str, scale: int) -> Column:
    return F.sum(col(measure).cast(f"decimal({_DIGITS},{scale})"))


def write_fact(fact: DataFrame, path: str, day: str) -> DataFrame:
    """Store a fact partitioned by month; :func:`read_fact` takes a range of days and reads its months only."""
    return land_table(fact.withColumn(MONTH, F.date_format(col(day), "yyyy-MM")), path, [MONTH]).drop(MONTH)


def read_fact(spark: SparkSession, path: str, day: str, first_day: str, last_day: str) -> DataFrame:
    """The rows of a stored fact between two days, both included, given as ``yyyy-MM-dd``."""
    stored = spark.read.parquet(path)
    months = F.col(MONTH).between(first_day[:7], last_day[:7])
    return stored.where(months & col(day).between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).drop(MONTH)


def conform_dimension(silver: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """A reference table for gold: everything but personal data."""
    return silver.drop(*drop)


def _totals(df: DataFrame, measures: Sequence[str], label: str) -> DataFrame:
    """(measure, total, size): each measure's sum, worked out from this table's own values, and the sum of absolutes."""
    exact = exact_sums(df, measures)
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    sums = []
    for m in measures:
        total = exact.get(m, (_decimal_sum(m, 0) if m in whole else F.sum(col(m))).cast("double"))
        sums.append(F.struct(F.lit(m).alias("measure"), F.coalesce(total, F.lit(0.0)).alias(label),
                             F.coalesce(F.sum(F.abs(col(m).cast("double"))), F.lit(0.0)).alias(f"{label}_size")))
    return df.agg(F.array(*sums).alias("all")).select(F.inline("all"))


def reconcile(silver: DataFrame, gold: DataFrame, measures: Sequence[str], relative: float = 1e-12,
              strict: bool = False) -> DataFrame:
    """(measure, silver_sum, gold_sum, result) per measure. Either sum comes from its own table's values, added up as
    decimals that fit them, so measures of any size are compared to the digits that doubles have.

    The sums may differ by ``relative`` of the sum of silver's absolute values: what doubles lose when very many cells
    are stored. Facts built with ``exact=True`` from values of few digits pass with 0 too. Two NaN sums agree. With
    ``strict`` a failure raises.
    """
    both = _totals(silver, measures, "silver_sum").join(_totals(gold, measures, "gold_sum"), "measure")
    same = F.col("silver_sum") == F.col("gold_sum")
    near = F.abs(F.col("silver_sum") - F.col("gold_sum")) <= F.col("silver_sum_size") * relative
    both = both.select("measure", "silver_sum", "gold_sum", (same | near).alias("_agrees"))
    checked = both.withColumn("result", F.when(F.col("_agrees"), "pass").otherwise("fail")).drop("_agrees")
    if strict:
        failed = [r["measure"] for r in checked.where(F.col("result") == "fail").collect()]
        if failed:
            raise ValueError(f"sums do not reconcile: {', '.join(failed)}")
    return checked


def reconcile_rows(silver: DataFrame, gold: DataFrame, count_col: str) -> DataFrame:
    """The row count check: no silver row was lost or counted twice."""
    one = silver.agg(F.count(F.lit(1)).alias("n")).select(F.lit("silver").alias("side"), "n")
    two = gold.agg(F.coalesce(F.sum(col(count_col)), F.lit(0)).alias("n")).select(F.lit("gold").alias("side"), "n")
    return (one.unionByName(two).groupBy().pivot("side", ["silver", "gold"]).agg(F.max("n"))
            .select(F.lit(count_col).alias("measure"), F.col("silver").alias("silver_rows"),
                    F.col("gold").alias("gold_rows"),
                    F.when(F.col("silver") == F.col("gold"), "pass").otherwise("fail").alias("result")))
