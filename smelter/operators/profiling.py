"""Column profiling over raw text columns: types, nulls, distinct counts, keys, personal data, roles.

The exact profile scans the table once. Cells are grouped by (column, value) with map-side combine, so a
value that fills a third of the table reaches the shuffle once per task, and the patterns and date parsers
run once per distinct value instead of once per cell. Values longer than ``_LONG`` characters are grouped
by their SHA-256 digest, so whole documents are not shuffled to count them. A table that is stored by column
(Parquet) can be profiled column by column: each scan reads one column, and the few values of one do not share a
hash table with the many of another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import COMPACT, DAY_FIRST, MONTH_FIRST, YEAR_FIRST, is_datetime, trimmed_date
from ..functions.names import ROW_ID, SOURCE_FILE, col, data_columns
from ..functions.predicates import (EMAIL_TEXT, ID_NAME_PATTERN, PHONE_TEXT, PII_NAME_PATTERNS, WORD_TOKENS,
                                    is_id_like, is_integer_text, is_real_text, pii_class_of_name)
from ..functions.text import blank_to_null, is_blank, strip
from ..plans.contract import Classification
from ..session import small_frame

_LONG = 64


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ordinal, value) of every cell. Columns travel as numbers, which keeps the grouping key short."""
    numbered = df.select(*[col(c).cast("string").alias(str(i)) for i, c in enumerate(columns)])
    return numbered.unpivot([], [str(i) for i in range(len(columns))], "at", "value")


# What a value can be read as, as bits: a column fits a type when all its filled values have the bit.
_INTEGER, _REAL, _BOOLEAN, _WORD, _DATETIME, _DATE = 1, 2, 4, 8, 16, 32


def _readings(text: Column) -> Column:
    """The readings of one trimmed value. The first character decides which patterns are tried at all, so plain
    text costs no pattern, and a date parser runs only on a value of that shape."""
    numeral = (text >= "+") & (text < ":")  # + , - . / and the digits
    whole = (F.when(F.length(text) == 1, F.when(text.isin("0", "1"), _INTEGER + _REAL + _BOOLEAN))
             .when(trimmed_date(text, [COMPACT]).isNotNull(), _INTEGER + _REAL + _DATE))
    token = F.lower(text)
    return (F.when(numeral,
                   F.when(is_integer_text(text), F.coalesce(whole, F.lit(_INTEGER + _REAL)))
                   .when(is_real_text(text), _REAL)
                   .when(F.length(text) <= 10,
                         F.when(trimmed_date(text, [YEAR_FIRST, DAY_FIRST, MONTH_FIRST]).isNotNull(), _DATE).otherwise(0))
                   .when(is_datetime(text), _DATETIME).otherwise(0))
            .when(F.length(text) > 5, 0)
            .when(token.isin(*WORD_TOKENS), _BOOLEAN + _WORD).otherwise(0))


def _type_rule(common: Column, any_reading: Column) -> Column:
    """Precedence: boolean (needs a word token), integer, real, datetime, date, text."""
    def has(mask: Column, bit: int) -> Column:
        return mask.bitwiseAND(F.lit(bit)) != 0

    return (F.when(has(common, _BOOLEAN) & has(any_reading, _WORD), "boolean")
            .when(has(common, _INTEGER), "integer").when(has(common, _REAL), "real")
            .when(has(common, _DATETIME), "datetime").when(has(common, _DATE), "date").otherwise("text"))


def _keyed(cells: DataFrame) -> DataFrame:
    """(ordinal, key, long_readings, long_number) of (ordinal, value). A long value travels as its digest and what its
    stripped text can be read as; it reads as it would if it were short."""
    cells = cells.select("ordinal", "value", (F.octet_length("value") > _LONG).alias("long"))
    cells = cells.select("ordinal", "value", "long", F.when(F.col("long"), strip("value")).alias("bare"))
    cells = cells.select("*", F.when(F.col("long"), F.when(F.col("bare") == "", -1).otherwise(_readings(F.col("bare"))))
                         .alias("long_readings"))
    return cells.select(
        "ordinal", F.when(F.col("long"), F.sha2("value", 256)).otherwise(F.col("value")).alias("key"), "long_readings",
        F.when((F.col("long_readings") >= 0) & (F.col("long_readings").bitwiseAND(F.lit(_REAL)) != 0),
               F.col("bare").try_cast("double")).alias("long_number"))


def _values(cells: DataFrame) -> DataFrame:
    return _keyed(cells).groupBy("ordinal", "key", "long_readings", "long_number").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame, table: str = "", exact: bool = True, by_column: bool = False) -> DataFrame:
    """One row per data column: type, rows, nulls, null_pct, distinct, min, max.

    ``exact=False`` estimates the distinct counts with HyperLogLog and needs no value shuffle; confirm keys
    with :func:`confirm_keys` then. ``by_column`` scans the table once a column, which takes half the time where
    the table is stored by column; text files would be parsed as often.
    """
    columns = data_columns(df)
    spark = df.sparkSession
    if exact and by_column:
        values = reduce(DataFrame.unionByName, [
            _values(df.select(F.lit(i).alias("ordinal"), col(c).cast("string").alias("value"))) for i, c in enumerate(columns)])
    else:
        cells = _cells(df, columns).select(F.col("at").cast("int").alias("ordinal"), "value")
        values = _values(cells) if exact else _keyed(cells).withColumn("n", F.lit(1).cast("long"))
    text = F.when(F.col("long_readings").isNull(), blank_to_null("key")).alias("text")
    values = values.select("ordinal", "key", "long_readings", "long_number", "n", text)
    values = values.select(
        "ordinal", "key", "long_number", "n", "text",
        F.when(F.col("text").isNotNull(), _readings(F.col("text"))).otherwise(F.nullif("long_readings", F.lit(-1)))
        .alias("readings"))
    values = values.select(
        "ordinal", "n", "readings", F.when(F.col("readings").isNotNull(), F.col("key")).alias("key"),
        F.when(F.col("readings").bitwiseAND(F.lit(_REAL)) != 0,
               F.coalesce("long_number", F.col("text").try_cast("double"))).alias("number"))
    stats = values.groupBy("ordinal").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("readings").isNotNull(), F.col("n")).otherwise(0)).alias("filled_rows"),
        (F.count("key") if exact else F.approx_count_distinct("key", 0.02)).alias("distinct"),
        F.min("number").alias("lowest"), F.max("number").alias("highest"),
        F.bit_and("readings").alias("common"), F.bit_or("readings").alias("any_reading"))
    # The list of columns comes from the schema, so a table without rows still has a profile.
    names = small_frame(spark, list(enumerate(columns)), "ordinal int, column string")
    rows = F.coalesce("rows", F.lit(0)).cast("long")
    nulls = F.coalesce(F.col("rows") - F.col("filled_rows"), F.lit(0)).cast("long")
    numeric = F.col("type").isin("integer", "real")
    return (names.join(stats, "ordinal", "left")
            .withColumn("type", F.when(F.coalesce("filled_rows", F.lit(0)) == 0, "text")
                        .otherwise(_type_rule(F.col("common"), F.col("any_reading"))))
            .select(F.lit(table).alias("table"), "ordinal", "column", "type", rows.alias("rows"), nulls.alias("nulls"),
                    F.coalesce(F.round(F.try_divide(nulls.cast("double"), rows.cast("double")), 4), F.lit(0.0))
                    .alias("null_pct"),
                    F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
                    F.when(numeric, F.col("lowest")).alias("min"), F.when(numeric, F.col("highest")).alias("max")))


def infer_types(df: DataFrame) -> DataFrame:
    """Only the logical type per column: one scan, no value shuffle."""
    return profile_columns(df, exact=False).select("ordinal", "column", "type")


def first_values(df: DataFrame, columns: Sequence[str], k: int,
                 order: Sequence[str] = (SOURCE_FILE, ROW_ID)) -> DataFrame:
    """(ordinal, column, values): the first ``k`` filled values of each column in row order.

    Each column is a top-k of its own: tasks keep ``k`` rows each and read that column only.
    """
    ordering = [col(c) for c in order]
    tops = [
        df.where(~is_blank(col(c).cast("string")))
        .select(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), col(c).cast("string").alias("value"),
                F.struct(*ordering).alias("at"))
        .orderBy("at").limit(k)
        for i, c in enumerate(columns)]
    merged = reduce(DataFrame.unionByName, tops)
    return (merged.groupBy("ordinal", "column")
            .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("taken"))
            .select("ordinal", "column", F.col("taken.value").alias("values")))


def column_samples(df: DataFrame, k: int = 3, order: Sequence[str] = (SOURCE_FILE, ROW_ID),
                   columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns) if columns else [c for c in data_columns(df) if c not in order]
    return first_values(df, columns, k, order).withColumnRenamed("values", "samples")


def candidate_keys(profile: DataFrame) -> DataFrame:
    """Columns that are unique and complete, and of a type that can identify."""
    return profile.where((F.col("rows") > 1) & (F.col("distinct") == F.col("rows")) & (F.col("nulls") == 0)
                         & ~F.col("type").isin("real", "boolean")).select("table", "ordinal", "column")


def confirm_keys(df: DataFrame, profile: DataFrame, tolerance: float = 0.9) -> DataFrame:
    """Candidate keys from an estimated profile: columns whose estimate comes near the row count are
    checked exactly, the others cannot be keys."""
    near = [(r["ordinal"], r["column"]) for r in profile.where(
        (F.col("rows") > 1) & (F.col("nulls") == 0) & ~F.col("type").isin("real", "boolean")
        & (F.col("distinct") >= F.col("rows") * tolerance)).orderBy("ordinal").collect()]
    spark = df.sparkSession
    survivors = small_frame(spark, near, "ordinal int, column string")
    if not near:
        return survivors
    columns = [c for _, c in near]
    repeated = (_cells(df, columns).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .select(F.element_at(F.array(*[F.lit(o) for o, _ in near]), F.col("at").cast("int") + 1)
                        .alias("ordinal")).distinct())
    return survivors.join(repeated, "ordinal", "left_anti")


def detect_pii(df: DataFrame, profile: DataFrame, table: str,
               patterns: Mapping[str, str] = PII_NAME_PATTERNS, extra: Mapping[str, str] | None = None,
               share: float = 0.6) -> DataFrame:
    """(table, column, class, action) of personal-data columns: by name, else for text columns by the share
    of all filled values that look like an e-mail address or a phone number: one aggregate over all such columns."""
    extra = dict(extra or {})
    spark = df.sparkSession
    known = F.lit(None).cast("string")
    for name, cls in extra.items():
        known = F.when(F.col("column") == name, F.lit(cls)).otherwise(known)
    by_name = profile.select("ordinal", "column", "type",
                             F.coalesce(known, pii_class_of_name("column", patterns)).alias("class"))
    rows = by_name.orderBy("ordinal").collect()  # one row per column
    named = [(r["ordinal"], r["column"], r["class"]) for r in rows if r["class"]]
    found = small_frame(spark, named, "ordinal int, column string, class string")
    open_text = {r["column"]: r["ordinal"] for r in rows if not r["class"] and r["type"] == "text"}
    if open_text:
        texts = df.select(*[col(c).cast("string").alias(f"c{i}") for c, i in open_text.items()])
        texts = texts.select(*[blank_to_null(f"c{i}").alias(f"c{i}") for i in open_text.values()])
        shares = texts.agg(*[F.array(*[F.try_divide(F.count_if(F.col(f"c{i}").rlike(pattern)), F.count(f"c{i}"))
                                       for pattern in (EMAIL_TEXT, PHONE_TEXT)]).alias(f"c{i}")
                             for i in open_text.values()]).first()  # two numbers a column
        sniffed = []
        for c, i in open_text.items():
            mail, phone = (s or 0.0 for s in shares[f"c{i}"])
            if max(mail, phone) > share:
                sniffed.append((i, c, "email" if mail > share else "phone"))
        if sniffed:
            found = found.unionByName(small_frame(spark, sniffed, "ordinal int, column string, class string"))
    return found.select(F.lit(table).alias("table"), "ordinal", "column", "class", F.lit("flagged").alias("action"))


def quality_checks(profile: DataFrame) -> DataFrame:
    """Three checks per profiled table: it has rows, no column is mostly null, it has a candidate key."""
    key = ((F.col("rows") > 1) & (F.col("distinct") == F.col("rows")) & (F.col("nulls") == 0)
           & ~F.col("type").isin("real", "boolean"))

    def names(condition: Column) -> Column:
        hits = F.array_sort(F.collect_list(F.when(condition, F.struct("ordinal", "column"))))
        return F.array_join(hits.getField("column"), ", ")

    summary = profile.groupBy("table").agg(F.max("rows").alias("rows"),
                                           names(F.col("null_pct") > 0.5).alias("sparse"), names(key).alias("keys"))
    checks = F.array(
        F.struct(F.concat("table", F.lit(" row_count > 0")).alias("check"),
                 F.when(F.col("rows") > 0, "pass").otherwise("fail").alias("result"),
                 F.concat(F.col("rows").cast("string"), F.lit(" rows")).alias("detail")),
        F.struct(F.concat("table", F.lit(" columns <50% null")).alias("check"),
                 F.when(F.col("sparse") != "", "warn").otherwise("pass").alias("result"),
                 F.when(F.col("sparse") != "", F.concat("sparse", F.lit(" >50% null"))).otherwise("ok").alias("detail")),
        F.struct(F.concat("table", F.lit(" has a candidate key")).alias("check"),
                 F.when(F.col("keys") != "", "pass").otherwise("warn").alias("result"),
                 F.when(F.col("keys") != "", F.col("keys")).otherwise("no unique non-null column").alias("detail")))
    return summary.select("table", F.inline(checks))


def _low_cardinality(divisor: int) -> Column:
    """Between 2 and max(50, rows / divisor) distinct values."""
    return (F.col("distinct") > 1) & (F.col("distinct") <= F.greatest(F.lit(50), F.floor(F.col("rows") / divisor)))


def _roles_input(profile: DataFrame, pii: DataFrame | None) -> DataFrame:
    keys = candidate_keys(profile).select("table", "column", F.lit(True).alias("is_key"))
    joined = profile.join(keys, ["table", "column"], "left")
    if pii is None:
        joined = joined.withColumn("class", F.lit(None).cast("string"))
    else:
        joined = joined.join(pii.select("table", "column", "class"), ["table", "column"], "left")
    return joined.withColumn("is_key", F.coalesce("is_key", F.lit(False)))


def dim_candidates(profile: DataFrame, pii: DataFrame | None = None, divisor: int = 4) -> DataFrame:
    """Catalog dimensions: text or boolean columns of low cardinality that are neither key nor personal data."""
    return (_roles_input(profile, pii)
            .where(F.col("type").isin("text", "boolean") & ~F.col("is_key") & F.col("class").isNull()
                   & _low_cardinality(divisor))
            .select("table", "ordinal", "column", "distinct"))


def classify_columns(profile: DataFrame, pii: DataFrame | None = None, divisor: int = 2,
                     id_pattern: str = ID_NAME_PATTERN) -> DataFrame:
    """One row per column with its role in gold: ``grain`` (the first date), ``measure``, ``dim`` or ``none``.

    Numbers named like identifiers and personal data are no measures, however many distinct values they have.
    """
    first_date = W.partitionBy("table")
    dated = F.col("type").isin("date", "datetime")
    personal = F.col("class").isNotNull()
    role = (F.when(dated & (F.col("ordinal") == F.col("first_date")), "grain")
            .when(F.col("type").isin("integer", "real") & ~is_id_like("column", id_pattern) & ~personal, "measure")
            .when(F.col("type").isin("text", "boolean") & ~F.col("is_key") & ~personal & _low_cardinality(divisor),
                  "dim").otherwise("none"))
    return (_roles_input(profile, pii)
            .withColumn("first_date", F.min(F.when(dated, F.col("ordinal"))).over(first_date))
            .select("table", "ordinal", "column", "type", role.alias("role"), "is_key", "class"))


def to_classification(roles: DataFrame) -> Classification:
    """Bring the roles of one table to the driver (one row per column)."""
    rows = roles.orderBy("ordinal").collect()

    def having(role: str) -> list[str]:
        return [r["column"] for r in rows if r["role"] == role]

    grain = having("grain")
    return Classification(grain=grain[0] if grain else None, measures=having("measure"), dims=having("dim"),
                          keys=[r["column"] for r in rows if r["is_key"]],
                          pii=[r["column"] for r in rows if r["class"]],
                          types={r["column"]: r["type"] for r in rows})
