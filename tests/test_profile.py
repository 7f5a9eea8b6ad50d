"""Profiles against a plain Python reading of the same rules, on mixed and awkward values."""

import re
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from smelter.functions import blank_to_null, coerce, is_date, is_datetime, norm_date, strip
from smelter.operators import (candidate_keys, cast_bronze, classify_columns, column_samples, confirm_keys, detect_pii,
                               profile_columns, quality_checks, to_classification)
from smelter.functions.names import REJECTED
from smelter.session import small_frame

BOOL = {"true", "false", "yes", "no", "y", "n", "0", "1", "t", "f"}
DATES = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%Y%m%d")
STAMPS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ")


def parses(text, formats):
    for f in formats:
        try:
            return datetime.strptime(text, f)
        except ValueError:
            pass
    return None


def expected_type(values):
    texts = [v.strip() for v in values if v is not None and v.strip()]
    if not texts:
        return "text"
    if all(t.lower() in BOOL for t in texts) and any(t.lower() in BOOL - {"0", "1"} for t in texts):
        return "boolean"
    if all(re.fullmatch(r"[+-]?\d+", t) for t in texts):
        return "integer"
    if all(re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", t) for t in texts):
        return "real"
    if all(parses(t, STAMPS) for t in texts):
        return "datetime"
    if all(parses(t, DATES) for t in texts):
        return "date"
    return "text"


def frame(spark, columns):
    names = list(columns)
    rows = list(zip(range(len(columns[names[0]])), *columns.values()))
    return small_frame(spark, rows, "_row_id long, " + ", ".join(f"`{n}` string" for n in names))


COLUMNS = {
    "whole": ["1", "-2", "+3", " 4 ", ""], "zero_one": ["0", "1", "0", "1", "1"], "real": ["1", "2.", ".5", "1e3", "-7E-2"],
    "flag": ["yes", "NO", "1", None, "t"], "day": ["2024-1-5", "31/12/2024", "12/31/2024", "2024/02/29", "01-02-2024"],
    "compact": ["20240105", "2024-01-06", "20241231", None, " "], "compact_only": ["20240105"] * 5,
    "stamp": ["2024-01-05T01:02:03", "2024-01-05 1:2:3", "2024-12-31T23:59:59Z", None, "2024-02-29 00:00:00"],
    "mixed": ["2024-01-05", "2024-01-05T01:02:03", None, None, None], "no_day": ["30/02/2024", "2024-01-01"] + [None] * 3,
    "no_time": ["2024-01-05 25:00:00"] * 5, "short_year": ["24-01-05"] * 5, "blank": ["", " \t", " ", None, "\n"],
    "text": ["a", "b", "a", "", None], "long_number": ["1" * 70, "2", "3", "4", "5"],
    "long_real": ["1" * 70 + ".5", "2", "3", "4", "5"], "long_text": ["x" * 100, "x" * 100, "y" * 100, "z", " " * 80],
    "year_zero": ["0000-01-01"] * 5, "sign": ["+", "-", "1", "2", "3"], "unicode": ["é", "é", "日本", "", "x"],
}


@pytest.mark.parametrize("exact", [True, False])
def test_profile_follows_the_rules(spark, exact):
    df = frame(spark, COLUMNS)
    got = {r["column"]: r for r in profile_columns(df, "t", exact).collect()}
    assert list(got) and [got[c]["ordinal"] for c in COLUMNS] == list(range(len(COLUMNS)))
    for name, values in COLUMNS.items():
        filled = [v for v in values if v is not None and v.strip()]
        row = got[name]
        assert row["type"] == expected_type(values), name
        assert (row["rows"], row["nulls"], row["distinct"]) == (5, 5 - len(filled), len(set(filled))), name
        assert row["null_pct"] == round((5 - len(filled)) / 5, 4)
        numbers = [float(v) for v in filled] if row["type"] in ("integer", "real") else []
        assert (row["min"], row["max"]) == ((min(numbers), max(numbers)) if numbers else (None, None)), name


TOKENS = st.one_of(
    st.sampled_from(["", " ", "0", "1", "true", "F", "yes", "12", "-3", "1.5", "1e5", ".", "2024-01-05", "5/6/2024",
                     "30/02/2024", "2024-01-05T10:00:00", "2024-01-05 10:00:00", "20240105", "abc", "a b", "2024-1-5Z"]),
    st.text(alphabet="0123456789-/.eE+ tT:Z", max_size=12))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(TOKENS, min_size=1, max_size=3), min_size=30, max_size=30))
def test_types_of_random_columns(spark, columns):
    height = 3
    data = {f"c{i}": (values * height)[:height] for i, values in enumerate(columns)}
    got = {r["column"]: r["type"] for r in profile_columns(frame(spark, data)).collect()}
    for name, values in data.items():
        assert got[name] == expected_type(values), values


def lenient(text):
    """Formats without separators are read only at full width here."""
    return parses(text, [f for f in DATES if f != "%Y%m%d" or len(text) == 8])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(
    st.builds("{}{}{}{}{}".format, st.integers(0, 40), st.sampled_from("-/"), st.integers(0, 14), st.sampled_from("-/"),
              st.sampled_from([24, 2023, 2024])),
    st.builds("{}-{}-{}{}{}:{}:{}{}".format, st.sampled_from([2023, 2024]), st.integers(0, 13), st.integers(0, 32),
              st.sampled_from("T x"), st.integers(0, 25), st.integers(0, 61), st.integers(0, 61), st.sampled_from(["", "Z"])),
    st.from_regex(r"\A20[0-9]{6}\Z")), min_size=60, max_size=60))
def test_dates_of_random_texts(spark, texts):
    df = small_frame(spark, [(t,) for t in texts], "t string")
    rows = df.select("t", is_date("t").alias("d"), is_datetime("t").alias("s"), norm_date("t").alias("n")).collect()
    for r in rows:
        day, stamp = lenient(r["t"]), parses(r["t"], STAMPS)
        assert (r["d"], r["s"]) == (day is not None, stamp is not None), r["t"]
        found = day or stamp
        assert r["n"] == (found.date().isoformat() if found else r["t"].strip())


def test_strip_and_blank(spark):
    texts = [" a ", " b ", "", " \n", "c d", "é ", "\x1fx", None]
    df = small_frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [(r["s"], r["b"]) for r in df.select(strip("t").alias("s"), blank_to_null("t").alias("b")).collect()]
    assert got == [(t if t is None else t.strip(), None if t is None else t.strip() or None) for t in texts]


def test_coercion(spark):
    cases = [("3.0", "integer", 3), ("1e3", "integer", 1000), ("x", "integer", None), (" 7 ", "integer", 7),
             ("9" * 25, "integer", None), ("2.5", "real", 2.5), ("Yes", "boolean", True), ("0", "boolean", False),
             ("maybe", "boolean", None), ("", "text", None)]
    for text, kind, value in cases:
        df = small_frame(spark, [(text,)], "t string")
        assert df.select(coerce("t", kind)).first()[0] == value, (text, kind)


def test_rejected_values_are_kept_on_request(spark):
    df = frame(spark, {"n": ["1", "x"], "b": ["yes", "no"]})
    rows = cast_bronze(df, {"n": "integer", "b": "boolean"}, keep_rejected=True).orderBy("_row_id").collect()
    assert [(r["n"], r["b"], r[REJECTED]) for r in rows] == [(1, True, {}), (None, False, {"n": "x"})]


def test_keys_samples_roles(spark):
    n = 120
    df = frame(spark, {
        "order_id": [str(i) for i in range(n)], "zone": ["ABC"[i % 3] for i in range(n)],
        "note": [f"n{i}" if i else "" for i in range(n)], "booked": [f"2024-01-{1 + i % 28:02d}" for i in range(n)],
        "amount": [str(i % 7) for i in range(n)], "zip": [str(10000 + i % 9) for i in range(n)],
        "mail": [f"u{i % 40}@example.com" if i % 4 else "none" for i in range(n)], "price_key": ["5"] * n})
    profile = profile_columns(df, "t")
    assert [r["column"] for r in candidate_keys(profile).collect()] == ["order_id"]
    estimated = profile_columns(df, "t", exact=False)
    assert [r["column"] for r in confirm_keys(df, estimated).collect()] == ["order_id"]
    samples = {r["column"]: r["samples"] for r in column_samples(df, order=["_row_id"]).collect()}
    assert samples["note"] == ["n1", "n2", "n3"] and samples["zone"] == ["A", "B", "C"]
    pii = detect_pii(df, profile, "t")
    assert {(r["column"], r["class"]) for r in pii.collect()} == {("zip", "address"), ("mail", "email")}
    roles = to_classification(classify_columns(profile, pii))
    assert (roles.grain, roles.measures, roles.dims, roles.keys) == ("booked", ["amount"], ["zone"], ["order_id"])
    assert roles.pii == ["zip", "mail"]


def test_quality_checks_warn_and_fail(spark, collect):
    sparse = frame(spark, {"a": ["1", None, None], "b": ["1", "1", "2"]})
    checks = {r["check"]: (r["result"], r["detail"]) for r in collect(quality_checks(profile_columns(sparse, "s")))}
    assert checks == {"s row_count > 0": ("pass", "3 rows"), "s columns <50% null": ("warn", "a >50% null"),
                      "s has a candidate key": ("warn", "no unique non-null column")}
    empty = sparse.where(F.lit(False))
    checks = {r["check"]: r["result"] for r in collect(quality_checks(profile_columns(empty, "s")))}
    assert checks["s row_count > 0"] == "fail"


@pytest.mark.parametrize("exact", [True, False])
def test_padding_never_changes_a_type(spark, exact):
    pad = " " * 70
    df = frame(spark, {
        "flag": [f"no{pad}", "yes", f"{pad}no"], "day": [f"2024-01-06{pad}", "2024-02-01", ""], "n": [f"{pad}7", "8", pad],
        "at": [f"{pad}2024-01-06 10:11:12", "2024-01-06 10:11:12", None], "word": [f"{pad}x", "y", "z"]})
    types = {r["column"]: (r["type"], r["nulls"]) for r in profile_columns(df, "t", exact).collect()}
    assert types == {"flag": ("boolean", 0), "day": ("date", 1), "n": ("integer", 1), "at": ("datetime", 1), "word": ("text", 0)}


def test_integers_beyond_38_digits_stay_text(spark):
    from smelter.operators.bronze import wide_integer_types
    df = frame(spark, {"huge": ["9" * 40, "1"], "wide": ["9" * 30, "2"], "plain": ["3", "4"]})
    types = {r["column"]: r["type"] for r in wide_integer_types(profile_columns(df, "t")).collect()}
    assert types == {"huge": "text", "wide": "wide_integer", "plain": "integer"}
    stored = cast_bronze(df, types).orderBy("_row_id").collect()
    assert stored[0]["huge"] == "9" * 40 and int(stored[0]["wide"]) == int("9" * 30)


def test_personal_data_are_found_beyond_the_first_rows(spark):
    n = 300
    df = frame(spark, {"reach": ["-" if i < 100 else f"u{i}@example.com" for i in range(n)],
                       "few": ["-" if i % 3 else f"u{i}@example.com" for i in range(n)]})
    assert {(r["column"], r["class"]) for r in detect_pii(df, profile_columns(df, "t"), "t").collect()} == {("reach", "email")}


def test_a_table_stored_by_column_is_profiled_column_by_column(spark, collect, tmp_path):
    frame(spark, COLUMNS).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    by_column = profile_columns(stored, "t", by_column=True)
    assert collect(by_column, "ordinal") == collect(profile_columns(stored, "t"), "ordinal")
    assert collect(profile_columns(stored.limit(0), "t", by_column=True), "ordinal") == collect(profile_columns(stored.limit(0), "t"), "ordinal")
    plan = by_column._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("ReadSchema: struct<") == plan.count("FileScan parquet") == len(COLUMNS)
    assert all("," not in part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:])


def test_governance_profiles_by_column_and_reads_stored_facts(spark):
    from checks.governance import _quality
    plan = _quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "ExistingRDD" in plan
