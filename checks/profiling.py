"""Type inference, profiles, keys, personal data, roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from smelter.functions import (is_email, is_id_like, is_integer_text, is_phone, is_real_text, pii_class_of_name)
from smelter.operators import (attach_pii_flags, candidate_keys, classify_columns, column_samples, confirm_keys,
                               detect_pii, dim_candidates, infer_types, profile_columns, quality_checks)
from smelter.plans import GoldContract, contracts_frame, metrics_frame, propose_metrics
from smelter.operators import to_classification
from smelter.session import pinned

from .registry import as_text, query, table

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SUPPLIER = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

_TYPE_SQL = r"""
    CASE WHEN count(v) = 0 THEN 'text'
         WHEN bool_and(lower(v) IN ('true','false','yes','no','y','n','t','f','0','1'))
              AND bool_or(lower(v) IN ('true','false','yes','no','y','n','t','f')) THEN 'boolean'
         WHEN bool_and(regexp_full_match(v, '[+-]?\d+')) THEN 'integer'
         WHEN bool_and(regexp_full_match(v, '[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?')) THEN 'real'
         WHEN bool_and(regexp_full_match(v, '\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}Z?')
                       AND try_cast(replace(replace(v, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
         WHEN bool_and(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%m/%d/%Y'),
                                try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d-%m-%Y')) IS NOT NULL) THEN 'date'
         ELSE 'text' END"""


def profile_sql(name: str, columns: list[str], source: str | None = None) -> str:
    """A common table expression body: the profile of a table, one SELECT per column."""
    parts = [f"""SELECT '{name}' AS "table", {i} AS ordinal, '{c}' AS "column", {_TYPE_SQL} AS type,
        count(*) AS "rows", count(*) - count(v) AS nulls,
        round(CAST(count(*) - count(v) AS DOUBLE) / count(*), 4) AS null_pct, count(DISTINCT v) AS "distinct",
        min(try_cast(v AS DOUBLE)) AS lo, max(try_cast(v AS DOUBLE)) AS hi
        FROM (SELECT nullif(trim(CAST("{c}" AS VARCHAR)), '') AS v FROM {source or name})"""
             for i, c in enumerate(columns)]
    body = " UNION ALL ".join(parts)
    return f"""SELECT "table", ordinal, "column", type, "rows", nulls, null_pct, "distinct",
        CASE WHEN type IN ('integer','real') THEN lo END AS "min", CASE WHEN type IN ('integer','real') THEN hi END AS "max"
        FROM ({body})"""


IS_KEY_SQL = """ "rows" > 1 AND "distinct" = "rows" AND nulls = 0 AND type NOT IN ('real','boolean') """
ID_SQL = r"""regexp_matches("column", '(?i)((^|_)(id|key|code|no|num|number|uuid|guid)($|_)|id$|key$|number$)')"""


def roles_sql(profile: str, divisor: int = 2) -> str:
    return f"""SELECT p."table", p.ordinal, p."column", p.type,
        CASE WHEN type IN ('date','datetime') AND ordinal = (SELECT min(ordinal) FROM {profile} q
                  WHERE q.type IN ('date','datetime') AND q."table" = p."table") THEN 'grain'
             WHEN type IN ('integer','real') AND NOT {ID_SQL} THEN 'measure'
             WHEN type IN ('text','boolean') AND NOT ({IS_KEY_SQL}) AND "distinct" > 1
                  AND "distinct" <= greatest(50, "rows" // {divisor}) THEN 'dim' ELSE 'none' END AS role,
        ({IS_KEY_SQL}) AS is_key
        FROM {profile} p"""


def _register_profile(name: str, columns: list[str]) -> None:
    @query(f"profile_{name}", profile_sql(name, columns))
    def run(spark, sf_dir):
        return profile_columns(as_text(table(spark, sf_dir, name)), name)


for _name, _columns in (("orders", ORDERS), ("customer", CUSTOMER), ("part", PART), ("lineitem", LINEITEM)):
    _register_profile(_name, _columns)


@query("profile_documents", profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def profile_documents(spark, sf_dir):
    """Whole texts: long values are compared by digest."""
    return profile_columns(as_text(table(spark, sf_dir, "documents")), "documents")


@query("infer_types_events", f"""SELECT ordinal, "column", type FROM ({profile_sql(
    "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])})""")
def infer_types_events(spark, sf_dir):
    return infer_types(as_text(table(spark, sf_dir, "events")))


@query("candidate_keys_part", f"""WITH p AS ({profile_sql("part", PART)})
    SELECT "table", ordinal, "column" FROM p WHERE {IS_KEY_SQL}""")
def candidate_keys_part(spark, sf_dir):
    return candidate_keys(profile_columns(as_text(table(spark, sf_dir, "part")), "part"))


@query("confirm_keys_orders", f"""WITH p AS ({profile_sql("orders", ORDERS)})
    SELECT ordinal, "column" FROM p WHERE {IS_KEY_SQL}""")
def confirm_keys_orders(spark, sf_dir):
    """Keys from the estimated profile, checked exactly."""
    text = as_text(table(spark, sf_dir, "orders"))
    return confirm_keys(text, pinned(profile_columns(text, "orders", exact=False)))


@query("samples_customer", " UNION ALL ".join(
    f"""SELECT {i} AS ordinal, '{c}' AS "column", string_agg(v, '|' ORDER BY k) AS samples FROM (
        SELECT CAST({c} AS VARCHAR) AS v, c_custkey AS k FROM customer WHERE trim(CAST({c} AS VARCHAR)) <> ''
        ORDER BY c_custkey LIMIT 3)""" for i, c in enumerate(CUSTOMER)))
def samples_customer(spark, sf_dir):
    samples = column_samples(table(spark, sf_dir, "customer"), 3, order=["c_custkey"], columns=CUSTOMER)
    return samples.withColumn("samples", F.array_join("samples", "|"))


@query("dim_candidates_part", f"""WITH p AS ({profile_sql("part", PART)})
    SELECT "table", ordinal, "column", "distinct" FROM p WHERE type IN ('text','boolean') AND NOT ({IS_KEY_SQL})
    AND "distinct" > 1 AND "distinct" <= greatest(50, "rows" // 4)""")
def dim_candidates_part(spark, sf_dir):
    return dim_candidates(profile_columns(as_text(table(spark, sf_dir, "part")), "part"))


def _register_roles(name: str, columns: list[str]) -> None:
    @query(f"column_roles_{name}", f"WITH p AS ({profile_sql(name, columns)}) {roles_sql('p')}")
    def run(spark, sf_dir):
        return classify_columns(profile_columns(as_text(table(spark, sf_dir, name)), name)).drop("class")


_register_roles("orders", ORDERS)
_register_roles("lineitem", LINEITEM)


@query("pii_scan_customer", """SELECT 'customer' AS "table", 1 AS ordinal, 'customer_name' AS "column",
    'name' AS class, 'flagged' AS action FROM customer HAVING count(c_name) > 0""")
def pii_scan_customer(spark, sf_dir):
    """Found by its column name."""
    df = as_text(table(spark, sf_dir, "customer").withColumnRenamed("c_name", "customer_name"))
    return detect_pii(df, pinned(profile_columns(df, "customer")), "customer")


_CONTACT = r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+\.[A-Za-z]+"
_CONTACT_AT_WORD = r"(?<![A-Za-z0-9._])[A-Za-z0-9._]++@[A-Za-z0-9.-]+\.[A-Za-z]+"  # the same matches, without retries


@query("pii_scan_documents", f"""SELECT 'documents' AS "table", 1 AS ordinal, 'reach' AS "column",
    'email' AS class, 'flagged' AS action FROM (
        SELECT regexp_extract(text, '{_CONTACT}') AS v FROM documents WHERE regexp_extract(text, '{_CONTACT}') <> ''
        ORDER BY doc_id LIMIT 50)
    HAVING avg(CASE WHEN regexp_full_match(v, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN 1.0 ELSE 0.0 END) > 0.6""")
def pii_scan_documents(spark, sf_dir):
    """Found by its values: the first address in each text, where there is one."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", _CONTACT_AT_WORD, 0).alias("reach"))
    return detect_pii(df, pinned(profile_columns(as_text(df), "documents")), "documents")


@query("attach_pii_customer", f"""WITH p AS ({profile_sql("customer", ["c_custkey", "customer_name", "c_mktsegment"],
    "(SELECT c_custkey, c_name AS customer_name, c_mktsegment FROM customer)")})
    SELECT "table", "column", "distinct", CASE WHEN "column" = 'customer_name' THEN 'name' END AS pii_class FROM p""")
def attach_pii_customer(spark, sf_dir):
    df = as_text(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customer_name"),
                                                         "c_mktsegment"))
    profile = pinned(profile_columns(df, "customer"))
    return attach_pii_flags(profile.select("table", "column", "distinct"),
                            detect_pii(df, profile, "customer"))


def quality_sql(name: str, columns: list[str]) -> str:
    return f"""SELECT s."table", unnest([s."table" || ' row_count > 0', s."table" || ' columns <50% null',
            s."table" || ' has a candidate key']) AS "check",
        unnest([CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN sparse IS NULL THEN 'pass' ELSE 'warn' END,
            CASE WHEN keys IS NULL THEN 'warn' ELSE 'pass' END]) AS result,
        unnest([n || ' rows', coalesce(sparse || ' >50% null', 'ok'), coalesce(keys, 'no unique non-null column')])
            AS detail
        FROM (SELECT "table", max("rows") AS n, string_agg("column", ', ' ORDER BY ordinal) FILTER (null_pct > 0.5)
              AS sparse, string_agg("column", ', ' ORDER BY ordinal) FILTER ({IS_KEY_SQL}) AS keys
              FROM ({profile_sql(name, columns)}) GROUP BY "table") s"""


QUALITY_TABLES = {"supplier": SUPPLIER, "customer": CUSTOMER, "part": PART, "orders": ORDERS, "lineitem": LINEITEM}


@query("quality_checks", " UNION ALL ".join(quality_sql(n, c) for n, c in QUALITY_TABLES.items()))
def all_quality_checks(spark, sf_dir):
    profiles = None
    for name in QUALITY_TABLES:
        one = profile_columns(as_text(table(spark, sf_dir, name)), name)
        profiles = one if profiles is None else profiles.unionByName(one)
    return quality_checks(profiles)


@query("proposed_metrics", f"""WITH p AS ({profile_sql("lineitem", LINEITEM)}), r AS ({roles_sql("p")}),
    d AS (SELECT string_agg("column", ',' ORDER BY ordinal) AS dims FROM r WHERE role = 'dim')
    SELECT "column" AS metric, 'sum' AS aggregation, "column" AS measure, 'agg_lineitem_daily' AS fact, dims,
        CASE WHEN type = 'integer' THEN 'count' ELSE '' END AS unit, CASE WHEN type = 'integer' THEN 0 ELSE 2 END AS round
    FROM r, d WHERE role = 'measure'
    UNION ALL SELECT 'lineitem', 'sum', 'lineitem_count', 'agg_lineitem_daily', dims, 'count', 0 FROM d""")
def proposed_metrics(spark, sf_dir):
    """Profile, roles, contract, proposed metrics, each bound to its fact by the contract."""
    df = as_text(table(spark, sf_dir, "lineitem"))
    roles = to_classification(classify_columns(profile_columns(df, "lineitem")))
    contract = GoldContract("agg_lineitem_daily", "fact", grain=f"{roles.grain}_day", dims=roles.dims,
                            measures=roles.measures, count_col="lineitem_count",
                            measure_types={m: roles.types[m] for m in roles.measures})
    facts = contracts_frame(spark, [contract]).select(F.col("table").alias("fact"), "dims")
    metrics = metrics_frame(spark, propose_metrics([contract]))
    return (metrics.withColumn("fact", F.element_at(F.split(F.col("rollups")["daily"], r"\."), -1))
            .join(facts, "fact")
            .select("metric", "aggregation", "measure", "fact", F.array_join("dims", ",").alias("dims"), "unit", "round"))


_WORDS = "SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+'))) AS word FROM documents"


@query("name_predicates_documents", rf"""SELECT word,
    regexp_matches(word, '((^|_)(id|key|code|no|num|number|uuid|guid)($|_)|id$|key$|number$)') AS id_like,
    CASE WHEN regexp_matches(word, 'e[-_]?mail') THEN 'email'
         WHEN regexp_matches(word, 'phone|mobile|msisdn|contact_no') THEN 'phone'
         WHEN regexp_matches(word, '(full|first|last|customer|user)[_ ]?name|^name$') THEN 'name'
         WHEN regexp_matches(word, 'address|street|pincode|zip|postal') THEN 'address'
         WHEN regexp_matches(word, 'aadhaar|(^|[^a-z])(ssn|pan)([^a-z]|$)|passport|national[_ ]?id') THEN 'id'
    END AS pii_class FROM ({_WORDS}) WHERE word <> ''""")
def name_predicates_documents(spark, sf_dir):
    """Every distinct word of all documents, tested as a column name."""
    words = (table(spark, sf_dir, "documents")
             .select(F.explode(F.split("text", "[^A-Za-z0-9_]+")).alias("word"))
             .select(F.lower("word").alias("word")).where("word <> ''").distinct())
    return words.select("word", is_id_like("word").alias("id_like"), pii_class_of_name("word").alias("pii_class"))


@query("value_predicates_orders", r"""SELECT o_orderkey,
    regexp_full_match(CAST(o_custkey AS VARCHAR), '[+-]?\d+') AS int_key,
    regexp_full_match(CAST(o_totalprice AS VARCHAR), '[+-]?\d+') AS int_price,
    regexp_full_match(CAST(o_totalprice AS VARCHAR), '[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?') AS real_price,
    regexp_full_match(lower(o_orderstatus) || '@' || o_orderpriority || '.example', '[^@\s]+@[^@\s]+\.[^@\s]+') AS mail,
    regexp_full_match('+' || CAST(o_orderkey + 100000000 AS VARCHAR) || ' 0' || o_orderpriority[1],
                      '\+?\d[\d\s\-]{7,}\d') AS phone FROM orders""")
def value_predicates_orders(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("k"), F.col("o_totalprice").cast("string").alias("p"),
        F.concat(F.lower("o_orderstatus"), F.lit("@"), "o_orderpriority", F.lit(".example")).alias("m"),
        F.concat(F.lit("+"), (F.col("o_orderkey") + 100000000).cast("string"), F.lit(" 0"),
                 F.substring("o_orderpriority", 1, 1)).alias("t"))
    return text.select("o_orderkey", is_integer_text("k").alias("int_key"), is_integer_text("p").alias("int_price"),
                       is_real_text("p").alias("real_price"), is_email("m").alias("mail"), is_phone("t").alias("phone"))
