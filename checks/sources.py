"""Tables written in the raw formats and read back with the raw readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from smelter.operators import cast_bronze
from smelter.session import scratch_path
from smelter.sources import read_documents, read_json_document, read_json_lines, read_text_table, read_xml

from .registry import query, table


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("read_csv_orders", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
    o_orderpriority FROM orders""")
def read_csv_orders(spark, sf_dir):
    """Semicolons, to be found out; quoted values; all columns."""
    path = scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").select(*_ORDERS).write.option("header", True).option("sep", ";").option("quoteAll", True).csv(path)
    types = {"o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "real"}
    read = cast_bronze(read_text_table(spark, path), types).select(*_ORDERS)
    return read.withColumn("o_orderdate", F.to_date(F.substring("o_orderdate", 1, 10)))


@query("read_json_orders", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
    o_orderpriority FROM orders""")
def read_json_orders(spark, sf_dir):
    """Documents whose root is an array of some thousand orders, beside documents whose root is one order."""
    orders = table(spark, sf_dir, "orders").select(*_ORDERS)
    parts = max(1, orders.count() // 20000)
    path = scratch_path(spark, "orders-json")
    record = F.struct(*[F.col(c).cast("string").alias(c) for c in _ORDERS])
    single = F.col("o_orderkey") % 5000 == 0
    part = F.pmod(F.xxhash64("o_orderkey"), F.lit(parts))
    arrays = orders.where(~single).groupBy(part.alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    objects = orders.where(single).select((F.col("o_orderkey") + parts).alias("part"), F.to_json(record).alias("value"))
    arrays.unionByName(objects).repartition(8, "part").write.partitionBy("part").text(path)
    raw = read_json_document(spark, path)
    types = {"o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "real"}
    return cast_bronze(raw, types).select(*_ORDERS[:4], F.to_date(F.substring("o_orderdate", 1, 10)).alias("o_orderdate"), "o_orderpriority")


@query("read_tsv_documents", """SELECT doc_id, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS digest,
    lang FROM documents""")
def read_tsv_documents(spark, sf_dir):
    """Whole texts with line breaks, quotes and tabs in them."""
    path = scratch_path(spark, "documents-tsv")
    (table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
     .write.option("header", True).option("sep", "\t").option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    raw = read_text_table(spark, path, "\t", delimiter="\t")
    spaces = F.lit(" \t\n\r")
    return raw.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.btrim("text", spaces)).alias("digest"), "lang")


@query("read_ndjson_events", """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS "what.kind",
    json_extract_string(props, '$.k') AS "what.props.k", '[' || CAST(user_id AS VARCHAR) || ']' AS users FROM events""")
def read_ndjson_events(spark, sf_dir):
    path = scratch_path(spark, "events-ndjson")
    nested = table(spark, sf_dir, "events").select(
        "event_id", F.struct(F.col("event_type").alias("kind"),
                             F.from_json("props", "struct<k:bigint>").alias("props")).alias("what"),
        F.array("user_id").alias("users"))
    nested.write.json(path)
    return read_json_lines(spark, path).drop("_row_id", "_source_file", "_corrupt_record")


@query("read_xml_suppliers", """SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name,
    CAST(s_nationkey AS VARCHAR) AS nation FROM supplier""")
def read_xml_suppliers(spark, sf_dir):
    path = scratch_path(spark, "supplier-xml")
    (table(spark, sf_dir, "supplier")
     .select(F.col("s_suppkey").alias("_key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
     .write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").option("attributePrefix", "_")
     .save(path))
    return read_xml(spark, path, record_tag="supplier").select("key", "name", "nation")


@query("read_xml_suppliers_found", """SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name,
    CAST(s_nationkey AS VARCHAR) AS nation, s_acctbal AS balance FROM supplier""")
def read_xml_suppliers_found(spark, sf_dir):
    """All columns; which tag the records have is found out."""
    path = scratch_path(spark, "supplier-xml")
    (table(spark, sf_dir, "supplier")
     .select(F.col("s_suppkey").alias("_key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
     .write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").option("attributePrefix", "_")
     .save(path))
    return read_xml(spark, path).select("key", "name", "nation", F.col("balance").cast("double").alias("balance"))


_VISIBLE = "[^A-Za-z0-9.,]"


@query("read_documents", f"""SELECT coalesce(lang, 'none') AS lang, CAST(sum(length(regexp_replace(coalesce(text, ''), '{_VISIBLE}', '', 'g')))
    AS BIGINT) AS characters FROM documents GROUP BY 1""")
def read_document_files(spark, sf_dir):
    """Files of some thousand whole texts per language, read back as whole documents; what is visible of each is counted."""
    path = scratch_path(spark, "documents-text")
    texts = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.coalesce("lang", F.lit("none")).alias("lang"))
    texts.write.option("maxRecordsPerFile", 5000).partitionBy("lang").text(path)
    documents = read_documents(spark, path).withColumn("lang", F.regexp_extract("_source_file", "lang=([^/]+)", 1))
    seen = F.char_length(F.regexp_replace("text", _VISIBLE, ""))
    return documents.groupBy("lang").agg(F.sum(seen).cast("bigint").alias("characters"))
