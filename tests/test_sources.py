"""Raw readers on small files in each format."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from smelter.functions import label_from_id, table_ident
from smelter.operators import profile_columns
from smelter.sources.readers import read_text_table
from smelter.sources import (SourceError, discover_sources, read_documents, read_raw, reader_kind, sniff_delimiter,
                             union_ragged)


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_text(text, encoding=encoding)
    return str(path)


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("_row_id").select(*[f"`{c}`" for c in columns]).collect()]


def test_delimiters_bom_and_tabs(spark, tmp_path):
    cases = {"semicolon.csv": ("a;b\n1;x, y\n2;z\n", "utf-8"), "pipe.csv": ("a|b\n1|x, y\n2|z\n", "utf-8"),
             "bom.csv": ("a,b\n1,\"x, y\"\n2,z\n", "utf-8-sig"), "t.tsv": ("a\tb\n1\tx, y\n2\tz\n", "utf-8")}
    for name, (text, encoding) in cases.items():
        df = read_raw(spark, put(tmp_path, name, text, encoding))
        assert values(df, "a", "b") == [("1", "x, y"), ("2", "z")], name


def test_sniffer_prefers_the_regular_delimiter():
    assert sniff_delimiter('a;b\n"1;2";3\n') == ";"
    assert sniff_delimiter("single\nvalue\n") == ","
    assert sniff_delimiter("single\nvalue\n", "\t") == "\t"


def test_ragged_rows_are_kept_and_flagged(spark, tmp_path):
    df = read_raw(spark, put(tmp_path, "ragged.csv", "a,b\n1,x\n2,y,z\n3\n"))
    assert values(df, "a", "b") == [("1", "x"), ("2", "y"), ("3", None)]
    assert values(df, "a", "b", "_corrupt_record")[1] == ("2", "y", "2,y,z")
    assert profile_columns(df).count() == 2


def test_quoted_line_breaks_are_found(spark, tmp_path):
    df = read_raw(spark, put(tmp_path, "lines.csv", 'a,b\n1,"two\nlines"\n2,"say ""hi"""\n'))
    assert values(df, "a", "b") == [("1", "two\nlines"), ("2", 'say "hi"')]


def test_row_ids_follow_the_file_across_splits(spark, tmp_path):
    body = "".join(f"{i},{'x' * (i % 7)}\n" for i in range(20000))
    path = put(tmp_path, "long.csv", "n,t\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_raw(spark, path)
        assert df.rdd.getNumPartitions() > 3
        got = [int(r["n"]) for r in df.orderBy("_row_id").select("n").collect()]
        assert got == list(range(20000))
        assert df.select("_row_id").distinct().count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_roots(spark, tmp_path):
    wrapped = put(tmp_path, "wrapped.json", json.dumps(
        {"meta": 1, "tags": ["x"], "zeta": [{"id": 1, "ok": True}, {"id": 2, "ok": None}], "alpha": [{"other": 1}]}))
    assert values(read_raw(spark, wrapped), "id", "ok") == [("1", "true"), ("2", None)]
    single = read_raw(spark, put(tmp_path, "single.json", json.dumps({"b": 1.50, "a": {"c": "x"}}, indent=2)))
    assert single.columns[:2] == ["b", "a.c"] and values(single, "b", "a.c") == [("1.5", "x")]
    scalars = read_raw(spark, put(tmp_path, "scalars.json", "[1, \"two\", true]"))
    assert values(scalars, "value") == [("1",), ("two",), ("true",)]
    lines = read_raw(spark, put(tmp_path, "scalars.jsonl", '1\n"two"\n'))
    assert values(lines, "value") == [("1",), ("two",)]
    with pytest.raises(SourceError):
        read_raw(spark, put(tmp_path, "bare.json", "42"))


def test_nested_ndjson_keeps_first_seen_order(spark, tmp_path):
    lines = ['{"z": 1, "a": {"y": {"q": "deep"}, "b": null}, "list": [1, 2.5], "flag": false}', "",
             '{"z": 10000000000, "new": "late", "a": {"b": 0.10}}']
    df = read_raw(spark, put(tmp_path, "nested.ndjson", "\n".join(lines)))
    assert df.columns[:6] == ["z", "a.y.q", "a.b", "list", "flag", "new"]
    rows = values(df, "z", "a.y.q", "a.b", "flag", "new")
    assert rows == [("1", "deep", None, "false", None), ("10000000000", None, "0.1", None, "late")]
    assert json.loads(values(df, "list")[0][0]) == [1, 2.5]


def test_xml_records(spark, tmp_path):
    text = """<?xml version="1.0"?><shop open="yes"><note>hello</note>
      <item id="1" kind="a"><name> pen </name><size unit="cm"><w>1</w>big</size><name>pencil</name></item>
      <item id="2" kind="b"><name lang="en">ink</name></item></shop>"""
    df = read_raw(spark, put(tmp_path, "records.xml", text))
    assert df.columns[:5] == ["id", "kind", "name", "size.unit", "size"]
    assert values(df, "id", "kind", "name", "size.unit", "size") == [("1", "a", "pencil", "cm", "big"),
                                                                    ("2", "b", "ink", None, None)]
    with pytest.raises(SourceError):
        read_raw(spark, put(tmp_path, "broken.xml", "<a><b></a>"))


def workbook(path, rows, strings):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join(
        "<row>" + "".join(f'<c r="{ref}"' + (f' t="s"><v>{strings.index(v)}</v></c>' if v in strings else f"><v>{v}</v></c>")
                          for ref, v in row) + "</row>" for row in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    workbook(path, [[("A1", "name"), ("C1", "size")], [("A2", "pen"), ("B2", "7"), ("C2", "1.5")], [("C3", "2")]],
             ["name", "size", "pen"])
    df = read_raw(spark, str(path))
    assert df.columns[:3] == ["name", "col_1", "size"]
    assert values(df, "name", "col_1", "size") == [("pen", "7", "1.5"), ("", "", "2")]
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    with pytest.raises(SourceError):
        read_raw(spark, str(tmp_path / "bad.xlsx"))


def test_documents(spark, tmp_path):
    put(tmp_path, "a.txt", " one\ntwo \n")
    assert [(r["source"], r["text"]) for r in read_documents(spark, str(tmp_path)).collect()] == [("a.txt", "one\ntwo")]


def test_discovery_and_dispatch(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.CSV", "a.json", "skip.txt", "deep/c.jsonl"):
        put(tmp_path, name, "x\n1\n")
    found = [r["path"].rsplit("/", 1)[-1] for r in discover_sources(spark, [str(tmp_path)]).orderBy("path").collect()]
    assert found == ["a.json", "b.CSV", "c.jsonl"]
    assert reader_kind("x/y.TIFF") == "image" and reader_kind("x.doc") is None
    for name in ("x.pdf", "x.png", "x.doc"):
        with pytest.raises(SourceError):
            read_raw(spark, name)


def test_bad_sources_are_reported_and_the_rest_is_built(spark, tmp_path):
    from smelter.plans.medallion import run_medallion
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "good.csv", "id,day,amount\n1,2024-01-01,5\n2,2024-01-02,7\n")
    put(folder, "scan.pdf", "%PDF")
    put(folder, "broken.xml", "<a><b></a>")
    put(folder, "header_only.csv", "code,label\n")
    run = run_medallion(spark, [str(folder)], str(tmp_path / "out"))
    assert run.status == "partial" and {n for n, _ in run.skipped} == {"scan.pdf", "broken.xml"}
    assert [c.table for c in run.contracts] == ["agg_good_daily", "dim_header_only"]
    checks = {r["check"]: r["result"] for r in run.audit("quality").collect()}
    assert checks["header_only row_count > 0"] == "fail" and checks["good row_count > 0"] == "pass"
    assert run.governance()["verdict"].first()["governed"] is False


def test_names():
    assert table_ident("2024 Sales-Q1") == "t_2024_sales_q1"
    assert table_ident("orders", ["orders", "orders_x"]) == "orders_x_x"
    assert label_from_id("order_count") == "Order Count"


def test_ragged_union_keeps_first_seen_order(spark):
    a = spark.sql("SELECT 1 AS x, 2 AS y")
    b = spark.sql("SELECT 3 AS z, 4 AS x")
    merged = union_ragged([a, b])
    assert merged.columns == ["x", "y", "z"]
    assert merged.where(F.col("y").isNull()).first().asDict() == {"x": 4, "y": None, "z": 3}


def test_files_of_a_folder_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, y"\n2,z\n')
    (tmp_path / "b.csv").write_text("name,id,extra\nw,3,more\n")
    df = read_text_table(spark, str(tmp_path))
    rows = {(r["id"], r["name"], r["extra"]) for r in df.collect()}
    assert rows == {("1", "x, y", None), ("2", "z", None), ("3", "w", "more")}
    assert df.select("_source_file", "_row_id").distinct().count() == 3


def test_row_ids_of_a_compressed_file_in_many_splits(spark, tmp_path):
    import bz2
    path = tmp_path / "n.csv.bz2"
    path.write_bytes(bz2.compress(("n\n" + "\n".join("7" * 3 for _ in range(1_200_000)) + "\n").encode(), 1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = read_text_table(spark, str(path), multiline=False)
        assert df.rdd.getNumPartitions() > 1
        assert df.select("_row_id").distinct().count() == 1_200_000 == df.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def small_splits(spark):
    """Scans in splits of a few bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted_rows(n):
    texts = ["plain", "two\nlines", 'say ""hi""', "a, b", "", '""', "\n\n", "x" * 300, 'three\n""more""\nlines,\n', "end"]
    return "".join(f'{i},"{texts[i * 7 % 10]}",{["t", "", "5 inch"][i % 3]}\n' for i in range(n))


def test_quoted_line_breaks_over_many_splits_equal_one_task(spark, tmp_path, small_splits):
    path = put(tmp_path, "many.csv", "id,text,note\n" + quoted_rows(400))
    df = read_raw(spark, path)
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    got = df.orderBy("_row_id").select("id", "text", "note").collect()
    assert [int(r["id"]) for r in got] == list(range(400))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    ids = [r["_row_id"] for r in df.select("_row_id").orderBy("_row_id").collect()]
    assert len(set(ids)) == 400 and ids == [r["_row_id"] for r in read_raw(spark, path).select("_row_id").orderBy("_row_id").collect()]


def test_quotes_inside_plain_fields_open_nothing(spark, tmp_path, small_splits):
    body = "".join(f'{i},5" pipe,"a\nb"\n' if i % 3 else f'{i},x"y"z,"c"\n' for i in range(120))
    rows = values(read_raw(spark, put(tmp_path, "inch.csv", "id,size,text\n" + body)), "id", "size", "text")
    assert rows == [(str(i), '5" pipe' if i % 3 else 'x"y"z', "a\nb" if i % 3 else "c") for i in range(120)]


def test_crlf_files_with_quoted_line_breaks(spark, tmp_path):
    rows = values(read_raw(spark, put(tmp_path, "crlf.csv", 'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n').replace("\n", "\n")), "a", "b")
    assert rows == [("1", "x\r\ny"), ("2", "z")]


def test_differing_headers_with_quoted_line_breaks_and_rows_like_the_header(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,name\n1,"x\ny"\nid,name\n2,z\n')
    (tmp_path / "b.csv").write_text("\nname,id,extra\nw,3,more\nname,id,extra\n")
    rows = {(r["id"], r["name"], r["extra"]) for r in read_text_table(spark, str(tmp_path)).collect()}
    assert rows == {("1", "x\ny", None), ("id", "name", None), ("2", "z", None), ("3", "w", "more"), ("id", "name", "extra")}
    (tmp_path / "a.csv").write_text("id,name\nid,name\n2,z\n")
    rows = sorted((r["id"], r["name"], r["extra"]) for r in read_text_table(spark, str(tmp_path)).select("id", "name", F.coalesce("extra", F.lit("")).alias("extra")).collect())
    assert rows == [("2", "z", ""), ("3", "w", "more"), ("id", "name", ""), ("id", "name", "extra")]
    (tmp_path / "b.csv").unlink()
    assert sorted(r["id"] for r in read_text_table(spark, str(tmp_path)).collect()) == ["2", "id"]


def test_json_arrays_over_many_splits(spark, tmp_path, small_splits):
    rows = [{"id": i, "text": ["a, b", 'q"[{', "back\\slash\\", "]}", "x" * 500, ""][i % 6], "list": [i, [1, {"k": "]"}]], "o": {"p": i / 2}}
            for i in range(300)]
    for name, indent in (("flat.json", None), ("deep.json", 3)):
        df = read_raw(spark, put(tmp_path, name, "﻿" * (indent is None) + json.dumps(rows, indent=indent)))
        got = values(df, "id", "text", "o.p")
        assert [int(g[0]) for g in got] == list(range(300))
        assert [g[1] for g in got] == [r["text"] for r in rows] and [float(g[2]) for g in got] == [r["o"]["p"] for r in rows]
    scalars = values(read_raw(spark, put(tmp_path, "scalars.json", json.dumps([f"v,{i}" for i in range(200)]))), "value")
    assert scalars == [(f"v,{i}",) for i in range(200)]
    assert read_raw(spark, put(tmp_path, "nested.json", "[[1, 2], [3], []]")).count() == 3


def test_json_roots_of_a_folder_differ(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    put(folder, "a.json", '[{"id": 1, "x": "p"}, {"id": 2}]')
    put(folder, "b.json", '{"rows": [{"id": 3, "y": "q"}], "note": "n"}')
    put(folder, "c.json", '  {"id": 4}')
    put(folder, "d.json", "[ ]")
    from smelter.sources.readers import read_json_document
    df = read_json_document(spark, str(folder))
    assert sorted((r["id"], r["x"], r["y"]) for r in df.na.fill("").collect()) == [("1", "p", ""), ("2", "", ""), ("3", "", "q"), ("4", "", "")]
    put(folder, "e.json", "42")
    with pytest.raises(SourceError):
        read_json_document(spark, str(folder))


@pytest.mark.parametrize("few", [True, False])
def test_states_meet_pieces_by_either_join(spark, tmp_path, small_splits, monkeypatch, few):
    from smelter.sources import splits
    monkeypatch.setattr(splits, "BROADCAST_SPLITS", 10 ** 6 if few else 0)
    path = put(tmp_path, "j.csv", "id,text,note\n" + quoted_rows(150))
    assert [int(v[0]) for v in values(read_raw(spark, path), "id")] == list(range(150))


def test_xml_records_over_many_splits_without_a_tag(spark, tmp_path, small_splits):
    items = "".join(f'<x:item id="{i}" n:kind="k"><name lang="en">n{i}</name><!-- > <no> --><box w="1"><in>{i}</in></box>'
                    f'<raw><![CDATA[a > b]]></raw>{"<flag/>" if i % 2 else ""}</x:item>\n' for i in range(120))
    text = f'<?xml version="1.0"?>\n<!DOCTYPE shop>\n<shop open="yes"><note>x</note>{items}<note>y</note></shop>'
    df = read_raw(spark, put(tmp_path, "many.xml", text.replace("x:item", "item").replace("n:kind", "kind")))
    assert df.columns[:5] == ["id", "kind", "name", "box.w", "raw"] or df.columns[:4] == ["id", "kind", "name", "box.w"]
    assert sorted(int(r["id"]) for r in df.collect()) == list(range(120))
    assert {(r["kind"], r["box.w"], r["raw"]) for r in df.select("kind", F.col("`box.w`"), "raw").collect()} == {("k", "1", "a > b")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan
    for broken in ("<a><b></a>", "<a>", "</a>"):
        with pytest.raises(SourceError):
            read_raw(spark, put(tmp_path, "broken.xml", broken))


def test_order_of_names_is_found_by_hashing(spark):
    """The first place of a name is the least over files, rows and places; no task sorts the names of all its records."""
    from smelter.sources.readers import _first_places
    lines = [("f2", 1, '{"b": 1, "a": {"y": 1}}'), ("f1", 9, '{"c": 1, "b": 2}'), ("f1", 12, '{"b": 1, "a": {"x": 1, "y": 2}}'), ("f1", 13, "no object")]
    df = spark.createDataFrame(lines, "_source_file string, _row_id long, record string")
    found = _first_places(df, ["$", "$['a']"])
    assert {(r["path"], r["key"]): (r["first"][0][0], r["first"][0][1], r["first"]["pos"]) for r in found.collect()} == {
        ("$", "b"): ("f1", 9, 1), ("$", "c"): ("f1", 9, 0), ("$", "a"): ("f1", 12, 1), ("$['a']", "x"): ("f1", 12, 0), ("$['a']", "y"): ("f1", 12, 1)}
    first = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "HashAggregate(keys=[_source_file" in [line for line in first if "Aggregate(" in line][-1]


def test_documents_are_cut_once(spark, tmp_path):
    """Elements and objects are stored: the rows hold no cutting of texts any more."""
    from smelter.sources.readers import read_json_document
    (tmp_path / "a.json").write_text('[{"k": "1, [x", "n": 2}, {"k": "y", "n": 3}]')
    (tmp_path / "b.json").write_text('{"k": "z", "n": 4}')
    read = read_json_document(spark, str(tmp_path))
    assert sorted((r["k"], r["n"]) for r in read.collect()) == [("1, [x", "2"), ("y", "3"), ("z", "4")]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Relation" not in plan


def test_pieces_of_a_document_at_once_as_one_by_one():
    import random

    from smelter.sources.splits import ArrayElements, _steps
    scanner, draw = ArrayElements(), random.Random(5)
    for _ in range(20_000):
        pieces = "".join(draw.choice('ab"\\,[]{}\n') for _ in range(draw.randrange(14))).split(",")
        for start in (False, True):
            assert scanner.steps(start, pieces) == _steps(scanner, start, pieces), pieces
