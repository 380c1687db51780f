import base64
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom import catalog, queries, synth
from factloom.functions.evidence import gcd
from factloom.operators import report, sink
from factloom.operators.probe import probe, with_facts
from factloom.operators.routing import route
from factloom.sources import inputs, manifest, packages, pdf_objects, ranges
from factloom.sources.objects import logical_tables, object_rows, ordered_sheets, type_counts
from factloom.streaming import jsonl

DIR = "/root/testdata/sf0.001"
TYPES = queries.TYPES


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    for t in ("events", "documents", "customer", "supplier", "part", "orders"):
        duckdb.sql(f"create or replace view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    wanted = duckdb.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))


def test_route_of_nulls_and_slashes(spark):
    rows = spark.createDataFrame([(None, None), (".pdf", b"%PDF-1.7"), ("a/B.PDF", b"%PDF-1.7"), ("a.pdf/", b"%PDF-1.7")], "display_name string, content binary")
    got = route(rows).collect()
    assert [r["error_code"] for r in got] == ["UNSUPPORTED_FORMAT", "UNSUPPORTED_FORMAT", None, None]
    assert [r["exit_code"] for r in got] == [3, 3, 0, 0] and got[0]["error_message"] == "unsupported format: input filename has no extension"
    forced = route(rows, forced="word").collect()
    assert forced[2]["error_code"] == "INVALID_REQUEST" and forced[2]["exit_code"] == 1 and forced[0]["error_code"] == "UNSUPPORTED_FORMAT"


def test_text_stats_follow_unicode_white_space(spark, tmp_path):
    spark.createDataFrame([(1, "a\n\t\nb\n\r\nc"), (2, "a\u00a0b \u3000 c\n\u2003"), (3, ""), (4, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_lines"]) for r in queries.text_stats(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 3), 2: (3, 1), 3: (0, 0), 4: (None, None)}


def word(*parts, body="<w:document xmlns:w='w'><w:p/></w:document>", types=TYPES.format(catalog.MIME["docx"])):
    return synth.zip_bytes([("[Content_Types].xml", types), ("word/document.xml", body), *parts])


def asked(spark, files, wanted, **how):
    rows = spark.createDataFrame([(k, n, len(c), bytearray(c)) for k, (n, c) in enumerate(files)], "input_id int, display_name string, file_size bigint, content binary")
    return [(r["status"], r["error_code"], {e["target"]: e["value"] for e in r["results"]}) for r in sorted(probe(rows, wanted, **how).collect(), key=lambda r: r["input_id"])]


ASSETS = TYPES.format(catalog.MIME["docx"]).replace("</Types>", '<Override PartName="/word/media/Clip.BIN" ContentType="image/jpeg"/><Default Extension="PNG" ContentType="IMAGE/PNG"/></Types>')


def test_word_packages(spark):
    rels = lambda x: ("word/_rels/document.xml.rels", f"<Relationships>{x}</Relationships>")
    files = [
        ("a.docx", word(("docProps/core.xml", "<c xmlns:d='d'><d:title>A &amp; B</d:title><d:title> </d:title></c>"), ("word/media/a.png", "x"), ("word/media/A.PNG", "x"), ("word/media/clip.bin", "x"), ("word/media/c", "x"), types=ASSETS)),
        ("b.docx", word(rels('<Relationship Type="http://a/OLEObject" TargetMode="External"/>'), body="<w:document xmlns:w='w'><w:p/><w:tbl/><w:p>")),
        ("c.docx", word(rels("<broken"))),
        ("d.docx", word(("x/VBAProject.bin", "m"), types=TYPES.format(catalog.MIME["xlsx"]))),
        ("e.docx", synth.zip_bytes([("word/document.xml", "<a/>")])),
        ("f.docx", word()[:60]),
        ("g.docx", word(body=b"<a>\xff</a>")),
        ("h.docx", word(body="<!DOCTYPE a [<!ENTITY x 'y'>]><a><p/></a>")),
        ("i.docx", b"PK\x03\x04"),
    ]
    got = asked(spark, files, ["title", "unique_image_asset_count", "has_embedded_files", "has_external_relationships", "paragraph_count", "active_content_risk"], level="deep")
    assert got[0][2] == {"document.title": '"A & B"', "security.active_content_risk": '"none"', "security.has_embedded_files": "false", "security.has_external_relationships": "false", "word.paragraph_count": "1", "word.unique_image_asset_count": "2"}
    assert got[1][2]["word.paragraph_count"] == "2" and got[1][2]["security.has_embedded_files"] == "false" and got[1][2]["security.active_content_risk"] == '"low"'
    assert [g[1] for g in got] == [None, None, *["MALFORMED_INPUT"] * 5, None, "MALFORMED_INPUT"]
    assert got[7][2]["word.paragraph_count"] == "0" and got[1][0] == "partial"


def test_bounds_are_errors(spark):
    files = [("a.docx", word(body="<p>" + "x" * 100_000 + "</p>"))]
    assert asked(spark, files, ["paragraph_count"], level="deep", max_bytes=1000)[0][1] == "BUDGET_EXCEEDED" and asked(spark, files, ["@header"], max_entries=1)[0][1] == "BUDGET_EXCEEDED"


def test_requests():
    assert catalog.expand("docx", ["title, @security"]) >= {"document.title", "security.encrypted"}
    assert catalog.expand("pptx", ["notes_count"]) == {"powerpoint.notes_slide_count"} and catalog.aliases("pdf")["mime"] == "document.mime_type"
    for wanted, code in ((["nothing"], "UNSUPPORTED_TARGET"), ([" , "], "INVALID_REQUEST"), (["@format"], "INVALID_REQUEST")):
        with pytest.raises(catalog.RequestError) as e:
            catalog.expand("docx", wanted, "header")
        assert e.value.code == code
    made = catalog.request("pdf", ["version"], ["version", "title"], overrides={"version": "x"})
    assert made["required"] == ["pdf.version"] and made["optional"] == ["document.title"] and made["floors"]["pdf.version"] == "exact"
    assert catalog.value_schema("u64|null") == {"type": ["integer", "null"], "minimum": 0} and catalog.value_schema("other") == {}


def test_reports(spark):
    pdf, doc = b"%PDF-1.7x\n/Linearized", synth.cfb_bytes({"WordDocument": b"w", "Big": b"b" * 9000, "\x05SummaryInformation": synth.property_set({2: "Te\"st", 15: 42})})
    rows = spark.createDataFrame([(1, "a.pdf", bytearray(pdf)), (2, "b.doc", bytearray(doc)), (3, "c.docx", bytearray(synth.cfb_bytes({"EncryptionInfo": b"", "EncryptedPackage": b"x"}))), (4, "d.xls", bytearray(doc)), (5, "e.txt", None), (6, "f.doc", bytearray(doc[:700]))], "k int, display_name string, content binary")
    found = probe(rows.withColumn("file_size", F.octet_length("content").cast("bigint")), ["version", "title", "word_count", "linearized", "has_javascript", "encrypted"], overrides=None, level="metadata").collect()
    assert {r["error_code"] for r in found if r["k"] < 4} == {"UNSUPPORTED_TARGET"}
    out = probe(rows.withColumn("file_size", F.octet_length("content").cast("bigint")), ["title", "encrypted"], ["file_size"])
    lines = {r["k"]: json.loads(r["value"]) for r in report.lines(out, "values", "k").collect()}
    assert lines[2]["values"]["document.title"] == 'Te"st' and lines[2]["status"] == "partial" and lines[2]["unresolved_targets"] == ["security.encrypted"]
    assert lines[3]["values"]["security.encrypted"] is True and lines[4]["error"]["code"] == lines[6]["error"]["code"] == "MALFORMED_INPUT" and lines[5]["error"]["exit_code"] == 3
    full = {r["k"]: json.loads(r["value"]) for r in report.lines(out, "full", "k").collect()}
    assert full[2]["results"]["document.file_size"]["value"] == len(doc) and [d["code"] for d in full[2]["diagnostics"]] == ["UNRESOLVED_TARGET"]
    assert report.exit_status(out).collect()[0][0] == 4
    exact = probe(rows.where("k = 1").withColumn("file_size", F.lit(9).cast("bigint")), ["linearized"], level="metadata", overrides={"linearized": "exact"})
    wide = report.typed(exact, {"pdf.linearized": "bool"}, "k").collect()[0]
    assert wide["pdf_linearized"] is True and exact.collect()[0]["diagnostics"][0]["message"] == "pdf.linearized resolved at high, below requested exact"
    planned = probe(rows.where("k = 1").withColumn("file_size", F.lit(9).cast("bigint")), ["linearized"], plan_only=True).collect()[0]
    assert planned["results"][0]["status"] == "planned" and planned["status"] == "ok"


def test_iwork_packages(spark):
    m, ref = synth.message, synth.reference
    pages = [(1, 10000, m((4, ref(5)))), (5, 2001, m((3, "one\ntwo"), (3, "\U0001F600"))), (6, 10011, m((26, "a\x01")))]
    files = [
        ("a.pages", synth.iwork_bytes(pages)), ("b.key", synth.iwork_bytes(pages)), ("c.pages", synth.zip_bytes([("index.apxl", "x")])), ("d.pages", synth.zip_bytes([("x", "x")])),
        ("e.pages", synth.zip_bytes([("Index/Document.iwa", b"\x09\x01\x00\x00x")])), ("f.pages", synth.zip_bytes([("Index/Document.iwa", synth.iwa(pages)[:-1])])), ("g.pages", synth.zip_bytes([("Index/Document.iwa", synth.iwa(pages, True))])),
    ]
    got = asked(spark, files, ["@all"], level="deep")
    assert got[0][2]["pages.body_text_length"] == "9" and got[0][2]["pages.page_size"] == "null" and got[0][2]["pages.section_names"] == "[]" and got[0][0] == "ok"
    assert [g[1] for g in got] == [None, "MALFORMED_INPUT", "UNSUPPORTED_FORMAT", *["MALFORMED_INPUT"] * 4]


def test_decoders_alone():
    assert packages.unpacked(b"\x01\x02\x00\x00ab" + b"\x01\x01\x00\x00c", 10) == b"abc"
    for bad in (b"\x09\x01\x00\x00x", b"\x01\x05\x00\x00x", b"\x01"):
        with pytest.raises(packages.Damaged):
            packages.unpacked(bad, 10)
    assert next(packages.archive(synth.iwa([(42, 2, synth.message((1, "Sheet 1")))], True)[4:], True))["fields"][0]["s"] == "Sheet 1"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04xx\xff\xc0\x00\x0b\x08\x01\xe0\x02\x80\x03xxx"
    assert packages.dimensions(jpeg) == (640, 480) and packages.dimensions(b"\xff\xd8\xff") == (None, None)
    with pytest.raises(packages.Damaged):
        packages.varint(b"\xff" * 11, 0)
    assert packages.summary(synth.property_set({2: "Test", 15: 42})) == {2: "Test", 15: "42"} and packages.summary(b"") == {}


def test_files_and_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4")
    found = inputs.files(spark, str(tmp_path / "in"))
    assert [(r["display_name"], r["file_size"]) for r in found.collect()] == [("a.pdf", 8)]
    path = str(tmp_path / "in" / "a.pdf")
    data = base64.b64encode(b"%PDF-1.5").decode()
    lines = [json.dumps(path), json.dumps({"path": path, "name": "b.docx"}), json.dumps({"path": "/none.pdf"}), json.dumps({"name": "c.pdf", "data_base64": data}), json.dumps({"name": 5, "data_base64": data}), "[]", " ", json.dumps({"name": "c.pdf", "data_base64": data, "path": path})]
    recs = inputs.records(spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, value string"))
    got = {r["line_no"]: (r["display_name"], r["error_code"]) for r in inputs.with_files(recs, found).collect()}
    assert got == {1: ("a.pdf", None), 2: ("b.docx", None), 3: ("none.pdf", "SOURCE_IO"), 4: ("c.pdf", None), 5: (None, "INVALID_REQUEST"), 6: (None, "INVALID_REQUEST"), 8: (None, "INVALID_REQUEST")}
    assert inputs.within(found, 3).collect()[0]["error_code"] == "BUDGET_EXCEEDED"
    made = {r["line_no"]: json.loads(r["value"]) for r in jsonl.reports(spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, value string"), known_files=found, wanted=["@header"]).collect()}
    assert made[1]["results"]["pdf.version"]["value"] == "1.4" and made[2]["error"]["code"] == "MALFORMED_INPUT" and made[3]["error"]["exit_code"] == 2


def deck(spark, tmp_path, pictures=290_000):
    """A deck as the rows of a manifest and as bytes."""
    (tmp_path / "in").mkdir(exist_ok=True)
    core, app = "<c xmlns:d='d'><d:title>T</d:title></c>", "<Properties><Slides>7</Slides></Properties>"
    data = synth.zip_bytes([("ppt/media/a.png", random.Random(1).randbytes(pictures)), ("[Content_Types].xml", TYPES.format(catalog.MIME["pptx"])), ("ppt/presentation.xml", "<p><sldId/><sldId/></p>"), ("docProps/app.xml", app), ("docProps/core.xml", core), ("_rels/.rels", "<r/>")])
    (tmp_path / "in" / "deck.pptx").write_bytes(data)
    (tmp_path / "in" / "box.doc").write_bytes(synth.cfb_bytes({"WordDocument": b"w" * 70_000, "\x05SummaryInformation": synth.property_set({2: "Boxed", 15: 42})}))
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.6\n/Linearized\nxref")
    (tmp_path / "in" / "a.pages").write_bytes(synth.iwork_bytes([(1, 10000, b"")], {"language": "en"}, None, [("Data/a.png", b"x" * 50_000)]))
    with (tmp_path / "in" / "huge.pdf").open("wb") as f:
        f.write(b"%PDF-1.5")
        f.truncate(3 << 30)
    return manifest.inputs(manifest.listed(spark, str(tmp_path / "in"))).where("display_name <> 'huge.pdf'")


def test_ranges_give_what_whole_files_give(spark, tmp_path):
    by_path = deck(spark, tmp_path)
    whole = inputs.files(spark, str(tmp_path / "in"), "[!h]*")
    for level in ("header", "metadata", "deep"):
        found = [{r["display_name"]: (r["error_code"], [tuple(e) for e in r["results"]]) for r in probe(x, ["@all"], level=level).collect()} for x in (by_path, whole)]
        assert found[0] == found[1] and len(found[0]) == 4
    read = {r["display_name"]: r for r in probe(by_path, ["title", "slide_count"], level="metadata", forced=None).collect()}
    assert read["deck.pptx"]["bytes_read"] < 18_000 and read["deck.pptx"]["file_size"] > 290_000 and read["deck.pptx"]["reads"] > 3
    assert {e["target"]: e["value"] for e in read["deck.pptx"]["results"]} == {"document.title": '"T"', "powerpoint.slide_count": "2"}
    assert read["box.doc"]["error_code"] == "UNSUPPORTED_TARGET"


def test_large_and_missing_files_are_rows(spark, tmp_path):
    deck(spark, tmp_path)
    every = manifest.inputs(manifest.listed(spark, str(tmp_path / "in")))
    at = lambda level: {r["display_name"]: (r["error_code"], r["bytes_read"]) for r in probe(every, ["version"], level=level, confidence="low").where("display_name like '%.pdf'").collect()}
    assert at("header") == {"huge.pdf": (None, 8192), "a.pdf": (None, 25)}
    big = with_facts(every.where("display_name = 'huge.pdf'"), max_read=1 << 20, drivers=["pdf"]).collect()[0]
    assert big["error_code"] == "BUDGET_EXCEEDED" and big["exit_code"] == 4 and "file size 3221225472 exceeds" in big["error_message"]
    gone = every.where("display_name = 'a.pdf'").withColumn("path", F.concat("path", F.lit("x")))
    lost = probe(gone, ["version"]).collect()[0]
    assert lost["error_code"] == "SOURCE_IO" and lost["exit_code"] == 2 and lost["status"] == "error"


def test_files_are_dealt_out_by_bytes(spark):
    rows = spark.range(100).select(F.format_string("p%03d", "id").alias("path"), F.when(F.col("id") == 7, 1000).otherwise(F.col("id") % 10).alias("file_size"))
    dealt = manifest.packed(rows, bytes_per_task=100, files_per_task=50).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("file_size").alias("b"), F.count("*").alias("n"), F.max("file_size").alias("m")).collect()
    assert sum(r["n"] for r in dealt) == 100 and len(dealt) > 4 and all(r["b"] <= 120 or r["m"] == 1000 for r in dealt)


def test_lines_have_their_numbers_and_reports_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = json.dumps({"name": "c.pdf", "base64": base64.b64encode(b"%PDF-1.5").decode()})
    for name, n in (("a", 900), ("b", 1), ("c", 400)):
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(f"{good if k % 3 else '{broken'}\n" if k % 5 else "\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = inputs.jsonl_lines(spark, str(tmp_path / "in"))
        assert lines.rdd.getNumPartitions() > 5
        got = sorted((r["file"][-7], r["line_no"]) for r in lines.collect())
        assert got == [(name, k) for name, n in (("a", 900), ("b", 1), ("c", 400)) for k in range(1, n + 1) if k % 5]
        code = sink.write_lines(probe(inputs.records(lines).drop("path"), ["version"], level="header"), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    out = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    said = [f"JSONL line {k} is invalid" if k % 3 == 0 else None for n in (900, 1, 400) for k in range(1, n + 1) if k % 5]
    assert [x.get("error", {}).get("message") for x in out] == said and code == 1


def test_unforeseen_failures_are_rows(spark, monkeypatch):
    arrow = to_arrow_schema(StructType.fromDDL(packages.DECODED))
    sound = packages.decode(ranges.held(word()), "ooxml", (100, 1 << 20), packages.ALL)
    made = packages.columns([sound, {"entries": [{"name": "x", "size": 1 << 70}]}, sound], arrow)
    codes = made[packages.NAMES.index("decode_code")].to_pylist()
    assert codes == [None, "PARSER_FAILURE", None]
    broken = packages.decode(ranges.Ranges(lambda n, at: 1 / 0, 100), "ooxml", (100, 1 << 20), packages.ALL)
    assert broken["decode_code"] == "PARSER_FAILURE" and "ZeroDivisionError" in broken["decode_message"]


def test_objects_as_rows(spark):
    m, ref, n = synth.message, synth.reference, 60_000
    many = [(1, 1, m((1, ref(2)))), (2, 2, m((1, "s"))), *((100 + k, 6000, m((2, ref(1_000_000 + k % 3)))) for k in range(n)), *((1_000_000 + k, 6001, m((8, f"t{k}"), (6, 1), (7, 1))) for k in range(4))]
    docs = [(1, "a.numbers", synth.iwork_bytes(many)), (2, "b.numbers", synth.iwork_bytes([(1, 1, b""), (9, (1 << 64) - 1, b"")])), (3, "c.numbers", synth.zip_bytes([("Index/Document.iwa", synth.iwa(many[:9])[:-2])])), (4, "d.pdf", b"%PDF-1.5"), (5, "e.numbers", None)]
    rows = object_rows(route(spark.createDataFrame([(k, name, c and bytearray(c)) for k, name, c in docs], "k int, display_name string, content binary")), "k")
    assert {(r["k"], int(r["type"])): r["n"] for r in type_counts(rows, "k").collect()} == {(1, 1): 1, (1, 2): 1, (1, 6000): n, (1, 6001): 4, (2, 1): 1, (2, (1 << 64) - 1): 1}
    assert sorted(r["name"] for r in logical_tables(rows, "k").collect()) == ["t0", "t1", "t2"]
    assert [(r["k"], r["name"]) for r in ordered_sheets(rows, "k").collect()] == [(1, "s")]
    assert [(r["k"], r["error_code"]) for r in rows.where("error_code is not null").collect()] == [(3, "MALFORMED_INPUT")]


def test_format_options():
    assert catalog.ruled_out("word", {"statistics_path": "document-xml"}) == {"word.app_statistics"} and catalog.ruled_out("pages", {}) == set()
    assert catalog.ruled_out("excel", [("workbook_path", "xml"), ("excel.workbook_path", "inventory")]) == {"excel.workbook_xml"}
    for driver, options in (("word", {"": "x"}), ("word", {"nothing": "x"}), ("word", {"statistics_path": "x"}), ("keynote", {"statistics_path": "auto"}), ("word", {"excel.workbook_path": "xml"})):
        with pytest.raises(catalog.RequestError) as e:
            catalog.ruled_out(driver, options)
        assert e.value.code == "INVALID_REQUEST"


def test_workbook_options(spark):
    book = synth.zip_bytes([("[Content_Types].xml", TYPES.format(catalog.MIME["xlsx"])), ("xl/workbook.xml", "<w><sheet name='a'/></w>"), ("xl/worksheets/sheet1.xml", "<s/>"), ("xl/worksheets/sheet2.xml", "<s/>")])
    rows = spark.createDataFrame([(1, "a.xlsx", len(book), bytearray(book))], "input_id int, display_name string, file_size bigint, content binary")
    count = lambda **how: [(e["value"], e["confidence"], e["status"]) for e in probe(rows, ["extension", "sheet_count"], **how).collect()[0]["results"] if e["target"] == "excel.sheet_count"]
    assert count() == [("1", "exact", "resolved")] and count(options={"workbook_path": "inventory"}) == [(None, "none", "unsupported")]
    assert count(options={"workbook_path": "inventory"}, confidence="medium") == [("2", "medium", "estimated")]


def test_jsonl_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = json.dumps({"name": "c.pdf", "base64": base64.b64encode(b"%PDF-1.5").decode()})
    (tmp_path / "in" / "a.jsonl").write_text(f"{line}\n\n{{broken\n")
    jsonl.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "values", wanted=["version"]).awaitTermination(120)
    out = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["status"] for x in out) == ["error", "ok"] and {"pdf.version": "1.5"} in [x.get("values") for x in out]


@pytest.mark.parametrize(("name", "table", "columns"), [("pptx_facts", "part", "id p_partkey, int(id % 50) p_size"), ("keynote_facts", "part", "id p_partkey, int(id % 50) p_size")])
def test_documents_of_one_row_group_are_made_by_several_tasks(spark, tmp_path, name, table, columns):
    spark.range(2 * queries.EACH + 1).coalesce(1).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{table}.parquet")
    assert spark.read.parquet(f"{tmp_path}/{table}.parquet").rdd.getNumPartitions() == 1
    assert queries.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_pdf_documents_of_one_row_group_are_cut_by_several_tasks(spark, tmp_path):
    spark.range(2 * queries.EACH + 1).coalesce(1).selectExpr("id c_custkey", "'x' c_name").write.parquet(f"{tmp_path}/customer.parquet")
    assert queries.pdf_documents(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_reports_of_several_levels_work_out_the_graph_once(spark, monkeypatch):
    calls, real = [], pdf_objects.object_entries
    monkeypatch.setattr(pdf_objects, "object_entries", lambda *a: calls.append(a) or real(*a))
    queries.pdf_reports(spark, DIR)
    assert len(calls) == 1


def test_texts_are_read_once_for_requests_of_all_levels(spark, tmp_path):
    spark.range(2 * queries.EACH + 1).coalesce(1).selectExpr("id doc_id", "'a' text", "'en' lang", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.level_facts(spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if f"{tmp_path}/" in f]
    assert queries.word_documents(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_greatest_common_divisors_of_many_steps(spark):
    pairs = [(7540113804746346429, 4660046610375530309), (4660046610375530309, 7540113804746346429), (12, 18), (5, 0), (0, 5), (0, 0), (317500, 635000)]
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select(gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r["g"] for r in got] == [math.gcd(a, b) for a, b in pairs]
