"""Streams of documents and of JSONL paths; registered drivers."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.extension import OwnDriver, OwnFact, Registry
from factloom.operators.report import requested
from factloom.streaming import documents, jsonl


def test_documents_arrive_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(f"{source}/deep")
    run = lambda: documents.start(spark, source, out, state, "values", files_per_batch=2, wanted=["pdf.version"], level="header").awaitTermination(200)
    for k in range(3):
        (tmp_path / "in" / "deep" / f"{k}.pdf").write_bytes(b"%%PDF-1.%d" % k)
    run()
    # a batch whose commit is lost runs again, and a file comes in between
    batch = max(int(p) for p in os.listdir(f"{state}/commits") if p.isdigit())
    os.remove(f"{state}/commits/{batch}")
    if os.path.exists(crc := f"{state}/commits/.{batch}.crc"):
        os.remove(crc)
    (tmp_path / "in" / "broken.pdf").write_bytes(b"none")
    run()
    got = spark.read.parquet(out).collect()
    assert sorted(os.path.basename(r["path"]) for r in got) == ["0.pdf", "1.pdf", "2.pdf", "broken.pdf"]
    versions = {os.path.basename(r["path"]): json.loads(r["value"]).get("values", {}).get("pdf.version") for r in got}
    assert versions == {"0.pdf": "1.0", "1.pdf": "1.1", "2.pdf": "1.2", "broken.pdf": None}
    assert {r["exit_code"] for r in got if r["path"].endswith("broken.pdf")} == {4}


def test_jsonl_paths_of_a_stream_are_opened_by_tasks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    lines = [json.dumps(str(tmp_path / "a.pdf")), json.dumps({"path": str(tmp_path / "no.pdf")}), json.dumps({"name": "c.pdf", "base64": base64.b64encode(b"%PDF-1.5").decode()}), "{broken"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    jsonl.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "values", wanted=["version"], level="header").awaitTermination(200)
    out = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x.get("values", {}).get("pdf.version", x.get("error", {}).get("code")) for x in out) == ["1.4", "1.5", "INVALID_REQUEST", "SOURCE_IO"]


def driver(id="note", suffixes=("note",), facts=()):
    return OwnDriver(id, suffixes, "text/x-note", facts)


@pytest.mark.parametrize("second", [driver(), driver("other", ("note",)), driver("other", ("PDF",)), driver("other", ("pdf",)), driver("Not a name", ("x",)), driver("a", ("x",), (OwnFact("b.c", "1"),)), driver("a", ("x",), (OwnFact("a.c", "1"), OwnFact("a.c", "2"))), driver("a", ("x",), (OwnFact("a.c", "1", "later"),)), driver("a", ("x",), (OwnFact("a.c", "1", "deep", "sure"),))])
def test_what_cannot_be_registered(second):
    registry = Registry()
    registry.register(driver())
    with pytest.raises(ValueError):
        registry.register(second)
    assert list(registry.drivers) == ["note"]


def test_registered_drivers(spark):
    registry = Registry()
    empty = spark.createDataFrame([("a.note", b"x")], "display_name string, content binary")
    assert registry.with_facts(empty).first()["error_code"] == "UNSUPPORTED_FORMAT"
    registry.register(driver(facts=(OwnFact("note.size", "length(content)"), OwnFact("note.text", "decode(content, 'UTF-8')", source="it's \\ here"), OwnFact("note.deep", "array(1, 2)", "deep", "high"), OwnFact("note.odd", "try_to_number('x', '9')", confidence="low"))))
    rows = spark.createDataFrame([("A.NOTE", 'q"]\n'.encode(), None), ("b.note", None, None), ("c.txt", b"", None), ("d.note", b"", "SOURCE_IO")], "display_name string, content binary, error_code string")
    asked = ["note.size", "note.text", "note.deep", "note.odd"]
    got = {r["display_name"]: r for r in requested(registry.with_facts(rows, "deep"), asked).collect()}
    values = {e["target"]: (e["status"], e["value"]) for e in got["A.NOTE"]["results"]}
    assert values == {"note.size": ("resolved", "4"), "note.text": ("resolved", '"q\\"]\\n"'), "note.deep": ("resolved", "[1,2]"), "note.odd": ("unknown", None)}
    assert {e["status"] for e in got["b.note"]["results"]} == {"unknown", "resolved"} and got["b.note"]["status"] == "partial"
    assert got["c.txt"]["exit_code"] == 3 and got["d.note"]["error_code"] == "SOURCE_IO" and not got["d.note"]["results"]
    call = registry.published(spark, "note_facts", "header")
    assert spark.sql(f"select * from {call}('a.note', X'00')").count() == 0
    rows.createOrReplaceTempView("own_rows")
    registry.published(spark, "note_facts")
    found = spark.sql("select r.display_name, f.target, f.value, f.source from own_rows r, lateral note_facts(r.display_name, r.content) f where f.target = 'note.text'")
    assert [r["source"] for r in found.where(F.col("value").isNotNull()).orderBy("display_name").collect()] == ["it's \\ here"] * 2
