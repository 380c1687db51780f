"""The queries of the library over the test tables, and their SQL.

No test table holds an office document, so most queries build a small one from each row
and probe its bytes; the SQL says the same facts from the row alone.
"""

from functools import reduce
from hashlib import shake_128

import pyarrow as pa
from pyspark.sql import functions as F

from factloom import catalog, synth
from factloom.extension import OwnDriver, OwnFact, Registry
from factloom.operators.probe import probe, with_facts
from factloom.operators.report import best_rows, exit_status, requested
from factloom.operators.routing import route
from factloom.sources import manifest
from factloom.sources.pdf_objects import graph_facts
from factloom.sources.objects import logical_tables, object_rows, ordered_sheets, type_counts
from factloom.sources.inputs import jsonl_lines, records, within
from factloom.sources.shared import fresh, stored

TYPES = '<Types><Default Extension="png" ContentType="image/png"/><Default Extension="mp4" ContentType="video/mp4"/><Override PartName="/main" ContentType="{}.main+xml"/></Types>'
#: White space of the Unicode standard, as a class that Java and RE2 both read.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that makes documents of them.
EACH = 2048


def dealt(rows, key):
    """Rows spread over tasks by their number: a file of one row group is one task, however many documents come of it."""
    return rows.repartition(max(1, -(-rows.count() // EACH)), key)


def routing(spark, sf_dir):
    """Events read as inputs whose suffix and signature follow from the row, routed."""
    pick = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % by + 1).cast("int"))
    inputs = read(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("in/"), "event_type", pick(6, ".PDF", ".docx", ".doc", ".key", ".txt", "")).alias("display_name"),
        F.unhex(pick(4, "255044462D312E37", "504B030414000000", "D0CF11E0A1B11AE1", "00")).alias("content"),
    )
    return route(inputs).groupBy("extension", "container", "family", "driver", "profile", "error_code", "error_message", "exit_code").agg(F.count("*").alias("n"))


def text_stats(spark, sf_dir):
    """Characters, words and non-blank lines of every document."""
    full = lambda parts: F.size(F.filter(parts, lambda x: F.regexp_replace(x, SPACE, "") != "")).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_characters"), full(F.split("text", SPACE + "+")).alias("n_words"), full(F.split("text", "\n")).alias("n_lines"))


def probed(rows, key, targets, drivers, *more):
    """(key, more columns, target, status, value, confidence) of the targets for inputs of (key, more columns, display_name, content)."""
    inputs = rows.withColumn("file_size", F.octet_length("content").cast("bigint"))
    found = requested(with_facts(inputs, drivers=drivers, targets=targets), targets)
    return found.select(key, *more, F.explode("results").alias("r")).select(key, *more, "r.target", "r.status", "r.value", "r.confidence")


def packed(rows, key, name, parts, *more):
    """Rows as packages: `parts` is a list of (name, text column), absent where the text is null."""
    each = F.filter(F.array(*(F.struct((F.lit(n) if isinstance(n, str) else n).alias("name"), t.alias("text")) for n, t in parts)), lambda p: p["text"].isNotNull())
    return synth.zipped(rows.select(key, *more, name.alias("display_name"), each.alias("parts")), key, *more, "display_name")


def times(text, n):
    return F.repeat(F.lit(text), n.cast("int"))


DOCX = ["document.title", "document.author", "document.subject", "word.paragraph_count", "word.word_count", "word.page_count", "word.table_count", "word.is_template", "word.unique_image_asset_count", "office.package_entry_count", "office.conformance"]


def word_documents(spark, sf_dir):
    """A Word document for each text: a paragraph a line that is not blank, with saved counts that are out of date."""
    # texts are counted where they are read, and only the counts are dealt; words hold no white space, of a line one other character tells
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1))))
    words = F.size(F.filter(F.split("text", SPACE + "+"), lambda x: x != ""))
    docs = dealt(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", lines.alias("n"), words.alias("w")), "doc_id")
    saved = F.concat(F.lit("<Properties><Words>"), F.col("w").cast("string"), F.lit("</Words><Paragraphs>1</Paragraphs><Pages>"), F.when(F.col("doc_id") % 3 == 0, "+7").when(F.col("doc_id") % 3 == 1, "7.5").otherwise("12"), F.lit("</Pages></Properties>"))
    core = F.concat(F.lit("<cp:p xmlns:cp='c' xmlns:dc='d'><dc:title> "), "source", F.lit(" </dc:title><dc:creator>"), "lang", F.lit("</dc:creator><dc:subject>  </dc:subject></cp:p>"))
    body = F.concat(F.lit("<w:document xmlns:w='w'><w:body>"), times("<w:p><w:r/></w:p>", F.col("n")), times("<w:tbl/>", F.col("doc_id") % 4), F.lit("</w:body></w:document>"))
    image = F.when(F.col("doc_id") % 2 == 0, "x")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".dotx").otherwise(".docx"))
    types = F.when(F.col("doc_id") % 5 == 0, TYPES.format(catalog.MIME["dotx"])).otherwise(TYPES.format(catalog.MIME["docx"]))
    return packed(docs, "doc_id", name, [("[Content_Types].xml", types), ("docProps/app.xml", saved), ("docProps/core.xml", core), ("word/document.xml", body), ("word/media/a.png", image), ("word/media/A.PNG", image), ("word/media/b.bin", image)])


def docx_facts(spark, sf_dir):
    """Facts of a Word document for each text."""
    return probed(word_documents(spark, sf_dir), "doc_id", DOCX, ["word"])


#: Requests by name: level, format options, least confidences of single targets.
REQUESTS = {
    "header": ("header", {}, None),
    "metadata": ("metadata", {}, None),
    "metadata, exact": ("metadata", {}, {"paragraph_count": "exact"}),
    "deep": ("deep", {}, None),
    "deep, saved": ("deep", {"statistics_path": "app-properties"}, None),
    "wrong option": ("deep", {"statistics_path": "fast"}, None),
}


def level_facts(spark, sf_dir):
    """The same documents asked at each level, with options and floors: which path answers, and with what."""
    # stored, so that texts are read once for all requests
    made = stored(word_documents(spark, sf_dir).withColumn("file_size", F.octet_length("content").cast("bigint")), "word-documents")
    out = None
    for name, (level, options, floors) in REQUESTS.items():
        found = probe(made, ["document.format_profile", "title", "paragraph_count"], level=level, options=options, overrides=floors)
        shown = F.when(F.col("status") == "error", F.array(F.struct(F.lit("").alias("target"), F.lit("error").alias("status"), F.col("error_message").alias("value"), F.lit("none").alias("confidence"), F.lit("").alias("path"))))
        kept = F.transform("results", lambda r: F.struct(*(r[c].alias(c) for c in ("target", "status", "value", "confidence", "path"))))
        rows = found.select("doc_id", F.lit(name).alias("request"), F.explode(F.coalesce(shown, kept)).alias("r")).select("doc_id", "request", "r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


XLSX = ["excel.sheet_count", "excel.sheet_names", "excel.hidden_sheet_count", "excel.defined_name_count", "excel.shared_string_count", "excel.table_count", "excel.binary_workbook", "excel.chart_part_count"]


def xlsx_facts(spark, sf_dir):
    """A workbook for each customer, with a sheet an order; finished orders are hidden sheets."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.struct("o_orderkey", "o_orderstatus").alias("o"))
    rows = read(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.array_sort(F.collect_list("o")).alias("os"))
    sheet = lambda o: F.concat(F.lit('<sheet name="o'), o["o_orderkey"].cast("string"), F.lit('"'), F.when(o["o_orderstatus"] == "F", ' state="hidden"').when(o["o_orderstatus"] == "O", ' state="visible"').otherwise(""), F.lit("/>"))
    key = F.col("c_custkey")
    book = F.concat(F.lit("<workbook><sheets>"), F.array_join(F.transform("os", sheet), ""), F.lit("</sheets>"), times("<definedName/>", key % 3), F.lit("</workbook>"))
    strings = F.when(key % 4 == 0, "<sst count='9' uniqueCount='5'/>").when(key % 4 == 1, "<sst count='9'/>").when(key % 4 == 2, "<sst count='-1'/>")
    more = [(f"xl/{n}", F.when(key % 2 == 0, "<x/>")) for n in ("tables/table1.xml", "tables/Table2.XML", "charts/chart1.xml", "charts/CHART1.xml")]
    made = packed(rows, "c_custkey", F.lit("book.xlsx"), [("[Content_Types].xml", F.lit(TYPES.format(catalog.MIME["xlsx"]))), ("xl/workbook.xml", book), ("xl/sharedStrings.xml", strings), *more])
    return probed(made, "c_custkey", XLSX, ["excel"])


PPTX = ["powerpoint.slide_count", "powerpoint.hidden_slide_count", "powerpoint.master_count", "powerpoint.slide_size", "powerpoint.aspect_ratio", "powerpoint.orientation", "powerpoint.presentation_kind", "powerpoint.unique_media_asset_count"]


def pptx_facts(spark, sf_dir):
    """Slides for each part: their number and size follow from its size."""
    rows, n = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"), F.col("p_size")
    size = F.when(n % 5 != 0, F.concat(F.lit('<p:sldSz cx="'), (n * 12700).cast("string"), F.lit('" cy="'), F.lit("317500"), F.lit('"/>'))).otherwise("")
    show = F.concat(F.lit("<p:presentation xmlns:p='p'><p:sldIdLst>"), times('<p:sldId id="1"/>', n), times('<p:sldId show="false"/>', n % 3), F.lit("</p:sldIdLst>"), size, F.lit("</p:presentation>"))
    kind = F.element_at(F.array(*map(F.lit, ("pptx", "ppsx", "potx"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    types = F.when(kind == "pptx", TYPES.format(catalog.MIME["pptx"])).when(kind == "ppsx", TYPES.format(catalog.MIME["ppsx"])).otherwise(TYPES.format(catalog.MIME["potx"]))
    masters = [(f"ppt/slideMasters/slideMaster{k}.xml", F.when(n % 4 >= k, "<m/>")) for k in range(4)]
    made = packed(rows, "p_partkey", F.concat(F.lit("show."), kind), [("[Content_Types].xml", types), ("ppt/presentation.xml", show), *masters, ("ppt/media/v.mp4", F.when(n % 2 == 0, "v"))])
    return probed(made, "p_partkey", PPTX, ["powerpoint"])


PDF = ["pdf.version", "pdf.linearized", "pdf.xref_type", "document.file_size", "document.extension_matches", "security.has_macros"]


def pdf_header_facts(spark, sf_dir):
    """The head of a PDF for each customer."""
    key = F.col("c_custkey")
    text = F.concat(F.lit("%PDF-1."), (key % 8).cast("string"), F.when(key % 2 == 0, "\n").otherwise("\r"), F.when(key % 3 == 0, "/Linearized 1\n").otherwise(""), F.when(key % 4 < 2, "\nxref\n").otherwise(""), F.when(key % 5 < 2, "/Type /XRef").otherwise(""))
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(".PDF")).alias("display_name"), F.encode(text, "UTF-8").alias("content"))
    return probed(rows, "c_custkey", PDF, ["pdf"])


def pdf_documents(spark, sf_dir):
    """A PDF of objects for each customer: pages, annotations, fields and actions follow from its key.

    Some have short cross-reference lines or none, an object that is defined again, a cycle
    of fields, references to nothing, or objects that are compressed.
    """
    c, name = F.col("c_custkey"), F.col("c_name")
    n, line = c % 4, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"))
    obj = lambda k, *parts: line(f"{k} 0 obj\n", *parts, "\nendobj")
    some = lambda when, then: F.when(when, then).otherwise("")
    forms = {1: "<< /Fields [10 0 R] >>", 2: "<< /Fields [10 0 R << /Kids [ << /T (a\\)(b)) >> << /Subtype /Widget >> ] >>] >>", 3: "<< /Fields [11 0 R] >>", 4: "<< /DA (x) >>"}
    form = reduce(lambda out, f: out.when(c % 5 == f[0], f" /AcroForm {f[1]}"), forms.items(), F.when(F.lit(False), "")).otherwise("")
    metadata = F.when(c % 4 == 1, " /Metadata 6 0 R").when(c % 4 == 2, " /Metadata 7 0 R").otherwise("")
    acts = {0: "<< /S /JavaScript /JS (go\\(1\\)) >>", 1: "<< /S /Launch >>", 2: "<</S/URI/URI(http://a)>>", 3: "<< /Next << /S /Rendition >> >>", 4: "<< /Type /Filespec /F (a) /EF << /F 6 0 R >> >>", 5: "<< /S /SubmitForm >>", 6: "<< /Type /Filespec /UF (a) >>"}
    act = reduce(lambda out, a: out.when(c % 8 == a[0], a[1]), acts.items(), F.when(F.lit(False), "")).otherwise("<< /S /GoTo >>")
    page = lambda k: some(n > k, obj(30 + k, "<< /Type /Page /Parent 20 0 R", *([" /Annots [40 0 R", some(c % 7 == 3, " 99 0 R"), " << /Subtype /Link >>]"] if k % 2 == 0 else []), " >>"))
    title = F.when(c % 2 == 0, F.concat(F.lit("("), name, F.lit(" \\(\\061\\))"))).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(name, "UTF-16BE")), F.lit("D83D>")))
    body = F.concat(
        F.lit("%PDF-1.7\n"), obj(1, "<< /Type /Catalog /Pages 2 0 R", form, metadata, " >>"), obj(2, "<< /Type /Pages /Kids [20 0 R] >> % a [ in a remark"),
        obj(20, "<< /Type /Pages /Kids [", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: some(n > k, F.concat((k + 30).cast("string"), F.lit(" 0 R ")))), ""), "] >>"), page(0), page(1), page(2),
        obj(6, "<< /Type /Metadata /Subtype /XML /Length 9 >>\nstream\n<<[( >> x\nendstream"), obj(10, "<< /FT /Tx /T (one) >>"), obj(11, "<< /T (c) /Kids [12 0 R] >>"), obj(12, "<< /T (d) /Kids [11 0 R] >>"),
        obj(40, F.when(c % 2 == 0, "[1]").otherwise("<< /Type /Annot >>")), obj(50, act), some(c % 3 == 0, obj(51, "<< /Type /Sig /ByteRange [0 1] /Contents <00> >>")), some(c % 11 == 10, obj(52, "<< /Type /ObjStm >>")),
        obj(60, "<< /Title ", title, " >>"), obj(40, "<< /Type /Annot /Subtype /Text >>"),
    )
    end = F.concat(F.lit("xref\n0 1\n0000000000 65535 f"), F.when(c % 3 == 1, "\n").otherwise(" \n"), F.lit("trailer\n<< /Root 1 0 R /Info 60 0 R >>\n"))
    rows = dealt(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", body.alias("body"), end.alias("end"))
    text = F.concat("body", "end", F.when(c % 3 == 2, "").otherwise(F.concat(F.lit("startxref\n"), F.length("body").cast("string"), F.lit("\n%%EOF\n"))))
    return rows.select("c_custkey", F.lit("a.pdf").alias("display_name"), F.encode(text, "ISO-8859-1").alias("content"))


def pdf_graph(spark, sf_dir):
    """What the object graphs of these documents say, by joins of object rows."""
    return graph_facts(pdf_documents(spark, sf_dir), "c_custkey").select("c_custkey", "xref", "object_count", "page_count", "annotation_count", "form_field_count", "signature_count", "attachment_count", "has_xmp", "external", "embedded", "risk", "title")


def pdf_reports(spark, sf_dir):
    """Reports of the same documents at two levels: risk is told only at the deep one."""
    made, out = pdf_documents(spark, sf_dir).withColumn("file_size", F.octet_length("content").cast("bigint")), None
    graph = stored(graph_facts(made, "c_custkey"), "pdf-graph")
    for level in ("metadata", "deep"):
        found = probe(made, ["pdf.page_count", "pdf.annotation_count", "pdf.repaired", "security.active_content_risk"], level=level, graph_by=["c_custkey"], graph=graph)
        rows = found.select("c_custkey", F.lit(level).alias("level"), F.explode("results").alias("r")).select("c_custkey", "level", "r.target", "r.status", "r.value", "r.confidence", "r.path")
        out = rows if out is None else out.unionByName(rows)
    return out


RISK = ["security.has_macros", "security.has_embedded_files", "security.has_external_relationships", "security.has_digital_signature", "security.signature_count", "security.active_content_risk"]


def risk_rollup(spark, sf_dir):
    """A package for each event, whose kind says what it holds; risks counted by kind."""
    kind = F.col("event_type")
    rel = F.when(kind == "click", '<Relationship Type="x" TargetMode="External"/>').when(kind == "signup", '<Relationship Type="http://a/oleObject"/>').when(kind == "view", '<Relationship Type="http://a/package" TargetMode="external"/>').otherwise("")
    types = TYPES.format(catalog.MIME["docm"]).replace("</Types>", '<Override PartName="/s/X.xml" ContentType="application/vnd.openxmlformats-package.digital-signature-xmlsignature+xml"/></Types>')
    parts = [("[Content_Types].xml", F.lit(types)), ("word/document.xml", F.lit("<d/>")), ("_rels/.RELS", F.concat(F.lit("<R>"), rel, F.lit("</R>"))), ("word/vbaProject.bin", F.when(kind == "purchase", "m")), ("s/x.XML", F.when(kind == "error", "s")), ("_xmlsignatures/sig1.xml", F.when(kind == "error", "s"))]
    made = packed(read(spark, sf_dir, "events"), "event_id", F.lit("a.docm"), parts, "event_type")
    long = probed(made, "event_id", RISK, ["word"], "event_type")
    return long.groupBy("event_type", "target", "status", "value").agg(F.count("*").alias("n"))


def built(rows, name, make, *columns):
    """Rows of a key and columns as inputs, whose bytes `make(*values)` gives in the tasks."""
    key = rows.columns[0]

    def run(batches):
        for batch in batches:
            made = [make(*v) for v in zip(*(batch[c].to_pylist() for c in (key, *columns)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([name] * batch.num_rows), pa.array(made, pa.binary())], names=[key, "display_name", "content"])

    return rows.select(key, *columns).mapInArrow(run, f"{key} bigint, display_name string, content binary")


PAGES = ["pages.body_text_length", "pages.body_paragraph_break_count", "pages.section_count", "pages.page_size", "pages.orientation", "pages.change_tracking_enabled", "pages.cached_page_count", "iwork.archive_object_count", "document.language", "iwork.producer_build"]


def pages_facts(spark, sf_dir):
    """A Pages document for each text, which is its body."""
    m, ref = synth.message, synth.reference

    def make(key, text, lang):
        size = [(30, ("f", 595.0)), (31, ("f", 842.0 - key % 2 * 400))] if key % 3 else []
        objects = [(1, 10000, m((4, ref(5)), *size, (40, key % 2))), (5, 2001, m((3, text[:7]), (3, text[7:]))), *((k + 6, 10011, m((26, f"s{k}"))) for k in range(key % 4)), (90, 10131, m((4, key)))]
        return synth.iwork_bytes(objects, {"language": lang} if key % 2 else {}, ["Template: a", f"M{key}", "Template: b"] if key % 5 else None)

    return probed(built(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "a.pages", make, "text", "lang"), "doc_id", PAGES, ["pages"])


NUMBERS = ["numbers.sheet_count", "numbers.sheet_names", "numbers.table_count", "numbers.hidden_row_count", "numbers.filtered_row_count", "numbers.formula_definition_count", "numbers.table_component_count", "iwork.iwa_entry_count"]


def numbers_documents(spark, sf_dir):
    """A Numbers document for each supplier: sheets, tables and formulas follow from its nation."""
    m, ref = synth.message, synth.reference

    def make(key, nation):
        n = nation % 5 + 1
        sheets = [(k + 2, 2, m((1, f"n{nation}s{k}"))) for k in range(n)]
        root = (1, 1, m(*((1, ref(k + 2)) for k in reversed(range(n))), *([(1, ref(77))] if key % 4 == 0 else [])))
        tables = [(100 + k, 6000, m((2, ref(200 + k)))) if k % 2 else (100 + k, 6007, m((1, m((2, ref(200 + k)))))) for k in range(n)]
        models = [(200 + k, 6001, m((8, f"t{k}"), (6, 9), (7, 4), (14, k), (40, key))) for k in range(n + 1)]  # the last is in no sheet
        lists = [(400, 6005, m((1, 3), *((3, b"f") for _ in range(key % 3)))), (401, 6201, m((1, 4), (3, b"f")))]
        return synth.iwork_bytes([root, *sheets], {}, None, [("Index/Tables/Tile-1.iwa", synth.iwa(tables + models, key % 2 == 0)), ("Index/Tables/Tile.iwa", synth.iwa(lists))])

    return built(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("nation")), "a.numbers", make, "nation")


def numbers_facts(spark, sf_dir):
    """Facts of a Numbers document for each supplier."""
    return probed(numbers_documents(spark, sf_dir), "s_suppkey", NUMBERS, ["numbers"])


def numbers_tables(spark, sf_dir):
    """The tables of these documents by a join of object rows: infos with the models they refer to."""
    rows = object_rows(route(numbers_documents(spark, sf_dir)), "s_suppkey", types={6000, 6001, 6007})
    return logical_tables(rows, "s_suppkey").select("s_suppkey", "name", F.col("identifier").cast("bigint").alias("identifier"), "rows", "columns", "hidden_rows", "filtered_rows")


def numbers_sheets(spark, sf_dir):
    """Their sheets in the order of the root's references, by a join of object rows."""
    rows = object_rows(route(numbers_documents(spark, sf_dir)), "s_suppkey", types={1, 2})
    return ordered_sheets(rows, "s_suppkey").select("s_suppkey", F.col("position").cast("bigint").alias("position"), F.col("identifier").cast("bigint").alias("identifier"), "name")


def object_types(spark, sf_dir):
    """How often each message type stands in all these documents."""
    rows = object_rows(route(numbers_documents(spark, sf_dir)), "s_suppkey")
    return type_counts(rows).select(F.col("type").cast("bigint").alias("type"), "n")


KEYNOTE = ["keynote.slide_count", "keynote.master_slide_count", "keynote.hidden_slide_count", "keynote.slides_with_notes_count", "keynote.orientation", "iwork.data_asset_count", "iwork.data_asset_bytes", "iwork.asset_type_counts", "iwork.preview_dimensions", "iwork.preview_count", "iwork.object_type_counts"]


def keynote_facts(spark, sf_dir):
    """A Keynote document for each part: slides, notes and assets follow from its size."""
    m, ref = synth.message, synth.reference
    empty, png = synth.iwa([]), b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")

    def make(key, size):
        nodes = [(10 + k, 4, m((2, ref(k)), (4, k % 2), (8, int(k % 3 == 0)))) for k in range(size % 6)] + [(50, 4, m((4, 1)))]  # the last has no reference
        show = (2, 2, m((4, m((1, ("f", 100.0 + size)), (2, ("f", 125.0)))))) if key % 7 else (2, 2, m())
        more = [("Index/Slide.iwa", empty), *((f"Index/Slide-{k}.iwa", empty) for k in range(size % 6)), ("Index/SlideNode.iwa", empty), ("Index/MasterSlide-1.iwa", empty), ("Index/TemplateSlide2-a.iwa", empty), ("Data/", b"")]
        more += [(f"Data/a{k}.{'png mov TTF wav doc'.split()[k % 5]}", b"x" * k) for k in range(size % 9)] + ([("preview.PNG", png), ("preview-web.jpg", b"?")] if key % 2 else [])
        return synth.iwork_bytes([(1, 1, b""), show, *nodes], {}, None, more)

    rows = dealt(read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("size")), "p_partkey")
    return probed(built(rows, "a.key", make, "size"), "p_partkey", KEYNOTE, ["keynote"])


LEGACY = ["document.title", "document.author", "word.word_count", "word.page_count", "word.is_template", "security.has_macros", "security.encrypted", "office.cfb_entry_count", "office.document_kind"]


def legacy_facts(spark, sf_dir):
    """A compound file for each customer: its summary holds the name and the nation."""

    def make(key, name, nation):
        streams = {"WordDocument": b"w", "\x05SummaryInformation": synth.property_set({2: name, 4: "" if key % 2 else "me", 15: nation, **({14: 3} if key % 3 else {})})}
        return synth.cfb_bytes(streams | ({"_VBA_PROJECT": b"v"} if key % 4 == 0 else {}))

    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("nation"))
    made = built(rows, "a.doc", make, "c_name", "nation")
    return probed(made.withColumn("display_name", F.when(F.col("c_custkey") % 5 == 0, "a.dot").otherwise("a.doc")), "c_custkey", LEGACY, ["office-legacy"])


def lines_of(events):
    """JSONL lines of events: heads of PDF files, a path, and records that are wrong in several ways."""
    k, data = F.col("event_id") % 8, F.base64(F.encode(F.concat(F.lit("%PDF-1."), (F.col("event_id") % 8).cast("string")), "UTF-8"))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    good = F.concat(F.lit('{"name":"a.pdf","data_base64":'), q(data), F.lit("}"))
    line = F.when(k < 3, good).when(k == 3, F.replace(good, F.lit("data_base64"), F.lit("base64"))).when(k == 4, '{"name":"a.pdf","data_base64":"%%"}').when(k == 5, '{"name":"a.pdf"}').when(k == 6, "{broken").otherwise(F.replace(good, F.lit("a.pdf"), F.lit("a.txt")))
    return events.select("event_type", F.col("event_id").alias("line_no"), line.alias("value"))


def jsonl_reports(spark, sf_dir):
    """Status, error and version of each JSONL line, in order of lines."""
    rows = within(records(lines_of(read(spark, sf_dir, "events"))), 16 << 20).drop("path")
    found = requested(with_facts(rows, drivers=["pdf"], targets=(asked := ["pdf.version", "document.file_size"])), asked)
    value = lambda t: F.get(F.filter("results", lambda e: e["target"] == t), F.lit(0))["value"]
    return found.select("line_no", "status", "error_code", "error_message", "exit_code", value("pdf.version").alias("version"), value("document.file_size").alias("size"))


def jsonl_exit(spark, sf_dir):
    """The greatest exit code of all lines, by kind of event."""
    rows = requested(with_facts(records(lines_of(read(spark, sf_dir, "events"))).drop("path"), drivers=["pdf"], targets=[]), ["document.title"])
    return exit_status(rows, "event_type", strict=True).select("event_type", F.col("exit_code").cast("bigint").alias("exit_code"))


def best_evidence(spark, sf_dir):
    """Events as facts of users: for each kind the most certain one, the first of equals."""
    level = (F.col("event_id") % 5).cast("int")
    names, scores = (F.array(*map(F.lit, x)) for x in (catalog.SCORES, catalog.SCORES.values()))
    facts = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("target"), F.col("event_id").cast("string").alias("value"), F.get(names, level).alias("confidence"), F.get(scores, level).alias("confidence_score"), F.col("event_id").alias("arrival"))
    return best_rows(facts, "user_id", "target").select("user_id", "target", "value", "confidence")


def registered_facts(spark, sf_dir):
    """Facts of texts by a driver of one's own, selected in SQL through its table function; a text of another suffix has none."""
    registry = Registry()
    text = "decode(content, 'UTF-8')"
    registry.register(
        OwnDriver("note", ("note", "memo"), "text/x-note", (
            OwnFact("note.line_count", f"length({text}) - length(replace({text}, '\\n', '')) + 1"),
            OwnFact("note.first_word", f"nullif(regexp_extract({text}, '^([A-Za-z]+)', 1), '')", "header", "medium"),
            OwnFact("note.byte_sum", "length(content)", "deep"),
        ))
    )
    call = registry.published(spark)
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".note").when(F.col("doc_id") % 3 == 1, ".MEMO").otherwise(".txt"))
    docs = read(spark, sf_dir, "documents").select("doc_id", name.alias("display_name"), F.encode("text", "UTF-8").alias("content"))
    return spark.sql(f"select d.doc_id, f.target, f.status, f.value, f.confidence, f.path from {{docs}} d, lateral {call}(d.display_name, d.content) f", docs=docs)


def damaged_documents(spark, sf_dir):
    """A document for each event, sound or damaged in one of many ways: no kind fails the job, each gives its row."""
    m, ref = synth.message, synth.reference
    types = ("[Content_Types].xml", TYPES.format(catalog.MIME["docx"]))
    word = lambda *parts: synth.zip_bytes([types, ("word/document.xml", "<d/>"), *parts])
    root = (1, 10000, m((4, ref(5))))
    pages = lambda *objects, **more: synth.iwork_bytes([root, *objects], {}, None, **more)
    plist = ("Metadata/Properties.plist", b"<plist><dict/></plist>", 22)
    sized = lambda *sizes: synth.directory_zip([("Index/Document.iwa", (d := synth.iwa([root])), len(d)), plist, *((f"Data/{k}", b"", n) for k, n in enumerate(sizes))])
    box = synth.cfb_bytes({"WordDocument": b"w", "\x05SummaryInformation": synth.property_set({2: "T"})})
    kinds = [
        ("a.docx", word()), ("a.docx", word()[:-30]), ("a.docx", synth.zip_bytes([types])), ("a.docx", synth.zip_bytes([("[Content_Types].xml", TYPES.format(catalog.MIME["xlsx"])), ("word/document.xml", "<d/>")])),
        ("a.docx", word(("_rels/.rels", "<broken"))), ("a.pages", pages((7, (1 << 64) - 1, b"x"))), ("a.pages", sized((1 << 63) + 5)), ("a.pages", sized(1 << 63, 1 << 63)),
        ("a.pages", synth.zip_bytes([("index.apxl", "x")])), ("a.pages", synth.zip_bytes([("Index/Document.iwa", synth.iwa([root])[:-1]), ("Metadata/Properties.plist", "x")])),
        ("a.pages", synth.zip_bytes([("Index/Document.iwa", synth.iwa([root])), ("Metadata/Properties.plist", "no plist")])), ("a.doc", box), ("a.doc", box[:700]), ("a.doc", box[:-512] + b"\x05" * 512), ("a.pdf", b"none"), ("a", b""),
    ]
    kind = F.pmod(F.col("event_id"), F.lit(len(kinds))).cast("int")
    name = F.element_at(F.array(*(F.lit(n) for n, _ in kinds)), kind + 1)
    content = F.element_at(F.array(*(F.lit(bytearray(c)) for _, c in kinds)), kind + 1)
    rows = read(spark, sf_dir, "events").select("event_id", name.alias("display_name"), content.alias("content")).withColumn("file_size", F.octet_length("content").cast("bigint"))
    asked = ["document.format", "iwork.data_asset_bytes", "iwork.message_type_counts", "document.title", "security.has_external_relationships"]
    found = requested(with_facts(rows, targets=[*asked, "iwork.is_multi_page"]), asked)
    value = lambda t: F.get(F.filter("results", lambda e: e["target"] == t), F.lit(0))["value"]
    return found.select("event_id", "error_code", "exit_code", value("document.format").alias("format"), value("iwork.data_asset_bytes").alias("bytes"), value("iwork.message_type_counts").alias("types"), value("document.title").alias("title"))


def manifest_facts(spark, sf_dir):
    """A file for each supplier, found by JSONL paths in a listing and read by ranges.

    Slides hold 100 KB of pictures that no fact needs; PDF files are larger than what may be
    read of them; some paths lead nowhere.
    """
    key = F.col("s_suppkey")
    types, app = TYPES.format(catalog.MIME["pptx"]), "<Properties><Slides>{}</Slides></Properties>"

    def make(key, name):
        if key % 5 == 3:
            return b"%PDF-1.7\n" + b"x" * 30_000
        core = f"<cp:p xmlns:cp='c' xmlns:dc='d'><dc:title>{name}</dc:title></cp:p>"
        return synth.zip_bytes([("ppt/media/a.png", shake_128(str(key).encode()).digest(100_000)), ("[Content_Types].xml", types), ("ppt/presentation.xml", "<p/>"), ("docProps/app.xml", app.format(key)), ("docProps/core.xml", core)])

    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    named = F.concat(key.cast("string"), F.when(key % 5 == 3, ".pdf").otherwise(".pptx"))
    made = built(rows, "", make, "s_name").withColumn("display_name", named).where(key % 5 != 4)
    folder = fresh(spark, "files")
    synth.written(made, folder, "s_suppkey").write.format("noop").mode("overwrite").save()
    lines = rows.select(key.alias("line_no"), F.to_json(F.struct(F.concat(F.lit(folder + "/"), named).alias("path"))).alias("value"))
    inputs = manifest.packed(manifest.with_paths(records(lines), manifest.listed(spark, folder)))
    asked = ["powerpoint.slide_count", "document.title"]
    paths = {"powerpoint": {"powerpoint.app_statistics", "ooxml.core_properties"}, "pdf": {"pdf.document_structure"}}
    found = requested(with_facts(inputs, drivers=list(paths), targets=[*asked, "pdf.xref_type"], paths=paths, max_read=20_000), asked)
    value = lambda t: F.get(F.filter("results", lambda e: e["target"] == t), F.lit(0))["value"]
    return found.select(F.col("line_no").alias("s_suppkey"), "error_code", "exit_code", value(asked[0]).alias("slides"), value(asked[1]).alias("title"), (F.col("bytes_read") < 18_000).alias("frugal"), (F.col("file_size") > 100_000).alias("large"))


def jsonl_files(spark, sf_dir):
    """JSONL files, one a kind of event, with blank lines: every report under its file and its line's true number."""
    events = read(spark, sf_dir, "events")
    folder = fresh(spark, "jsonl")
    lines = lines_of(events).withColumn("value", F.when(F.col("line_no") % 7 != 0, F.col("value")).otherwise(" "))
    lines.repartition("event_type").sortWithinPartitions("event_type", "line_no").select("event_type", "value").write.partitionBy("event_type").text(folder)
    rows = within(records(jsonl_lines(spark, folder)), 16 << 20).drop("path")
    found = requested(with_facts(rows, drivers=["pdf"], targets=(asked := ["pdf.version"])), asked)
    return found.select(F.regexp_extract("file", "event_type=([a-z]+)", 1).alias("event_type"), F.col("line_no").cast("bigint").alias("line_no"), "status", "error_message", "exit_code")


def selector_sizes(spark, sf_dir):
    """How many targets each selector gives, by profile and level."""
    names = ("@header", "@default", "@summary", "@security", "@structure", "@assets", "@quality", "@format", "@all")
    rows = [(p, s, lv, len(catalog.selector(p, s, lv))) for p in SIZES for s in names for lv in catalog.LEVELS]
    return spark.createDataFrame(rows, "profile string, selector string, level string, n bigint")


def format_list(spark, sf_dir):
    """Drivers with their profiles."""
    return catalog.formats(spark).select("driver", F.explode("profiles").alias("profile"), "support")


def target_list(spark, sf_dir):
    """Targets of slides by scope and cost class, with the number of their aliases."""
    return catalog.discovered(spark, "powerpoint").groupBy("scope", "cost_class").agg(F.count("*").alias("n"), F.sum(F.size("aliases")).alias("n_aliases"), F.count_if(F.size("supported_levels") > 0).alias("n_applicable"))


#: Sizes of selectors by profile, at header, metadata and deep level. Fixed values.
SIZES = {
    "pdf": {"@header": (8, 8, 8), "@default": (8, 16, 16), "@summary": (8, 12, 12), "@security": (0, 6, 9), "@structure": (0, 5, 6), "@assets": (0, 1, 1), "@quality": (1, 2, 2), "@format": (2, 10, 10), "@all": (8, 31, 34)},
    "docx": {"@header": (8, 8, 8), "@default": (8, 16, 18), "@summary": (8, 15, 15), "@security": (1, 6, 9), "@structure": (1, 9, 11), "@assets": (0, 1, 1), "@quality": (1, 2, 2), "@format": (0, 7, 8), "@all": (8, 31, 35)},
    "xlsx": {"@header": (8, 8, 8), "@default": (8, 19, 20), "@summary": (8, 16, 16), "@security": (1, 6, 9), "@structure": (1, 12, 14), "@assets": (0, 1, 1), "@quality": (1, 2, 2), "@format": (0, 10, 11), "@all": (8, 34, 38)},
    "xlsb": {"@header": (8, 8, 8), "@default": (8, 16, 16), "@summary": (8, 14, 14), "@security": (1, 6, 9), "@structure": (1, 8, 9), "@assets": (0, 1, 1), "@quality": (1, 2, 2), "@format": (0, 6, 6), "@all": (8, 30, 33)},
    "pptx": {"@header": (8, 8, 8), "@default": (8, 21, 21), "@summary": (8, 17, 17), "@security": (1, 6, 9), "@structure": (1, 15, 16), "@assets": (0, 2, 2), "@quality": (1, 2, 2), "@format": (0, 13, 13), "@all": (8, 37, 40)},
    "key": {"@header": (8, 8, 8), "@default": (8, 20, 20), "@summary": (8, 12, 16), "@security": (1, 3, 3), "@structure": (1, 9, 20), "@assets": (0, 6, 6), "@quality": (1, 1, 2), "@format": (1, 16, 28), "@all": (8, 29, 42)},
    "numbers": {"@header": (8, 8, 8), "@default": (8, 20, 20), "@summary": (8, 13, 14), "@security": (1, 3, 3), "@structure": (1, 9, 18), "@assets": (0, 6, 6), "@quality": (1, 1, 2), "@format": (1, 16, 26), "@all": (8, 29, 40)},
    "pages": {"@header": (8, 8, 8), "@default": (8, 18, 18), "@summary": (8, 12, 17), "@security": (1, 3, 3), "@structure": (1, 7, 19), "@assets": (0, 6, 6), "@quality": (1, 1, 2), "@format": (1, 14, 28), "@all": (8, 27, 42)},
    "doc": {"@header": (11, 11, 11), "@default": (11, 21, 21), "@summary": (11, 15, 15), "@security": (1, 4, 4), "@structure": (1, 7, 7), "@assets": (0, 0, 0), "@quality": (1, 1, 1), "@format": (3, 9, 9), "@all": (11, 27, 27)},
    "xls": {"@header": (11, 11, 11), "@default": (11, 20, 20), "@summary": (11, 15, 15), "@security": (1, 4, 4), "@structure": (1, 6, 6), "@assets": (0, 0, 0), "@quality": (1, 1, 1), "@format": (3, 8, 8), "@all": (11, 26, 26)},
    "ppt": {"@header": (11, 11, 11), "@default": (11, 19, 19), "@summary": (11, 15, 15), "@security": (1, 4, 4), "@structure": (1, 5, 5), "@assets": (0, 0, 0), "@quality": (1, 1, 1), "@format": (3, 7, 7), "@all": (11, 25, 25)},
    "encrypted-ooxml": {"@header": (11, 11, 11), "@default": (11, 16, 16), "@summary": (11, 15, 15), "@security": (1, 4, 4), "@structure": (1, 2, 2), "@assets": (0, 0, 0), "@quality": (1, 1, 1), "@format": (3, 4, 4), "@all": (11, 22, 22)},
}

QUERIES = {f.__name__: f for f in (routing, text_stats, docx_facts, xlsx_facts, pptx_facts, pdf_header_facts, pdf_graph, pdf_reports, risk_rollup, pages_facts, numbers_facts, numbers_tables, numbers_sheets, object_types, keynote_facts, legacy_facts, jsonl_reports, jsonl_exit, best_evidence, registered_facts, level_facts, damaged_documents, manifest_facts, jsonl_files, selector_sizes, format_list, target_list)}


def _long(source, key, facts):
    """SQL of (key, target, status, value, confidence) from {target: (SQL of the value, confidence)}; a null value is unknown."""
    one = "select {k} as {name}, '{t}' as target, case when v is null then 'unknown' else '{s}' end as status, v as value, case when v is null then 'none' else '{c}' end as confidence from (select {k}, cast({v} as varchar) as v from src)"
    k = key
    return f"with src as ({source}) " + " union all ".join(one.format(k=k, name=key, t=t, v=v, c=c, s="resolved" if c in ("high", "exact") else "estimated") for t, (v, c) in facts.items())


_full = lambda parts: f"len(list_filter({parts}, lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> ''))"
_WORDS, _LINES = _full(f"string_split_regex(text, '{SPACE}+')"), _full("string_split(text, chr(10))")
_YES = lambda c: f"case when {c} then 'true' else 'false' end"

_PDF_GRAPH = """
with k as (select c_custkey, c_name, c_custkey % 11 <> 10 as o, c_custkey % 4 as n, c_custkey % 8 as a, c_custkey % 5 as f, c_custkey % 7 = 3 as lost from customer),
g as (select c_custkey, ['sound', 'short', 'lost'][c_custkey % 3 + 1] as xref, case when o then 10 + n + (c_custkey % 3 = 0)::bigint end as object_count, case when o then n end as page_count,
  case when o and not (lost and n > 0) then [0, 2, 2, 4][n + 1]::bigint end as annotation_count, case when o then case f when 0 then 0 when 1 then 1 when 2 then 2 end::bigint end as form_field_count,
  case when o then (c_custkey % 3 = 0)::bigint end as signature_count, case when o then (a = 4)::bigint end as attachment_count, case when o and n <> 2 then n = 1 end as has_xmp, case when o then a in (1, 2, 5, 6) end as external, case when o then a = 4 end as embedded,
  case when o then case when a < 2 then 'high' when a in (3, 5) then 'medium' when a in (2, 4, 6) then 'low' else 'none' end end as risk, case when o then case when c_custkey % 2 = 0 then c_name || ' (1)' else c_name || chr(65533) end end as title from k)"""
ORACLE_SQL = {
    "routing": """
with i as (select ['pdf', 'docx', 'doc', 'key', 'txt', ''][event_id % 6 + 1] as extension, ['pdf', 'zip', 'cfb', 'other'][event_id % 4 + 1] as container from events),
f as (select *, case when extension = 'pdf' and container = 'pdf' then 'pdf' when extension = 'doc' and container = 'cfb' then 'legacy'
  when extension = 'docx' and container = 'cfb' then 'encrypted-ooxml' when extension = 'docx' and container = 'zip' then 'ooxml'
  when extension = 'key' and container = 'zip' then 'iwork' end as family from i),
e as (select *, case when extension in ('txt', '') then 'UNSUPPORTED_FORMAT' when family is null then 'MALFORMED_INPUT' end as error_code from f)
select extension, container, family, case family when 'pdf' then 'pdf' when 'legacy' then 'office-legacy' when 'encrypted-ooxml' then 'office-legacy' when 'ooxml' then 'word' when 'iwork' then 'keynote' end as driver,
  case when family = 'encrypted-ooxml' then family when family is not null then extension end as profile, error_code,
  case when extension = 'txt' then 'unsupported format: .txt' when extension = '' then 'unsupported format: input filename has no extension'
    when family is null then 'malformed input: .' || extension || ' input does not contain the expected ' || case extension when 'pdf' then 'PDF' when 'doc' then 'CFB/OLE' when 'key' then 'ZIP/IWA' else 'ZIP/OPC or encrypted CFB' end || ' container' end as error_message,
  case error_code when 'UNSUPPORTED_FORMAT' then 3 when 'MALFORMED_INPUT' then 4 else 0 end as exit_code, count(*) as n
from e group by all""",
    "text_stats": f"select doc_id, length(text) as n_characters, {_WORDS} as n_words, {_LINES} as n_lines from documents",
    "docx_facts": _long(
        f"select doc_id, lang, source, {_WORDS} as w, {_LINES} as n from documents", "doc_id",
        {
            "document.title": ("case when trim(source) <> '' then '\"' || source || '\"' end", "high"), "document.author": ("case when trim(lang) <> '' then '\"' || lang || '\"' end", "high"), "document.subject": ("null", "high"),
            "word.paragraph_count": ("n", "exact"), "word.word_count": ("w", "high"), "word.page_count": ("case doc_id % 3 when 0 then 7 when 2 then 12 end", "high"), "word.table_count": ("doc_id % 4", "exact"),
            "word.is_template": (_YES("doc_id % 5 = 0"), "exact"), "word.unique_image_asset_count": ("case when doc_id % 2 = 0 then 1 else 0 end", "exact"), "office.package_entry_count": ("case when doc_id % 2 = 0 then 7 else 4 end", "exact"), "office.conformance": ("'\"transitional\"'", "high"),
        },
    ),
    "xlsx_facts": _long(
        "select c_custkey, count(o_orderkey) as n, count(*) filter (o_orderstatus = 'F') as h, coalesce(string_agg('\"o' || o_orderkey || '\"', ',' order by o_orderkey), '') as names from customer left join orders on c_custkey = o_custkey group by 1", "c_custkey",
        {
            "excel.sheet_count": ("n", "exact"), "excel.sheet_names": ("'[' || names || ']'", "exact"), "excel.hidden_sheet_count": ("h", "exact"), "excel.defined_name_count": ("c_custkey % 3", "exact"),
            "excel.shared_string_count": ("case c_custkey % 4 when 0 then 5 when 1 then 9 end", "exact"), "excel.table_count": ("case when c_custkey % 2 = 0 then 1 else 0 end", "exact"), "excel.binary_workbook": ("'false'", "exact"), "excel.chart_part_count": ("case when c_custkey % 2 = 0 then 1 else 0 end", "exact"),
        },
    ),
    "pptx_facts": _long(
        "select p_partkey, p_size, p_size % 5 <> 0 as sized from part", "p_partkey",
        {
            "powerpoint.slide_count": ("p_size + p_size % 3", "exact"), "powerpoint.hidden_slide_count": ("p_size % 3", "exact"), "powerpoint.master_count": ("1 + p_size % 4", "exact"),
            "powerpoint.slide_size": ("case when sized then '{\"height_emu\":317500,\"height_pt\":25.0,\"width_emu\":' || p_size * 12700 || ',\"width_pt\":' || p_size || '.0}' end", "exact"),
            "powerpoint.aspect_ratio": ("case when sized then '{\"decimal\":' || p_size / 25.0::double || ',\"height\":' || 25 // gcd(p_size, 25) || ',\"width\":' || p_size // gcd(p_size, 25) || '}' end", "exact"),
            "powerpoint.orientation": ("case when not sized then null when p_size > 25 then '\"landscape\"' else '\"portrait\"' end", "exact"),
            "powerpoint.presentation_kind": ("['\"presentation\"', '\"show\"', '\"template\"'][p_partkey % 3 + 1]", "exact"), "powerpoint.unique_media_asset_count": ("case when p_size % 2 = 0 then 1 else 0 end", "exact"),
        },
    ),
    "pdf_header_facts": _long(
        "select c_custkey, c_custkey % 4 < 2 as t, c_custkey % 5 < 2 as s from customer", "c_custkey",
        {
            "pdf.version": ("'\"1.' || c_custkey % 8 || '\"'", "exact"), "pdf.linearized": (_YES("c_custkey % 3 = 0"), "high"), "pdf.xref_type": ("case when t and s then '\"hybrid\"' when t then '\"table\"' when s then '\"stream\"' else '\"unknown\"' end", "exact"),
            "document.file_size": ("9 + case when c_custkey % 3 = 0 then 14 else 0 end + case when t then 6 else 0 end + case when s then 11 else 0 end", "exact"), "document.extension_matches": ("'true'", "exact"), "security.has_macros": ("'false'", "exact"),
        },
    ),
    "pdf_graph": _PDF_GRAPH + """
select c_custkey, xref, object_count, page_count, annotation_count, form_field_count, signature_count, attachment_count, has_xmp, external, embedded, risk, title from g""",
    "pdf_reports": _PDF_GRAPH + """,
l as (select c_custkey, unnest([
  {'level': 'metadata', 'target': 'pdf.page_count', 'value': page_count::varchar, 'confidence': 'exact', 'path': 'pdf.document_structure'}, {'level': 'deep', 'target': 'pdf.page_count', 'value': page_count::varchar, 'confidence': 'exact', 'path': 'pdf.document_structure'},
  {'level': 'metadata', 'target': 'pdf.repaired', 'value': (xref <> 'sound')::varchar, 'confidence': 'exact', 'path': 'pdf.document_structure'}, {'level': 'deep', 'target': 'pdf.repaired', 'value': (xref <> 'sound')::varchar, 'confidence': 'exact', 'path': 'pdf.document_structure'},
  {'level': 'metadata', 'target': 'pdf.annotation_count', 'value': annotation_count::varchar, 'confidence': 'exact', 'path': 'pdf.document_features'}, {'level': 'deep', 'target': 'pdf.annotation_count', 'value': annotation_count::varchar, 'confidence': 'exact', 'path': 'pdf.deep_document_features'},
  {'level': 'metadata', 'target': 'security.active_content_risk', 'value': null, 'confidence': 'unsupported', 'path': 'planner'}, {'level': 'deep', 'target': 'security.active_content_risk', 'value': '"' || risk || '"', 'confidence': 'high', 'path': 'pdf.active_content_assessment'}]) as x from g)
select c_custkey, x.level, x.target, case when x.confidence = 'unsupported' then 'unsupported' when x.value is null then 'unknown' else 'resolved' end as status, x.value, case when x.value is null then 'none' else x.confidence end as confidence, x.path from l""",
    "registered_facts": """
with d as (select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as n, regexp_extract(text, '^([A-Za-z]+)', 1) as w from documents where doc_id % 3 < 2)
select doc_id, 'note.line_count' as target, 'resolved' as status, n::varchar as value, 'exact' as confidence, 'note.metadata' as path from d
union all select doc_id, 'note.first_word', case when w = '' then 'unknown' else 'estimated' end, case when w <> '' then '"' || w || '"' end, case when w = '' then 'none' else 'medium' end, 'note.header' from d""",
    "risk_rollup": """
with e as (select event_type, event_type = 'purchase' as macros, event_type = 'signup' as embedded, event_type in ('click', 'view') as external, event_type = 'error' as signed from events),
l as (select event_type, unnest([{'t': 'security.has_macros', 'v': macros::varchar}, {'t': 'security.has_embedded_files', 'v': embedded::varchar}, {'t': 'security.has_external_relationships', 'v': external::varchar},
  {'t': 'security.has_digital_signature', 'v': signed::varchar}, {'t': 'security.signature_count', 'v': case when signed then '2' else '0' end},
  {'t': 'security.active_content_risk', 'v': case when macros then '"high"' when embedded then '"medium"' when external then '"low"' else '"none"' end}]) as x from e)
select event_type, x.t as target, 'resolved' as status, x.v as value, count(*) as n from l group by all""",
    "pages_facts": _long(
        "select doc_id, text, lang, doc_id % 3 <> 0 as sized, 842 - doc_id % 2 * 400 as h from documents", "doc_id",
        {
            "pages.body_text_length": ("length(text)", "exact"), "pages.body_paragraph_break_count": ("length(text) - length(replace(text, chr(10), ''))", "exact"), "pages.section_count": ("doc_id % 4", "exact"),
            "pages.page_size": ("case when sized then '{\"height_pt\":' || h || '.0,\"width_pt\":595.0}' else 'null' end", "exact"), "pages.orientation": ("case when not sized then 'null' when h < 595 then '\"landscape\"' else '\"portrait\"' end", "exact"),
            "pages.change_tracking_enabled": (_YES("doc_id % 2 = 1"), "exact"), "pages.cached_page_count": ("doc_id", "high"), "iwork.archive_object_count": ("3 + doc_id % 4", "exact"),
            "document.language": ("case when doc_id % 2 = 1 then '\"' || lang || '\"' else 'null' end", "high"), "iwork.producer_build": ("case when doc_id % 5 <> 0 then '\"M' || doc_id || '\"' else 'null' end", "high"),
        },
    ),
    "numbers_facts": _long(
        "select s_suppkey, s_nationkey as nation, s_nationkey % 5 + 1 as n, s_suppkey % 4 = 0 as lost from supplier", "s_suppkey",
        {
            "numbers.sheet_count": ("case when not lost then n end", "exact"), "numbers.sheet_names": ("case when not lost then '[' || array_to_string(list_transform(range(n - 1, -1, -1), lambda k: '\"n' || nation || 's' || k || '\"'), ',') || ']' end", "exact"),
            "numbers.table_count": ("n", "exact"), "numbers.hidden_row_count": ("n * (n - 1) // 2", "exact"), "numbers.filtered_row_count": ("n * s_suppkey", "exact"), "numbers.formula_definition_count": ("s_suppkey % 3", "exact"),
            "numbers.table_component_count": ("2", "exact"), "iwork.iwa_entry_count": ("3", "exact"),
        },
    ),
    "numbers_tables": "with t as (select s_suppkey, unnest(range(s_nationkey % 5 + 1)) as k from supplier) select s_suppkey, 't' || k as name, 200 + k as identifier, 9::bigint as rows, 4::bigint as columns, k as hidden_rows, s_suppkey as filtered_rows from t",
    "numbers_sheets": """
with n as (select s_suppkey, s_nationkey as nation, s_nationkey % 5 + 1 as n from supplier), t as (select *, unnest(range(n)) as p from n)
select s_suppkey, p as position, n - p + 1 as identifier, 'n' || nation || 's' || n - 1 - p as name from t union all select s_suppkey, n, 77, null from n where s_suppkey % 4 = 0""",
    "object_types": """
with s as (select s_nationkey % 5 + 1 as n from supplier)
select 1::bigint as type, count(*) as n from s union all select 2, sum(n)::bigint from s union all select 6000, sum(n // 2)::bigint from s having sum(n // 2) > 0 union all select 6007, sum((n + 1) // 2)::bigint from s
union all select 6001, sum(n + 1)::bigint from s union all select 6005, count(*) from s union all select 6201, count(*) from s""",
    "keynote_facts": _long(
        "select p_partkey, p_size, p_size % 6 as n, p_size % 9 as d from part", "p_partkey",
        {
            "keynote.slide_count": ("n + 1", "exact"), "keynote.master_slide_count": ("2", "exact"), "keynote.hidden_slide_count": ("n // 2", "exact"), "keynote.slides_with_notes_count": ("(n + 2) // 3", "exact"),
            "keynote.orientation": ("case when p_partkey % 7 = 0 then 'null' when p_size > 25 then '\"landscape\"' when p_size < 25 then '\"portrait\"' else '\"square\"' end", "exact"),
            "iwork.data_asset_count": ("d", "exact"), "iwork.data_asset_bytes": ("d * (d - 1) // 2", "exact"),
            "iwork.asset_type_counts": ("'{\"audio\":' || (d + 1) // 5 || ',\"font\":' || (d + 2) // 5 || ',\"image\":' || (d + 4) // 5 || ',\"other\":' || d // 5 || ',\"video\":' || (d + 3) // 5 || '}'", "exact"),
            "iwork.preview_dimensions": ("case when p_partkey % 2 = 1 then '{\"preview-web.jpg\":null,\"preview.PNG\":{\"height\":480,\"width\":640}}' else '{}' end", "exact"), "iwork.preview_count": ("case when p_partkey % 2 = 1 then 2 else 0 end", "exact"),
            "iwork.object_type_counts": ("'{\"chart\":0,\"comment_info\":0,\"comment_storage\":0,\"image\":0,\"movie\":0,\"table_info\":0,\"table_model\":0,\"text_storage\":0}'", "exact"),
        },
    ),
    "legacy_facts": _long(
        "select c_custkey, c_name, c_nationkey as nation from customer", "c_custkey",
        {
            "document.title": ("'\"' || c_name || '\"'", "high"), "document.author": ("case when c_custkey % 2 = 0 then '\"me\"' end", "high"), "word.word_count": ("nation", "high"), "word.page_count": ("case when c_custkey % 3 <> 0 then 3 end", "high"),
            "word.is_template": (_YES("c_custkey % 5 = 0"), "exact"), "security.has_macros": (_YES("c_custkey % 4 = 0"), "exact"), "security.encrypted": ("null", "exact"), "office.cfb_entry_count": ("case when c_custkey % 4 = 0 then 4 else 3 end", "exact"), "office.document_kind": ("'\"word\"'", "exact"),
        },
    ),
    "jsonl_reports": """
with l as (select event_id, event_id % 8 as k from events),
e as (select *, case when k in (4, 5, 6) then 'INVALID_REQUEST' when k = 7 then 'UNSUPPORTED_FORMAT' end as error_code from l)
select event_id as line_no, case when error_code is null then 'ok' else 'error' end as status, error_code,
  case k when 4 then 'invalid JSONL base64 payload' when 5 then 'JSONL object must contain either path, or name plus data_base64' when 6 then 'JSONL line ' || event_id || ' is invalid' when 7 then 'unsupported format: .txt' end as error_message,
  case error_code when 'INVALID_REQUEST' then 1 when 'UNSUPPORTED_FORMAT' then 3 else 0 end as exit_code,
  case when error_code is null then '"1.' || k || '"' end as version, case when error_code is null then '8' end as size from e""",
    "jsonl_exit": "select event_type, cast(max(case when event_id % 8 < 4 then 5 when event_id % 8 = 7 then 3 else 1 end) as bigint) as exit_code from events group by 1",
    "best_evidence": """
with e as (select *, event_id % 5 as c from events),
r as (select *, row_number() over (partition by user_id, event_type order by c desc, event_id) as k from e)
select user_id, event_type as target, event_id::varchar as value, ['none', 'low', 'medium', 'high', 'exact'][c + 1] as confidence from r where k = 1""",
    "level_facts": f"""
with d as (select doc_id, source, {_LINES} as n from documents),
r as (select unnest(['header', 'metadata', 'metadata, exact', 'deep', 'deep, saved']) as request),
f as (select doc_id, request, unnest([
  {{'target': 'document.format_profile', 'value': case when doc_id % 5 = 0 then '"dotx"' else '"docx"' end, 'confidence': 'exact', 'path': 'ooxml.identity'}},
  {{'target': 'document.title', 'value': case when request <> 'header' and trim(source) <> '' then '"' || source || '"' end, 'confidence': 'high', 'path': 'ooxml.core_properties'}},
  {{'target': 'word.paragraph_count', 'value': case when request in ('metadata', 'deep, saved') then '1' when request like 'deep%' then n::varchar end,
    'confidence': case when request = 'deep' then 'exact' else 'high' end, 'path': case when request = 'deep' then 'word.document_structure' else 'word.app_statistics' end}}]) as x from d, r)
select doc_id, request, x.target as target, case when x.value is not null then 'resolved' when request = 'header' or request = 'metadata, exact' and x.target = 'word.paragraph_count' then 'unsupported' else 'unknown' end as status,
  x.value as value, case when x.value is null then 'none' else x.confidence end as confidence, case when x.value is not null or x.target = 'document.title' and request <> 'header' then x.path else 'planner' end as path from f
union all select doc_id, 'wrong option', '', 'error', 'invalid request: invalid word.statistics_path: fast', 'none', '' from d""",
    "damaged_documents": """
with k as (select event_id, event_id % 16 as k from events), e as (select *, case when k in (1, 2, 3, 4, 7, 9, 10, 12, 13, 14) then 'MALFORMED_INPUT' when k in (8, 15) then 'UNSUPPORTED_FORMAT' end as error_code from k)
select event_id, error_code, case error_code when 'MALFORMED_INPUT' then 4 when 'UNSUPPORTED_FORMAT' then 3 else 0 end as exit_code,
  case k when 0 then '"office-open-xml"' when 5 then '"apple-iwork"' when 6 then '"apple-iwork"' when 11 then '"office-legacy"' end as format,
  case k when 5 then '0' when 6 then '9223372036854775813' end as bytes, case k when 5 then '{"10000":1,"18446744073709551615":1}' when 6 then '{"10000":1}' end as types, case k when 11 then '"T"' end as title from e""",
    "manifest_facts": """
with k as (select s_suppkey, s_name, s_suppkey % 5 as k from supplier)
select s_suppkey, case k when 3 then 'BUDGET_EXCEEDED' when 4 then 'SOURCE_IO' end as error_code, case k when 3 then 4 when 4 then 2 else 0 end as exit_code,
  case when k < 3 then s_suppkey::varchar end as slides, case when k < 3 then '"' || s_name || '"' end as title, case when k <> 4 then true end as frugal, case when k <> 4 then k <> 3 end as large from k""",
    "jsonl_files": """
with l as (select *, row_number() over (partition by event_type order by event_id) as line_no from events), k as (select *, event_id % 8 as k from l where event_id % 7 <> 0)
select event_type, line_no, case when k < 4 then 'ok' else 'error' end as status,
  case k when 4 then 'invalid JSONL base64 payload' when 5 then 'JSONL object must contain either path, or name plus data_base64' when 6 then 'JSONL line ' || line_no || ' is invalid' when 7 then 'unsupported format: .txt' end as error_message,
  case when k < 4 then 0 when k = 7 then 3 else 1 end as exit_code from k""",
    "selector_sizes": "select profile, selector, level, n::bigint as n from (values "
    + ", ".join(f"('{p}', '{s}', '{level}', {n})" for p, of in SIZES.items() for s, ns in of.items() for level, n in zip(catalog.LEVELS, ns, strict=True)) + ") as t(profile, selector, level, n)",
    "format_list": "select driver, unnest(string_split(ps, ' ')) as profile, support from (values ('pdf', 'pdf', '2.0'), ('word', 'docx docm dotx dotm', '2.0'), ('excel', 'xlsx xlsm xltx xltm xlsb', '2.0; xlsb identity only'), ('powerpoint', 'pptx pptm ppsx ppsm potx potm', '2.0'), ('keynote', 'key', '2.0; modern IWA only'), ('numbers', 'numbers', '2.0; modern IWA only'), ('pages', 'pages', '2.0; modern IWA only'), ('office-legacy', 'doc xls ppt encrypted-ooxml', 'metadata and format statistics')) as t(driver, ps, support)",
    "target_list": "select * from (values ('common', 'low', 7, 9, 7), ('common', 'moderate', 16, 17, 14), ('common', 'high', 5, 5, 3), ('office', 'low', 1, 1, 1), ('office', 'moderate', 2, 2, 2), ('format', 'moderate', 13, 14, 13)) as t(scope, cost_class, n, n_aliases, n_applicable)",
}
