"""Facts of documents, derived in column expressions from what their containers hold.

`facts` adds `evidence`, an array of facts, to decoded rows. A row is a document; all is
worked out within it, so nothing is shuffled. A document that does not fit its profile
gets an error instead, as does one whose parts are damaged. Ties between facts of one
target are settled by `report.best`.
"""

from functools import cache, reduce

from pyspark.sql import functions as F

from factloom.catalog import APPLICATIONS, DRIVERS, FAMILIES
from factloom.functions.evidence import RAW, evidence, gcd, or_null, orientation, pinned, plain, resolved, settled, text_json, unresolved, unsigned
from factloom.operators.routing import exit_code, mapped, prefix
from factloom.sources.packages import APP, CORE, DOCUMENT, MAIN, NAMES, NEEDS, PROPERTIES, TYPES

SIGNATURE = "application/vnd.openxmlformats-package.digital-signature-xmlsignature+xml"


def long(n=0):
    return F.lit(n).cast("bigint")


def none(kind):
    return F.lit(None).cast(kind)


# ---- what is common


def identity(path):
    """Facts that routing gives; `extensions` of a profile hold the suffix it was routed by."""
    by = F.when(F.col("profile") == "doc", F.col("extension").isin("doc", "dot")).when(F.col("profile") == "xls", F.col("extension").isin("xls", "xlt")).when(F.col("profile") == "ppt", F.col("extension").isin("ppt", "pps", "pot"))
    fits = F.coalesce(by, F.col("extension") == F.col("profile"), F.lit(False)) | (F.col("profile") == "encrypted-ooxml")
    return [
        resolved("document.format", text_json(F.col("format")), "exact", path, "profile"),
        resolved("document.format_profile", text_json(F.col("profile")), "exact", path, "profile"),
        resolved("document.mime_type", text_json(F.col("mime_type")), "exact", path, "profile"),
        resolved("document.file_size", plain(F.col("file_size")), "exact", path, "source length"),
        resolved("document.extension", text_json(F.col("extension")), "exact", path, "source name"),
        resolved("document.extension_matches", plain(fits), "exact", path, "source name"),
    ]


# ---- OPC


def part(name):
    return F.get(F.filter("parts", lambda p: p["part"] == name), F.lit(0))


def items(p, name):
    return F.coalesce(F.filter(p["items"], lambda i: i["name"] == name), F.array().cast("array<struct<name:string,attrs:map<string,string>>>"))


def lower_names():
    return F.col("_names")


def unique_parts(start, end, keep=lambda n: F.lit(True)):
    """Distinct names, case folded, with a beginning and an end."""
    return F.size(F.array_distinct(F.filter(lower_names(), lambda n: n.startswith(start.lower()) & n.endswith(end.lower()) & keep(n)))).cast("bigint")


def counted_parts(start, end):
    """Names with a beginning and an end as they are written."""
    return F.size(F.filter("entries", lambda e: e["name"].startswith(start) & e["name"].endswith(end))).cast("bigint")


def content_type(name):
    """The content type of a part: its last override, else the last default of its suffix."""
    last = lambda found: F.lower(F.get(F.reverse(found), F.lit(0))["attrs"]["contenttype"])
    override = F.filter("_overrides", lambda i: (F.ltrim(F.lower(i["attrs"]["partname"]), F.lit("/")) == name))
    default = F.filter("_defaults", lambda i: (F.lower(i["attrs"]["extension"]) == F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))))
    return F.coalesce(last(override), last(default))


def typed_parts(start, *kinds):
    """Distinct parts below a folder whose content type begins with one of the kinds."""
    return unique_parts(start, "", lambda n: F.coalesce(F.exists(F.array(*map(F.lit, kinds)), lambda k: F.startswith(content_type(n), k)), F.lit(False)))


def relationships():
    return F.col("_rels")


def ooxml_security():
    """{macros, external, embedded, signed, signatures} of an OPC package."""
    rels, names = relationships(), lower_names()
    external = lambda r: F.coalesce(F.lower(r["attrs"]["targetmode"]) == "external", F.lit(False))
    kind = lambda r: F.coalesce(F.lower(r["attrs"]["type"]), F.lit(""))
    named = F.filter(names, lambda n: n.startswith("_xmlsignatures/") & n.endswith(".xml") & F.startswith(F.substring_index(n, "/", -1), F.lit("sig")) & ~F.contains(n, F.lit("/_rels/")))
    typed = F.transform(F.filter("_overrides", lambda i: F.lower(i["attrs"]["contenttype"]) == SIGNATURE), lambda i: F.ltrim(F.lower(i["attrs"]["partname"]), F.lit("/")))
    signatures = F.size(F.array_union(named, F.array_intersect(typed, names))).cast("bigint")
    return {
        "macros": F.exists(names, lambda n: n.endswith("vbaproject.bin")),
        "external": F.exists(rels, external),
        "embedded": F.exists(names, lambda n: F.array_contains(F.split(n, "/"), "embeddings")) | F.exists(rels, lambda r: ~external(r) & (kind(r).endswith("/oleobject") | kind(r).endswith("/package"))),
        "signed": (signatures > 0) | F.exists(names, lambda n: n.startswith("_xmlsignatures/")) | F.exists(rels, lambda r: F.contains(kind(r), F.lit("/relationships/digital-signature/"))),
        "signatures": signatures,
    }


def pins(decoded, families=("ooxml", "pdf", "iwork", "legacy")):
    """Decoded rows with what several facts of these families look at."""
    rows = pinned(decoded, _names=F.transform("entries", lambda e: F.lower(e["name"])), _head=F.coalesce(F.col("marks.head"), F.col("pdf_head")))
    if "ooxml" in families:
        rels = F.flatten(F.transform(F.filter("parts", lambda p: F.lower(p["part"]).endswith(".rels")), lambda p: items(p, "relationship")))
        rows = pinned(rows, _types=part(TYPES), _core=part(CORE), _app=part(APP), _main=part(mapped(F.col("driver"), MAIN)), _rels=rels)
        typed = lambda name: F.when(F.col("_types").isNotNull(), F.filter(items(F.col("_types"), name), lambda i: i["attrs"]["contenttype"].isNotNull()))
        rows = pinned(rows, _overrides=typed("override"), _defaults=typed("default"))
    if "iwork" in families:
        iwork_, refs = F.col("family") == "iwork", lambda o: F.transform(F.filter(o["fields"], lambda f: (f["n"] == 1) & f["ref"].isNotNull()), lambda f: f["ref"])
        rows = pinned(
            rows, _refs=F.when(iwork_, F.concat(F.transform(objects(6000), lambda o: first_bytes(o, 2)["ref"]), F.transform(objects(6007), lambda o: first_bytes(o, 1)["sub"]))),
            _kinds=F.transform("objects", lambda o: o["type"].cast("string")), _root=F.filter("objects", lambda o: o["document"]),
            _nodes=F.filter(objects(4), lambda o: F.exists(o["fields"], lambda f: (f["n"] == 2) & f["ref"].isNotNull())),
        )
        rows = pinned(
            rows, _tables=F.when(iwork_, tables()), _sheets=F.filter("_root", lambda o: (o["type"] == 2) & label(o, 1).isNotNull()),
            _ordered=F.get(F.filter(F.transform(F.filter("_root", lambda o: o["type"] == 1), refs), lambda r: F.size(r) > 0), F.lit(0)),
        )
        rows = pinned(rows, _titles=F.transform("_ordered", lambda r: label(F.get(F.reverse(F.filter("_sheets", lambda o: o["id"] == r)), F.lit(0)), 1)))
    return rows


def risk(macros, embedded, external):
    return F.when(macros, "high").when(embedded, "medium").when(external, "low").otherwise("none")


def texts(name, pairs, path):
    found = F.col("_core" if name == CORE else "_app")["texts"]
    return [resolved(target, text_json(found[key]), "high", path, name) for target, key in pairs]


def ooxml():
    """Facts that all OPC profiles share."""
    s = ooxml_security()
    raw = F.lower(F.col("_types")["raw"])
    core = [("document.title", "title"), ("document.subject", "subject"), ("document.author", "creator"), ("document.keywords", "keywords"), ("document.description", "description"), ("document.created_at", "created"), ("document.modified_at", "modified")]
    inventory, security, deep = "ooxml.package_inventory", "ooxml.package_security", "ooxml.deep_security"
    return [
        *identity("ooxml.identity"),
        resolved("security.encrypted", F.lit("false"), "exact", "ooxml.identity", "readable OPC ZIP"),
        resolved("office.document_kind", text_json(F.col("driver")), "exact", "ooxml.identity", "main part family"),
        *texts(CORE, core, "ooxml.core_properties"),
        *texts(APP, [("document.application", "application"), ("document.application_version", "appversion")], "ooxml.app_properties"),
        resolved("security.has_macros", plain(s["macros"]), "exact", inventory, "OPC entry inventory"),
        resolved("office.package_entry_count", plain(F.size("entries")), "exact", inventory, "ZIP central directory"),
        resolved("office.conformance", text_json(F.when(raw.isNull(), "unknown").when(F.contains(raw, F.lit("purl.oclc.org/ooxml")), "strict").otherwise("transitional")), "high", inventory, "[Content_Types].xml namespaces"),
        resolved("security.password_protected", F.lit("false"), "exact", "ooxml.readability_security", "readable unencrypted OPC package"),
        resolved("security.has_digital_signature", plain(s["signed"]), "exact", security, "OPC digital-signature parts and relationships"),
        resolved("security.has_external_relationships", plain(s["external"]), "exact", security, "all OPC .rels parts scanned for TargetMode=External"),
        resolved("security.has_embedded_files", plain(s["embedded"]), "exact", security, "OPC embeddings and internal oleObject/package relationships"),
        resolved("security.signature_count", plain(s["signatures"]), "exact", deep, "unique OPC digital-signature XML parts"),
        unresolved("security.has_javascript", deep, "unsupported"),
        resolved("security.active_content_risk", text_json(risk(s["macros"], s["embedded"], s["external"])), "exact", deep, "macros, then embedded files, then external relationships"),
    ]


def saved(target, key, path):
    """A whole number that the application saved."""
    return resolved(target, plain(unsigned(F.col("_app")["texts"][key])), "high", path, "docProps/app.xml saved statistic")


def word():
    main, structure, assets = F.col("_main"), "word.document_structure", "word.asset_inventory"
    count = lambda name: plain(F.coalesce(main["counts"][name], long()))
    return [
        resolved("word.is_template", plain(F.col("profile").isin("dotx", "dotm")), "exact", "word.profile", "detected OOXML profile"),
        resolved("word.unique_image_asset_count", plain(typed_parts("word/media/", "image/")), "exact", assets, "unique image asset parts under word/media/"),
        resolved("word.comment_part_count", plain(unique_parts("word/comments", ".xml")), "exact", assets, "unique Word comment-related XML parts"),
        *(saved(f"word.{t}_count", k, "word.app_statistics") for t, k in (("page", "pages"), ("word", "words"), ("character", "characters"), ("paragraph", "paragraphs"))),
        resolved("word.paragraph_count", count("p"), "exact", structure, MAIN["word"]),
        resolved("word.table_count", count("tbl"), "exact", structure, MAIN["word"]),
    ]


def excel():
    book, assets, xml, source = F.col("_main"), "excel.asset_inventory", "excel.workbook_xml", MAIN["excel"]
    text_book = F.col("profile") != "xlsb"
    sheets = items(book, "sheet")
    there = lambda c: F.when(text_book, c)
    names = F.filter(F.transform(sheets, lambda i: i["attrs"]["name"]), lambda n: n.isNotNull())
    hidden = F.filter(sheets, lambda i: F.coalesce(i["attrs"]["state"] != "visible", F.lit(False)))
    strings = F.get(items(part("xl/sharedStrings.xml"), "sst"), F.lit(0))["attrs"]
    return [
        resolved("excel.is_template", plain(F.col("profile").isin("xltx", "xltm")), "exact", "excel.profile", "detected OOXML profile"),
        resolved("excel.binary_workbook", plain(~text_book), "exact", "excel.profile", "detected OOXML profile"),
        resolved("excel.table_count", plain(counted_parts("xl/tables/", ".xml")), "exact", "excel.table_inventory", "OPC entry inventory"),
        resolved("excel.chart_part_count", plain(unique_parts("xl/charts/chart", ".xml")), "exact", assets, "unique Excel chart XML parts"),
        resolved("excel.pivot_table_part_count", plain(unique_parts("xl/pivotTables/pivotTable", ".xml")), "exact", assets, "unique Excel pivot-table definition parts"),
        resolved("excel.unique_image_asset_count", plain(typed_parts("xl/media/", "image/")), "exact", assets, "unique image asset parts under xl/media/"),
        resolved("excel.sheet_count", there(plain(counted_parts("xl/worksheets/sheet", ".xml"))), "medium", "excel.worksheet_inventory", "worksheet part inventory"),
        resolved("excel.sheet_count", there(plain(F.size(sheets))), "exact", xml, source),
        resolved("excel.sheet_names", there(F.to_json(names)), "exact", xml, source),
        resolved("excel.hidden_sheet_count", there(plain(F.size(hidden))), "exact", xml, source),
        resolved("excel.defined_name_count", there(plain(F.coalesce(book["counts"]["definedname"], long()))), "exact", xml, source),
        resolved("excel.shared_string_count", there(plain(unsigned(F.coalesce(strings["uniquecount"], strings["count"])))), "exact", "excel.shared_strings", "xl/sharedStrings.xml"),
    ]


def powerpoint():
    show, parts, assets, xml, source = F.col("_main"), "powerpoint.part_inventory", "powerpoint.asset_inventory", "powerpoint.presentation_xml", MAIN["powerpoint"]
    slides = items(show, "sldid")
    hidden = F.filter(slides, lambda i: F.coalesce(i["attrs"]["show"].isin("0", "false", "off"), F.lit(False)))
    size = F.get(items(show, "sldsz"), F.lit(0))["attrs"]
    w, h = unsigned(size["cx"]).cast("bigint"), unsigned(size["cy"]).cast("bigint")
    both = w.isNotNull() & h.isNotNull()
    # in a lambda, so that the divisor is worked out once
    ratio = lambda by: F.struct(F.try_divide(w.cast("double"), h.cast("double")).alias("decimal"), F.floor(h / by).alias("height"), F.floor(w / by).alias("width"))
    size_json = F.to_json(F.struct(h.alias("height_emu"), (h / 12700.0).alias("height_pt"), w.alias("width_emu"), (w / 12700.0).alias("width_pt")))
    ratio_json = F.to_json(F.transform(F.array(F.greatest(gcd(w, h), long(1))), ratio)[0])
    kind = F.when(F.col("profile").isin("ppsx", "ppsm"), "show").when(F.col("profile").isin("potx", "potm"), "template").otherwise("presentation")
    return [
        resolved("powerpoint.presentation_kind", text_json(kind), "exact", "powerpoint.profile", "detected OOXML profile"),
        *(resolved(f"powerpoint.{t}_count", plain(counted_parts(f"ppt/{p}", ".xml")), "exact", parts, "OPC entry inventory") for t, p in (("master", "slideMasters/slideMaster"), ("layout", "slideLayouts/slideLayout"), ("notes_slide", "notesSlides/notesSlide"))),
        resolved("powerpoint.chart_part_count", plain(unique_parts("ppt/charts/chart", ".xml")), "exact", assets, "unique PowerPoint chart XML parts"),
        resolved("powerpoint.unique_image_asset_count", plain(typed_parts("ppt/media/", "image/")), "exact", assets, "unique image asset parts under ppt/media/"),
        resolved("powerpoint.unique_media_asset_count", plain(typed_parts("ppt/media/", "audio/", "video/")), "exact", assets, "unique audio/video asset parts under ppt/media/"),
        resolved("powerpoint.comment_part_count", plain(unique_parts("ppt/comments/", ".xml")), "exact", assets, "unique PowerPoint comment XML parts"),
        saved("powerpoint.slide_count", "slides", "powerpoint.app_statistics"),
        resolved("powerpoint.slide_count", plain(F.size(slides)), "exact", xml, source),
        resolved("powerpoint.hidden_slide_count", plain(F.size(hidden)), "exact", xml, source),
        resolved("powerpoint.slide_size", F.when(both, size_json), "exact", xml, source + " p:sldSz"),
        resolved("powerpoint.aspect_ratio", F.when(both, ratio_json), "exact", xml, source + " p:sldSz"),
        resolved("powerpoint.orientation", text_json(F.when(both, orientation(w, h))), "exact", xml, source + " p:sldSz"),
    ]


def ooxml_error():
    """Why a package does not fit its profile, or null: main part, content types, media type."""
    main = F.when(F.col("profile") == "xlsb", "xl/workbook.bin").otherwise(mapped(F.col("driver"), MAIN))
    raw = F.col("_types")["raw"]
    return (
        F.when(~F.exists("entries", lambda e: e["name"] == main), F.concat(F.lit("."), F.col("profile"), F.lit(" package is missing required main part "), main))
        .when(raw.isNull(), "missing [Content_Types].xml")
        .when(~F.contains(F.lower(raw), F.lower("mime_type")), F.concat(F.lit("package main content type does not match ."), F.col("profile")))
    )


# ---- PDF


def pdf():
    """Facts of a PDF's first 8 KiB and of its bytes; `pdf_head` and `pdf_xref` come from `heads`."""
    path = "pdf.header"
    return [
        *identity(path),
        resolved("pdf.version", text_json(F.regexp_extract("_head", r"%PDF-([0-9.]{0,8})", 1)), "exact", path, "%PDF header"),
        resolved("pdf.linearized", plain(F.instr("_head", "/Linearized") > 0), "high", path, "first 8 KiB"),
        resolved("pdf.xref_type", text_json(F.coalesce(F.col("marks.xref"), F.col("pdf_xref"))), "exact", "pdf.document_structure", "cross-reference markers"),
        resolved("security.has_macros", F.lit("false"), "exact", "pdf.document_structure", "format capability"),
    ]


def heads(routed):
    """Add what byte searches of PDF files give, before their content is left behind."""
    whole = F.when(F.col("family") == "pdf", F.col("content"))
    has = lambda *marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(whole, m))
    table, stream = has(b"\nxref", b"\rxref"), has(b"/Type/XRef", b"/Type /XRef")
    xref = F.when(whole.isNotNull(), F.when(table & stream, "hybrid").when(table, "table").when(stream, "stream").otherwise("unknown"))
    by_path = F.col("path").isNotNull() if "path" in routed.columns else F.lit(False)
    at_hand = lambda c: F.when(~by_path, c)
    return routed.withColumns({"pdf_head": at_hand(F.decode(F.substring(whole, 1, 8192), "ISO-8859-1")), "pdf_xref": at_hand(xref)})


# ---- iWork


def objects(*kinds):
    return F.filter("objects", lambda o: o["type"].isin(*kinds))


def count_of(*kinds):
    return F.size(objects(*kinds)).cast("bigint")


def field(o, number, value):
    """The first field of a number that has such a value."""
    return F.get(F.filter(o["fields"], lambda f: (f["n"] == number) & f[value].isNotNull()), F.lit(0))[value]


def first_bytes(o, number):
    return F.get(F.filter(o["fields"], lambda f: (f["n"] == number) & f["bytes"]), F.lit(0))


def label(o, number):
    """The first bytes of a number as text; none if it is no UTF-8 or holds control characters."""
    text = first_bytes(o, number)["s"]
    return F.when(~text.rlike(r"[\x00-\x1F\x7F-\x9F]"), text)


def components(*starts):
    """Entries that are components of a name: that name, or followed by a digit or a hyphen."""
    pattern = "^(?:" + "|".join(s.replace("/", "\\/") for s in starts) + r")(?:|[-0-9][^/]*)\.iwa$"
    return F.size(F.filter("entries", lambda e: e["name"].rlike(pattern))).cast("bigint")


def tables():
    """Logical tables in order of name and identifier: models that a table info refers to."""
    models = F.filter(objects(6001), lambda o: F.exists("_refs", lambda r: F.coalesce(r == o["id"], F.lit(False))) & field(o, 6, "v").isNotNull() & field(o, 7, "v").isNotNull())
    number = lambda o, n: F.coalesce(field(o, n, "v"), F.lit(0)).cast("bigint")
    made = F.transform(
        models,
        lambda o: F.struct(
            F.coalesce(label(o, 8), label(o, 1), F.lit("")).alias("name"), o["id"].alias("id"), number(o, 6).alias("rows"), number(o, 7).alias("columns"), number(o, 14).alias("hidden_rows"),
            number(o, 15).alias("hidden_columns"), number(o, 40).alias("filtered_rows"), field(o, 16, "d").alias("default_row_height_pt"), field(o, 17, "d").alias("default_column_width_pt"),
        ),
    )
    return F.array_sort(made)


def total(found, name):
    return F.aggregate(found, long(), lambda n, t: n + t[name])


def canvas(kind, w, h, path, source):
    """Size, ratio and orientation; null values where there is no positive size."""
    good = (w > 0) & (h > 0) & (w < float("inf")) & (h < float("inf"))
    size, ratio, way = ("slide_size", "aspect_ratio", "orientation") if kind == "keynote" else ("page_size", "aspect_ratio", "orientation")
    return [
        resolved(f"{kind}.{size}", or_null(F.when(good, F.to_json(F.struct(h.alias("height_pt"), w.alias("width_pt"))))), "exact", path, source),
        resolved(f"{kind}.{ratio}", or_null(F.when(good, F.to_json(F.struct((w / h).alias("decimal"), h.alias("height"), w.alias("width"))))), "exact", path, source),
        resolved(f"{kind}.{way}", or_null(text_json(F.when(good, orientation(w, h)))), "exact", path, source),
    ]


SEMANTIC = {"chart": [5021], "comment_info": [2014], "comment_storage": [3056], "image": [3005], "movie": [3007], "table_info": [6000, 6007], "table_model": [6001], "text_storage": [2001, 2005]}
# Suffixes of assets by kind. Fixed values of the format.
ASSETS = {"image": "bmp gif heic heif jpeg jpg png svg tif tiff webp", "audio": "aac aif aiff caf m4a mp3 wav", "video": "avi m4v mov mp4 mpeg mpg", "font": "otf ttf woff woff2"}


def asset_kind(name):
    """image, audio, video, font or other, by suffix."""
    suffix = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))
    out = F.when(F.lit(False), F.lit(""))
    for kind, known in ASSETS.items():
        out = out.when(suffix.isin(*known.split()), kind)
    return out.otherwise("other")


def histogram(keys):
    """JSON of {key: how often it stands in the array}, in the keys' order as text."""
    distinct = F.array_sort(F.array_distinct(keys))
    pairs = F.transform(distinct, lambda k: F.struct(k, F.size(F.filter(keys, lambda x: x == k)).cast("bigint")))
    return F.to_json(F.map_from_entries(pairs))


def iwork():
    inventory, about, deep, whole = "iwork.package_inventory", "iwork.package_metadata", "iwork.iwa_objects", "iwork.iwa_integrity"
    data = F.filter("entries", lambda e: e["name"].startswith("Data/") & ~e["name"].endswith("/"))
    kinds = F.transform(data, lambda e: asset_kind(e["name"]))
    previews = F.filter(lower_names(), lambda n: n.isin("preview.jpg", "preview.jpeg", "preview.png") | n.startswith("preview-"))
    zip_ = "ZIP central directory"
    build = F.get(F.reverse(F.filter("builds", lambda b: ~b.startswith("Template:"))), F.lit(0))
    named = lambda key: or_null(text_json(F.when(~F.col("plist")[key].isNull(), F.col("plist")[key])))
    flag = lambda key: or_null(F.when(F.col("plist")[key].isin("true", "false"), F.col("plist")[key]))
    sizes = F.to_json(F.map_from_entries(F.transform(F.array_sort("previews"), lambda p: F.struct(p["name"], F.when(p["width"].isNotNull(), F.struct(p["height"].alias("height"), p["width"].alias("width")))))), {"ignoreNullFields": "false"})
    fixed = lambda counts: F.to_json(F.struct(*(c.alias(k) for k, c in counts.items())))
    of_kind = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("bigint")
    asset_counts = fixed({k: of_kind(k) for k in ("audio", "font", "image", "other", "video")})
    return [
        *identity("iwork.identity"),
        resolved("security.encrypted", F.lit("false"), "exact", "iwork.identity", "readable validated IWA package"),
        resolved("iwork.document_kind", text_json(F.col("driver")), "exact", "iwork.identity", "validated IWA family"),
        resolved("iwork.file_format_version", named("fileFormatVersion"), "high", about, PROPERTIES),
        resolved("document.application_version", or_null(text_json(build)), "high", about, "Metadata/BuildVersionHistory.plist"),
        resolved("iwork.producer_build", or_null(text_json(build)), "high", about, "Metadata/BuildVersionHistory.plist"),
        resolved("document.language", named("language"), "high", about, PROPERTIES),
        resolved("document.locale", named("locale"), "high", about, PROPERTIES),
        resolved("iwork.is_multi_page", flag("isMultiPage"), "high", about, PROPERTIES),
        resolved("iwork.has_external_or_missing_data", flag("hasExternalReferenceOrMissingOrUnmaterializedRemoteData"), "high", about, PROPERTIES),
        resolved("document.application", text_json(mapped(F.col("profile"), APPLICATIONS)), "exact", inventory, "validated IWA family"),
        resolved("security.has_macros", F.lit("false"), "exact", inventory, "modern IWA format capability"),
        resolved("security.password_protected", F.lit("false"), "exact", inventory, "readable validated IWA package"),
        resolved("iwork.package_entry_count", plain(F.size("entries")), "exact", inventory, zip_),
        resolved("iwork.iwa_entry_count", plain(F.size(F.filter(lower_names(), lambda n: n.endswith(".iwa")))), "exact", inventory, zip_),
        resolved("iwork.data_asset_count", plain(F.size(data)), "exact", inventory, zip_),
        resolved("iwork.data_asset_bytes", plain(F.aggregate(data, F.lit(0).cast("decimal(38,0)"), lambda n, e: (n + e["size"]).cast("decimal(38,0)"))), "exact", inventory, zip_),
        resolved("iwork.asset_type_counts", asset_counts, "exact", inventory, "Data/ filename extensions"),
        resolved("iwork.has_preview", plain(F.size(previews) > 0), "exact", inventory, zip_),
        resolved("iwork.preview_count", plain(F.size(previews)), "exact", inventory, zip_),
        resolved("iwork.preview_dimensions", sizes, "exact", "iwork.preview_metadata", "image headers"),
        resolved("iwork.all_iwa_valid", F.lit("true"), "exact", whole, "all IWA Snappy streams and protobuf archive frames"),
        resolved("quality.corrupted", F.lit("false"), "exact", whole, "complete IWA package validation"),
        resolved("iwork.archive_object_count", plain(F.size("objects")), "exact", deep, "IWA archive frames"),
        resolved("iwork.message_type_counts", histogram(F.col("_kinds")), "exact", deep, "IWA archive frames"),
        resolved("iwork.object_type_counts", fixed({k: count_of(*v) for k, v in SEMANTIC.items()}), "exact", deep, "IWA message types"),
    ]


def tile_components(kind):
    return resolved(f"{kind}.table_component_count", plain(components("Index/Tables/Tile")), "exact", "iwork.package_inventory", "IWA component inventory")


def keynote():
    inventory, deep, node = "iwork.package_inventory", "iwork.iwa_objects", "KN.SlideNodeArchive"
    nodes = F.col("_nodes")
    flagged = lambda n: plain(F.size(F.filter(nodes, lambda o: F.coalesce(field(o, n, "v") != 0, F.lit(False)))))
    size = first_bytes(F.get(objects(2), F.lit(0)), 4)
    return [
        resolved("keynote.slide_count", plain(components("Index/Slide")), "exact", inventory, "IWA component inventory"),
        resolved("keynote.master_slide_count", plain(components("Index/MasterSlide", "Index/TemplateSlide")), "exact", inventory, "IWA component inventory"),
        tile_components("keynote"),
        *canvas("keynote", size["w"], size["h"], deep, "KN.ShowArchive size"),
        *(resolved(f"keynote.{t}_count", flagged(n), "exact", deep, node) for t, n in (("hidden_slide", 4), ("slides_with_builds", 6), ("slides_with_transitions", 7), ("slides_with_notes", 8))),
        resolved("keynote.table_count", plain(F.size("_tables")), "exact", deep, "TST.TableInfoArchive tableModel references"),
    ]


def numbers():
    inventory, deep, model = "iwork.package_inventory", "iwork.iwa_objects", "TST.TableModelArchive"
    names = F.when(F.forall("_titles", lambda n: n.isNotNull()), F.col("_titles"))
    found = F.col("_tables")
    shown = F.transform(found, lambda t: F.struct(*(t[k].alias(k) for k in ("columns", "default_column_width_pt", "default_row_height_pt", "filtered_rows", "hidden_columns", "hidden_rows", "name", "rows"))))
    lists = F.filter(objects(6005, 6201), lambda o: F.coalesce(field(o, 1, "v") == 3, F.lit(False)))
    formulas = F.aggregate(lists, long(), lambda n, o: n + F.size(F.filter(o["fields"], lambda f: (f["n"] == 3) & f["bytes"])))
    return [
        resolved("numbers.sheet_count", plain(F.when(names.isNotNull(), F.size(names))), "exact", inventory, "document sheet references"),
        resolved("numbers.sheet_names", F.to_json(names), "exact", inventory, "document sheet references"),
        tile_components("numbers"),
        resolved("numbers.table_count", plain(F.size(found)), "exact", deep, "TST.TableInfoArchive tableModel references"),
        resolved("numbers.table_dimensions", F.to_json(shown, {"ignoreNullFields": "false"}), "exact", deep, model),
        *(resolved(f"numbers.{t}_count", plain(total(found, n)), "exact", deep, model) for t, n in (("hidden_row", "hidden_rows"), ("hidden_column", "hidden_columns"), ("filtered_row", "filtered_rows"))),
        resolved("numbers.formula_definition_count", plain(formulas), "exact", deep, "TST.TableDataList FORMULA entries"),
    ]


def pages():
    deep = "iwork.iwa_objects"
    document = F.get(objects(10000), F.lit(0))
    ref = first_bytes(document, 4)["ref"]
    body = F.get(F.filter(objects(2001, 2005), lambda o: o["id"] == ref), F.lit(0))
    runs = F.filter(body["fields"], lambda f: f["n"] == 3)
    text = F.when(F.forall(runs, lambda f: f["bytes"] & f["s"].isNotNull()), F.array_join(F.transform(runs, lambda f: f["s"]), ""))
    sections = objects(10011)
    titles = F.filter(F.transform(sections, lambda o: label(o, 26)), lambda n: n.isNotNull())
    return [
        tile_components("pages"),
        resolved("pages.section_count", plain(F.size(sections)), "exact", deep, "TP.SectionArchive objects"),
        resolved("pages.section_names", F.to_json(titles), "exact", deep, "TP.SectionArchive names"),
        resolved("pages.change_tracking_enabled", plain(F.coalesce(field(document, 40, "v") != 0, F.lit(False))), "exact", deep, "TP.DocumentArchive change_tracking_enabled"),
        resolved("pages.body_text_length", or_null(plain(F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2))), "exact", deep, "TSWP.StorageArchive text"),
        resolved("pages.body_paragraph_break_count", or_null(plain(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))), "exact", deep, "TSWP.StorageArchive text"),
        resolved("pages.cached_page_count", or_null(plain(field(F.get(objects(10131), F.lit(0)), 4, "v"))), "high", deep, "TP.LayoutStateArchive last_page_count cache"),
        resolved("pages.table_count", plain(F.size("_tables")), "exact", deep, "TST.TableInfoArchive tableModel references"),
        *canvas("pages", field(document, 30, "f"), field(document, 31, "f"), deep, "TP.DocumentArchive page_width/page_height"),
    ]


def iwork_error():
    """Why a package is no modern iWork document of its profile, as (code, message), both null if it is."""
    has = lambda name: F.exists("entries", lambda e: e["name"] == name)
    old = has("index.apxl") | has("index.xml")
    root = F.transform("_root", lambda o: o["type"])
    within = lambda n: F.array_contains(root, long(n))
    slide = components("Index/Slide") > 0
    fits = (
        F.when(F.col("profile") == "key", within(1) & slide)
        .when(F.col("profile") == "numbers", within(1) & within(2) & ~within(10000) & ~slide & F.exists("entries", lambda e: e["name"].startswith("Index/Tables/")))
        .otherwise(within(10000))
    )
    code = F.when(~has(DOCUMENT) & old, "UNSUPPORTED_FORMAT").when(~has(DOCUMENT) | ~has(PROPERTIES) | ~fits, "MALFORMED_INPUT")
    said = (
        F.when(~has(DOCUMENT) & old, "legacy XML iWork packages are not supported; modern IWA is required")
        .when(~has(DOCUMENT), f"iWork ZIP package is missing {DOCUMENT}")
        .when(~has(PROPERTIES), F.concat(F.lit("modern ."), F.col("profile"), F.lit(f" package is missing {PROPERTIES}")))
        .when(~fits, F.concat(F.lit("IWA root objects do not match the ."), F.col("profile"), F.lit(" profile")))
    )
    return code, said


# ---- legacy containers


def cfb_kind():
    has = lambda n: F.array_contains(F.col("streams"), n)
    return (
        F.when(has("EncryptionInfo") & has("EncryptedPackage"), "encrypted-ooxml")
        .when(has("WordDocument"), "doc")
        .when(has("Workbook") | has("Book"), "xls")
        .when(has("PowerPoint Document") | has("PP97_DUALSTORAGE"), "ppt")
    )


def legacy():
    inventory, about, content = "office_legacy.cfb_inventory", "office_legacy.summary_information", "office_legacy.content_statistics"
    names = F.transform("streams", lambda n: F.rtrim(F.lower(n), F.lit("/")))
    encrypted = F.col("profile") == "encrypted-ooxml"
    kind = mapped(F.col("profile"), {"doc": "word", "xls": "excel", "ppt": "powerpoint", "encrypted-ooxml": "encrypted"})
    any_of = lambda *marks: F.exists(names, lambda n: F.greatest(*(F.contains(n, F.lit(m)).cast("int") for m in (*marks, marks[0]))) == 1)
    macros = any_of("vba") | F.array_contains(names, "macros")
    text = lambda n: text_json(F.when(F.col("properties")[n] != "", F.col("properties")[n]))
    only = lambda profile, c: F.when(F.col("profile") == profile, c)
    ext = F.col("extension")
    show = F.when(ext == "pps", "show").when(ext == "pot", "template").otherwise("presentation")
    streams = "EncryptionInfo + EncryptedPackage streams"
    return [
        *identity(inventory),
        resolved("security.encrypted", F.when(encrypted, "true"), "exact", inventory, streams),
        resolved("security.password_protected", F.when(encrypted, "true"), "exact", inventory, streams),
        resolved("security.has_macros", plain(macros), "exact", inventory, "CFB directory names"),
        resolved("security.has_embedded_files", plain(any_of("objectpool", "ole10native", "package")), "exact", inventory, "CFB directory names"),
        resolved("office.document_kind", text_json(kind), "exact", inventory, "CFB streams"),
        resolved("office.legacy_kind", text_json(F.col("profile")), "exact", inventory, "CFB streams"),
        resolved("office.cfb_container", F.lit("true"), "exact", inventory, "CFB signature"),
        resolved("office.cfb_entry_count", plain(F.size("streams")), "exact", inventory, "CFB directory"),
        resolved("office.content_probe_supported", plain(~encrypted), "exact", inventory, "CFB streams"),
        *(resolved(t, text(n), "high", about, "SummaryInformation property set") for t, n in (("document.title", 2), ("document.subject", 3), ("document.author", 4), ("document.keywords", 5), ("document.application", 18))),
        unresolved("document.created_at", about), unresolved("document.modified_at", about),
        *(resolved(f"word.{t}_count", only("doc", plain(unsigned(F.col("properties")[n]))), "high", about, "SummaryInformation saved statistic") for t, n in (("page", 14), ("word", 15), ("character", 16))),
        resolved("word.is_template", only("doc", plain(ext == "dot")), "exact", content, "source name"),
        resolved("excel.is_template", only("xls", plain(ext == "xlt")), "exact", content, "source name"),
        resolved("excel.binary_workbook", only("xls", F.lit("true")), "exact", content, "BIFF container"),
        resolved("powerpoint.presentation_kind", text_json(only("ppt", show)), "exact", content, "source name"),
    ]


# ---- all


#: Facts by driver, and those that drivers of a family share.
OWN = {"word": word, "excel": excel, "powerpoint": powerpoint, "keynote": keynote, "numbers": numbers, "pages": pages}
SHARED = {"ooxml": ooxml, "pdf": pdf, "iwork": iwork, "legacy": legacy}


@cache
def found_by(driver):
    """(target, path) of all facts of a driver."""
    return tuple((f.target, f.path) for f in (*SHARED[FAMILIES[driver]](), *(OWN[driver]() if driver in OWN else ())))


def needed(drivers=None, targets=None, paths=None):
    """{driver: what its decoder has to read} for facts of these targets by these paths (by driver)."""
    out = {}
    for driver in drivers or DRIVERS:
        used = {p for t, p in found_by(driver) if (targets is None or t in targets) and (paths is None or p in paths.get(driver, ()))}
        out[driver] = frozenset().union(*(NEEDS.get(p, ()) for p in used))
    return out


def facts(decoded, drivers=None, targets=None, paths=None):
    """Add `evidence` to decoded rows; rows with an error have none. Errors of decoding and of the profile join those of routing.

    drivers, targets, paths (by driver): only these are derived (a shorter plan); documents of
    other drivers get no facts, and are not held against their profile.
    """
    family, driver = F.col("family"), F.col("driver")
    boxed = family.isin("legacy", "encrypted-ooxml")
    chosen = [d for d in DRIVERS if d in (drivers or DRIVERS)]
    kin = {f: [d for d in chosen if FAMILIES[d] == f] for f in SHARED}
    other = F.coalesce(cfb_kind() != F.col("profile"), F.lit(True))
    code, said = F.when(boxed & other, "MALFORMED_INPUT"), F.when(boxed & other, "CFB streams do not match the detected profile")
    if kin["ooxml"]:
        unfit = ooxml_error()
        code, said = code.when((family == "ooxml") & unfit.isNotNull(), "MALFORMED_INPUT"), said.when(family == "ooxml", unfit)
    if kin["iwork"]:
        ik, im = iwork_error()
        code, said = code.when(family == "iwork", ik), said.when(family == "iwork", im)
    code, said = F.coalesce("error_code", "decode_code", code), F.coalesce("decode_message", said)
    rows = pinned(pins(decoded, [f for f, ds in kin.items() if ds]), _code=code, _said=F.coalesce(F.col("error_message"), F.concat(prefix(code), said)))
    empty = F.array().cast(f"array<{RAW}>")
    by = lambda c, made: reduce(lambda out, kv: out.when(c == kv[0], evidence(kv[1])), made.items(), F.when(F.lit(False), empty)).otherwise(empty)
    allowed = lambda f, among: (targets is None or f.target in targets) and (paths is None or any(f.path in paths.get(d, ()) for d in among))
    own = by(driver, {d: [f for f in OWN[d]() if allowed(f, [d])] for d in chosen if d in OWN and (targets is None or any(t in targets for t, _ in found_by(d)))})
    shared = by(F.when(boxed, "legacy").otherwise(family), {f: [x for x in make() if allowed(x, kin[f])] for f, make in SHARED.items() if kin[f]})
    made = F.concat(shared, own)
    if paths is not None and any(paths.get(a, set()) ^ paths.get(b, set()) for ds in kin.values() for a in ds for b in ds):
        # drivers of a family that take different paths: each row keeps those of its own
        mine = F.create_map(*(x for d in chosen for x in (F.lit(d), F.array(*map(F.lit, sorted(paths.get(d, ())))).cast("array<string>"))))[driver]
        made = F.filter(made, lambda e: F.array_contains(mine, e["path"]))
    rows = pinned(rows, _raw=F.when(F.col("_code").isNull(), made).otherwise(empty))
    rows = pinned(rows, evidence=settled(F.col("_raw")))
    rows = rows.withColumns({"error_code": F.col("_code"), "error_message": F.col("_said"), "exit_code": exit_code(F.col("_code"))})
    return rows.drop(*(c for c in rows.columns if c.startswith("_")), *(n for n in NAMES if n not in ("bytes_read", "reads")), "pdf_head", "pdf_xref")
