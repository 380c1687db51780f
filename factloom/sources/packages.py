"""Containers decoded in Spark tasks: ZIP packages with their XML parts, IWA objects and plists, CFB directories.

Only the bytes are read here, with the standard library and pyarrow; what follows from
them is said in column expressions (`operators`). Bytes come from a content column or by
ranges from a file, and only parts that are needed are read. A damaged container gives
decode_code and decode_message, as does whatever a decoder did not expect: no document
fails a job. XML parts that are read leniently end at their first error; a broken part
that has to be whole (content types, relationships) is an error of the document.
"""

import plistlib
import struct
import zipfile
import zlib
from collections import defaultdict
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.sources.ranges import HEAD, SIGNATURE, Damaged, held, opened

PARTS = "array<struct<part: string, counts: map<string,bigint>, items: array<struct<name: string, attrs: map<string,string>>>, texts: map<string,string>, raw: string>>"
FIELDS = "array<struct<n: bigint, v: decimal(20,0), s: string, ref: decimal(20,0), sub: decimal(20,0), f: double, d: double, w: double, h: double, bytes: boolean>>"
DECODED = f"entries array<struct<name: string, size: decimal(20,0)>>, parts {PARTS}, objects array<struct<id: decimal(20,0), type: decimal(20,0), document: boolean, fields: {FIELDS}>>, plist map<string,string>, builds array<string>, previews array<struct<name: string, width: bigint, height: bigint>>, streams array<string>, properties map<int,string>, marks struct<head: string, xref: string>, decode_code string, decode_message string, bytes_read bigint, reads bigint"
NAMES = ["entries", "parts", "objects", "plist", "builds", "previews", "streams", "properties", "marks", "decode_code", "decode_message", "bytes_read", "reads"]

TYPES, CORE, APP = "[Content_Types].xml", "docProps/core.xml", "docProps/app.xml"
MAIN = {"word": "word/document.xml", "excel": "xl/workbook.xml", "powerpoint": "ppt/presentation.xml"}
#: XML parts by what they are needed for.
PARTS_OF = {"core": [CORE], "app": [APP], "strings": ["xl/sharedStrings.xml"], "main": list(MAIN.values())}
#: What facts of a path need besides the directory, content types and an iWork document's root.
NEEDS = {
    "ooxml.core_properties": {"core"}, "ooxml.app_properties": {"app"}, "ooxml.package_security": {"rels"}, "ooxml.deep_security": {"rels"},
    "word.app_statistics": {"app"}, "powerpoint.app_statistics": {"app"}, "word.document_structure": {"main"}, "excel.workbook_xml": {"main"}, "excel.shared_strings": {"strings"}, "powerpoint.presentation_xml": {"main"},
    "iwork.package_metadata": {"about"}, "iwork.preview_metadata": {"previews"}, "iwork.iwa_integrity": {"objects"}, "iwork.iwa_objects": {"objects"},
    "office_legacy.summary_information": {"summary"}, "pdf.document_structure": {"whole"},
}
ALL = frozenset().union(*NEEDS.values())
#: Elements whose attributes are kept.
WANTED = {"default", "override", "relationship", "sheet", "sst", "sldid", "sldsz"}
DOCUMENT, PROPERTIES, BUILDS = "Index/Document.iwa", "Metadata/Properties.plist", "Metadata/BuildVersionHistory.plist"
#: Message types whose fields are kept. Fixed values of the format.
KEPT = {1, 2, 4, 2001, 2005, 6000, 6001, 6005, 6007, 6201, 10000, 10011, 10131}
MAX_OBJECTS = 1_000_000
#: Bytes of containers whose decoded rows are sent on together.
STEP_BYTES = 16 << 20


@lru_cache(4096)
def local(name):
    return name.rpartition(":")[2].lower()


def xml_part(name, data, strict):
    """Counts of start elements, attributes of the wanted ones, and the last text of each element of the parts that hold texts, by local names."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Damaged("MALFORMED_INPUT", f"{name} is not valid UTF-8 XML: {e}") from None
    counts, items, texts, stack, held = defaultdict(int), [], {}, [], []

    def flush():
        value = "".join(held).strip()
        held.clear()
        if value and stack:
            texts[stack[-1]] = value

    def start(tag, attributes):
        tag = local(tag)
        counts[tag] += 1
        if tag in WANTED:
            items.append({"name": tag, "attrs": list({local(k): v for k, v in attributes.items()}.items())})

    def start_within(tag, attributes):
        flush()
        stack.append(local(tag))
        start(tag, attributes)

    def end(_):
        flush()
        stack.pop()

    def refuse(*_):
        raise expat.ExpatError("entities are not read")

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EntityDeclHandler = start, refuse
    if name in (CORE, APP):
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start_within, end, held.append
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        if strict:
            raise Damaged("MALFORMED_INPUT", f"invalid {name}: {e}") from None
    return {"part": name, "counts": list(counts.items()), "items": items, "texts": list(texts.items()), "raw": text if name == TYPES else None}


class Package:
    """A ZIP file, of which the directory and the entries that are asked for are read, up to a bound."""

    def __init__(self, source, max_entries, max_bytes, kind):
        try:
            self.zip = zipfile.ZipFile(source)
        except (zipfile.BadZipFile, OSError, ValueError, struct.error, NotImplementedError) as e:
            raise Damaged("MALFORMED_INPUT", f"invalid {kind} container: {e}") from None
        self.sizes, self.left = {i.filename: i.file_size for i in self.zip.infolist()}, max_bytes
        if len(self.sizes) > max_entries:
            raise Damaged("BUDGET_EXCEEDED", f"archive entries {len(self.sizes)} exceed budget {max_entries}")

    def entries(self):
        return [{"name": n, "size": s} for n, s in self.sizes.items()]

    def read(self, name):
        """An entry's bytes, or None if there is none."""
        if name not in self.sizes:
            return None
        try:
            with self.zip.open(name) as f:
                data = f.read(self.left + 1)
        except (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError, ValueError) as e:
            raise Damaged("MALFORMED_INPUT", f"cannot read {name}: {e}") from None
        self.left -= len(data)
        if self.left < 0:
            raise Damaged("BUDGET_EXCEEDED", f"entry {name} exceeds expanded budget")
        return data


def opc(source, max_entries, max_bytes, needs):
    """Entries and the XML parts of an OPC package that are needed; content types always are."""
    package = Package(source, max_entries, max_bytes, "ZIP/OPC")
    wanted = {TYPES, *(n for need, parts in PARTS_OF.items() if need in needs for n in parts)}
    names = [n for n in package.sizes if n in wanted or "rels" in needs and n.lower().endswith(".rels")]
    return {"entries": package.entries(), "parts": [xml_part(n, package.read(n), n == TYPES or n.lower().endswith(".rels")) for n in names]}


def varint(data, at):
    """(value, place after it) of a base-128 number of at most ten bytes."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            break
        b = data[at + k]
        if k == 9 and b > 1:
            break
        value |= (b & 127) << 7 * k
        if b < 128:
            return value, at + k + 1
    raise Damaged("MALFORMED_INPUT", "invalid varint")


def fields(data):
    """[(number, wire type, value)] of a message; whole numbers are varints, others bytes."""
    out, at = [], 0
    while at < len(data):
        tag, at = varint(data, at)
        number, wire = tag >> 3, tag & 7
        if not number or wire not in (0, 1, 2, 5):
            raise Damaged("MALFORMED_INPUT", "invalid message field")
        if wire == 0:
            value, at = varint(data, at)
        else:
            size = 8 if wire == 1 else 4
            if wire == 2:
                size, at = varint(data, at)
            if at + size > len(data):
                raise Damaged("MALFORMED_INPUT", "field exceeds its message")
            value, at = data[at : at + size], at + size
        out.append((number, wire, value))
    return out


def sub_fields(data):
    """The fields of nested bytes, none if they are no message."""
    try:
        return fields(data)
    except Damaged:
        return []


def first(found, number, wire):
    return next((v for n, w, v in found if n == number and w == wire), None)


def field_row(number, wire, value):
    """A field with all that it may stand for: number, text, reference, nested reference, floats, size."""
    row = dict.fromkeys(("v", "s", "ref", "sub", "f", "d", "w", "h")) | {"n": number, "bytes": wire == 2}
    if wire == 0:
        row["v"] = value
    elif wire == 5:
        row["f"] = struct.unpack("<f", value)[0]
    elif wire == 1:
        row["d"] = struct.unpack("<d", value)[0]
    else:
        try:
            row["s"] = value.decode("utf-8")
        except UnicodeDecodeError:
            pass
        inner = sub_fields(value)
        row["ref"] = first(inner, 1, 0)
        row["sub"] = first(sub_fields(first(inner, 2, 2) or b""), 1, 0)
        w, h = first(inner, 1, 5), first(inner, 2, 5)
        row["w"], row["h"] = (struct.unpack("<f", x)[0] if x else None for x in (w, h))
    return row


def unpacked(data, bound):
    """The bytes of IWA chunks: type 0 is raw Snappy, type 1 stored, lengths are 24 bits."""
    out, at = bytearray(), 0
    while at < len(data):
        if len(data) - at < 4:
            raise Damaged("MALFORMED_INPUT", "trailing bytes after IWA Snappy chunk")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        block, at = data[at + 4 : at + 4 + size], at + 4 + size
        if len(block) < size:
            raise Damaged("MALFORMED_INPUT", "IWA chunk exceeds ZIP entry")
        if kind == 0:
            wanted, _ = varint(block, 0)
            if len(out) + wanted > bound:
                raise Damaged("BUDGET_EXCEEDED", "IWA expanded bytes exceed per-entry limit")
            try:
                block = pa.Codec("snappy").decompress(block, wanted).to_pybytes()
            except (OSError, pa.ArrowException) as e:
                raise Damaged("MALFORMED_INPUT", f"invalid IWA Snappy block: {e}") from None
        elif kind != 1:
            raise Damaged("MALFORMED_INPUT", f"unsupported IWA chunk type {kind:#04x}")
        out += block
        if len(out) > bound:
            raise Damaged("BUDGET_EXCEEDED", "IWA expanded bytes exceed per-entry limit")
    return bytes(out)


def archive(data, document):
    """Objects of an unpacked IWA stream, one by one: identifier, message type and, for the kept types, fields."""
    at = 0
    while at < len(data):
        size, at = varint(data, at)
        info, at = data[at : at + size], at + size
        if len(info) < size:
            raise Damaged("MALFORMED_INPUT", "ArchiveInfo exceeds IWA stream")
        found = fields(info)
        identifier, messages = first(found, 1, 0), [(w, v) for n, w, v in found if n == 2]
        if identifier is None or not messages or any(w != 2 for w, _ in messages):
            raise Damaged("MALFORMED_INPUT", "ArchiveInfo without identifier or messages")
        for _, message in messages:
            about = fields(message)
            kind, length = first(about, 1, 0), first(about, 3, 0)
            if kind is None or length is None:
                raise Damaged("MALFORMED_INPUT", "MessageInfo without type or length")
            payload, at = data[at : at + length], at + length
            if len(payload) < length:
                raise Damaged("MALFORMED_INPUT", "IWA object payload exceeds stream")
            yield {"id": identifier, "type": kind, "document": document, "fields": [field_row(*f) for f in sub_fields(payload)] if kind in KEPT else []}


def dimensions(data):
    """(width, height) of a PNG or JPEG, by their headers."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 3 < len(data):
        at = data.find(b"\xff", at)
        while 0 <= at < len(data) and data[at] == 0xFF:
            at += 1
        if at < 0 or at >= len(data):
            break
        marker, at = data[at], at + 1
        if marker == 1 or 0xD0 <= marker <= 0xD9:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            break
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and size >= 7:
            return struct.unpack(">HH", data[at + 3 : at + 7])[::-1]
        at += size
    return None, None


def plist(package, name):
    data = package.read(name)
    try:
        return None if data is None else plistlib.loads(data)
    except Exception as e:  # plistlib lets errors of every kind through
        raise Damaged("MALFORMED_INPUT", f"invalid {name}: {e}") from None


def iwork(source, max_entries, max_bytes, needs):
    """Entries, objects, plists and previews of a modern iWork package; the root's objects always, what else is needed."""
    package = Package(source, max_entries, max_bytes, "ZIP/IWA")
    out = {"entries": package.entries(), "objects": []}
    if sum(s for n, s in package.sizes.items() if n.startswith("Data/") and not n.endswith("/")) >= 1 << 64:
        raise Damaged("MALFORMED_INPUT", "Data/ asset byte count overflow")
    names = sorted((n for n in package.sizes if n == DOCUMENT or "objects" in needs and n.lower().endswith(".iwa")), key=lambda n: n != DOCUMENT)
    if DOCUMENT not in package.sizes:
        return out
    for n in names:
        out["objects"] += archive(unpacked(package.read(n), max_bytes), n == DOCUMENT)
        if len(out["objects"]) > MAX_OBJECTS:
            raise Damaged("BUDGET_EXCEEDED", f"IWA object count exceeds {MAX_OBJECTS}")
    about = plist(package, PROPERTIES) if "about" in needs else None
    if isinstance(about, dict):
        out["plist"] = [(k, str(v).lower() if isinstance(v, bool) else v) for k, v in about.items() if isinstance(v, str | bool)]
    builds = plist(package, BUILDS) if "about" in needs else None
    out["builds"] = [b for b in builds if isinstance(b, str)] if isinstance(builds, list) else None
    previews = [n for n in package.sizes if "previews" in needs and n.lower() in ("preview.jpg", "preview.jpeg", "preview.png") or "previews" in needs and n.lower().startswith("preview-")]
    out["previews"] = [dict(zip(("name", "width", "height"), (n, *dimensions(package.read(n))), strict=True)) for n in previews]
    return out


def each_object(source, max_entries, max_bytes):
    """(entry, ordinal, object) of an iWork package's objects, entry by entry, the root's first."""
    package = Package(source, max_entries, max_bytes, "ZIP/IWA")
    for name in sorted((n for n in package.sizes if n.lower().endswith(".iwa")), key=lambda n: (n != DOCUMENT, n)):
        for k, found in enumerate(archive(unpacked(package.read(name), max_bytes), name == DOCUMENT)):
            yield name, k, found


class Compound:
    """A compound file: its directory, and streams by name."""

    def __init__(self, source):
        self.source = source
        try:
            self.read_header()
        except (struct.error, IndexError, ValueError, OverflowError) as e:
            raise Damaged("MALFORMED_INPUT", f"cannot parse CFB directory: {e}") from None

    def sector(self, n):
        return self.source.at(self.size, (n + 1) * self.size)

    def read_header(self):
        data = self.source.at(512, 0)
        self.size, self.mini_size = (1 << min(16, n) for n in struct.unpack_from("<HH", data, 30))
        if self.size not in (512, 4096) or self.mini_size != 64:
            raise ValueError("sector size")
        count, start, _, self.cutoff, mini, _, more, _ = struct.unpack_from("<I I I I I I I I", data, 44)
        table = list(struct.unpack_from("<109I", data, 76))
        each, seen = self.size // 4, set()
        while more < 0xFFFFFFFC and more not in seen:
            seen.add(more)
            part = struct.unpack(f"<{each}I", self.sector(more))
            table, more = table + list(part[:-1]), part[-1]
        self.next = [n for s in table[:count] if s < 0xFFFFFFFC for n in struct.unpack(f"<{each}I", self.sector(s))]
        found, self.entries = self.chain(start), []
        for at in range(0, len(found) - 127, 128):
            size, kind = struct.unpack_from("<HB", found, at + 64)
            if kind in (1, 2, 5) and 2 <= size <= 64:
                self.entries.append((found[at : at + size - 2].decode("utf-16-le", "replace"), kind, *struct.unpack_from("<IQ", found, at + 116)))
        root = next((e for e in self.entries if e[1] == 5), None)
        if root is None:
            raise ValueError("no root entry")
        # the small streams are read when one of them is
        self.mini, self.root = mini, root

    def chain(self, sector):
        out, seen = [], set()
        while sector < 0xFFFFFFFC:
            if sector in seen or sector >= len(self.next):
                raise ValueError("broken sector chain")
            seen.add(sector)
            out.append(self.sector(sector))
            sector = self.next[sector]
        return b"".join(out)

    def stream(self, name):
        """The bytes of a stream, or None."""
        entry = next((e for e in self.entries if e[0] == name and e[1] == 2), None)
        if entry is None:
            return None
        _, _, sector, size = entry
        if size >= self.cutoff:
            return self.chain(sector)[:size]
        small = self.chain(self.root[2]) if self.root[2] < 0xFFFFFFFC else b""
        table = self.chain(self.mini) if self.mini < 0xFFFFFFFC else b""
        after = struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4])
        out, seen = [], set()
        while sector < 0xFFFFFFFC and sector not in seen and sector < len(after):
            seen.add(sector)
            out.append(small[sector * 64 : sector * 64 + 64])
            sector = after[sector]
        return b"".join(out)[:size]


def summary(data):
    """{property: text} of a SummaryInformation stream; numbers as decimal text, at most 256 properties."""
    if len(data) < 48 or data[:2] != b"\xfe\xff":
        return {}
    at = lambda form, k: struct.unpack_from(form, data, k)[0] if k + struct.calcsize(form) <= len(data) else None
    section, out = at("<I", 44), {}
    for k in range(min(256, at("<I", section + 4) or 0)):
        name, offset = at("<I", section + 8 + 8 * k), at("<I", section + 12 + 8 * k)
        if name is None or offset is None:
            break
        place = section + offset
        kind, size = at("<I", place), at("<I", place + 4)
        value = None
        if kind == 2:
            value = at("<H", place + 4)
        elif kind == 3:
            value = size
        elif kind == 30 and size is not None:
            value = data[place + 8 : place + 8 + size].decode("utf-8", "replace").rstrip("\0")
        elif kind == 31 and size is not None and place + 8 + 2 * size <= len(data):
            value = data[place + 8 : place + 8 + 2 * size].decode("utf-16-le", "replace").partition("\0")[0]
        if value is not None and name < 1 << 31:
            out[name] = str(value)
    return out


def compound(source, max_entries, max_bytes, needs):
    """Names of a compound file's entries and, if needed, the properties of its summary."""
    file = Compound(source)
    # a storage has no stream of its own, so its name is marked
    names = [n if kind == 2 else n + "/" for n, kind, _, _ in file.entries]
    try:
        data = (file.stream("\x05SummaryInformation") or b"") if "summary" in needs else b""
    except (ValueError, struct.error) as e:
        raise Damaged("MALFORMED_INPUT", f"cannot read SummaryInformation: {e}") from None
    return {"streams": names, "properties": list(summary(data).items())}


def marks(source, max_entries, max_bytes, needs):
    """The head of a PDF and, if needed, the kinds of cross-references that it holds."""
    head, kind = source.at(HEAD, 0), None
    if "whole" in needs:
        data = source.whole()
        table, stream = b"\nxref" in data or b"\rxref" in data, b"/Type/XRef" in data or b"/Type /XRef" in data
        kind = "hybrid" if table and stream else "table" if table else "stream" if stream else "unknown"
    return {"marks": {"head": head.decode("latin-1"), "xref": kind}}


DECODERS = {"ooxml": opc, "iwork": iwork, "legacy": compound, "encrypted-ooxml": compound}


def with_signatures(rows):
    """Inputs with `path` and no content get `content` of their first bytes, which routing looks at; a file that can't be opened is an error."""
    kept = [c for c in rows.columns if c not in ("content", "error_code", "error_message")]
    schema = StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL("content binary, error_code string, error_message string").fields])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            found = []
            for path, content, code, said in zip(*(batch[c].to_pylist() for c in ("path", "content", "error_code", "error_message")), strict=True):
                if path is not None and content is None and code is None:
                    try:
                        content = opened(path).at(SIGNATURE, 0)
                    except Damaged as e:
                        code, said = e.args[0], e.args[1]
                found.append((content, code, said))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.string(), pa.string()), strict=True))], schema=arrow)

    return rows.mapInArrow(run, schema)


def decode(source, family, bounds, needs):
    """The columns of DECODED for a source; whatever a decoder did not expect is a PARSER_FAILURE."""
    try:
        out = (marks if family == "pdf" else DECODERS[family])(source, *bounds, needs)
    except Damaged as e:
        out = dict(zip(("decode_code", "decode_message"), e.args, strict=True))
    except Exception as e:  # a document's fault, not the job's
        out = failure(e)
    return out | {"bytes_read": source.bytes_read, "reads": source.reads}


def failure(e):
    return {"decode_code": "PARSER_FAILURE", "decode_message": f"{type(e).__name__}: {e}"[:300]}


def columns(found, arrow):
    """Arrow columns of decoded documents; one that has no such form is a PARSER_FAILURE, the others stay."""
    try:
        return [pa.array([f.get(n) for f in found], arrow.field(n).type) for n in NAMES]
    except (pa.ArrowException, OverflowError, ValueError, TypeError) as e:
        if len(found) == 1:
            return columns([failure(e) | {n: found[0].get(n) for n in ("bytes_read", "reads")}], arrow)
        each = [columns([f], arrow) for f in found]
        return [pa.concat_arrays([c[k] for c in each]) for k in range(len(NAMES))]


def decoded(routed, max_entries=50_000, max_bytes=256 << 20, max_read=None, needs=None):
    """Routed inputs with the columns of DECODED in place of their content, in one pass; null for rows without a decoder.

    needs: what has to be read, by driver (names as in NEEDS); all of it if there is none.
    A row with a path is read from its file by ranges, other rows from their content.
    """
    by_path = "path" in routed.columns
    kept = [c for c in routed.columns if c != "content"]
    schema = StructType([*(routed.schema[c] for c in kept), *StructType.fromDDL(DECODED).fields])
    bounds = max_entries, max_bytes

    def one(content, path, family, driver, failed):
        if failed is not None or family not in DECODERS and not (family == "pdf" and path is not None):
            return {}
        try:
            source = opened(path, max_read) if path is not None else held(content.as_buffer(), max_read)
        except Damaged as e:
            return dict(zip(("decode_code", "decode_message"), e.args, strict=True))
        return decode(source, family, bounds, ALL if needs is None else needs.get(driver, frozenset()))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = max(1, batch.num_rows * STEP_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                paths = some["path"].to_pylist() if by_path else [None] * some.num_rows
                found = [one(*row) for row in zip(some["content"], paths, *(some[c].to_pylist() for c in ("family", "driver", "error_code")), strict=True)]
                yield pa.RecordBatch.from_arrays([*(some[c] for c in kept), *columns(found, arrow)], schema=arrow)

    content = F.when(F.col("family").isin(*DECODERS), F.col("content"))
    return routed.select(*kept, content.alias("content")).mapInArrow(run, schema)
