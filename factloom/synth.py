"""Small synthetic packages, made from rows: for tests and for the queries over the test tables.

Texts of parts are built as columns; only the packing is done in Python.
"""

import io
import plistlib
import struct
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs


def zip_bytes(parts):
    """A ZIP file of (name, bytes or text) entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def zipped(df, *keys):
    """`parts` (array of name and text) of each row packed as `content`, beside the key columns."""
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "content binary"])

    def run(batches):
        for batch in batches:
            made = [zip_bytes((p["name"], p["text"]) for p in parts) for parts in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(made, pa.binary())], names=[*keys, "content"])

    return df.select(*keys, "parts").mapInArrow(run, schema)


def written(df, folder, *keys):
    """Write `content` of each row as a file `display_name` below `folder`, by tasks; gives the keys and the path."""
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "path string"])
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)

    def run(batches):
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = [f"{base}/{n}" for n in batch["display_name"].to_pylist()]
            for path, content in zip(paths, batch["content"].to_pylist(), strict=True):
                # a file that another attempt wrote holds the same bytes
                with files.open_output_stream(path) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(paths)], names=[*keys, "path"])

    return df.select(*keys, "display_name", "content").mapInArrow(run, schema)


def number(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(*found):
    """A message of (field, value) pairs: whole numbers, floats (64 bits), ('f', x) for 32 bits, texts and bytes."""
    out = b""
    for n, v in found:
        if isinstance(v, tuple):
            out += number(n << 3 | 5) + struct.pack("<f", v[1])
        elif isinstance(v, float):
            out += number(n << 3 | 1) + struct.pack("<d", v)
        elif isinstance(v, int):
            out += number(n << 3) + number(v)
        else:
            data = v.encode() if isinstance(v, str) else v
            out += number(n << 3 | 2) + number(len(data)) + data
    return out


def reference(identifier):
    return message((1, identifier))


def iwa(objects, stored=False):
    """An IWA stream of (identifier, message type, payload) objects, in Snappy or stored chunks."""
    data = b"".join((lambda info: number(len(info)) + info + payload)(message((1, i), (2, message((1, kind), (3, len(payload)))))) for i, kind, payload in objects)
    out = b""
    for at in range(0, len(data), 1 << 16):
        block = data[at : at + (1 << 16)]
        block = block if stored else pa.Codec("snappy").compress(block).to_pybytes()
        out += bytes([stored]) + len(block).to_bytes(3, "little") + block
    return out


def iwork_bytes(objects, properties=None, builds=None, more=()):
    """An iWork package whose document holds the objects, with `more` entries."""
    parts = [("Index/Document.iwa", iwa(objects)), ("Metadata/Properties.plist", plistlib.dumps(properties or {}))]
    if builds is not None:
        parts.append(("Metadata/BuildVersionHistory.plist", plistlib.dumps(builds, fmt=plistlib.FMT_BINARY)))
    return zip_bytes([*parts, *more])


def property_set(values):
    """A SummaryInformation stream of {property: text or number}."""
    body, table = b"", b""
    for k, v in values.items():
        table += struct.pack("<II", k, 8 + 8 * len(values) + len(body))
        if isinstance(v, str):
            data = v.encode("utf-16-le") + b"\0\0"
            body += struct.pack("<II", 31, len(data) // 2) + data + b"\0" * (-len(data) % 4)
        else:
            body += struct.pack("<II", 3, v)
    section = struct.pack("<II", 8 + len(table) + len(body), len(values)) + table + body
    return struct.pack("<HHI16sI16sI", 0xFFFE, 0, 2, b"", 1, b"", 48) + section


def cfb_bytes(streams):
    """A compound file with the named streams, each of a chain of whole sectors."""
    size, end, free = 512, 0xFFFFFFFE, 0xFFFFFFFF
    table, sectors, entries = [], [], []
    for name, data in streams.items():
        padded = data.ljust(max(4096, len(data) + -len(data) % size), b"\0")
        count, start = len(padded) // size, len(sectors)
        sectors += [padded[k * size : (k + 1) * size] for k in range(count)]
        table += [*range(start + 1, start + count), end]
        entries.append((name, 2, start, max(4096, len(data))))
    entry = lambda name, kind, start, length: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, free, free, free) + bytes(36) + struct.pack("<IQ", start, length)
    directory = entry("Root Entry", 5, end, 0) + b"".join(entry(*e) for e in entries)
    directory += bytes(-len(directory) % size)
    at, count = len(sectors), len(directory) // size
    sectors += [directory[k * size : (k + 1) * size] for k in range(count)]
    table += [*range(at + 1, at + count), end]
    fats = 1
    while len(table) + fats > fats * 128:
        fats += 1
    place = len(sectors)
    table += [0xFFFFFFFD] * fats
    flat = struct.pack(f"<{len(table)}I", *table).ljust(fats * size, b"\xff")
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, fats, at, 0, 4096, end, 0, end, 0, place)
    header = header[:76] + struct.pack("<109I", *range(place, place + fats), *[free] * (109 - fats))
    return header.ljust(512, b"\0") + b"".join(sectors) + flat


def directory_zip(entries):
    """A ZIP file of (name, bytes, size) entries, stored, whose directory claims these sizes in 64-bit fields."""
    body, directory = b"", b""
    for name, data, size in entries:
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, len(data))
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, len(body)) + raw + extra
        body += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, zlib.crc32(data), len(data), len(data), len(raw), 0) + raw + data
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(entries), len(entries), len(directory), len(body), 0)
    return body + directory + end
