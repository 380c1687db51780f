"""TIFF media columns: write samples as strips and tiles, walk directories, decode every page.

A page is a row. Texts are stored in pages of PAGE_ROWS rows, packed in turn by each of
FORMS, so that every packing is written and read back. Null texts are stored as the
empty text, which has one page of zero bytes. A null file or one that is no TIFF gives one row with `error` and no page; a
damaged page, or one of a kind that is not read here (planar, fill order 2, predictor
3, other depths than 8 and 16 bits), gives a row with its number and `error`, after
the pages before it. Repeated rows give repeated results, an empty table no rows.
Very long texts are whole: a file holds up to 4 GB. Only the columns named are read.
"""

import hashlib
import re
import struct
import zlib

import numpy as np

from .common import map_columns, sha, table

# Tags, compression numbers and the sizes of field types. Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR = 266, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


#: How the pages of a file are packed in turn: compression, whether in tiles, predictor.
FORMS = [(ADOBE_DEFLATE, False, 2), (PACKBITS, False, 1), (LZW, True, 1), (DEFLATE, True, 2)]
PAGE_ROWS, STRIP_ROWS, TILE_SIZE = 256, 64, (32, 128)
#: Words that an LZW table takes after its 258 before it is cleared: the last code of 12 bits is never reached.
LZW_ROOM = 4094 - 258
FIRST_WORDS = [bytes([k]) for k in range(256)] + [b"", b""]


def pack_bits(data, row):
    """PackBits of rows of `row` bytes, none of which shares a packet with the next."""
    out = bytearray()

    def literal(part):
        for k in range(0, len(part), 128):
            out.append(len(part[k : k + 128]) - 1)
            out.extend(part[k : k + 128])

    for at in range(0, len(data), row):
        line, last = data[at : at + row], 0
        for run in re.finditer(rb"(.)\1{2,127}", line, re.DOTALL):
            literal(line[last : run.start()])
            out += bytes([257 - len(run[0]), line[run.start()]])
            last = run.end()
        literal(line[last:])
    return bytes(out)


def pack_lzw(data):
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, widened one code early; the table starts anew when it is full."""
    runs, codes, known, word = [], [], {}, None
    for byte in data:
        if word is None:
            word = byte
        elif (code := known.get(key := word << 8 | byte)) is not None:
            word = code
        else:
            codes.append(word)
            known[key] = 258 + len(known)
            word = byte
            if len(known) == LZW_ROOM:
                runs.append(codes)
                codes, known = [], {}
    runs.append(codes if word is None else [*codes, word])
    # a run's codes are followed by the next clear code, or by the end; all widths follow from the place in the run
    values = np.concatenate([[256], *([*run, 256] for run in runs[:-1]), [*runs[-1], 257]]).astype(">u2")
    places = np.concatenate([[0], *(np.arange(len(run) + 1) for run in runs)])
    widths = lzw_widths(places)
    bits = np.unpackbits(values.view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


def packed_page(samples, form):
    """The fields but for the place of each part, and the packed strips or tiles, of a grey page (height x width uint8)."""
    compression, tiled, predictor = form
    (height, width), across, down = samples.shape, samples.shape[1], STRIP_ROWS
    if tiled:
        across, down = TILE_SIZE[0], min(TILE_SIZE[1], -(-height // 16) * 16)
        samples = np.pad(samples, ((0, -height % down), (0, -width % across)))
    parts = []
    for y in range(0, height, down):
        for x in range(0, width, across):
            part = samples[y : y + down, x : x + across]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            parts.append(PACK[compression](part.tobytes(), part.shape[1]))
    fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
    return fields | ({TILE_WIDTH: [across], TILE_HEIGHT: [down]} if tiled else {ROWS_PER_STRIP: [down]}), parts


def write_tiff(pages):
    """A little-endian file of grey pages, given as (samples, form) with a form of FORMS; each page's parts stand before its directory."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for samples, form in pages:
        fields, parts = packed_page(samples, form)
        fields[TILE_OFFSETS if form[1] else STRIP_OFFSETS] = np.cumsum([len(out), *map(len, parts)])[:-1].tolist()
        fields[TILE_BYTES if form[1] else STRIP_BYTES] = [len(part) for part in parts]
        out += b"".join(parts)
        out += bytes(len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        extra_at, extra = len(out) + 2 + 12 * len(fields) + 4, b""
        out += struct.pack("<H", len(fields))
        for tag, values in sorted(fields.items()):
            value = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                extra, value = extra + value, struct.pack("<I", extra_at + len(extra))
            out += struct.pack("<HHI", tag, 4, len(values)) + value
        link = len(out)
        out += bytes(4) + extra
    return bytes(out)


def unpack_bits(data):
    """Undo PackBits run lengths."""
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw_codes(data):
    """Lists of codes, each up to and with a clear code or the end, or as far as the data goes."""
    bits, at = np.unpackbits(np.frombuffer(data + b"\0\0", np.uint8)), 0
    place, most = 0, 256
    while at + 9 <= 8 * len(data):
        # all widths follow from the place since the last clear code, so many codes are cut out at once
        widths = lzw_widths(np.arange(place, place + min(most, (8 * len(data) - at) // 9)))
        starts = at + np.cumsum(widths) - widths
        whole = np.searchsorted(starts + widths, 8 * len(data), "right")
        codes = (bits[starts[:whole, None] + np.arange(12)] @ (1 << np.arange(11, -1, -1))) >> (12 - widths[:whole])
        marks = np.flatnonzero((codes == 256) | (codes == 257))
        if not whole:
            return
        n = int(marks[0]) + 1 if len(marks) else int(whole)
        yield codes[:n].tolist()
        if len(marks) and codes[n - 1] == 257:
            return
        at = int(starts[n - 1] + widths[n - 1])
        place, most = (0, 256) if len(marks) else (place + n, 4096)


def lzw_widths(places):
    """Bits of the codes at these places since the last clear code."""
    return 9 + np.searchsorted([512, 1024, 2048], 258 + places, "right")


def unpack_lzw(data):
    """Undo TIFF's LZW: codes of 9 to 12 bits, high bit first, widened one code early."""
    out, words, last = [], [], b""
    for codes in lzw_codes(data):
        mark = codes.pop() if codes[-1] in (256, 257) else None
        for code in codes:
            if code < len(words):
                word = words[code]
            elif code == len(words) and last:
                word = last + last[:1]
            else:
                raise ValueError("broken LZW data")
            out.append(word)
            if last:
                words.append(last + word[:1])
            last = word
        if mark == 256:
            words, last = FIRST_WORDS.copy(), b""
    return b"".join(out)


PACK = {LZW: lambda data, row: pack_lzw(data), ADOBE_DEFLATE: lambda data, row: zlib.compress(data, 1), DEFLATE: lambda data, row: zlib.compress(data, 1), PACKBITS: pack_bits}
UNPACK = {NONE: bytes, LZW: unpack_lzw, ADOBE_DEFLATE: zlib.decompress, DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def directories(data):
    """The fields of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    if not at:
        raise ValueError("no image directory")
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        fields = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            place = at + 10 + 12 * k
            if n * TYPE_SIZE.get(kind, 1) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if form := {1: "B", 3: "H", 4: "I"}.get(kind):
                fields[tag] = struct.unpack_from(f"{order}{n}{form}", data, place)
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def page_samples(data, order, fields):
    """Samples of a page: height x width x samples, of 8 or 16 bits, interleaved."""
    one = lambda tag, other=None: fields.get(tag, (other,))[0]
    width, height, per, bits, packed = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1)
    if packed not in UNPACK or any(b not in (8, 16) or b != bits for b in fields.get(BITS, (bits,))):
        raise ValueError(f"compression {packed} with {bits} bits is not supported")
    if one(PREDICTOR, 1) not in (1, 2) or one(FILL_ORDER, 1) != 1 or one(PLANAR, 1) != 1 and per > 1:
        raise ValueError("predictor, fill order or planes are not supported")
    if not (width and height and per):
        raise ValueError("a page without samples")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(order + "u2")
    tiled = TILE_OFFSETS in fields
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not (across and down):
        raise ValueError("tiles or strips without samples")
    places = list(zip(fields[TILE_OFFSETS if tiled else STRIP_OFFSETS], fields[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    if len(places) != -(-width // across) * -(-height // down) or width * height * per > 1500 * len(data):  # no packing here is denser
        raise ValueError("strips or tiles do not make up the page")
    page, columns = np.zeros((height, width, per), kind.newbyteorder("=")), max(1, -(-width // across))
    for k, (offset, size) in enumerate(places):
        y, x = k // columns * down, k % columns * across
        rows = down if tiled else min(down, height - y)
        part = np.frombuffer(UNPACK[packed](data[offset : offset + size]), kind, rows * across * per).astype(page.dtype).reshape(rows, across, per)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=page.dtype)
        page[y : y + rows, x : x + across] = part[: height - y, : width - x]
    return page


class Features:
    """Of pages read so far: their number, the mean in thousandths and a 64-bit code, whether each of 64 column means is above the mean of all."""

    def __init__(self):
        self.pages, self.size, self.sums = 0, 0, np.zeros(64, np.int64)

    def add(self, page):
        self.pages, self.size = self.pages + 1, self.size + page.size
        self.sums += [part.sum() for part in np.array_split(page.reshape(page.shape[0], -1).sum(axis=0, dtype=np.int64), 64)]
        code = int.from_bytes(np.packbits(self.sums * 64 > self.sums.sum()).tobytes(), "big")
        return f"{self.pages}p;{int(self.sums.sum()) * 1000 // self.size};{code:016x}"


def payload(text):
    """The text's UTF-8 with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % 64 if data else 64)


def text_pages(data):
    """A payload as pages 64 samples wide of at most PAGE_ROWS rows; the forms go round from one that the payload's checksum picks."""
    samples, first = np.frombuffer(data, np.uint8).reshape(-1, 64), zlib.crc32(data)
    return [(samples[y : y + PAGE_ROWS], FORMS[(first + y // PAGE_ROWS) % len(FORMS)]) for y in range(0, len(samples), PAGE_ROWS)]


def store_texts(docs, doc_id="doc_id", text="text"):
    """Per row: the id, n_bytes and `media`, a TIFF file whose pages hold the padded text."""

    def step(ids, texts):
        padded = list(map(payload, texts))
        return ids, [n for n, _ in padded], [write_tiff(text_pages(p)) for _, p in padded]

    return map_columns(docs, [doc_id, text], lambda: step, f"{doc_id} bigint, n_bytes bigint, media binary")


def pages(media, keep=(), column="media"):
    """One row per page, those of a file in order.

    Columns: `keep` = [(name, type)], page_no, last (whether the file ends here), width, height,
    samples (bytes); media_bytes and media_sha256 of the file; of all its samples up to and with
    this page read_bytes, read_sha256 and feature; error. What follows a damaged page is not read.
    """

    def step(*columns):
        out = []
        for *kept, data in zip(*columns, strict=True):
            about = [len(data), sha(data)] if data is not None else [None, None]
            k, read, so_far, features = None, 0, hashlib.sha256(), Features()
            try:
                for k, (order, fields) in enumerate(directories(data or b"")):
                    page = page_samples(data, order, fields)
                    samples = page.tobytes()
                    read += len(samples)
                    so_far.update(samples)
                    out.append([*kept, k, False, page.shape[1], page.shape[0], samples, *about, read, so_far.hexdigest(), features.add(page), None])
            except (ValueError, LookupError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                out.append([*kept, k, False, None, None, None, *about, None, None, None, str(e) or type(e).__name__])
            out[-1][len(kept) + 1] = True
        return list(map(list, zip(*out, strict=True))) if out else [[]] * (len(columns) + 10)

    schema = "".join(f"{n} {t}, " for n, t in keep) + "page_no int, last boolean, width int, height int, samples binary, media_bytes bigint, media_sha256 string, read_bytes bigint, read_sha256 string, feature string, error string"
    return map_columns(media, [*(n for n, _ in keep), column], lambda: step, schema)


def op4_tiff(spark, sf_dir):
    """Digests of every text as stored in, and read back from, the pages of a TIFF file."""
    from pyspark.sql import functions as F

    read = pages(store_texts(table(spark, sf_dir, "documents")), [("doc_id", "bigint"), ("n_bytes", "bigint")]).where("last")
    return read.select(
        "doc_id", "n_bytes", F.col("read_bytes").alias("payload_bytes"), F.col("read_sha256").alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", (F.col("page_no") + 1).alias("n_pages"),
    )
