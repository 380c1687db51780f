"""Files read in parts, by tasks: a file-like object over byte ranges that counts what it reads and keeps to a bound.

Tasks open files through pyarrow's file systems (local, S3, GCS, HDFS where its library is
installed). What cannot be opened is a SOURCE_IO error of its row.
"""

import io
import re
from functools import cache

import pyarrow as pa
from pyarrow import fs

#: Bytes that routing looks at, and those that hold a PDF's header.
SIGNATURE, HEAD = 8, 8192


class Damaged(Exception):
    """An input that cannot be read: code and message."""


class Ranges(io.RawIOBase):
    """A seekable source of `size` bytes; `bytes_read` and `reads` say what was taken from it."""

    def __init__(self, read_at, size, limit=None):
        self.read_at, self.size, self.limit = read_at, size, float("inf") if limit is None else limit
        self.place = self.bytes_read = self.reads = 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.place

    def seek(self, offset, whence=io.SEEK_SET):
        self.place = max(0, offset + (0, self.place, self.size)[whence])
        return self.place

    def read(self, n=-1):
        left = max(0, self.size - self.place)
        n = left if n is None or n < 0 else min(n, left)
        if self.bytes_read + n > self.limit:
            raise Damaged("BUDGET_EXCEEDED", "physical read budget exceeded")
        data = bytes(self.read_at(n, self.place)) if n else b""
        self.place += len(data)
        self.bytes_read += len(data)
        self.reads += bool(n)
        return data

    def whole(self):
        """All bytes, if the bound allows them."""
        if self.size > self.limit:
            raise Damaged("BUDGET_EXCEEDED", f"file size {self.size} exceeds physical read budget {self.limit}")
        self.seek(0)
        return self.read()

    def at(self, n, place):
        self.seek(place)
        return self.read(n)


def held(content, limit=None):
    """A source over bytes at hand."""
    view = memoryview(content)
    return Ranges(lambda n, at: view[at : at + n], len(view), limit)


@cache
def _store(scheme_and_host):
    return fs.FileSystem.from_uri(scheme_and_host + "/")[0]


def opened(path, limit=None):
    """A source over a file, by its path or URI."""
    local = re.sub("^file:/*", "/", path)
    try:
        if local.startswith("/"):
            file = pa.OSFile(local)
        else:
            store = re.match("[A-Za-z][A-Za-z0-9+.-]*://[^/]*", path)
            file = _store(store.group()).open_input_file(path[store.end() :] if store.group().startswith("hdfs") else path.partition("://")[2])
        size = file.size()
    except (OSError, pa.ArrowException, AttributeError, ValueError) as e:
        raise Damaged("SOURCE_IO", f"cannot open {path}: {type(e).__name__}") from None

    def read_at(n, at):
        try:
            return file.read_at(n, at)
        except (OSError, pa.ArrowException) as e:
            raise Damaged("SOURCE_IO", f"cannot read {path}: {type(e).__name__}") from None

    return Ranges(read_at, size, limit)
