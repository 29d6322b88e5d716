"""Lines of files by ranges of bytes, as a data source in batches and streams.

One large file is many ranges; a line belongs to the range that holds its first
byte. A partition is some ranges, so that small ones do not cost a task each. Only bytes after a file's
offset are read. A line longer than the limit is counted and not held; what has
no newline yet waits for the next run. A stream's offsets are bytes by file,
each with a hash of the ends of what was read: a file whose beginning is
another one starts again at 0.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file_path string, byte_start long, byte_end long, text string, oversized boolean"
CHUNK, BATCH = 1 << 20, 4 << 20
#: What is read at once to find the end of a range's last line.
TAIL = 64 << 10
#: A task takes more than one range where there are more than so many, up to so many bytes.
TASKS, TASK_BYTES = 200, 16 << 20
#: Bytes at either end of what a stream has read that tell whether it changed.
ENDS = 4096
# Parts of paths that are never read.
SENSITIVE = [".ssh", ".gnupg", ".aws", ".kube", "secrets", "credentials", "id_rsa", ".env", ".pem", ".p12", "keychain"]


def opened(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path, what stands before its paths in an address)."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
    return fs, path, "file://" if isinstance(fs, pafs.LocalFileSystem) else uri[: len(uri) - len(path)] if uri.endswith(path) else f"{fs.type_name}://"


def listed(root: str, pattern: str = "*", most: int | None = None) -> list[tuple[str, int, float]]:
    """(address, bytes, seconds of the last change) of the files at or below an
    address, the newest first, then by address. Sensitive paths are left out,
    and what a symbolic link leads to."""
    fs, path, before = opened(root)
    info = fs.get_file_info(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    local = isinstance(fs, pafs.LocalFileSystem)
    base = os.path.realpath(path) if local else ""
    out = []
    for f in found:
        if not f.is_file or not fnmatch.fnmatch(f.base_name, pattern) or any(w in f.path.lower() for w in SENSITIVE):
            continue
        if local and os.path.realpath(f.path) != os.path.normpath(os.path.join(base, os.path.relpath(f.path, path))):
            continue
        out.append((before + f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0))
    return sorted(out, key=lambda f: (-f[2], f[0]))[:most]


def digest(address: str, end: int) -> str | None:
    """SHA-256 of the first bytes of a file, in constant memory; None if it is shorter."""
    fs, path, _ = opened(address)
    h = hashlib.sha256()
    with fs.open_input_file(path) as f:
        while end > 0 and (part := f.read(min(CHUNK, end))):
            h.update(part)
            end -= len(part)
    return h.hexdigest() if end == 0 else None


def ends_digest(address: str, end: int) -> str | None:
    fs, path, _ = opened(address)
    with fs.open_input_file(path) as f:
        if f.size() < end:
            return None
        first = f.read_at(min(ENDS, end), 0)
        return hashlib.sha256(first + f.read_at(min(ENDS, end), max(0, end - ENDS))).hexdigest()


def last_newline(address: str, start: int, end: int) -> int:
    """The byte after the last newline in a range; its start if it has none."""
    fs, path, _ = opened(address)
    with fs.open_input_file(path) as f:
        while end > start:
            low = max(start, end - CHUNK)
            at = f.read_at(end - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return start


def lines_of(f: pa.NativeFile, base: int, start: int, end: int, stop: int, max_line: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, line) of the lines that begin in [start, end) of a file of
    which [base, stop) is read; None for a line over the limit. No more than a
    chunk and a line of the limit is held."""
    at = start if start == base else start - 1
    skipping = start > base  # the line before belongs to the range before
    line_start, held, size = start, bytearray(), 0
    while at < stop:
        chunk = f.read_at(min(CHUNK, stop - at, max(end - at, TAIL)), at)
        if not chunk:
            return
        here = 0
        while (newline := chunk.find(b"\n", here)) >= 0:
            if skipping:
                skipping = False
            else:
                size += newline - here
                if size <= max_line + 1:
                    held += chunk[here:newline]
                line = bytes(held).removesuffix(b"\r") if size <= max_line + 1 else None
                yield line_start, at + newline + 1, line if line is not None and len(line) <= max_line else None
            here, line_start = newline + 1, at + newline + 1
            held.clear()
            size = 0
            if line_start >= end:
                return
        if not skipping:
            size += len(chunk) - here
            if size <= max_line + 1:
                held += chunk[here:]
            else:
                held.clear()
        at += len(chunk)


@dataclass
class Range(InputPartition):
    address: str
    base: int
    start: int
    end: int
    stop: int


def ranges(address: str, base: int, stop: int, size: int) -> list[Range]:
    return [Range(address, base, at, min(at + size, stop), stop) for at in range(base, stop, size)]


@dataclass
class Share(InputPartition):
    ranges: list[Range]


def shares(found: list[Range]) -> list[Share]:
    """Ranges dealt to tasks, in their order."""
    most = min(TASK_BYTES, sum(r.end - r.start for r in found) // TASKS)
    out: list[Share] = []
    held = 0
    for r in found:
        if not out or held + r.end - r.start > most:
            out.append(Share([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.end - r.start
    return out


def rows_of(part: Range, max_line: int) -> Iterator[pa.RecordBatch]:
    fs, path, _ = opened(part.address)
    rows: list[tuple[int, int, str | None]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        starts, ends, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([part.address] * len(rows)), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string()), pa.array([t is None for t in texts])], names=["file_path", "byte_start", "byte_end", "text", "oversized"])

    with fs.open_input_file(path) as f:
        for a, b, line in lines_of(f, part.base, part.start, part.end, part.stop, max_line):
            rows.append((a, b, None if line is None else line.decode("utf-8", "replace")))
            held += 64 + len(line or b"")
            if held > BATCH:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.size, self.max_line = int(options.get("rangebytes", 64 << 20)), int(options.get("maxline", 4 << 20))
        self.offsets: dict[str, int] = json.loads(options.get("offsets", "{}"))


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = _Options(options)

    def partitions(self) -> list[InputPartition]:
        return shares([r for address, size, _ in listed(self.o.path, self.o.pattern) for r in ranges(address, self.o.offsets.get(address, 0), size, self.o.size)])

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges if partition is not None else []:
            yield from rows_of(part, self.o.max_line)


class LineStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = _Options(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for address, size, _ in listed(self.o.path, self.o.pattern):
            end = last_newline(address, 0, size)
            out[address] = [end, ends_digest(address, end)]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for address, (stop, _) in sorted(end.items()):
            base, known = start.get(address, (0, None))
            if base and (base > stop or ends_digest(address, base) != known):
                base = 0
            out += ranges(address, base, stop, self.o.size)
        return shares(out)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from rows_of(part, self.o.max_line)


class ByteLines(DataSource):
    """``format("byte_lines")``: options path, pattern, rangeBytes, maxLine and,
    for batches, offsets: bytes by file, as JSON."""

    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema: object) -> LineStreamReader:
        return LineStreamReader(self.options)
