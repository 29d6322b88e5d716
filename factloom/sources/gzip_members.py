"""Text in gzip members, as a sink whose tasks write and whose commit names.

Rows (member, nth, value) arrive with each member whole in one task and in
order. A task writes members below a staging folder; the commit moves what the
tasks that counted have written to its place and lists it in ``_manifest.json``;
a job that fails leaves nothing behind. Members hold no time and no name, so the
same rows are the same bytes, and one after the other they are one gzip file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .byte_lines import CHUNK, listed, opened

MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    members: list[tuple[int, str, int, int, str]]  # number, staged path, rows, bytes, SHA-256


class MemberWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        self.staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder, _ = opened(self.staging)
        fs.create_dir(folder)
        done: list[tuple[int, str, int, int, str]] = []
        now, out, rows, name = None, None, 0, ""

        def close() -> None:
            if out is not None:
                out.close()
                with fs.open_input_file(name) as f:
                    h = hashlib.sha256()
                    while part := f.read(CHUNK):
                        h.update(part)
                    done.append((now, name, rows, f.size(), h.hexdigest()))

        for batch in iterator:
            for member, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if member != now:
                    close()
                    now, rows, name = member, 0, f"{folder}/{member:08d}-{uuid.uuid4().hex}"
                    out = _Member(fs.open_output_stream(name, compression=None))
                out.write(value.encode() + b"\n")
                rows += 1
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder, _ = opened(self.path)
        members = sorted(m for message in messages if message for m in message.members)
        for number, staged, *_ in members:
            fs.move(staged, f"{folder}/member-{number:08d}.jsonl.gz")
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps([{"name": f"member-{n:08d}.jsonl.gz", "rows": r, "bytes": b, "sha256": h} for n, _, r, b, h in members]).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, folder, _ = opened(self.staging)
        with suppress(FileNotFoundError):
            fs.delete_dir(folder)


class _Member:
    def __init__(self, raw: pa.NativeFile) -> None:
        self.raw = raw
        self.gz = gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0)
        self.write = self.gz.write

    def close(self) -> None:
        self.gz.close()
        self.raw.close()


class GzipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_members"

    def schema(self) -> str:
        return "member long, nth long, value string"

    def writer(self, schema: object, overwrite: bool) -> MemberWriter:
        return MemberWriter(self.options["path"])


def write(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(GzipMembers)
    placed = rows.select("member", "nth", "value").repartition("member").sortWithinPartitions("member", "nth")
    placed.write.format("gzip_members").option("path", path).mode("append").save()


def joined(path: str, out: str) -> None:
    """All members of a folder as one gzip file, in constant memory."""
    fs, folder, _ = opened(path)
    to, target, _ = opened(out)
    with fs.open_input_file(f"{folder}/{MANIFEST}") as f:
        names = [m["name"] for m in json.loads(f.read())]
    with to.open_output_stream(target, compression=None) as sink:
        for name in names:
            with fs.open_input_file(f"{folder}/{name}") as f:
                while part := f.read(CHUNK):
                    sink.write(part)


def expanded(read: Iterator[bytes], most: int, ratio: float) -> tuple[int, bool]:
    """(bytes, whether too many): what gzip members expand to, in steps of a
    chunk; reading ends where the budget or the ratio to what was read does."""
    took = made = 0
    d = zlib.decompressobj(31)
    for part in read:
        took += len(part)
        while part:
            made += len(d.decompress(part, CHUNK))
            if made > most or made > CHUNK and made > ratio * took:
                return made, True
            part = d.unconsumed_tail
            if d.eof:
                part, d = d.unused_data, zlib.decompressobj(31)
    return made, False


def sizes(spark: SparkSession, path: str, most: int, ratio: float) -> DataFrame:
    """(address, bytes, refused) of the gzip files at a path, a task a file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for address in b.column(0).to_pylist():
                fs, place, _ = opened(address)
                with fs.open_input_file(place) as f:
                    found.append(expanded(iter(lambda f=f: f.read(CHUNK), b""), most, ratio))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([r for _, r in found])], names=["address", "bytes", "refused"])

    files = [(address,) for address, *_ in listed(path, "*.gz")]
    return spark.createDataFrame(files, "address string").repartition(max(1, len(files))).mapInArrow(run, "address string, bytes long, refused boolean")
