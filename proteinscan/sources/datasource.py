"""FASTA as a Spark data source: `spark.read.format("fasta")` and `df.write.format("fasta")`.

Reading splits files into byte ranges. A record belongs to the range in which its `>` lies, on a
line start, whatever range its residues end in. Writing makes a file for each task, which gets its
name only when the whole job commits; a failed job leaves nothing.
"""

from __future__ import annotations

import dataclasses
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, start long, header string, seq string, length int"
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Records, and residues, of a batch.
BATCH_RECORDS, BATCH_RESIDUES = 4096, 8 << 20

_SPACE = re.compile(rb"\s+")


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


@dataclasses.dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclasses.dataclass
class Part(WriterCommitMessage):
    name: str


def records(file, start: int, end: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """`start, header, lines` of the records whose marker lies from `start` to before `end`."""
    file.seek(max(0, start - 1))
    at, line_start = max(0, start - 1), start == 0
    rest, current = b"", None
    while chunk := file.read(READ_BYTES):
        *lines, last = (rest + chunk).split(b"\n")
        rest = last
        for line in lines:
            if line_start and line.startswith(b">"):
                if current:
                    yield current
                current = None
                if at >= end:
                    return
                if at >= start:
                    current = (at, line[1:].rstrip(b"\r"), [])
            elif current:
                current[2].append(line)
            elif at >= end:
                return
            at += len(line) + 1
            line_start = True
    if rest and line_start and rest.startswith(b">"):
        if current:
            yield current
        current = (at, rest[1:].rstrip(b"\r"), []) if start <= at < end else None
    elif rest and current:
        current[2].append(rest)
    if current:
        yield current


class FastaReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        files, base = open_path(self.path)
        about = files.get_file_info(base)
        found = [about] if about.type == fs.FileType.File else files.get_file_info(fs.FileSelector(base, recursive=True))
        found = sorted((x for x in found if x.type == fs.FileType.File and not re.search(r"(^|/)[_.][^/]*", x.path[len(base) :])), key=lambda x: x.path)
        return [Range(x.path, at, min(at + self.split, x.size)) for x in found for at in range(0, x.size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = open_path(self.path)
        rows: list[tuple] = []
        residues = 0
        with files.open_input_file(partition.path) as file:
            for start, header, lines in records(file, partition.start, partition.end):
                seq = _SPACE.sub(b"", b"".join(lines)).decode("utf-8", "replace")
                seq = seq.upper() if seq.isascii() else "".join(c.upper() if c.isascii() else c for c in seq)
                rows.append((partition.path, start, header.decode("utf-8", "replace"), seq, len(seq)))
                residues += len(seq)
                if len(rows) >= BATCH_RECORDS or residues >= BATCH_RESIDUES:
                    yield _batch(rows)
                    rows, residues = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "start", "header", "seq", "length"])


class FastaWriter(DataSourceWriter):
    """Tasks write into a hidden folder; `commit` moves their files out, in order of partitions.

    The driver makes the folder and `abort` removes it. Tasks never make it, so one that is still
    running when its job is given up fails instead of leaving a new folder behind.
    """

    def __init__(self, path: str, names: list[str], width: int, overwrite: bool):
        self.path, self.names, self.width, self.overwrite = path, names, width, overwrite
        self.job = uuid.uuid4().hex
        files, base = open_path(path)
        files.create_dir(self._hidden(base), recursive=True)

    def _hidden(self, base: str) -> str:
        return f"{base}/_writing-{self.job}"

    def write(self, rows) -> Part:
        from pyspark import TaskContext

        files, base = open_path(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.fa"
        header, seq = self.names.index("header"), self.names.index("seq")
        with files.open_output_stream(f"{self._hidden(base)}/{name}") as out:
            for row in rows:
                title = re.sub(r"[\r\n]+", " ", row[header] or "")
                text = row[seq] or ""
                lines = [f">{title}", *(text[at : at + self.width] for at in range(0, len(text), self.width))]
                out.write(("\n".join(lines) + "\n").encode())
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        files, base = open_path(self.path)
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(base)):
                if x.type == fs.FileType.File:
                    files.delete_file(x.path)
        for message in messages:
            if message is not None:
                files.move(f"{self._hidden(base)}/{message.name}", f"{base}/{self.job[:8]}-{message.name}")
        self._clear(files, base)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*open_path(self.path))

    def _clear(self, files: fs.FileSystem, base: str) -> None:
        if files.get_file_info(self._hidden(base)).type == fs.FileType.Directory:
            files.delete_dir(self._hidden(base))


class FastaSource(DataSource):
    """Options: `splitBytes` of a range when reading, `width` of a line when writing (columns `header` and `seq`)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        missing = {"header", "seq"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))} to write as FASTA")
        return FastaWriter(self.options["path"], schema.names, int(self.options.get("width", 60)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
