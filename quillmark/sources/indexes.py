"""Code indexes as a data source: `spark.read.format("code_index").load(path)` and `df.write.format("code_index")`.

An index is a message of length-delimited records, one for each document. `spans` walks the records' headers only and cuts
an index between documents into ranges of about `split_bytes`; a task reads one range, record by record, so memory is
bounded by the largest document, not by the index. The options `records` and `only` (paths; both comma-separated) and `starts` (what a
path begins with) are answered in the reader: what is not asked for is not decoded. They are options and not pushed
filters: with those, a query that filtered one loaded frame twice and joined the two gave no rows, presumably since Spark
keeps one pushed state for a frame. Files are opened through Arrow's file systems, by path or URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillmark.sources import scip

SPLIT, BLOCK, ROWS = 32 << 20, 64 << 10, 4096
HEADER = 20  # bytes of a record's number and length, at most


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of an index, or of those of a folder; names that begin with a dot or underscore are not read."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and i.base_name[0] not in "._"]
    base = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((base + i.path, i.size) for i in found)


class Records:
    """The records of a range of an open file, by their headers: number, where the value starts, its length."""

    def __init__(self, file: pa.NativeFile, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop
        self.block, self.block_at = b"", start

    def bytes_at(self, at: int, size: int) -> bytes:
        """Bytes from a block that is read ahead; longer ones are read by themselves."""
        if size > BLOCK:
            self.file.seek(at)
            return self.file.read(size)
        if not self.block_at <= at <= at + size <= self.block_at + len(self.block):
            self.file.seek(at)
            self.block, self.block_at = self.file.read(min(BLOCK, self.stop - at)), at
        return self.block[at - self.block_at : at - self.block_at + size]

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        at = self.start
        while at < self.stop:
            head = self.bytes_at(at, min(HEADER, self.stop - at))
            try:
                key, used = scip.varint(head, 0)
                if key & 7 == 2:
                    size, used = scip.varint(head, used)
                elif key & 7 == 0:
                    _, after = scip.varint(head, used)
                    size = after - used
                else:
                    size = {1: 8, 5: 4}[key & 7]
            except (IndexError, KeyError):
                raise ValueError(f"damaged index at byte {at}") from None
            if at + used + size > self.stop:
                raise ValueError(f"damaged index at byte {at}")
            yield key >> 3, at + used, size
            at += used + size


def cut_points(path: str, size: int, split_bytes: int) -> list[tuple[int, int]]:
    """Ranges of about split_bytes (a longer document is a range of its own), cut between records."""
    if size <= split_bytes:
        return [(0, size)]
    system, at = opened(path)
    out, start = [], 0
    with system.open_input_file(at) as file:
        for _, begin, length in Records(file, 0, size):
            if begin + length - start >= split_bytes:
                out.append((start, begin + length))
                start = begin + length
    return [*out, (start, size)] if start < size else out


def path_of(document: bytes) -> str:
    for number, value in scip.fields(document):
        if number == scip.DOC_PATH:
            return value.decode(errors="replace").replace("\\", "/")
    return ""


def rows_of(path: str, prefix: str, start: int, stop: int, wanted: Wanted | None = None) -> Iterator[tuple]:
    """scip.ROW rows of the documents in a range of an index."""
    system, at = opened(path)
    with system.open_input_file(at) as file:
        records = Records(file, start, stop)
        for number, begin, length in records:
            if number not in (scip.DOCUMENTS, scip.EXTERNAL) or (wanted and number == scip.EXTERNAL and wanted.paths_only):
                continue
            value = records.bytes_at(begin, length)
            if wanted and number == scip.DOCUMENTS and wanted.paths_only and not wanted.path("/".join(p for p in (prefix, path_of(value)) if p)):
                continue
            for row in scip.record_rows(number, value, prefix, wanted.records if wanted else None):
                yield row


def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in scip.ROW.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), scip.TYPES)], names)

    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


@dataclass
class Wanted:
    """What the reader is asked for: kinds of records, paths by value or beginning. None and empty: all."""

    records: frozenset[str] | None = None
    paths: frozenset[str] | None = None
    starts: str = ""

    @staticmethod
    def of(options: dict[str, str]) -> Wanted:
        listed_ = lambda name: frozenset(options[name].split(",")) if name in options else None
        wanted = Wanted(listed_("records"), listed_("only"), options.get("starts", ""))
        if wrong := (wanted.records or frozenset()) - {"occurrence", "symbol", "relation"}:
            raise ValueError(f"records: {', '.join(sorted(wrong))} is not a kind of record")
        return wanted

    @property
    def paths_only(self) -> bool:
        return self.paths is not None or bool(self.starts)

    def path(self, value: str) -> bool:
        return (self.paths is None or value in self.paths) and value.startswith(self.starts)


class Span(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class IndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.location, self.prefix = options["path"], options.get("prefix", "")
        self.split_bytes = int(options.get("split_bytes", SPLIT))
        self.wanted = Wanted.of(options)

    def partitions(self) -> list[Span]:
        return [Span(path, *ends) for path, size in listed(self.location) for ends in cut_points(path, size, self.split_bytes) if size]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        return batched(rows_of(span.path, self.prefix, span.start, span.stop, self.wanted))


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class IndexWriter(DataSourceArrowWriter):
    """An index for each task. Rows of a path have to be neighbours (sort by path within partitions); a file is hidden
    until all tasks are done, so a failed or repeated task leaves nothing that a reader sees."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.location, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.location)
        system.create_dir(folder, recursive=True)
        name = f"{self.job}-{uuid.uuid4().hex[:12]}.scip"
        path, held, none = None, [], True
        with system.open_output_stream(f"{folder}/_{name}") as out:
            for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
                if not none and row[1] != path:
                    out.write(scip.encoded(path, held))
                    held = []
                path, none = row[1], False
                held.append(row)
            if held:
                out.write(scip.encoded(path, held))
        if none:
            system.delete_file(f"{folder}/_{name}")
        return Written(None if none else name)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.location)
        system.create_dir(folder, recursive=True)
        old = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.is_file and i.base_name[0] not in "._"] if self.overwrite else []
        for m in messages:
            if m and m.name:
                system.move(f"{folder}/_{m.name}", f"{folder}/{m.name}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.location)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{folder}/_{m.name}")


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_index"

    def schema(self) -> str:
        return scip.ROW

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options)

    def writer(self, schema, overwrite: bool) -> IndexWriter:
        return IndexWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexSource)


def spans(files: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """files (prefix, path) of many indexes: prefix, path, start, stop of ranges to read. The headers are walked in tasks;
    the data source does so on the driver, which is enough for some large indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(prefix, path, *ends) for prefix, location in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for path, size in listed(location) if size for ends in cut_points(path, size, split_bytes)]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.int64()])], ["prefix", "path", "start", "stop"])

    return files.select(F.col("prefix").cast("string"), F.col("path").cast("string")).mapInArrow(run, "prefix string, path string, start long, stop long")


def rows(ranges: DataFrame) -> DataFrame:
    """scip.ROW rows of the ranges, which are dealt over all tasks first: a few bytes of each are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prefix, path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                yield from batched(rows_of(path, prefix or "", start, stop))

    return ranges.select("prefix", "path", "start", "stop").repartition("path", "start").mapInArrow(run, scip.ROW)
