"""Planned file sources: ``register(spark)``, then ``spark.read.format(...).load(folder)``.

| format | rows | planned by |
|---|---|---|
| ``case_lines`` | JSON lines, strict: the first bad line fails the query with its file and line | byte ranges of ``split_bytes`` |
| ``hl7_messages``, ``cda_reports`` | one row a file: path, text | groups of files of up to ``split_bytes`` |
| ``case_tickets`` | a Parquet case store by ticket (``cases``, ``cases?status=X``) | groups of row groups; columns by option ``columns`` |
| ``sse_transcripts`` | recorded event streams (see ``transcripts``), batch and stream | files; a stream's offset is the newest file taken |

Filters that the source takes (equality, membership and presence of a column) are applied
before a row leaves the worker, and for ``case_tickets`` before a row group is
read. Readers yield Arrow batches of ``batch_rows`` rows and hold no more. Folders
are URIs that Arrow's file systems open on every executor (``file``, ``hdfs``,
``s3``, ``gs``). Defined results: an empty folder or file gives no rows, blank lines
are skipped, files that begin with ``_`` or ``.`` are none of the table's.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from casegrid.sources.readers import CASE
from casegrid.sources.transcripts import SCHEMA as TRANSCRIPT
from casegrid.sources.transcripts import transcripts


@dataclass
class Piece(InputPartition):
    """Part of the input of one task: (file, first byte or row group, end) of each of some files."""

    spans: list[tuple[str, int, int]]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))


def files_of(folder: str) -> list[fs.FileInfo]:
    """Files of a folder (or the one file), by path."""
    system, path = opened(folder)
    top = system.get_file_info(path)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{folder} isn't there")
    found = [top] if top.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f for f in found if f.is_file and f.base_name[:1] not in ("_", ".")), key=lambda f: f.path)


def grouped(spans: Iterable[tuple[tuple[str, int, int], int]], most: int) -> list[Piece]:
    """Pieces of up to ``most`` bytes (one span at least)."""
    pieces: list[Piece] = []
    room = 0
    for span, size in spans:
        if not pieces or size > room:
            pieces.append(Piece([]))
            room = most
        pieces[-1].spans.append(span)
        room -= size
    return pieces


class PlannedReader(DataSourceReader):
    """What the formats share: options, pushed filters, batches."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.options = dict(options)
        if "path" not in self.options:
            raise ValueError("load() needs a folder")
        self.folder = self.options["path"]
        self.split_bytes = int(self.options.get("split_bytes", 64 << 20))
        self.batch_rows = int(self.options.get("batch_rows", 10_000))
        self.schema = schema
        #: values that a column may have
        self.wanted: dict[str, tuple] = {}
        #: columns that may not be null
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {x.name for x in self.schema.fields}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in names else None
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if column and isinstance(f, IsNotNull):
                self.present.add(column)
            elif column and values is not None and column not in self.wanted:
                self.wanted[column] = tuple(values)
            else:
                yield f

    def keeps(self, row: dict) -> bool:
        return all(row.get(c) is not None for c in self.present) and all(row.get(c) in values for c, values in self.wanted.items())

    def batches(self, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        held: list[dict] = []
        for row in rows:
            if self.keeps(row):
                held.append(row)
                if len(held) == self.batch_rows:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    def partitions(self) -> list[Piece]:
        return grouped((((f.path, 0, f.size), f.size) for f in files_of(self.folder) if f.size), self.split_bytes) or [Piece([])]

    def rows(self, system: fs.FileSystem, path: str, start: int, stop: int) -> Iterator[dict]:
        raise NotImplementedError

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        yield from self.batches(row for span in partition.spans for row in self.rows(system, *span))


def lines_of(system: fs.FileSystem, path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that begin in [start, stop)."""
    with system.open_input_file(path) as raw:
        at = max(0, start - 1)
        raw.seek(at)
        block = min(1 << 20, max(1 << 12, stop - at))
        rest = raw.read(block)
        if start:  # a line that began before belongs to the span before
            while b"\n" not in rest:
                at += len(rest)
                rest = raw.read(block)
                if not rest or at >= stop:  # the line goes on beyond this span: none begins here
                    return
            skipped = rest.index(b"\n") + 1
            rest, at = rest[skipped:], at + skipped
        while at < stop:
            end = rest.find(b"\n")
            if end < 0:
                more = raw.read(max(1 << 20, len(rest)))  # twice as much for a long line, so that it is copied a few times only
                if more:
                    rest += more
                    continue
                if rest:
                    yield at, rest
                return
            here = 0
            while end >= 0 and at + here < stop:
                yield at + here, rest[here:end]
                here = end + 1
                end = rest.find(b"\n", here)
            rest, at = rest[here:], at + here


def line_number(system: fs.FileSystem, path: str, at: int) -> int:
    """Number (from 1) of the line that begins at a byte; only a failing query counts."""
    n = 1
    with system.open_input_stream(path) as raw:
        while at > 0:
            block = raw.read(min(at, 1 << 20))
            n, at = n + block.count(b"\n"), at - len(block)
    return n


class CaseLinesReader(PlannedReader):
    def partitions(self) -> list[Piece]:
        spans = [((f.path, at, min(f.size, at + self.split_bytes)), min(f.size - at, self.split_bytes)) for f in files_of(self.folder) for at in range(0, f.size, self.split_bytes)]
        return grouped(spans, self.split_bytes) or [Piece([])]

    def rows(self, system: fs.FileSystem, path: str, start: int, stop: int) -> Iterator[dict]:
        names = [f.name for f in self.schema.fields]
        for at, line in lines_of(system, path, start, stop):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
                if not isinstance(row, dict):
                    raise ValueError("not an object")
            except ValueError as fault:
                raise ValueError(f"{path}:{line_number(system, path, at)}: {fault}: {line[:80]!r}") from None
            yield {name: row.get(name) for name in names}


class WholeFilesReader(PlannedReader):
    def rows(self, system: fs.FileSystem, path: str, start: int, stop: int) -> Iterator[dict]:
        with system.open_input_file(path) as raw:
            data = raw.readall()
        try:
            yield {"path": path, "text": data.decode("utf-8-sig")}
        except UnicodeDecodeError as fault:
            raise ValueError(f"{path}:{data.count(b'\n', 0, fault.start) + 1}: not UTF-8 at byte {fault.start}") from None


class TicketReader(PlannedReader):
    """The store's rows by ticket; row groups whose statistics rule out the wanted values aren't read."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.status = self.options.get("status_column", "queue_status")
        self.hidden = self.options.get("hidden", "Graylist")
        name, _, query = self.options.get("ticket", "cases").partition("?")
        if name != "cases" or (query and not query.startswith("status=")):
            raise ValueError(f"unknown ticket {self.options.get('ticket')!r}")
        self.of_ticket = query.removeprefix("status=") if query else None

    def partitions(self) -> list[Piece]:
        system, _ = opened(self.folder)
        spans = []
        for f in files_of(self.folder):
            about = pq.read_metadata(f.path, filesystem=system)
            spans += [((f.path, k, k + 1), about.row_group(k).total_byte_size) for k in range(about.num_row_groups)]
        return grouped(spans, self.split_bytes) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        schema = to_arrow_schema(self.schema)
        status = ds.field(self.status)
        chosen = status == self.of_ticket if self.of_ticket is not None else ~(status == self.hidden) | status.is_null()
        for column, values in self.wanted.items():
            chosen = chosen & ds.field(column).isin(list(values))
        for column in self.present:
            chosen = chosen & ds.field(column).is_valid()
        by_file: dict[str, list[int]] = {}
        for path, group, _ in partition.spans:
            by_file.setdefault(path, []).append(group)
        fmt = ds.ParquetFileFormat()
        for path, groups in by_file.items():
            fragment = fmt.make_fragment(path, filesystem=system, row_groups=groups)
            for batch in fragment.scanner(columns=schema.names, filter=chosen, batch_size=self.batch_rows).to_batches():
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, schema.types)], schema=schema)


class TranscriptReader(PlannedReader):
    def rows(self, system: fs.FileSystem, path: str, start: int, stop: int) -> Iterator[dict]:
        yield from transcripts(((path, at, line) for at, line in lines_of(system, path, start, stop)))


class TranscriptStream(DataSourceStreamReader):
    """Files in order of (time of change, path); an offset is the last one taken. Files must appear whole (renamed in), with rising times."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.reader = TranscriptReader(schema, options)

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        newest = max(((f.mtime_ns, f.path) for f in files_of(self.reader.folder)), default=(-1, ""))
        return {"at": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, until = (start["at"], start["path"]), (end["at"], end["path"])
        new = [f for f in files_of(self.reader.folder) if f.size and after < (f.mtime_ns, f.path) <= until]
        return grouped((((f.path, 0, f.size), f.size) for f in new), self.reader.split_bytes) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class CaseLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "case_lines"

    def schema(self) -> str:
        return CASE

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaseLinesReader(schema, self.options)


class Hl7Messages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hl7_messages"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WholeFilesReader(schema, self.options)


class CdaReports(Hl7Messages):
    @classmethod
    def name(cls) -> str:
        return "cda_reports"


class CaseTickets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "case_tickets"

    def schema(self) -> StructType:
        system, _ = opened(self.options["path"])
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no file in {self.options['path']}")
        whole = from_arrow_schema(pq.read_schema(files[0].path, filesystem=system))
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([whole[c] for c in names]) if names else whole

    def reader(self, schema: StructType) -> DataSourceReader:
        return TicketReader(schema, self.options)


class SseTranscripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sse_transcripts"

    def schema(self) -> str:
        return TRANSCRIPT

    def reader(self, schema: StructType) -> DataSourceReader:
        return TranscriptReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TranscriptStream(schema, self.options)


FORMATS = (CaseLines, Hl7Messages, CdaReports, CaseTickets, SseTranscripts)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in FORMATS:
        spark.dataSource.register(source)
