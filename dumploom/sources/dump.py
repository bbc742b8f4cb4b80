"""Index of a dump and its rows as DataFrames.

One pass on the driver finds table definitions and, for each COPY block, newline-aligned byte
ranges; rows stay in the file. A block's DataFrame reads its ranges in parallel, each task its
own, so a table of any size is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from dumploom.errors import MalformedCreateTable, MissingDumpVersion, RowTooLarge, UnsupportedDumpVersion, UnterminatedCopy
from dumploom.functions.copytext import Limits
from dumploom.sources.code import send
from dumploom.sources.ddl import CREATE, TableDef, TableName, ends_statement, parse_copy_header, parse_create_table, take_qualified
from dumploom.sources.files import file_system, opened

MAJORS = frozenset((16, 17))
RANGE_BYTES = 16 << 20
NUMBERED = ["value", "first", "n"]
_BY = re.compile(r"--\s*Dumped by pg_dump version\s+(\d+)", re.I)
_FROM = re.compile(r"--\s*Dumped from database version\s+(\d+)", re.I)


@dataclass
class Block:
    """The rows of one COPY: where they stand, and the columns they have."""

    name: TableName
    columns: tuple[tuple[str, str], ...]
    ranges: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class DumpIndex:
    uri: str
    dumped_by: int | None = None
    from_database: int | None = None
    tables: dict[TableName, TableDef] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    seen: list[TableName] = field(default_factory=list)
    headers: list[bytes] = field(default_factory=list)  # the tables as COPY headers spell them


def _chunks(uri: str, size: int, most: int, options: Mapping[str, str] | None = None) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes, whether the last) cut at newlines; a line may not exceed ``most``."""
    stream, _ = opened(uri, options)
    at, rest = 0, b""
    with stream:
        while True:
            new = stream.read(size)
            data = rest + new
            if not new:
                yield at, data, True
                return
            cut = data.rfind(b"\n") + 1
            if not cut and len(data) > most:
                raise RowTooLarge(len=len(data), limit=most)
            yield at, data[:cut], False
            at, rest = at + cut, data[cut:]


def _end_mark(data: bytes, at: int) -> tuple[int, int] | None:
    r"""(start, end) of the line ``\.``, which must be the whole line (a CR may follow)."""
    while (found := data.find(b"\\.", at)) >= 0:
        if found == 0 or data[found - 1 : found] == b"\n":
            for end in (b"\n", b"\r\n"):
                if data.startswith(end, found + 2):
                    return found, found + 2 + len(end)
        at = found + 2
    return None


def index(uri: str, *, wanted: Callable[[TableName], bool] = lambda name: True, excluded_schemas: frozenset[str] = frozenset(), expect_major: int | None = None, limits: Limits = Limits(), range_bytes: int = RANGE_BYTES, options: Mapping[str, str] | None = None) -> DumpIndex:
    """Read the dump once; structural faults surface here, before any Spark job.

    Blocks that are not wanted are skipped to their end mark, though they count as seen; tables of
    excluded schemas have their definitions skipped unread.
    """
    out, block, copying, statement, skipping = DumpIndex(uri), None, None, "", False
    for offset, data, last in _chunks(uri, range_bytes, max(limits.max_row_bytes, range_bytes), options):
        at = 0
        while at < len(data):
            if copying is not None:
                mark = _end_mark(data, at)
                end = mark[0] if mark else len(data)
                if block is not None and end > at:
                    block.ranges.append((offset + at, offset + end))
                if mark is None:
                    at = len(data)
                    continue
                at, copying, block = mark[1], None, None
                continue
            end = data.find(b"\n", at)
            if end < 0:
                break  # an unfinished last line is no statement
            line = data[at:end].removesuffix(b"\r").decode("utf-8", "replace")
            here, at = offset + at, end + 1
            if statement:
                statement += "\n" + line
            elif CREATE.match(line):
                statement = line
                got = take_qualified(line, CREATE.match(line).end())
                skipping = bool(got) and got[0].schema in excluded_schemas
            elif (m := _FROM.match(line)) and out.dumped_by is None:
                out.from_database = int(m[1])
            elif m := _BY.match(line):
                out.dumped_by = int(m[1])
                if out.dumped_by not in MAJORS or expect_major not in (None, out.dumped_by):
                    raise UnsupportedDumpVersion(found=out.dumped_by)
            elif header := parse_copy_header(line, here):
                name, columns = header
                copying = name
                out.headers.append(line[5 : take_qualified(line, 5)[1]].strip().encode())
                if out.dumped_by is None:
                    raise MissingDumpVersion()
                if name not in out.seen:
                    out.seen.append(name)
                if wanted(name) and name.schema not in excluded_schemas:
                    block = Block(name, _columns(out.tables.get(name), name, columns))
                    out.blocks.append(block)
            if statement and (line.rstrip().endswith(";") and ends_statement(statement)):
                if not skipping:
                    table = parse_create_table(statement)
                    out.tables[table.name] = table
                statement = ""
        if last:
            break
    if copying is not None:
        raise UnterminatedCopy(table=copying.qualified())
    if out.dumped_by is None:
        raise MissingDumpVersion()
    return out


def _columns(table: TableDef | None, name: TableName, columns: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    """Declared types of the rows' columns, by name; without a list, all in the declared order."""
    if table is None:
        raise MalformedCreateTable(table=name.qualified())
    if not columns:
        return table.columns
    declared = dict(table.columns)
    if any(c not in declared for c in columns):
        raise MalformedCreateTable(table=name.qualified())
    return tuple((c, declared[c]) for c in columns)


def block_lines(spark: SparkSession, uri: str, ranges: list[tuple[int, int]], piece: int = 4 << 20, *, numbered: bool = False, options: Mapping[str, str] | None = None) -> DataFrame:
    """The rows at ``ranges`` of a file, undecoded, in a string column ``value``; one task a range, or a few, in the file's order.

    ``numbered`` adds ``first`` (where the range begins) and ``n`` (the row's number in it, from 1).
    """
    send(spark)
    listed = spark.createDataFrame([(uri, a, b) for a, b in ranges], "uri string, first long, end long")
    listed = listed.repartitionByRange(max(1, len(ranges)), "first").sortWithinPartitions("first") if len(ranges) > 1 else listed.coalesce(1)

    def read(batches):
        for batch in batches:
            for where, begin, b in zip(*(batch.column(c).to_pylist() for c in ("uri", "first", "end")), strict=True):
                store, path = file_system(where, options)
                with store.open_input_file(path) as f:
                    f.seek(begin)
                    a, n, rest = begin, 0, b""
                    while a < b:
                        data = f.read(min(piece, b - a))
                        if not data:
                            raise OSError("the file is shorter than when it was indexed")
                        a += len(data)
                        data = rest + data
                        cut = data.rfind(b"\n") + 1
                        rest = data[cut:]
                        if cut:
                            lines = pc.split_pattern(pa.array([data[: cut - 1]], pa.binary()), b"\n").flatten()
                            for at in range(0, len(lines), 20_000):
                                part = lines[at : at + 20_000]
                                number = pa.array(range(n + 1, n + len(part) + 1), pa.int64())
                                n += len(part)
                                yield pa.record_batch([part, pa.array([begin] * len(part), pa.int64()), number] if numbered else [part], NUMBERED if numbered else ["value"])

    kind = "value binary, first long, n long" if numbered else "value binary"
    return listed.mapInArrow(read, kind).selectExpr("cast(value as string) as value", *(["first", "n"] if numbered else []))
