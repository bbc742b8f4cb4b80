"""The little of PostgreSQL's DDL that a dump's tables need: names, columns, types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from dumploom.errors import MalformedCopyHeader, MalformedCreateTable

# Words that end a column's type, and that begin a table constraint.
TYPE_ENDS = frozenset("DEFAULT NOT NULL GENERATED COLLATE CONSTRAINT CHECK REFERENCES PRIMARY UNIQUE".split())
CONSTRAINTS = frozenset("CONSTRAINT PRIMARY UNIQUE FOREIGN CHECK EXCLUDE LIKE".split())

#: Quoted identifiers and literals, brackets, commas and the end of a statement; the rest is plain.
_PIECE = re.compile(r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|[(),;\[\]]|[^\s\"'(),;\[\]]+|\s+")
_NAME = re.compile(r"\s*(?:\"((?:[^\"]|\"\")*)\"|([^\s(,.;\"]+))")


@dataclass(frozen=True)
class TableName:
    """Two parts that are never joined for identity: a dot may be part of a name."""

    schema: str | None
    table: str

    def qualified(self) -> str:
        return self.table if self.schema is None else f"{self.schema}.{self.table}"


@dataclass(frozen=True)
class TableDef:
    name: TableName
    columns: tuple[tuple[str, str], ...]  # name, declared type


def take_name(text: str, at: int = 0) -> tuple[str, int] | None:
    m = _NAME.match(text, at)
    return m and (m[1].replace('""', '"') if m[1] is not None else m[2], m.end())


def take_qualified(text: str, at: int = 0) -> tuple[TableName, int] | None:
    first = take_name(text, at)
    if first is None:
        return None
    name, at = first
    if at < len(text) and text[at] == "." and (second := take_name(text, at + 1)):
        return TableName(name, second[0]), second[1]
    return TableName(None, name), at


def ends_statement(text: str) -> bool:
    """Whether a semicolon outside quotes and brackets has come."""
    depth = 0
    for m in _PIECE.finditer(text):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] == ";" and depth <= 0:
            return True
    return False


def _split(text: str, at: int) -> list[str] | None:
    """The comma-separated items of the brackets that open at ``at``; what follows them is dropped."""
    depth, items, item = 0, [], []
    for m in _PIECE.finditer(text, at):
        depth += (m[0] == "(") - (m[0] == ")")
        if depth == 0:
            return [*items, "".join(item)]
        if depth == 1 and m[0] == ",":
            items.append("".join(item))
            item = []
        elif depth > 1 or m[0] != "(":
            item.append(m[0])
    return None


def _type(text: str) -> str:
    """A column's type: pieces up to a word that ends it, brackets kept whole."""
    depth, out = 0, []
    for m in _PIECE.finditer(text):
        if depth == 0 and m[0].upper() in TYPE_ENDS:
            break
        depth += (m[0] == "(") - (m[0] == ")")
        out.append(m[0])
    return "".join(out).strip()


CREATE = re.compile(r"CREATE (?:UNLOGGED )?TABLE ", re.I)


def parse_create_table(ddl: str) -> TableDef:
    start = CREATE.match(ddl)
    found = take_qualified(ddl, start.end()) if start else None
    if found is None:
        raise MalformedCreateTable(table="an unnamed table")
    name, at = found
    while at < len(ddl) and ddl[at].isspace():
        at += 1
    items = _split(ddl, at) if at < len(ddl) and ddl[at] == "(" else None
    if items is None:
        raise MalformedCreateTable(table=name.qualified())
    columns = []
    for item in filter(str.strip, items):
        got = take_name(item)
        if got is None:
            raise MalformedCreateTable(table=name.qualified())
        quoted = item.lstrip().startswith('"')
        if not quoted and got[0].upper() in CONSTRAINTS:
            continue
        declared = _type(item[got[1] :])
        if not declared:
            raise MalformedCreateTable(table=name.qualified())
        columns.append((got[0], declared))
    return TableDef(name, tuple(columns))


def parse_copy_header(line: str, offset: int = 0) -> tuple[TableName, tuple[str, ...]] | None:
    """Table and columns of ``COPY … FROM stdin;``, or None where the line is another statement."""
    if not line.startswith("COPY ") or not line.rstrip().endswith("FROM stdin;"):
        return None
    found = take_qualified(line, 5)
    if found is None:
        raise MalformedCopyHeader(offset=offset)
    name, at = found
    rest = line[at:].strip()
    if not rest.startswith("("):
        return name, ()
    items = _split(line, line.index("(", at))
    names = [take_name(i) for i in items or []]
    if not names or None in names:
        raise MalformedCopyHeader(offset=offset)
    return name, tuple(n for n, _ in names)
