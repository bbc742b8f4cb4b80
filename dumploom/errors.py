"""What a load can fail with. No message ever holds row data."""

from __future__ import annotations

import json


class LoadError(Exception):
    """Base of all failures of a load; keyword details become attributes. Faults of the input are also ValueErrors, others what they are."""

    text = "load failed"

    def __init__(self, **details):
        self.__dict__.update(details)
        self.details = details
        super().__init__(self.text.format(**details))


def _kind(name: str, text: str, base: type = ValueError) -> type:
    return type(name, (LoadError, base), {"text": text, "__module__": __name__})


FieldTooLarge = _kind("FieldTooLarge", "a field of {len} bytes exceeds the limit of {limit}")
RowTooLarge = _kind("RowTooLarge", "a row of {len} bytes exceeds the limit of {limit}")
TooManyColumns = _kind("TooManyColumns", "{count} columns exceed the limit of {limit}")
FieldCountMismatch = _kind("FieldCountMismatch", "a row has {found} fields, {expected} were expected")
TruncatedEscape = _kind("TruncatedEscape", "a field ends within an escape")
InvalidHexEscape = _kind("InvalidHexEscape", "a hexadecimal escape has no digits")
UnterminatedCopy = _kind("UnterminatedCopy", "the rows of {table} have no end mark")
MalformedCopyHeader = _kind("MalformedCopyHeader", "the COPY header at byte {offset} cannot be read")
MalformedCreateTable = _kind("MalformedCreateTable", "the definition of {table} cannot be read or lacks a column of its rows")
UnsupportedDumpVersion = _kind("UnsupportedDumpVersion", "dump version {found} is not supported")
MissingDumpVersion = _kind("MissingDumpVersion", "the dump states no version")
UnsafeTableName = _kind("UnsafeTableName", "the table name {name} is not safe as a path")
UnparsableValue = _kind("UnparsableValue", "a value of column {column} is not a valid {expected}")
NonUtf8Text = _kind("NonUtf8Text", "a text of column {column} is not UTF-8")
UnsupportedCompression = _kind("UnsupportedCompression", "{format} input is not supported")
ArrowFailure = _kind("ArrowFailure", "column data failed: {message}", RuntimeError)
TableFailure = _kind("TableFailure", "the table store failed: {message}", RuntimeError)
TableExists = _kind("TableExists", "{table} already holds data")
IoFailure = _kind("IoFailure", "input or output failed: {message}", OSError)
SchemaChanged = _kind("SchemaChanged", "the schema of {table} changed: {detail}")
ManagedTableTarget = _kind("ManagedTableTarget", "{uri} is managed storage ({marker})")
InternalFailure = _kind("InternalFailure", "internal failure: {detail}", RuntimeError)


class Interrupted(KeyboardInterrupt):
    """The progress callback, or the user, stopped the load."""


class PartialCommitError(RuntimeError):
    """Some tables of a load were committed before another failed."""

    def __init__(self, table: str, committed: int, total: int, message: str):
        self.table, self.committed, self.total = table, committed, total
        super().__init__(f"commit of {table} failed after {committed} of {total}: {message}")


#: Failures that expressions raise on executors, as JSON in the message of raise_error.
RAISED = {k.__name__: k for k in (FieldTooLarge, RowTooLarge, TooManyColumns, FieldCountMismatch, TruncatedEscape, InvalidHexEscape, UnparsableValue, NonUtf8Text)}


def from_spark(error: Exception) -> Exception | None:
    """The load error that an expression raised, or None; the Spark exception's own text is dropped."""
    found = getattr(error, "getMessageParameters", lambda: None)() or {}
    said = found.get("errorMessage") or str(error)
    start = said.find('{"failed"')
    if start < 0:
        return None
    try:
        details, _ = json.JSONDecoder().raw_decode(said[start:])
        return RAISED[details.pop("failed")](**details)
    except (ValueError, KeyError):
        return None
