"""COPY text: rows to fields, fields to values, as Spark expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Limits:
    """Raw sizes, checked before unescaping."""

    max_field_bytes: int = 64 << 20
    max_row_bytes: int = 256 << 20
    max_columns: int = 1600


def fail(name: str, **details) -> Column:
    """Raise a load error; details may be columns of numbers, never of row data."""
    parts = [F.lit('{"failed": "' + name + '"')]
    for k, v in details.items():
        parts += [F.lit(f', "{k}": '), v.cast("string") if isinstance(v, Column) else F.lit(json.dumps(v))]
    return F.raise_error(F.concat(*parts, F.lit("}")))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once. It is evaluated as a tree, outside generated code, which keeps rare and long
    expressions from making the generated methods too large to be compiled to machine code."""
    return F.transform(F.array(value), then)[0]


def whole_row(line: Column) -> Column:
    """The row without its trailing CR, if it has one."""
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def split_row(row: Column) -> Column:
    return F.split(row, "\t", -1)


def checked(row: Column, parts: Column, value: Column, expected: int, limits: Limits = Limits(), texts: Sequence[tuple[int, str]] = ()) -> Column:
    """``value`` (text or array) of a row whose number of fields and sizes are as they should be; else the load fails.

    Fields in ``texts`` (place, column) must be UTF-8, which a split would hide.
    """
    kind = lambda c: c.cast("array<string>") if value is parts else c.cast("string")
    out = F.when(F.octet_length(row) > limits.max_row_bytes, kind(fail("RowTooLarge", len=F.octet_length(row), limit=limits.max_row_bytes)))
    out = out.when(F.size(parts) > limits.max_columns, kind(fail("TooManyColumns", count=F.size(parts), limit=limits.max_columns)))
    if limits.max_field_bytes < limits.max_row_bytes:
        large = F.filter(F.transform(parts, F.octet_length), lambda n: n > limits.max_field_bytes)
        out = out.when((F.octet_length(row) > limits.max_field_bytes) & (F.size(large) > 0), kind(fail("FieldTooLarge", len=large[0], limit=limits.max_field_bytes)))
    out = out.when(F.size(parts) != expected, kind(fail("FieldCountMismatch", found=F.size(parts), expected=expected)))
    if texts:
        raw = F.transform(F.split(F.decode(row.cast("binary"), "ISO-8859-1"), "\t", -1), lambda p: F.encode(p, "ISO-8859-1").cast("string"))
        names = F.array(*[F.when(~F.is_valid_utf8(raw[i]), F.lit(json.dumps(name))) for i, name in texts])
        bad = F.filter(names, lambda n: n.isNotNull())
        out = out.when(~F.is_valid_utf8(row), F.when(F.size(bad) > 0, kind(fail("NonUtf8Text", column=bad[0]))).otherwise(value))
    return out.otherwise(value)


def fields(line: Column, expected: int, limits: Limits = Limits()) -> Column:
    """The raw fields of a row, checked."""
    return let(split_row(whole_row(line)), lambda parts: checked(whole_row(line), parts, parts, expected, limits))


#: One token of an escaped field: a hexadecimal, octal or other escape, plain text, or a faulty end.
TOKENS = r"(?s)\\x[0-9a-fA-F]{1,2}|\\[0-7]{1,3}|\\.|[^\\]+|\\$"
#: Escapes that stand for control characters.
CONTROLS = {"b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B"}


def _token_bytes(token: Column) -> Column:
    rest = F.substring(token, 2, 3)
    value = F.when(~F.startswith(token, F.lit("\\")), F.encode(token, "UTF-8"))
    value = value.when(F.length(token) == 1, fail("TruncatedEscape").cast("binary"))
    value = value.when(F.substring(token, 2, 1).between("0", "7"), F.unhex(F.lpad(F.hex(F.conv(rest, 8, 10).cast("int").bitwiseAND(255)), 2, "0")))
    value = value.when(token == "\\x", fail("InvalidHexEscape").cast("binary"))
    value = value.when(F.startswith(token, F.lit("\\x")), F.unhex(F.lpad(F.substring(token, 3, 2), 2, "0")))
    for letter, code in CONTROLS.items():
        value = value.when(rest == letter, F.unhex(F.lit(code)))
    return value.otherwise(F.encode(rest, "UTF-8"))


def unescape(field: Column) -> Column:
    """The field's bytes; fields without a backslash take no expression."""
    tokens = F.regexp_extract_all(field, F.lit(TOKENS), F.lit(0))
    joined = F.aggregate(tokens, F.unhex(F.lit("")), lambda whole, token: F.concat(whole, _token_bytes(token)))
    return F.when(F.contains(field, F.lit("\\")), joined).otherwise(field.cast("binary"))


def text(field: Column, column: str, checked: bool = True) -> Column:
    r"""The field's text: ``\N`` is null, escapes are undone; if ``checked``, bytes must be UTF-8."""

    def valid(value: Column) -> Column:
        return F.when(F.is_valid_utf8(value), value).otherwise(fail("NonUtf8Text", column=column).cast("string")) if checked else value

    escaped = F.when(field != "\\N", valid(unescape(field).cast("string")))
    return F.when(F.contains(field, F.lit("\\")), escaped).otherwise(valid(field))


#: What ``escape`` has to look for.
SPECIAL = "[\\\\\x08\f\n\r\t\x0b]"


def escape(value: Column) -> Column:
    r"""The inverse of ``text``, for writing COPY rows: null is ``\N``."""
    out = plain = value.cast("string")
    for sign, mark in (("\\", "\\\\"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x0b", "\\v")):
        out = F.replace(out, F.lit(sign), F.lit(mark))
    return F.coalesce(F.when(plain.rlike(SPECIAL), out).otherwise(plain), F.lit("\\N"))


def render_row(*values: Column, plain: Sequence[bool] = ()) -> Column:
    """A row; values that are ``plain`` hold nothing that needs an escape."""
    flags = plain or [False] * len(values)
    return F.concat_ws("\t", *[F.coalesce(v, F.lit("\\N")) if p else escape(v) for v, p in zip(values, flags, strict=True)])
