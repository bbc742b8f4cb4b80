"""Typed values from unescaped text: one guarded expression a type.

A parser returns (value, substituted): ``substituted`` is true where a valid value has no
representation and loads as null (infinite dates, NaN in numerics). A value that
contradicts its type raises UnparsableValue with the column and the type's name only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from dumploom.functions.copytext import fail, let, unescape
from dumploom.functions.pgtypes import PgType, spark_type

DAY = 86_400_000_000
BLANKS = " \t\n\x0b\f\r"


def _valid(text: Column, ok: Column, value: Column, column: str, expected: str, kind: str) -> Column:
    """Null stays null; a text that is not ``ok``, or has no value, fails."""
    found = F.when(ok, value)
    bad = fail("UnparsableValue", column=column, expected=expected).cast(kind)
    return F.when(text.isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce(found, bad))


def _either(text: Column, plain: str, fast: Column, full: Callable[[Column], Column]) -> Column:
    """``fast`` for texts of the usual form ``plain``, for which it must have the value that ``full`` has; ``full`` for all others.

    One match and one cast decide nearly every row; the long expression is no part of the generated code.
    """
    return F.when(text.rlike(plain), fast).when(text.isNotNull(), let(text, full))


def _number(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def parse_integer(text: Column, column: str, kind: str) -> Column:
    name = {"smallint": "smallint", "integer": "int", "bigint": "bigint"}[kind]
    plain = text.try_cast(name)

    def full(t: Column) -> Column:
        return _valid(t, _number(t).rlike(r"^[+-]?[0-9]+\z"), _number(t).try_cast(name), column, kind, name)

    # A number written the usual way is its own text again, which is cheaper to see than a match.
    return F.when(plain.cast("string") == text, plain).when(text.isNotNull(), let(text, full))


def parse_float(text: Column, column: str, kind: str) -> Column:
    name = "float" if kind == "real" else "double"

    def full(t: Column) -> Column:
        value = F.lower(_number(t))
        ok = value.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?\z|^[+-]?(inf|infinity|nan)\z")
        special = F.when(value.rlike("nan"), F.lit("NaN")).when(value.rlike("inf"), F.when(F.startswith(value, F.lit("-")), F.lit("-Infinity")).otherwise(F.lit("Infinity")))
        return _valid(t, ok, F.coalesce(special, value).try_cast(name), column, kind, name)

    return _either(text, r"^-?[0-9]++(?:[.][0-9]++)?(?:[eE][+-]?[0-9]{1,3})?\z", text.try_cast(name), full)


def parse_boolean(text: Column, column: str) -> Column:
    return _valid(text, text.isin("t", "true", "T", "f", "false", "F"), text.isin("t", "true", "T"), column, "boolean", "boolean")


def parse_numeric(text: Column, column: str, precision: int, scale: int) -> tuple[Column, Column]:
    name = f"decimal({precision},{scale})"
    nan = F.coalesce(_number(text) == "NaN", F.lit(False))

    def full(t: Column) -> Column:
        value = _number(t)
        ok = value.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)\z") & ~value.rlike(rf"[.][0-9]{{{scale}}}[0-9]*[1-9]")
        # Surplus zeros are cut: a cast would round where the digits exceed what a decimal can hold.
        cut = F.regexp_replace(value, rf"([.][0-9]{{{scale}}})0+\z", "$1")
        return F.when(value != "NaN", _valid(t, ok, cut.try_cast(name), column, "numeric", name))

    whole = precision - scale
    form = "^-?" + (rf"[0-9]{{1,{whole}}}" if whole else "0") + (rf"(?:[.][0-9]{{1,{scale}}})?" if scale else "") + r"\z"
    return _either(text, form, text.try_cast(name), full), nan


def _infinite(text: Column) -> Column:
    return F.coalesce(F.endswith(F.rtrim(text), F.lit("infinity")) & F.btrim(text, F.lit(BLANKS)).isin("infinity", "-infinity"), F.lit(False))


def _groups(text: Column, form: str, n: int) -> Column:
    """The groups 1 to ``n`` of a text that matches ``form``, by one match; empty where a group has none."""
    return F.split(F.regexp_replace(text, form, "|".join(f"${i}" for i in range(1, n + 1))), "[|]", -1)


def _days(y: Column, m: Column, d: Column, bc: Column) -> Column:
    """Days since 1970; days roll over the month's end."""
    year = y.try_cast("int")
    year = F.when(bc != "", 1 - year).otherwise(year)
    day = d.cast("int")
    ok = m.cast("int").between(1, 12) & day.between(1, 31) & year.between(-300_000, 300_000)
    return F.when(ok, F.unix_date(F.make_date(year, m.cast("int"), F.lit(1))) + day - 1)


DATE = r"^([0-9]+)-([0-9]{2})-([0-9]{2})( BC)?\z"
TIME = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.]([0-9]{1,6}))?)?"
OFFSET = r"(?: ?([+-])([0-9]{1,2})(?::([0-9]{2}))?(?::([0-9]{2}))?)?"
STAMP = rf"^([0-9]+)-([0-9]{{2}})-([0-9]{{2}})(?: {TIME}{OFFSET})?( BC)?\z"
#: Usual forms, whose values the built-in casts have: four digits of a year, days that the month has every year, hours below 24, whole offsets.
PLAIN_DATE = r"^(?!0000)[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
PLAIN_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:[.][0-9]{1,6})?"


def parse_date(text: Column, column: str) -> tuple[Column, Column]:
    def full(t: Column) -> Column:
        value = _number(t)
        days = F.when(value.rlike(DATE), let(_groups(value, DATE, 4), lambda g: _days(g[0], g[1], g[2], g[3])))
        return F.when(~_infinite(t), _valid(t, value.rlike(DATE), F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), column, "date", "date"))

    return _either(text, PLAIN_DATE + r"\z", text.try_cast("date"), full), _infinite(text)


def _micros(h: Column, m: Column, s: Column, f: Column) -> Column:
    """Microseconds of a time; hours to 24 and seconds to 60 are taken."""
    second = F.when(s == "", 0).otherwise(s.try_cast("int"))
    ok = h.try_cast("int").between(0, 24) & m.try_cast("int").between(0, 59) & second.between(0, 60)
    whole = (h.try_cast("bigint") * 3600 + m.try_cast("bigint") * 60 + second) * 1_000_000 + F.rpad(f, 6, "0").try_cast("bigint")
    return F.when(ok, whole)


def _offset(sign: Column, h: Column, m: Column, s: Column) -> Column:
    number = lambda x: F.when(x == "", 0).otherwise(x.try_cast("bigint"))
    size = (number(h) * 3600 + number(m) * 60 + number(s)) * 1_000_000
    return F.when(sign == "-", -size).otherwise(size)


def parse_time(text: Column, column: str) -> Column:
    form = rf"^{TIME}{OFFSET}\z"

    def full(t: Column) -> Column:
        value = _number(t)
        micros = let(_groups(value, form, 8), lambda g: F.pmod(_micros(g[0], g[1], g[2], g[3]) - _offset(g[4], g[5], g[6], g[7]), F.lit(DAY)))
        return _valid(t, value.rlike(form), F.when(value.rlike(form), micros), column, "time", "bigint")

    plain = F.unix_micros(F.concat(F.lit("1970-01-01 "), text, F.lit("Z")).try_cast("timestamp"))
    return _either(text, rf"^{PLAIN_TIME}\z", plain, full)


def _session_is_utc() -> bool:
    """Whether a cast without a zone means UTC; looking up a zone a row costs more than the rest of the cast."""
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone").upper() in ("UTC", "Z", "GMT", "ETC/UTC", "+00:00")


def parse_timestamp(text: Column, column: str, zoned: bool) -> tuple[Column, Column]:
    def total(g: Column) -> Column:
        days = _days(g[0], g[1], g[2], g[11]).cast("bigint")
        clock = F.when(g[3] == "", F.lit(0).cast("bigint")).otherwise(_micros(g[3], g[4], g[5], g[6]))
        shift = _offset(g[7], g[8], g[9], g[10]) if zoned else F.when(g[7] == "", F.lit(0).cast("bigint"))  # a zone where none belongs has no value
        return F.try_subtract(F.try_add(F.try_multiply(days, F.lit(DAY)), clock), shift)

    def full(t: Column) -> Column:
        value = _number(t)
        found = F.timestamp_micros(F.when(value.rlike(STAMP), let(_groups(value, STAMP, 12), total)))
        return F.when(~_infinite(t), _valid(t, value.rlike(STAMP), found, column, "timestamp", "timestamp"))

    zone = r"[+-](?:0[0-9]|1[0-7])(?::[0-5][0-9])?" if zoned else ""
    if not zoned and _session_is_utc():
        return _either(text, f"{PLAIN_DATE} {PLAIN_TIME}\\z", text.try_cast("timestamp"), full), _infinite(text)
    plain = F.concat(text, F.when(F.substring(text, -3, 1).isin("+", "-"), F.lit(":00")).otherwise(F.lit(""))) if zoned else F.concat(text, F.lit("Z"))
    return _either(text, f"{PLAIN_DATE} {PLAIN_TIME}{zone}\\z", plain.try_cast("timestamp"), full), _infinite(text)


def parse_bytea(raw: Column, column: str) -> Column:
    r"""Bytes from ``\x`` and hexadecimal digits, or from the escape form (``\\``, three octal digits)."""
    digits = F.substring(raw, 3, (1 << 31) - 1)
    hex_ok = F.startswith(raw, F.lit("\\x")) & (F.length(digits) % 2 == 0) & digits.rlike(r"^[0-9a-fA-F]*\z")
    tokens = F.regexp_extract_all(raw, F.lit(r"(?s)\\[0-3][0-7]{2}|\\\\|[^\\]+"), F.lit(0))
    escape_ok = ~F.startswith(raw, F.lit("\\x")) & (F.array_join(tokens, "") == raw)
    joined = F.when(F.contains(raw, F.lit("\\")), unescape(raw)).otherwise(raw.cast("binary"))
    value = F.when(F.startswith(raw, F.lit("\\x")), F.unhex(F.when(hex_ok, digits))).when(escape_ok, F.when(escape_ok, joined))
    return _valid(raw, hex_ok | escape_ok, value, column, "bytea", "binary")


ELEMENT = r'(?s)(?:^|,)([ \t\n\f\r]*(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|(?!")[^,}\s]*+)[ \t\n\f\r]*)'


def parse_array(text: Column, column: str, element: PgType, wide: bool = False) -> tuple[Column, Column]:
    """A one-dimensional literal; its validity is that its tokens, joined again, give the literal."""
    kind = spark_type(element, wide).simpleString()
    value = F.btrim(text, F.lit(BLANKS))
    inner = F.substring(value, 2, (1 << 31) - 1)
    inner = F.left(inner, F.greatest(F.length(inner) - 1, F.lit(0)))
    tokens = F.regexp_extract_all(inner, F.lit(ELEMENT), F.lit(1))
    empty = F.btrim(inner, F.lit(BLANKS)) == ""
    ok = F.startswith(value, F.lit("{")) & F.endswith(value, F.lit("}")) & (empty | (F.concat(F.lit("{"), F.array_join(tokens, ","), F.lit("}")) == value))

    def item(token: Column) -> Column:
        bare = F.btrim(token, F.lit(BLANKS))
        quoted = F.startswith(bare, F.lit('"'))
        body = F.regexp_replace(F.substring(bare, 2, (1 << 31) - 1), r'(?s)"\z', "")
        body = F.when(F.contains(body, F.lit("\\")), F.regexp_replace(body, r"(?s)\\(.)", "$1")).otherwise(body)
        return F.when(~quoted & (F.lower(bare) == "null"), F.lit(None).cast("string")).otherwise(F.when(quoted, body).otherwise(bare))

    items = F.transform(F.when(ok, tokens), item)
    parsed = F.transform(items, lambda x: parse(x, column, element, wide)[0])
    lost = F.exists(items, lambda x: parse(x, column, element, wide)[1]) if element.kind in ("numeric", "date", "timestamp", "timestamptz") else F.lit(False)
    result = F.when(empty, F.array().cast(f"array<{kind}>")).otherwise(parsed)
    return _valid(text, ok, result, column, "array", f"array<{kind}>"), F.coalesce(lost, F.lit(False))


def parse(text: Column, column: str, t: PgType, wide: bool = False, arrays: bool = False) -> tuple[Column, Column]:
    """(value, substituted) of an unescaped text, null for null."""
    target, none = spark_type(t, wide, arrays), F.lit(False)
    if target.typeName() == "array":
        return parse_array(text, column, PgType(t.declared, t.kind, 0, t.precision, t.scale, t.recognised), wide)
    if t.dimensions or target.typeName() == "string":
        return text, none
    if t.kind in ("smallint", "integer", "bigint"):
        return parse_integer(text, column, t.kind), none
    if t.kind in ("real", "double precision"):
        return parse_float(text, column, t.kind), none
    if t.kind == "boolean":
        return parse_boolean(text, column), none
    if t.kind == "numeric":
        return parse_numeric(text, column, target.precision, target.scale)
    if t.kind == "date":
        return parse_date(text, column)
    if t.kind == "time":
        return parse_time(text, column), none
    if t.kind == "bytea":
        return parse_bytea(text, column), none
    return parse_timestamp(text, column, t.kind == "timestamptz")
