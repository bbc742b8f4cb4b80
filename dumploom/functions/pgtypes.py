"""PostgreSQL type declarations and the Spark types they load as."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# Names of types that load as text by design.
TEXTUAL = frozenset({
    "bit", "bit varying", "box", "bpchar", "char", "character", "character varying", "cidr", "circle", "daterange", "inet", "int4range", "int8range", "interval",
    "json", "jsonb", "line", "lseg", "macaddr", "macaddr8", "money", "name", "numrange", "path", "point", "polygon", "text", "tsquery", "tsrange", "tstzrange",
    "tsvector", "uuid", "varbit", "varchar", "xml",
})
# Names of types that load as something else, and their kinds.
KIND = {
    "smallint": "smallint", "int2": "smallint", "smallserial": "smallint", "serial2": "smallint",
    "integer": "integer", "int": "integer", "int4": "integer", "serial": "integer", "serial4": "integer",
    "bigint": "bigint", "int8": "bigint", "bigserial": "bigint", "serial8": "bigint",
    "real": "real", "float4": "real", "double precision": "double precision", "float8": "double precision",
    "numeric": "numeric", "decimal": "numeric", "boolean": "boolean", "bool": "boolean", "date": "date", "bytea": "bytea",
    "timestamp": "timestamp", "timestamp without time zone": "timestamp", "timestamptz": "timestamptz", "timestamp with time zone": "timestamptz",
    "time": "time", "time without time zone": "time", "timetz": "time", "time with time zone": "time",
}
WIDE_PRECISION, WIDE_SCALE = 38, 18


@dataclass(frozen=True)
class PgType:
    """A declaration: its kind, array dimensions, numeric precision and scale, and whether it is known."""

    declared: str
    kind: str
    dimensions: int = 0
    precision: int | None = None
    scale: int | None = None
    recognised: bool = True


def resolve(declared: str) -> PgType:
    """Never fails: an unknown declaration is text, not recognised."""
    name = " ".join(declared.split()).lower()
    dimensions = 0
    while m := re.search(r"\s*\[\d*\]$", name):
        name, dimensions = name[: m.start()], dimensions + 1
    params = None
    if m := re.search(r"\(([^)]*)\)", name):
        params, name = m[1], " ".join(f"{name[: m.start()]} {name[m.end() :]}".split())
    kind = KIND.get(name) or ("text" if name in TEXTUAL else None)
    precision = scale = None
    if kind == "numeric" and params is not None:
        parts = [p.strip() for p in params.split(",")]
        if all(re.fullmatch(r"[+-]?\d+", p) for p in parts) and len(parts) <= 2 and 0 <= int(parts[0]) <= 255:
            precision, scale = int(parts[0]), int(parts[1]) if len(parts) == 2 else 0
    return PgType(declared, kind or "text", dimensions, precision, scale, kind is not None)


def is_representable_numeric(t: PgType) -> bool:
    return t.precision is not None and 1 <= t.precision <= 38 and 0 <= t.scale <= t.precision


def is_wide_numeric(t: PgType) -> bool:
    """Unconstrained, or of more digits than a decimal holds; a scale outside 0 to the precision stays text always."""
    return t.precision is None or (t.precision > 38 and 0 <= t.scale <= t.precision)


_SIMPLE = {
    "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(), "real": T.FloatType(), "double precision": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "bytea": T.BinaryType(), "timestamp": T.TimestampType(), "timestamptz": T.TimestampType(),
    "time": T.LongType(), "text": T.StringType(),
}


def spark_type(t: PgType, wide_numeric: bool = False, native_arrays: bool = False) -> T.DataType:
    """The column type. ``time`` loads as microseconds of the day in UTC, a long."""
    if t.dimensions:
        if native_arrays and t.dimensions == 1:
            element = spark_type(PgType(t.declared, t.kind, 0, t.precision, t.scale, t.recognised), wide_numeric)
            if t.kind != "text" and not isinstance(element, T.StringType) or t.kind == "text" and t.recognised:
                return T.ArrayType(element, True)
        return T.StringType()
    if t.kind == "numeric":
        if is_representable_numeric(t):
            return T.DecimalType(t.precision, t.scale)
        return T.DecimalType(WIDE_PRECISION, WIDE_SCALE) if wide_numeric and is_wide_numeric(t) else T.StringType()
    return _SIMPLE[t.kind]
