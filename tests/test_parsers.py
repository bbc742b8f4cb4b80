"""Value, field and definition parsers on their edge values."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumploom import errors
from dumploom.functions.copytext import Limits, escape, fields, text, unescape
from dumploom.functions.pgtypes import resolve, spark_type
from dumploom.functions.values import parse
from dumploom.sources.ddl import TableName, parse_copy_header, parse_create_table


def evaluate(spark, value, column):
    rows = spark.createDataFrame([(value,)], "v string").repartition(1)
    try:
        return rows.select(column(F.col("v")).alias("r")).first().r
    except Exception as error:
        found = errors.from_spark(error)
        if found is None:
            raise
        return found


def bad(found, expected):
    return isinstance(found, errors.UnparsableValue) and (found.column, found.expected) == ("c", expected)


@pytest.mark.parametrize(
    "declared,value,want",
    [
        ("smallint", "32767", 32767), ("smallint", "32768", "smallint"), ("integer", " -5 ", -5), ("integer", "5.0", "integer"), ("bigint", "+9", 9), ("integer", "", "integer"),
        ("double precision", "1.5", 1.5), ("double precision", "Infinity", float("inf")), ("real", "-Infinity", float("-inf")), ("double precision", "1d", "double precision"), ("double precision", "", "double precision"),
        ("boolean", "t", True), ("boolean", "F", False), ("boolean", "1", "boolean"), ("boolean", "yes", "boolean"),
        ("numeric(10,2)", "1.2300", Decimal("1.23")), ("numeric(10,2)", "1.239", "numeric"), ("numeric(10,2)", "1e5", "numeric"), ("numeric(10,2)", ".", "numeric"), ("numeric(5,2)", "1000.00", "numeric"), ("numeric(10,2)", "NaN", None),
        ("numeric(10,2)", "Infinity", "numeric"), ("numeric(2,5)", "1.5", "1.5"),
        ("date", "2023-02-31", dt.date(2023, 3, 3)), ("date", "infinity", None), ("date", "2023-13-01", "date"), ("date", "x", "date"),
        ("time", "24:00:00", 0), ("time", "12:30", 45_000_000_000), ("timetz", "01:00:00+02", 82_800_000_000), ("time", "12", "time"), ("time", "25:00:00", "time"),
        ("timestamp", "1970-01-01 00:00:01.5", 1_500_000), ("timestamptz", "1970-01-01 05:30:00+05:30", 0), ("timestamp", "1970-01-02", 86_400_000_000), ("timestamp", "-infinity", None), ("timestamp", "1970-01-01 24:00:00", 86_400_000_000),
        ("timestamp", "junk", "timestamp"), ("timestamp", "900000-01-01 00:00:00", "timestamp"),
        ("bytea", "\\x4869", b"Hi"), ("bytea", "\\x", b""), ("bytea", "\\x4", "bytea"), ("bytea", "\\xzz", "bytea"), ("bytea", "abc\\000def", b"abc\x00def"), ("bytea", "a\\\\b", b"a\\b"), ("bytea", "\\99", "bytea"), ("bytea", "\\400", "bytea"),
        ("integer[]", "{1,2,NULL}", [1, 2, None]), ("integer[]", "{}", []), ("text[]", '{a,"b,c","NULL",NULL,"d\\"e"}', ["a", "b,c", "NULL", None, 'd"e']), ("integer[]", "1,2", "array"), ("integer[]", "{1}x", "array"), ("integer[][]", "{{1}}", "{{1}}"),
        ("move_kind", "sold", "sold"),
    ],
)
def test_values(spark, declared, value, want):
    t = resolve(declared)
    stamp = t.kind in ("timestamp", "timestamptz") and not t.dimensions

    def column(v):
        parsed = parse(v, "c", t, arrays=True)[0]
        return F.unix_micros(parsed) if stamp else parsed

    got = evaluate(spark, value, column)
    got = bytes(got) if isinstance(got, bytearray) else got
    failing = isinstance(want, str) and spark_type(t, native_arrays=True) != T.StringType()
    assert bad(got, want) if failing else got == want
    assert value not in str(got) if failing and len(value) > 1 else True
    assert evaluate(spark, None, column) is None


@pytest.mark.parametrize(
    "value,want",
    [
        ("plain", b"plain"), ("\\101", b"A"), ("\\1011", b"A1"), ("\\x41", b"A"), ("\\x4", b"\x04"), ("\\q", b"q"), ("\\xc3\\xa9", "é".encode()), ("a\\tb\\nc\\\\", b"a\tb\nc\\"), ("\\b\\f\\r\\v", b"\b\f\r\v"), ("", b""),
        ("\\N", b"N"), ("\\377", b"\xff"), ("\\777", b"\xff"), ("end\\", errors.TruncatedEscape), ("\\xg", errors.InvalidHexEscape),
    ],
)
def test_unescape(spark, value, want):
    got = evaluate(spark, value, unescape)
    assert isinstance(got, want) if isinstance(want, type) else bytes(got) == want


def test_text_null_and_utf8(spark):
    assert evaluate(spark, "\\N", lambda v: text(v, "c")) is None
    assert evaluate(spark, "", lambda v: text(v, "c")) == ""
    assert isinstance(evaluate(spark, "\\377", lambda v: text(v, "c")), errors.NonUtf8Text)


def test_fields(spark):
    small = Limits(max_field_bytes=5, max_row_bytes=12, max_columns=3)
    read = lambda n: lambda v: fields(v, n, small)
    assert evaluate(spark, "a\t\tb\r", read(3)) == ["a", "", "b"]
    assert evaluate(spark, "", read(1)) == [""]
    assert evaluate(spark, "1\tplank\tx", read(2)).details == {"found": 3, "expected": 2}
    assert isinstance(evaluate(spark, "abcdef", read(1)), errors.FieldTooLarge)
    assert isinstance(evaluate(spark, "abcdefghijklm", read(1)), errors.RowTooLarge)
    assert isinstance(evaluate(spark, "a\tb\tc\td", read(4)), errors.TooManyColumns)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"))), min_size=1, max_size=20))
def test_escape_round_trip(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
    got = {r.i: r.v for r in rows.select("i", text(escape(F.col("v")), "c").alias("v")).collect()}
    assert [got[i] for i in range(len(values))] == values


@pytest.mark.parametrize(
    "declared,kind",
    [
        ("serial8", T.LongType()), ("character varying(10)", T.StringType()), ("timestamp(3) without time zone", T.TimestampType()), ("numeric", T.StringType()), ("numeric(40,5)", T.StringType()),
        ("numeric(38)", T.DecimalType(38, 0)), ("numeric(5,-2)", T.StringType()), ("DOUBLE   PRECISION", T.DoubleType()), ("integer[3]", T.StringType()), ("public.my_enum", T.StringType()), ("numeric(300,2)", T.StringType()),
    ],
)
def test_types(declared, kind):
    assert spark_type(resolve(declared)) == kind


def test_type_flags():
    wide = lambda d: spark_type(resolve(d), wide_numeric=True)
    assert wide("numeric") == wide("numeric(40,5)") == wide("numeric(300,2)") == T.DecimalType(38, 18)
    assert wide("numeric(5,-2)") == T.StringType()
    arrays = lambda d: spark_type(resolve(d), native_arrays=True)
    assert arrays("integer[]") == T.ArrayType(T.IntegerType()) and arrays("integer[][]") == arrays("public.e[]") == T.StringType()
    assert not resolve("public.my_enum").recognised and resolve("jsonb").recognised


def test_definitions():
    ddl = """CREATE UNLOGGED TABLE public."Räks""x" (
    id integer DEFAULT nextval('a(,'::regclass) NOT NULL,
    "belopp, öre" numeric(10,2)[] COLLATE "C",
    kind character varying(3) CHECK ((a > 1)),
    CONSTRAINT pk PRIMARY KEY (id),
    "primary" text
)
WITH (fillfactor='70');"""
    table = parse_create_table(ddl)
    assert table.name == TableName("public", 'Räks"x')
    assert table.columns == (("id", "integer"), ("belopp, öre", "numeric(10,2)[]"), ("kind", "character varying(3)"), ("primary", "text"))
    assert parse_copy_header('COPY a."b.c" (x, "y z") FROM stdin;') == (TableName("a", "b.c"), ("x", "y z"))
    assert parse_copy_header("COPY t FROM stdin;") == (TableName(None, "t"), ())
    assert parse_copy_header("SELECT 1;") is None
    with pytest.raises(errors.MalformedCreateTable):
        parse_create_table("CREATE TABLE attic.notes not really a column list);")
