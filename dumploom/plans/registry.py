"""Registered queries over the sample tables, and the same in SQL.

Most render a table as COPY text and decode it again; the SQL reads the table itself.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dumploom.errors import LoadError
from dumploom.functions.copytext import Limits, escape, render_row, text, unescape
from dumploom.functions.pgtypes import resolve
from dumploom.functions.values import parse
from dumploom.operators import anonymise
from dumploom.operators.catalog import external_table_sql
from dumploom.operators.decode import columns_only, decode
from dumploom.operators.reports import HISTORY, snapshot_versions
from dumploom.operators.store import Table
from dumploom.plans.anonymise_dump import anonymise_dump, audit_dumps
from dumploom.plans.dumps import PREAMBLE, copy_lines, write_dump
from dumploom.plans.load import load_dump
from dumploom.sources.files import file_system

#: How the sample tables are declared.
DECLARED = {
    "region": "r_regionkey integer, r_name text", "nation": "n_nationkey integer, n_name text, n_regionkey integer",
    "customer": "c_custkey bigint, c_name text, c_nationkey integer, c_acctbal double precision, c_mktsegment character varying(10)",
    "supplier": "s_suppkey bigint, s_name text, s_nationkey integer, s_acctbal double precision",
    "part": "p_partkey bigint, p_name text, p_brand text, p_type text, p_size integer, p_retailprice double precision",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus character(1), o_totalprice double precision, o_orderdate timestamp without time zone, o_orderpriority text",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double precision, l_extendedprice double precision, l_discount double precision, "
    "l_tax double precision, l_returnflag text, l_linestatus text, l_shipdate timestamp(6) without time zone",
    "events": "event_id bigint, ts timestamp without time zone, user_id bigint, event_type text, value double precision, props jsonb",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in DECLARED[table].split(", ")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decoded(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as COPY text and back; timestamps as the sample tables have them."""
    columns = columns_of(table)
    rows = columns_only(decode(copy_lines(_table(spark, sf_dir, table), columns), tuple(columns)), tuple(columns))
    zoneless = {c: F.col(c).cast("timestamp_ntz") for c, kind in rows.dtypes if kind == "timestamp"}
    return rows.withColumns(zoneless) if zoneless else rows


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(spark, sf_dir, "orders")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("latest"))


def _one(spark, sf_dir, table, key, field, declared, *, wide=False, arrays=False):
    """``key`` and one rendered field, decoded as ``declared``: value and whether it was replaced by null."""
    rows = _table(spark, sf_dir, table).select(F.col(key), text(escape(field), "v").alias("raw"))
    value, lost = parse(F.col("raw"), "v", resolve(declared), wide, arrays)
    return rows.select(key, value.alias("v"), lost.alias("lost"))


def escapes(table: str, key: str, column: str):
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, table).select(key, escape(F.concat(F.col(column), F.lit("\t\\N\r\x08\x0c\x0b"))).alias("f"))
        return rows.select(key, F.md5(F.encode(text(F.col("f"), column), "UTF-8")).alias("digest"))

    return run, f"SELECT {key}, md5({column} || chr(9) || chr(92) || 'N' || chr(13) || chr(8) || chr(12) || chr(11)) AS digest FROM {table}"


def octal_and_hex(spark, sf_dir):
    """Every byte of a name as an octal escape, every byte of another column as a hexadecimal one."""
    rows = _table(spark, sf_dir, "customer")
    octal = F.array_join(F.transform(F.split("c_name", ""), lambda c: F.concat(F.lit("\\"), F.lpad(F.conv(F.hex(F.encode(c, "UTF-8")), 16, 8), 3, "0"))), "")
    hexed = F.array_join(F.transform(F.split("c_mktsegment", ""), lambda c: F.concat(F.lit("\\x"), F.hex(F.encode(c, "UTF-8")))), "")
    return rows.select("c_custkey", text(octal, "a").alias("a"), unescape(hexed).cast("string").alias("b"))


def null_and_empty(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 3 == 0, None).when(F.col("c_custkey") % 3 == 1, "").otherwise(F.col("c_name"))
    got = _table(spark, sf_dir, "customer").select("c_custkey", text(escape(value), "v").alias("v"))
    return got.select("c_custkey", F.col("v").isNull().alias("is_null"), (F.col("v") == "").alias("is_empty"), "v")


def decimals(declared: str, wide: bool):
    def run(spark, sf_dir):
        price = F.concat(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("000"))
        return _one(spark, sf_dir, "orders", "o_orderkey", price, declared, wide=wide).select("o_orderkey", F.col("v").cast("decimal(38,2)").alias("price"))

    return run


def dates(spark, sf_dir):
    """Infinite, BC and rolled-over dates among plain ones."""
    k, plain = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = F.when(k % 7 == 0, "infinity").when(k % 7 == 1, "-infinity").when(k % 7 == 2, "0001-01-01 BC").when(k % 7 == 3, "2023-02-31").otherwise(plain)
    got = _one(spark, sf_dir, "orders", "o_orderkey", shown, "date")
    return got.select("o_orderkey", F.unix_date("v").cast("long").alias("days"), "lost")


def offsets(spark, sf_dir):
    zone = F.when(F.col("event_id") % 3 == 0, "+05:30").when(F.col("event_id") % 3 == 1, "-08").otherwise("+00")
    shift = F.when(F.col("event_id") % 3 == 0, 19800).when(F.col("event_id") % 3 == 1, -28800).otherwise(0)
    local = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + shift.cast("bigint") * 1_000_000).cast("string")
    got = _one(spark, sf_dir, "events", "event_id", F.concat(local, zone), "timestamp with time zone")
    return got.select("event_id", F.col("v").cast("timestamp_ntz").alias("ts"))


def times(spark, sf_dir):
    shown = F.when(F.col("event_id") % 5 == 0, "24:00:00").otherwise(F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(".25+02")))
    return _one(spark, sf_dir, "events", "event_id", shown, "time with time zone").select("event_id", F.col("v").alias("micros"))


def booleans(spark, sf_dir):
    shown = F.when(F.col("quality") == 1, "t").when(F.col("quality") == 0, "f")
    return _one(spark, sf_dir, "labels", "doc_id", shown, "boolean").select("doc_id", F.col("v").alias("good"))


def bytes_hex(spark, sf_dir):
    shown = F.concat(F.lit("\\x"), F.hex(F.encode("text", "UTF-8")))
    return _one(spark, sf_dir, "documents", "doc_id", shown, "bytea").select("doc_id", F.md5("v").alias("digest"))


def bytes_escape(spark, sf_dir):
    shown = F.concat(F.replace(F.col("event_type"), F.lit("e"), F.lit("\\145")), F.lit("\\\\"))
    return _one(spark, sf_dir, "events", "event_id", shown, "bytea").select("event_id", F.col("v").cast("string").alias("v"))


def arrays(native: bool):
    """All items of a vector, by number and place, and a null behind them."""

    def run(spark, sf_dir):
        shown = F.concat(F.lit("{"), F.array_join("embedding", ","), F.lit(",NULL}"))
        got = _one(spark, sf_dir, "embeddings", "vec_id", shown, "real[]", arrays=native)
        items = F.col("v") if native else F.expr("transform(split(substring(v, 2, length(v) - 2), ','), x -> cast(nullif(x, 'NULL') as float))")
        got = got.select("vec_id", items.alias("v"))
        scaled = "cast(round(cast(x as double) * 1000000) as bigint)"
        total, placed = (F.expr(f"aggregate(transform(filter(v, x -> x is not null), (x, i) -> {w} * {scaled}), 0L, (s, x) -> s + x)") for w in ("1", "(i + 1)"))
        return got.select("vec_id", F.size("v").cast("long").alias("n"), total.alias("total"), placed.alias("placed"), F.element_at("v", -1).isNull().alias("last_is_null"))

    return run


def substitutions(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(
        k.cast("string").alias("a"), F.when(k % 5 == 0, "NaN").otherwise("1.50").alias("b"), F.when(k % 4 == 0, "infinity").otherwise("2020-01-01").alias("c")
    )
    columns = (("a", "bigint"), ("b", "numeric(5,2)"), ("c", "timestamp without time zone"))
    got = decode(copy_lines(rows, list(columns)), columns)
    return got.rows.agg(F.count("*").alias("n_rows"), *[got.substituted[c].alias(f"lost_{c}") for c in ("b", "c")])


def _sums(declared: str, column: str) -> tuple[str, str]:
    """A whole number that depends on every value of a column, in Spark's SQL and in the oracle's."""
    if declared.startswith(("integer", "bigint")):
        return f"sum(bigint({column}))", f"sum({column})"
    if declared.startswith("double"):
        return f"sum(bigint(round({column} * 100)))", f"sum(CAST(round({column} * 100) AS BIGINT))"
    if declared.startswith("timestamp"):
        return f"sum(unix_seconds(timestamp({column})))", f"sum(CAST(floor(epoch({column})) AS BIGINT))"
    return f"sum(bigint(length({column})))", f"sum(length({column}))"


def sums_per_column(spark, sf_dir):
    """Rows, values and a sum of every column of every table, decoded."""
    out = None
    for t in DECLARED:
        columns = columns_of(t)
        got = decoded(spark, sf_dir, t).agg(F.count("*").alias("n_rows"), *[x for c, d in columns for x in (F.count(c).alias(f"n_{c}"), F.expr(_sums(d, c)[0]).alias(f"s_{c}"))])
        rows = F.explode(F.array(*[F.struct(F.lit(t).alias("name"), F.lit(c).alias("column"), F.col("n_rows"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("total")) for c, _ in columns]))
        got = got.select(rows.alias("r")).select("r.*")
        out = got if out is None else out.unionByName(got)
    return out


SUMS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS name, '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n, CAST({_sums(d, c)[1]} AS BIGINT) AS total FROM {t}" for t in DECLARED for c, d in columns_of(t)
)


def table_set(unexpected: bool):
    """What a load reports of the tables it was told to expect."""

    def run(spark, sf_dir):
        folder = _folder(spark)
        dump = _dump_of(spark, sf_dir, folder, ["nation", "region"])
        report = load_dump(spark, dump, folder, tables=["public.nation"], expect_tables=["public.nation", "public.zeta", "public.alpha"])
        names = report.unexpected_tables if unexpected else report.missing_tables
        return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, name string")

    return run


def schema_diff(spark, sf_dir):
    """The drift that a second load of a table with other columns reports."""
    folder, rows = _folder(spark), _table(spark, sf_dir, "nation")
    load_dump(spark, _dump_of(spark, sf_dir, folder, ["nation"]), folder)
    changed = rows.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_regionkey", F.lit("c").alias("n_comment"))
    columns = [("n_nationkey", "bigint"), ("n_regionkey", "integer"), ("n_comment", "text")]
    drift = load_dump(spark, write_dump(f"{folder}/changed.sql", [("public.nation", columns, changed)]), folder).tables[0].schema_drift
    told = [("added", c, None, None) for c in drift.added] + [("removed", c, None, None) for c in drift.removed] + [("retyped", *x) for x in drift.retyped]
    return spark.createDataFrame([*told, ("summary", drift.summary(), None, None)], "kind string, name string, was string, now string")


def _faults() -> list[tuple]:
    """(case, dump, options) of loads that fail."""
    head = PREAMBLE
    t = lambda columns, rows, name="public.t", end="\\.\n": f"CREATE TABLE {name} (\n    {columns}\n);\n\nCOPY {name} ({', '.join(c.split()[0] for c in columns.split(', '))}) FROM stdin;\n{rows}{end}"
    good = t("a integer", "1\n")
    return [
        ("array", head + t("a integer[]", "1,2\n"), {"native_arrays": True}), ("create", head + "CREATE TABLE x.y nothing);\n" + good, {}), ("end", head + t("a integer", "1\n", end=""), {}),
        ("escape", head + t("a text", "x\\\n"), {}), ("field", head + t("a text", "abcdefgh\n"), {"limits": Limits(max_field_bytes=4)}), ("fields", head + t("a integer", "1\t2\n"), {}),
        ("header", head + "CREATE TABLE public.t (\n    a integer\n);\n\nCOPY public.t () FROM stdin;\n1\n\\.\n", {}), ("hex", head + t("a text", "\\xg\n"), {}), ("history", head + t("a integer", "1\n", "_load_history"), {"write_history": True}),
        ("major", head + good, {"expect_pg_major": 16}), ("managed", head + good, {"output_uri": "/user/hive/warehouse/x"}), ("name", head + t("a integer", "1\n", 'public."a/b"'), {}),
        ("old", head.replace("pg_dump version 17", "pg_dump version 15") + good, {}), ("overflow", head + t("a smallint", "40000\n"), {}), ("row", head + t("a text", "abcdefgh\n"), {"limits": Limits(max_field_bytes=4, max_row_bytes=4)}),
        ("utf8", head + t("a text", "\\377\n"), {}), ("value", head + t("a timestamp without time zone", "soon\n"), {}), ("version", good, {}), ("wide", head + t("a integer", "1\t2\t3\n"), {"limits": Limits(max_columns=2)}),
        ("zstd", b"\x28\xb5\x2f\xfd\0\0", {}),
    ]


FAULTS_SQL = """SELECT * FROM (VALUES ('array', 'UnparsableValue', '{"column": "a", "expected": "array"}'), ('create', 'MalformedCreateTable', '{"table": "x.y"}'), ('end', 'UnterminatedCopy', '{"table": "public.t"}'),
('escape', 'TruncatedEscape', '{}'), ('field', 'FieldTooLarge', '{"len": 8, "limit": 4}'), ('fields', 'FieldCountMismatch', '{"expected": 1, "found": 2}'), ('header', 'MalformedCopyHeader', '{"offset": 114}'),
('hex', 'InvalidHexEscape', '{}'), ('history', 'UnsafeTableName', '{"name": "_load_history"}'), ('major', 'UnsupportedDumpVersion', '{"found": 17}'), ('managed', 'ManagedTableTarget', '{"marker": "/user/hive/warehouse", "uri": "/user/hive/warehouse/x"}'),
('name', 'UnsafeTableName', '{"name": "public.a/b"}'), ('old', 'UnsupportedDumpVersion', '{"found": 15}'), ('overflow', 'UnparsableValue', '{"column": "a", "expected": "smallint"}'), ('row', 'RowTooLarge', '{"len": 8, "limit": 4}'),
('utf8', 'NonUtf8Text', '{"column": "a"}'), ('value', 'UnparsableValue', '{"column": "a", "expected": "timestamp"}'), ('version', 'MissingDumpVersion', '{}'), ('wide', 'TooManyColumns', '{"count": 3, "limit": 2}'),
('zstd', 'UnsupportedCompression', '{"format": "zstd"}')) AS t(name, error, details)"""


def load_faults(spark, sf_dir):
    """What each faulty dump fails with; none leaves a table."""
    folder, told = _folder(spark), []
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    for name, dump, options in _faults():
        with store.open_output_stream(f"{path}/{name}.sql") as out:
            out.write(dump if isinstance(dump, bytes) else dump.encode())
        try:
            load_dump(spark, f"{folder}/{name}.sql", **({"output_uri": f"{folder}/{name}"} | options))
            told.append((name, "none", "{}"))
        except LoadError as error:
            left = Table(f"{folder}/{name}/public/t").snapshot() is not None
            told.append((name, type(error).__name__ + (" but a table" if left else ""), json.dumps(error.details, sort_keys=True)))
    return spark.createDataFrame(told, "name string, error string, details string")


def write_modes(spark, sf_dir):
    """What the modes allow once a table holds data."""
    folder, told = _folder(spark), []
    dump = _dump_of(spark, sf_dir, folder, ["region"])
    other = write_dump(f"{folder}/other.sql", [("public.region", [("r_regionkey", "bigint")], _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey")))])
    for step, (path, mode) in enumerate([(dump, "error"), (dump, "error"), (dump, "append"), (other, "append"), (other, "overwrite")]):
        try:
            done = load_dump(spark, path, folder, mode=mode).tables[0]
            told.append((step, mode, f"version {done.delta_version}", done.rows))
        except LoadError as error:
            told.append((step, mode, type(error).__name__, None))
    return spark.createDataFrame(told, "step int, mode string, outcome string, n_rows long")


def catalog_statements(spark, sf_dir):
    """Tables of two schemas, one schema left out; the statements that register the rest."""
    folder = _folder(spark)
    rows, columns = _table(spark, sf_dir, "region"), columns_of("region")
    dump = write_dump(f"{_made(folder)}/two.sql", [(n, columns, rows) for n in ("public.region", "audit.region", "public.place", '"Old Data".region')])
    report = load_dump(spark, dump, folder, excluded_schemas=["audit"])
    made = external_table_sql(report, "/out/", "main", "raw", tables=["public.region", "Old Data.region", "audit.region"])
    return spark.createDataFrame([(s,) for s in made], "statement string")


def anonymised_dump(spark, sf_dir):
    """A dump with every field replaced, loaded: rows, values and lengths stay, no token does."""
    folder = _folder(spark)
    columns = [("c_custkey", "bigint"), ("c_name", "text"), ("c_nationkey", "integer"), ("c_mktsegment", "text")]
    dump = write_dump(f"{_made(folder)}/real.sql.gz", [("public.customer", columns, _table(spark, sf_dir, "customer"))], True)
    done = anonymise_dump(spark, dump, f"{folder}/synthetic.sql", "secret")
    load_dump(spark, f"{folder}/synthetic.sql", folder)
    rows = Table(f"{folder}/public/customer").read(spark)
    sizes = [F.sum(F.length(F.col(c).cast("string"))).alias(f"size_{c}") for c, _ in columns]
    leaked = audit_dumps(spark, dump, f"{folder}/synthetic.sql").leaked
    return rows.agg(F.count("*").alias("n_rows"), *sizes, F.lit(done.rows_out).alias("rows_out"), F.lit(done.fields).alias("fields"), F.lit(leaked).alias("leaked"))


def first_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("table"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))
    return anonymise.first_rows(rows, 5)


def audit(spark, sf_dir):
    bench, docs = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    return anonymise.shared_tokens(bench, docs)


SHAPE = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def anonymised(spark, sf_dir):
    """What must hold of anonymised rows: lengths, field counts and kinds stay."""
    line = render_row(*[F.col(c).cast("string") for c in SHAPE])
    lines = _table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"), F.col("c_custkey").alias("row_index"))
    out = anonymise.anonymise_rows(lines, "secret", "public.customer")
    parts = F.split("line", "\t", -1)
    sizes = [F.length(parts[i]).cast("long").alias(f"size_{c}") for i, c in enumerate(SHAPE)]
    return out.select("c_custkey", F.size(parts).cast("long").alias("n"), *sizes, parts[2].rlike("^[0-9]+$").alias("number"))


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="dumploom-")
    return f"{base.rstrip('/')}/loads-{uuid.uuid4().hex}"


def _made(folder: str) -> str:
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    return folder


def _dump_of(spark, sf_dir, folder, names, compress=False):
    _made(folder)
    tables = [(f"public.{t}", columns_of(t), _table(spark, sf_dir, t)) for t in names]
    return write_dump(f"{folder}/dump-{uuid.uuid4().hex[:6]}.sql", tables, compress)


def load_and_read(spark, sf_dir):
    """Through a compressed dump file, the loader and the store."""
    folder = _folder(spark)
    load_dump(spark, _dump_of(spark, sf_dir, folder, ["nation", "supplier"], True), folder)
    return Table(f"{folder}/public/supplier").read(spark)


def load_large(spark, sf_dir):
    """A plain dump file of the largest table; over 16 MiB it is read in several ranges."""
    folder = _folder(spark)
    load_dump(spark, _dump_of(spark, sf_dir, folder, ["lineitem"]), folder)
    rows = Table(f"{folder}/public/lineitem").read(spark)
    return rows.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


def load_filtered(spark, sf_dir):
    folder = _folder(spark)
    dump = _dump_of(spark, sf_dir, folder, ["region", "nation"])
    report = load_dump(spark, dump, folder, tables=["public.nation", "public.gone"])
    told = [(t.table, t.rows) for t in report.tables] + [(f"missing {m}", 0) for m in report.missing_tables]
    return spark.createDataFrame(told, "name string, n_rows long")


def load_append(spark, sf_dir):
    folder = _folder(spark)
    dump = _dump_of(spark, sf_dir, folder, ["nation"])
    for mode in ("overwrite", "append"):
        load_dump(spark, dump, folder, mode=mode)
    return Table(f"{folder}/public/nation").read(spark)


def time_travel(spark, sf_dir):
    """Version 1 after an overwrite made version 2; 0 is the empty table."""
    folder = _folder(spark)
    load_dump(spark, _dump_of(spark, sf_dir, folder, ["nation"]), folder)
    tables = [("public.nation", columns_of("nation"), _table(spark, sf_dir, "nation").where("n_regionkey = 1"))]
    load_dump(spark, write_dump(f"{folder}/second.sql", tables), folder)
    table = Table(f"{folder}/public/nation")
    counts = [table.read(spark, v).agg(F.lit(v).alias("version"), F.count("*").alias("n_rows")) for v in (0, 1, 2)]
    return counts[0].union(counts[1]).union(counts[2])


def history(spark, sf_dir):
    folder = _folder(spark)
    dump = _dump_of(spark, sf_dir, folder, ["region", "nation"])
    report = load_dump(spark, dump, folder, expect_tables=["public.region", "public.gone"], write_history=True)
    return snapshot_versions(Table(f"{folder}/{HISTORY}").read(spark), report.load_id)


ARRAYS_SQL = """SELECT vec_id, CAST(len(embedding) + 1 AS BIGINT) AS n, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS total,
CAST(list_sum(list_transform(list_zip(embedding, range(1, len(embedding) + 1)), lambda z: z[2] * CAST(round(CAST(z[1] AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS placed, true AS last_is_null FROM embeddings"""
_SELECT = {f"copy_roundtrip_{t}": (lambda s, d, t=t: decoded(s, d, t), f"SELECT * FROM {t}") for t in DECLARED}
_ALL = _SELECT | {
    "flagship_orders": (flagship, "SELECT o_orderstatus, count(*) AS n_orders, sum(o_totalprice) AS total, max(o_orderdate) AS latest FROM orders GROUP BY 1"),
    "copy_escapes_documents": escapes("documents", "doc_id", "text"),
    "copy_escapes_pages": escapes("pages", "page_id", "html"),
    "escape_octal_hex": (octal_and_hex, "SELECT c_custkey, c_name AS a, c_mktsegment AS b FROM customer"),
    "null_vs_empty": (null_and_empty, "SELECT c_custkey, v IS NULL AS is_null, v = '' AS is_empty, v FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS v FROM customer)"),
    "decimal_strict_prices": (decimals("numeric(12,2)", False), "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,2)) AS price FROM orders"),
    "wide_numeric_decimal": (decimals("numeric", True), "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,2)) AS price FROM orders"),
    "date_bc_infinity_rollover": (dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1) THEN NULL WHEN o_orderkey % 7 = 2 THEN -719528 WHEN o_orderkey % 7 = 3 THEN date_diff('day', DATE '1970-01-01', DATE '2023-03-03') ELSE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS days, o_orderkey % 7 IN (0, 1) AS lost FROM orders"),
    "timestamptz_offsets_events": (offsets, "SELECT event_id, ts FROM events"),
    "time_of_day_micros": (times, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(((extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))) * 1000000 + 250000 - 7200000000 + 86400000000) AS BIGINT) % 86400000000 END AS micros FROM events"),
    "bool_copy_labels": (booleans, "SELECT doc_id, CASE quality WHEN 1 THEN true WHEN 0 THEN false END AS good FROM labels"),
    "bytea_hex_documents": (bytes_hex, "SELECT doc_id, md5(text) AS digest FROM documents"),
    "bytea_escape_events": (bytes_escape, "SELECT event_id, event_type || chr(92) AS v FROM events"),
    "array_native_embeddings": (arrays(True), ARRAYS_SQL),
    "array_text_literal": (arrays(False), ARRAYS_SQL),
    "null_substitutions": (substitutions, "SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 5 = 0) AS lost_b, count(*) FILTER (o_orderkey % 4 = 0) AS lost_c FROM orders"),
    "sums_per_column": (sums_per_column, SUMS_SQL),
    "missing_tables": (table_set(False), "SELECT * FROM (VALUES (0, 'public.alpha'), (1, 'public.zeta')) AS t(place, name)"),
    "unexpected_tables": (table_set(True), "SELECT 0 AS place, 'public.region' AS name"),
    "schema_diff": (schema_diff, "SELECT * FROM (VALUES ('added', 'n_comment', NULL, NULL), ('removed', 'n_name', NULL, NULL), ('retyped', 'n_nationkey', 'integer', 'long'), ('summary', 'added n_comment; removed n_name; n_nationkey changed from integer to long', NULL, NULL)) AS t(kind, name, was, now)"),
    "load_faults": (load_faults, FAULTS_SQL),
    "write_modes": (write_modes, "SELECT 0 AS step, 'error' AS mode, 'version 1' AS outcome, count(*) AS n_rows FROM region UNION ALL SELECT 1, 'error', 'TableExists', NULL UNION ALL SELECT 2, 'append', 'version 2', count(*) FROM region UNION ALL SELECT 3, 'append', 'SchemaChanged', NULL UNION ALL SELECT 4, 'overwrite', 'version 3', count(*) FROM region"),
    "catalog_statements": (catalog_statements, "SELECT 'CREATE TABLE IF NOT EXISTS `main`.`raw`.`' || n || '` USING DELTA LOCATION ''/out/' || p || chr(39) AS statement FROM (VALUES ('public_region', 'public/region'), ('Old Data_region', 'Old Data/region')) AS t(n, p)"),
    "anonymised_dump": (anonymised_dump, "SELECT count(*) AS n_rows, CAST(sum(length(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS size_c_custkey, CAST(sum(length(c_name)) AS BIGINT) AS size_c_name, CAST(sum(length(CAST(c_nationkey AS VARCHAR))) AS BIGINT) AS size_c_nationkey, CAST(sum(length(c_mktsegment)) AS BIGINT) AS size_c_mktsegment, CAST(count(*) AS INTEGER) AS rows_out, CAST(4 * count(*) AS INTEGER) AS fields, 0 AS leaked FROM customer"),
    "max_rows_per_block": (first_rows, 'SELECT "table", line_no FROM (SELECT l_returnflag AS "table", l_orderkey * 10 + l_linenumber AS line_no, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r <= 5'),
    "audit_shared_tokens": (audit, "SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_.@-]{8,}')) AS token FROM benchmark) WHERE regexp_matches(token, '[^0-9]') AND token IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_.@-]{8,}')) FROM documents)"),
    "load_and_read": (load_and_read, "SELECT * FROM supplier"),
    "load_large": (load_large, "SELECT * FROM lineitem"),
    "load_filtered": (load_filtered, "SELECT 'public.nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'missing public.gone', 0"),
    "load_append": (load_append, "SELECT * FROM nation UNION ALL SELECT * FROM nation"),
    "time_travel": (time_travel, "SELECT 0 AS version, 0::BIGINT AS n_rows UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, count(*) FROM nation WHERE n_regionkey = 1"),
    "history_snapshot": (history, "SELECT 'public.gone' AS \"table\", NULL::BIGINT AS delta_version, NULL::BIGINT AS rows, 'missing' AS status UNION ALL SELECT 'public.nation', 1, (SELECT count(*) FROM nation), 'loaded' UNION ALL SELECT 'public.region', 1, (SELECT count(*) FROM region), 'loaded'"),
    "anonymised_shape": (anonymised, "SELECT c_custkey, 4::BIGINT AS n, length(CAST(c_custkey AS VARCHAR))::BIGINT AS size_c_custkey, length(c_name)::BIGINT AS size_c_name, length(CAST(c_nationkey AS VARCHAR))::BIGINT AS size_c_nationkey, length(c_mktsegment)::BIGINT AS size_c_mktsegment, true AS number FROM customer"),
}


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
