"""Dumps through the loader: structure, modes, drift, table sets, history."""

import gzip

import pytest

from dumploom import errors
from dumploom.operators.catalog import external_table_sql, register_views, snapshot_sql
from dumploom.operators.reports import HISTORY, snapshot_versions
from dumploom.operators.store import Table, relative_path
from dumploom.plans.load import load_dump
from dumploom.sources.ddl import TableName
from dumploom.sources.dump import index
from dumploom.sources.files import compression, is_remote, local_path

HEAD = "-- Dumped from database version 17.4\n-- Dumped by pg_dump version 17.4\n\n"


def block(name, columns, rows, end="\\.\n"):
    names = ", ".join(c.rsplit(" ", 1)[0] if '"' in c else c.split(" ", 1)[0] for c in columns)
    return f"CREATE TABLE {name} (\n    {', '.join(columns)}\n);\n\nCOPY {name} ({names}) FROM stdin;\n" + "".join(r + "\n" for r in rows) + end


TWO = HEAD + block("shop.tools", ["id integer", "name text"], ["1\thammer", "2\tsaw", "3\t\\N"]) + block("shop.moves", ["id bigint", "kind move_kind"], ["10\tsold", "11\tview"])


@pytest.fixture
def put(tmp_path):
    def write(dump, name="d.sql"):
        path = tmp_path / name
        path.write_bytes(dump if isinstance(dump, bytes) else dump.encode())
        return str(path)

    return write


def test_two_tables(spark, put, tmp_path):
    report = load_dump(spark, put(TWO), str(tmp_path / "out"))
    assert (report.dumped_by, report.from_database, report.compression, report.total_rows) == (17, 17, "none", 5)
    tools, moves = report.tables
    assert (tools.rows, tools.delta_version, tools.text_fallback_columns) == (3, 1, [])
    assert moves.text_fallback_columns == [("kind", "move_kind")]
    rows = Table(str(tmp_path / "out/shop/tools")).read(spark).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "hammer"), (2, "saw"), (3, None)]
    assert register_views(spark, report, str(tmp_path / "out")) == ["shop_tools", "shop_moves"]
    assert spark.sql("SELECT sum(id) FROM shop_moves").first()[0] == 21


def test_gzip_members(spark, put, tmp_path):
    half = len(TWO) // 2
    data = gzip.compress(TWO[:half].encode()) + gzip.compress(TWO[half:].encode())
    report = load_dump(spark, put(data, "odd.name"), str(tmp_path / "out"))
    assert (report.compression, report.total_rows, report.bytes_read) == ("gzip", 5, len(data))
    with pytest.raises(errors.UnsupportedCompression):
        load_dump(spark, put(b"\x28\xb5\x2f\xfd0000"), str(tmp_path / "out"))


@pytest.mark.parametrize(
    "dump,error",
    [
        (HEAD + block("public.t", ["id integer"], ["1"], end=""), errors.UnterminatedCopy), (HEAD + block("public.t", ["id integer"], ["1"], end="\\."), errors.UnterminatedCopy),
        (TWO.replace("pg_dump version 17.4", "pg_dump version 18.0"), errors.UnsupportedDumpVersion), (TWO.replace("-- Dumped by", "-- made by"), errors.MissingDumpVersion),
        (HEAD + block("public.t", ["a integer"], ["1\thammer\textra"]), errors.FieldCountMismatch), (HEAD + block("public.t", ["a integer"], ["secret"]), errors.UnparsableValue),
        (HEAD + "CREATE TABLE attic.notes not really a column list);\n", errors.MalformedCreateTable), (HEAD + block('public."a/b"', ["a integer"], ["1"]), errors.UnsafeTableName),
    ],
)
def test_faults_commit_nothing(spark, put, tmp_path, dump, error):
    good = block("public.good", ["id integer"], ["1"])
    with pytest.raises(error) as caught:
        load_dump(spark, put(dump.replace("\n\n", "\n\n" + good, 1)), str(tmp_path / "out"))
    assert "secret" not in str(caught.value) and "hammer" not in str(caught.value)
    assert Table(str(tmp_path / "out/public/good")).snapshot() is None


def test_modes_and_drift(spark, put, tmp_path):
    out = str(tmp_path / "out")
    one = put(HEAD + block("public.t", ["id integer", "name text"], ["1\ta"]), "1")
    two = put(HEAD + block("public.t", ["id text", "email text"], ["2\tb", "3\tc"]), "2")
    assert load_dump(spark, one, out).tables[0].schema_drift is None
    assert load_dump(spark, one, out, mode="append").tables[0].schema_drift.is_empty
    with pytest.raises(errors.SchemaChanged):
        load_dump(spark, two, out, mode="append")
    with pytest.raises(errors.TableExists):
        load_dump(spark, one, out, mode="error")
    change = load_dump(spark, two, out).tables[0].schema_drift
    assert (change.added, change.removed, change.retyped) == (("email",), ("name",), (("id", "integer", "string"),))
    assert change.summary() == "added email; removed name; id changed from integer to string"
    table = Table(f"{out}/public/t")
    assert [table.read(spark, v).count() for v in range(4)] == [0, 1, 2, 2]
    assert table.snapshot().schema.names == ["id", "email"] and table.read(spark, 1).columns == ["id", "name"]


def test_table_sets(spark, put, tmp_path):
    dump = put(TWO + block("attic.notes", ["id integer"], ["1"]))
    report = load_dump(spark, dump, str(tmp_path / "a"), tables=["shop.tools", "public.gone"])
    assert [t.table for t in report.tables] == ["shop.tools"] and report.missing_tables == ["public.gone"] and report.unexpected_tables == []
    report = load_dump(spark, dump, str(tmp_path / "b"), excluded_schemas=["attic"], expect_tables=["shop.tools", "x.y"])
    assert [t.table for t in report.tables] == ["shop.tools", "shop.moves"]
    assert report.missing_tables == ["x.y"] and report.unexpected_tables == ["attic.notes", "shop.moves"]
    assert load_dump(spark, dump, str(tmp_path / "c"), tables=[]).tables == []
    broken = put(HEAD + "CREATE TABLE attic.notes not really a column list);\n" + block("public.t", ["id integer"], ["1"]), "x")
    assert load_dump(spark, broken, str(tmp_path / "d"), excluded_schemas=["attic"]).total_rows == 1


def test_history_is_a_consistent_set(spark, put, tmp_path):
    out = str(tmp_path / "out")
    first = load_dump(spark, put(TWO, "1"), out, write_history=True, expect_tables=["shop.tools", "public.gone"])
    load_dump(spark, put(TWO.replace("2\tsaw\n", ""), "2"), out, write_history=True)
    past = Table(f"{out}/{HISTORY}").read(spark)
    assert past.count() == 5
    rows = snapshot_versions(past, first.load_id).collect()
    assert [(r.table, r.delta_version, r.status) for r in rows] == [("public.gone", None, "missing"), ("shop.moves", 1, "loaded"), ("shop.tools", 1, "loaded")]
    assert Table(f"{out}/shop/tools").read(spark, 1).count() == 3 and Table(f"{out}/shop/tools").read(spark).count() == 2
    assert first.load_id in snapshot_sql(out, first.load_id)
    with pytest.raises(ValueError):
        snapshot_sql(out, "1' OR '1")
    assert external_table_sql(first, out, "main", "raw")[0] == f"CREATE TABLE IF NOT EXISTS `main`.`raw`.`shop_tools` USING DELTA LOCATION '{out}/shop/tools'"
    with pytest.raises(ValueError):
        external_table_sql(first, out, "ma`in", "raw")


def test_many_tables_and_progress(spark, put, tmp_path):
    dump = put(HEAD + "".join(block(f"public.t{i}", ["id integer", "label text"], [f"{k}\tlabel-{i}-{k}" for k in range(3)]) for i in range(30)))
    seen = []
    report = load_dump(spark, dump, str(tmp_path / "out"), progress=seen.append)
    assert report.total_rows == 90 and len(seen) == 30 and seen[-1].rows == 90
    with pytest.raises(errors.Interrupted):
        load_dump(spark, dump, str(tmp_path / "stop"), progress=lambda p: False)
    assert Table(str(tmp_path / "stop/public/t0")).snapshot() is None


def test_ranges_cover_blocks(spark, put):
    rows = [f"{i}\t{'x' * (i % 50)}" for i in range(500)]
    path = put(HEAD + block("public.t", ["id integer", "b text"], rows))
    whole, cut = index(path), index(path, range_bytes=256)
    joined = b"".join(open(path, "rb").read()[a:b] for a, b in cut.blocks[0].ranges)
    assert joined.decode().splitlines() == rows and len(cut.blocks[0].ranges) > 20 and len(whole.blocks[0].ranges) == 1


def test_places():
    assert is_remote("abfss://c@h/x") and is_remote("https://h/x") and not is_remote("C:/x") and not is_remote("file:///x") and not is_remote("/x")
    assert local_path("file:///tmp/x%20y") == "/tmp/x y" and local_path("/tmp/x") == "/tmp/x"
    assert [compression(h) for h in (b"\x1f\x8b00", b"\x28\xb5\x2f\xfd", b"--")] == ["gzip", "zstd", "none"]
    assert relative_path(TableName("public", "Räksmörgås 1")) == "public/Räksmörgås 1"
    for name in ("", "a.b", " a", "x" * 256, "a/b", "é" * 128):
        with pytest.raises(errors.UnsafeTableName):
            relative_path(TableName("s", name))
    with pytest.raises(errors.ManagedTableTarget):
        load_dump(None, "x", "/USER/hive/warehouse/t")
