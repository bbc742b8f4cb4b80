"""Streams, options, logs with checkpoints, dumps without their data."""

import gzip
import io
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from dumploom import errors
from dumploom.operators.catalog import external_table_sql, register_external_tables
from dumploom.operators.store import Table
from dumploom.plans.anonymise_dump import anonymise_dump, audit_dumps
from dumploom.plans.load import load_dump
from dumploom.sources.dump import index
from dumploom.sources.files import Resumed, data_uri, file_system

DUMP = """-- Dumped from database version 16.2
-- Dumped by pg_dump version 16.2

CREATE TABLE garden."Red beds" (
    id integer NOT NULL,
    planted date,
    note text
);

CREATE TABLE garden.empty (
    id integer
);

COPY garden."Red beds" (id, planted, note) FROM stdin;
11	2021-05-06	tulips\\tand Narcissi 42
12	\\N	Österbotten peonies
13	2020-01-31	\\N
\\.

COPY garden.empty (id) FROM stdin;
\\.

ALTER TABLE garden."Red beds" OWNER TO keeper;
"""


class Dropping:
    """A stream that fails after ``good`` bytes."""

    def __init__(self, data, good):
        self.data, self.good = io.BytesIO(data), good

    def read(self, n):
        if self.good <= 0:
            raise OSError("connection lost")
        got = self.data.read(min(n, self.good))
        self.good -= len(got)
        return got


def test_resumed_reads():
    data, places = bytes(range(256)) * 40, []

    def open_at(place):
        places.append(place)
        return Dropping(data[place:], 3000)

    assert io.BufferedReader(Resumed(open_at, len(data))).read() == data and places == [0, 3000, 6000, 9000]
    with pytest.raises(errors.IoFailure):
        io.BufferedReader(Resumed(lambda place: Dropping(data[place:], 1000 if place < 5000 else 0), len(data))).read()
    with pytest.raises(errors.IoFailure) as caught:  # an end before the size that was told
        io.BufferedReader(Resumed(lambda place: io.BytesIO(data[place:]), len(data) + 1)).read()
    assert isinstance(caught.value, OSError) and not isinstance(caught.value, ValueError)


def test_storage_options():
    store, path = file_system("s3://box/a/b.sql", {"aws_access_key_id": "k", "aws_secret_access_key": "s", "aws_region": "eu-north-1", "aws_endpoint": "localhost:1"})
    assert (store.region, path) == ("eu-north-1", "box/a/b.sql") and file_system("s3a://box/a", {"aws_region": "x"})[1] == "box/a"
    assert data_uri("s3://box/a") == "s3a://box/a" and data_uri("/a") == "/a"
    with pytest.raises(errors.IoFailure):
        file_system("https://host/dump.sql")


def test_log_with_a_checkpoint(spark, tmp_path):
    dump, out = tmp_path / "d.sql", str(tmp_path / "out")
    dump.write_text(DUMP)
    for _ in range(3):
        load_dump(spark, str(dump), out, mode="append")
    log = tmp_path / "out/garden/Red beds/_delta_log"
    table = Table(f"{out}/garden/Red beds")
    before = table.snapshot(2)
    rows = [{"metaData": {"schemaString": before.schema.json()}, "add": None}] + [{"metaData": None, "add": {"path": p}} for p in before.files]
    pq.write_table(pa.Table.from_pylist(rows), log / f"{2:020d}.checkpoint.parquet")
    for n in (0, 1):
        os.unlink(log / f"{n:020d}.json")
    assert table.snapshot().files.keys() > before.files.keys() and table.snapshot(2).files.keys() == before.files.keys()
    assert [table.read(spark, v).count() for v in (2, 3)] == [6, 9]
    with pytest.raises(errors.TableFailure):
        table.snapshot(1)
    with pytest.raises(errors.TableFailure):
        table._put(3, [{}])
    assert not [f for f in os.listdir(log) if f.startswith(".") and "crc" not in f]
    assert json.loads((log / f"{3:020d}.json").read_text().splitlines()[0])["add"]["dataChange"]


def test_failed_load_leaves_no_files(spark, tmp_path):
    dump = tmp_path / "d.sql"
    dump.write_text(DUMP.replace("13\t2020-01-31", "13\tnever"))
    with pytest.raises(errors.UnparsableValue) as caught:
        load_dump(spark, str(dump), str(tmp_path / "out"))
    assert isinstance(caught.value, ValueError) and not list((tmp_path / "out").rglob("*.parquet"))


def test_batch_bytes_bound_row_groups(spark, tmp_path):
    dump = tmp_path / "d.sql"
    rows = "".join(f"{i}\t2020-01-01\t{'x' * 50}{i * 7919 % 100003}\n" for i in range(20_000))
    dump.write_text(DUMP.replace("11\t2021", rows + "11\t2021"))
    report = load_dump(spark, str(dump), str(tmp_path / "out"), batch_rows=15_000, batch_bytes=200_000)
    assert report.tables[0].rows == 20_003 and report.tables[0].batches == 2
    files = list((tmp_path / "out").rglob("part-*.parquet"))
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > 2


@pytest.mark.parametrize("rename", [False, True])
def test_anonymised_dump(spark, tmp_path, rename):
    source, target = tmp_path / "real", tmp_path / "synthetic.sql.gz"
    source.write_bytes(gzip.compress(DUMP.encode()))
    done = anonymise_dump(spark, str(source), str(target), "key", rename_identifiers=rename)
    assert (done.tables, done.rows_in, done.rows_out, done.fields) == (2, 3, 3, 9)
    old, new = DUMP.splitlines(), gzip.decompress(target.read_bytes()).decode().splitlines()
    assert len(old) == len(new)
    data = [k for k, line in enumerate(old) if line[:1].isdigit()]
    assert rename or all(a == b for k, (a, b) in enumerate(zip(old, new)) if k not in data)
    for k in data:
        a, b = old[k].split("\t"), new[k].split("\t")
        assert [len(x) for x in a] == [len(x) for x in b] and [x == "\\N" for x in a] == [x == "\\N" for x in b] and b[0].isdigit()
    assert "\\t" in new[data[0]] and "Ö" in new[data[1]] and "tulips" not in new[data[0]]
    if rename:
        text = "\n".join(new)
        assert "garden" not in text and "Red beds" not in text and text.count(index(str(target_plain(tmp_path, target))).headers[0].decode()) == 3
    else:
        assert load_dump(spark, str(target), str(tmp_path / "out")).total_rows == 3
    assert audit_dumps(spark, str(source), str(target)).passed
    same = audit_dumps(spark, str(source), str(source))
    assert not same.passed and same.first == sorted(same.first) and "2021-05-06" in same.first
    again = tmp_path / "again.sql"
    assert anonymise_dump(spark, str(source), str(again), "key", max_rows=1).rows_out == 1
    assert sum(line[:1].isdigit() for line in again.read_text().splitlines()) == 1


def target_plain(tmp_path, target):
    plain = tmp_path / "plain.sql"
    plain.write_bytes(gzip.decompress(target.read_bytes()))
    return plain


def test_registration(spark, tmp_path):
    dump, out, run = tmp_path / "d.sql", str(tmp_path / "out"), []
    dump.write_text(DUMP)
    report = load_dump(spark, str(dump), out)

    class Session:
        sql = run.append

    made = register_external_tables(Session, report, out, "main", "raw", tables=["garden.Red beds"])
    assert run == ["CREATE SCHEMA IF NOT EXISTS `main`.`raw`", *made] and made == external_table_sql(report, out, "main", "raw")[:1]
    assert made[0].endswith(f"`garden_Red beds` USING DELTA LOCATION '{out}/garden/Red beds'")
    with pytest.raises(ValueError):
        external_table_sql(report, out, "main", "r`aw")
