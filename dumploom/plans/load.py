"""Load a dump: every table staged, then all committed.

Index on the driver; each wanted table is one narrow Spark job (read ranges, decode, write);
jobs of different tables run side by side. Nothing is visible until all tables are staged;
then each is committed, and the history gets a row a table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Observation, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from dumploom.errors import Interrupted, PartialCommitError, UnsafeTableName, from_spark
from dumploom.functions.copytext import Limits
from dumploom.functions.pgtypes import resolve, spark_type
from dumploom.operators.decode import columns_only, decode
from dumploom.operators.reports import HISTORY, HISTORY_SCHEMA, LoadReport, TableStats, history_rows
from dumploom.operators.store import MODES, Table, reject_managed, relative_path
from dumploom.sources.ddl import TableName
from dumploom.sources.dump import block_lines, index
from dumploom.sources.files import file_system, give_options, plain_copy


@dataclass(frozen=True)
class Progress:
    bytes_read: int
    rows: int
    tables_done: int
    table: str


def table_sets(seen: set[str], wanted: set[str] | None, expected: set[str] | None) -> tuple[list[str], list[str]]:
    """(missing, unexpected) tables in order. What ``expected`` names, else what ``wanted`` does, is missing if not seen; only what ``expected`` does not name is unexpected."""
    basis = expected if expected is not None else wanted or set()
    return sorted(basis - seen), [] if expected is None else sorted(seen - expected)


def _unspool(plain: str, dump: str, options) -> None:
    """Delete the plain copy of a compressed dump."""
    if plain != dump:
        store, path = file_system(plain, options)
        store.delete_file(path)


def load_dump(
    spark: SparkSession, dump: str, output_uri: str, *, tables: Iterable[str] | None = None, excluded_schemas: Iterable[str] = (), wide_numeric_as_decimal: bool = False,
    native_arrays: bool = False, mode: str = "overwrite", batch_rows: int = 100_000, batch_bytes: int = 128 << 20, threads: int = 8, commit_concurrency: int = 16, expect_pg_major: int | None = None,
    expect_tables: Iterable[str] | None = None, write_history: bool = False, limits: Limits = Limits(), progress: Callable[[Progress], bool | None] | None = None, history: str = HISTORY, storage_options: Mapping[str, str] | None = None,
) -> LoadReport:
    """Publish every wanted table of ``dump`` under ``output_uri``; see the module for how.

    ``progress`` is called between tables; if it returns False or raises, nothing was committed. Files hold at most ``batch_rows`` rows,
    in row groups of about ``batch_bytes``. ``storage_options`` serve the dump and the tables alike.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    reject_managed(output_uri)
    give_options(spark, storage_options)
    output_uri, load_id, now = output_uri.rstrip("/"), f"{time.time_ns() // 1000:020d}", datetime.now(timezone.utc)
    wanted, expected = None if tables is None else set(tables), None if expect_tables is None else set(expect_tables)
    plain, compression, size = plain_copy(dump, f"{spark.conf.get('spark.checkpoint.dir', None) or output_uri}/_spool", storage_options)
    found = index(plain, wanted=lambda n: wanted is None or n.qualified() in wanted, excluded_schemas=frozenset(excluded_schemas), expect_major=expect_pg_major, limits=limits, options=storage_options)

    merged: dict[TableName, list] = {}
    for block in found.blocks:
        if write_history and block.name == TableName(None, history):
            raise UnsafeTableName(name=block.name.qualified())
        merged.setdefault(block.name, []).append(block)
    targets = {name: Table(f"{output_uri}/{relative_path(name)}", storage_options) for name in merged}
    schemas = {name: StructType([StructField(c, spark_type(resolve(t), wide_numeric_as_decimal, native_arrays)) for c, t in blocks[0].columns]) for name, blocks in merged.items()}

    def opened(name):
        return targets[name].check(schemas[name], mode, name.qualified())

    def staged(name):
        adds, rows, lost, fallbacks = [], 0, {}, []
        spark.sparkContext.setJobGroup(load_id, f"load of {name.qualified()}", interruptOnCancel=True)
        for block in merged[name]:
            if not block.ranges:
                fallbacks = [(c, t) for c, t in block.columns if not resolve(t).recognised]
                continue
            got = decode(block_lines(spark, plain, block.ranges, options=storage_options), block.columns, wide_numeric=wide_numeric_as_decimal, native_arrays=native_arrays, limits=limits)
            seen = Observation()
            names = list(got.substituted)
            watched = got.rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[got.substituted[c].alias(f"n{i}") for i, c in enumerate(names)])
            adds += targets[name].stage(columns_only(type(got)(watched, {}, []), block.columns), load_id, batch_rows, batch_bytes)
            counts = seen.get
            rows += counts["rows"]
            for i, c in enumerate(names):
                lost[c] = lost.get(c, 0) + counts[f"n{i}"]
            fallbacks = got.fallbacks
        return adds, rows, {c: n for c, n in lost.items() if n}, fallbacks

    with ThreadPoolExecutor(max(1, commit_concurrency)) as pool:
        changes = dict(zip(merged, pool.map(opened, merged), strict=True))
    results, total = {}, 0
    with ThreadPoolExecutor(max(1, threads)) as pool:
        jobs = {name: pool.submit(staged, name) for name in merged}
        try:
            for name, job in jobs.items():
                results[name] = job.result()
                total += results[name][1]
                if progress is not None and progress(Progress(size, total, len(results), name.qualified())) is False:
                    raise Interrupted()
        except BaseException as error:
            for job in jobs.values():
                job.cancel()
            spark.sparkContext.cancelJobGroup(load_id)
            wait(jobs.values())
            for name in merged:
                targets[name].discard(load_id)
            _unspool(plain, dump, storage_options)
            ours = from_spark(error)
            if ours is not None:
                raise ours from None
            raise

    _unspool(plain, dump, storage_options)
    versions: dict[TableName, int] = {}
    failed: list[tuple[TableName, Exception]] = []
    with ThreadPoolExecutor(max(1, commit_concurrency)) as pool:
        commits = {name: pool.submit(targets[name].commit, results[name][0], schemas[name], mode) for name in merged}
        for name, job in commits.items():
            try:
                versions[name] = job.result()
            except Exception as error:
                failed.append((name, error))
    if failed:
        raise PartialCommitError(failed[0][0].qualified(), len(versions), len(merged), str(failed[0][1]))

    seen = {n.qualified() for n in found.seen}
    absent, surplus = table_sets(seen, wanted, expected)
    stats = [TableStats(n.qualified(), results[n][1], len(results[n][0]), versions[n], results[n][2], results[n][3], changes[n], n) for n in merged]
    report = LoadReport(
        found.dumped_by, found.from_database, compression, size, total, stats, absent, surplus, load_id
    )
    if write_history:
        table = Table(f"{output_uri}/{history}", storage_options)
        rows = spark.createDataFrame(history_rows(report, now), HISTORY_SCHEMA)
        nullable = StructType([StructField(f.name, f.dataType) for f in HISTORY_SCHEMA])
        table.check(nullable, "append", history)
        table.commit(table.stage(rows.coalesce(1), load_id), nullable, "append")
    return report
