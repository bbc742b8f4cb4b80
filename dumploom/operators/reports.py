"""What a load tells: table sets, schema changes, history; as DataFrames where rows are many."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from dumploom.operators.store import Drift, relative_path
from dumploom.sources.ddl import TableName

HISTORY = "_load_history"
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("load_id", T.StringType(), False), T.StructField("loaded_at", T.TimestampType(), False), T.StructField("table", T.StringType(), False),
        T.StructField("status", T.StringType(), False), T.StructField("expected", T.BooleanType(), False), T.StructField("delta_version", T.LongType()),
        T.StructField("rows", T.LongType()), T.StructField("batches", T.LongType()), T.StructField("dumped_by", T.IntegerType(), False),
        T.StructField("from_database", T.IntegerType()), T.StructField("compression", T.StringType(), False), T.StructField("bytes_read", T.LongType(), False),
        T.StructField("total_rows", T.LongType(), False), T.StructField("schema_added", T.StringType(), False), T.StructField("schema_removed", T.StringType(), False),
        T.StructField("schema_retyped", T.StringType(), False), T.StructField("null_substitutions", T.StringType(), False), T.StructField("text_fallback_columns", T.StringType(), False),
    ]
)


@dataclass(frozen=True)
class TableStats:
    table: str
    rows: int
    batches: int
    delta_version: int
    null_substitutions: dict[str, int] = field(default_factory=dict)
    text_fallback_columns: list[tuple[str, str]] = field(default_factory=list)
    schema_drift: Drift | None = None
    name: TableName | None = None  # in its two parts

    @property
    def folder(self) -> str:
        """Below the load's output."""
        return relative_path(self.name)


@dataclass(frozen=True)
class LoadReport:
    dumped_by: int
    from_database: int | None
    compression: str
    bytes_read: int
    total_rows: int
    tables: list[TableStats]
    missing_tables: list[str]
    unexpected_tables: list[str]
    load_id: str


def history_rows(report: LoadReport, loaded_at) -> list[tuple]:
    """A row a table, loaded or missing; load-level facts on each."""
    rows = []
    for t in report.tables:
        d = t.schema_drift or Drift()
        rows.append(
            (report.load_id, loaded_at, t.table, "loaded", t.table not in report.unexpected_tables, t.delta_version, t.rows, t.batches, report.dumped_by, report.from_database,
             report.compression, report.bytes_read, report.total_rows, ", ".join(d.added), ", ".join(d.removed), ", ".join(f"{c}: {was} -> {now}" for c, was, now in d.retyped),
             ", ".join(f"{c}={n}" for c, n in t.null_substitutions.items()), ", ".join(f"{c}: {kind}" for c, kind in t.text_fallback_columns))
        )
    facts = (report.dumped_by, report.from_database, report.compression, report.bytes_read, report.total_rows)
    return rows + [(report.load_id, loaded_at, name, "missing", True, None, None, None, *facts, "", "", "", "", "") for name in report.missing_tables]


def snapshot_versions(history: DataFrame, load_id: str) -> DataFrame:
    """The versions that one load wrote: what a consistent read of its tables needs."""
    return history.where(F.col("load_id") == load_id).select("table", "delta_version", "rows", "status").orderBy("table")
