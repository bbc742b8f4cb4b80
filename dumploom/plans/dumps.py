"""Write DataFrames as a plain-text dump: for tests, benches and round trips."""

from __future__ import annotations

import gzip
import shutil
from collections.abc import Mapping

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from dumploom.functions.copytext import render_row
from dumploom.sources.files import data_uri, file_system

PREAMBLE = "-- Dumped from database version 17.4\n-- Dumped by pg_dump version 17.4\n\n"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def copy_lines(rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """``rows`` as COPY text, one line a row, in ``value``."""
    plain = [t.startswith(PLAIN) and not t.endswith("]") for _, t in columns]
    return rows.select(render_row(*[_rendered(F.col(f"`{c}`"), t) for c, t in columns], plain=plain).alias("value"))


#: Declarations whose rendered values never need an escape.
PLAIN = ("smallint", "integer", "bigint", "real", "double precision", "numeric", "boolean", "date", "timestamp", "time")


def _rendered(value, declared: str):
    if declared == "boolean":
        return F.when(value, "t").when(~value, "f")
    if declared == "bytea":
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if declared.endswith("[]"):
        return F.concat(F.lit("{"), F.array_join(F.transform(value, lambda x: x.cast("string")), ",", "NULL"), F.lit("}"))
    return value.cast("string")


def append_lines(lines: DataFrame, out, folder: str, storage_options: Mapping[str, str] | None = None) -> None:
    """Put ``lines`` (one string column) at the end of the stream ``out``: written by tasks to ``folder``, then copied as bytes in their order."""
    lines.write.option("lineSep", "\n").text(data_uri(folder))
    store, path = file_system(folder, storage_options)
    for f in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda f: f.base_name):
        if f.base_name.startswith("part-"):
            with store.open_input_file(f.path) as part:
                shutil.copyfileobj(part, out, 8 << 20)
    store.delete_dir(path)


def write_dump(path: str, tables: list[tuple[str, list[tuple[str, str]], DataFrame]], compress: bool = False) -> str:
    """A dump of (qualified name, columns, rows)."""
    store, where = file_system(path)
    with store.open_output_stream(where, compression=None) as raw:
        out = gzip.GzipFile(fileobj=raw, mode="wb") if compress else raw
        out.write(PREAMBLE.encode())
        for name, columns, _ in tables:
            body = ",\n".join(f"    {quoted(c)} {t}" for c, t in columns)
            out.write(f"CREATE TABLE {name} (\n{body}\n);\n\n".encode())
        for name, columns, rows in tables:
            out.write(f"COPY {name} ({', '.join(quoted(c) for c, _ in columns)}) FROM stdin;\n".encode())
            append_lines(copy_lines(rows, columns), out, f"{path}-lines")
            out.write(b"\\.\n\n")
        if compress:
            out.close()
    return path
