"""A dump without its data: every field replaced, everything else as it was.

The text between the rows of COPY blocks is copied byte by byte; rows pass through the field
anonymiser as DataFrames, a task a byte range, and are put back in their order.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from dumploom.operators.anonymise import anonymise_rows, identifier, shared_tokens
from dumploom.plans.dumps import append_lines
from dumploom.sources.dump import DumpIndex, block_lines, index
from dumploom.sources.files import file_system, plain_copy

@dataclass(frozen=True)
class Summary:
    tables: int
    rows_in: int
    rows_out: int
    fields: int


@dataclass(frozen=True)
class Audit:
    """``passed`` if no token of a data field survived; ``first`` are five of those that did, in order."""

    leaked: int
    first: list[str]

    @property
    def passed(self) -> bool:
        return self.leaked == 0


def _spool(spark: SparkSession, near: str) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir', None) or near.rsplit('/', 1)[0]}/_spool"


def _numbered(spark: SparkSession, found: DumpIndex, ranges: list[tuple[int, int]], options) -> DataFrame:
    """``line`` and ``row_index`` (from 1 in the block): the numbers of rows in a range after those of the ranges before it."""
    rows = block_lines(spark, found.uri, ranges, numbered=True, options=options)
    if len(ranges) == 1:
        return rows.select(F.col("value").alias("line"), F.col("n").alias("row_index"))
    before, starts = 0, []
    for first, n in sorted((r["first"], r["n"]) for r in rows.groupBy("first").agg(F.max("n").alias("n")).collect()):  # a row a range
        starts.append((first, before))
        before += n
    known = F.broadcast(spark.createDataFrame(starts, "first long, before long"))  # two numbers for each 16 MB
    return rows.join(known, "first").select(F.col("value").alias("line"), (F.col("before") + F.col("n")).alias("row_index"))


def _renamed(text: bytes, names: Mapping[bytes, bytes]) -> bytes:
    for old, new in names.items():
        text = re.sub(rb"(?<![\w\"])" + re.escape(old) + rb"(?![\w\"])", new.replace(b"\\", rb"\\"), text)
    return text


def anonymise_dump(spark: SparkSession, source: str, target: str, key: str, *, max_rows: int | None = None, rename_identifiers: bool = False, storage_options: Mapping[str, str] | None = None) -> Summary:
    """Write ``source`` (plain or gzip) to ``target`` (gzip if it ends in .gz) with every field replaced; of each block the first ``max_rows`` rows."""
    spool = _spool(spark, target)
    plain, _, _ = plain_copy(source, spool, storage_options)
    found = index(plain, options=storage_options)
    store, path = file_system(plain, storage_options)
    out_store, out_path = file_system(target, storage_options)
    rows_in = rows_out = n_fields = 0
    with store.open_input_file(path) as text, out_store.open_output_stream(out_path, compression=None) as raw:
        out = gzip.GzipFile(fileobj=raw, mode="wb") if target.endswith(".gz") else raw
        names: dict[bytes, bytes] = {}
        if rename_identifiers:
            for table in found.headers:
                names[table] = b".".join(identifier(part.decode(), key).encode() for part in table.split(b"."))
        at = 0

        def copy_to(end: int) -> None:
            nonlocal at
            text.seek(at)
            while at < end:
                piece = text.read(min(8 << 20, end - at)) if not names else text.read(end - at)  # what is renamed is the little text between rows
                at += len(piece)
                out.write(_renamed(piece, names) if names else piece)

        for block in found.blocks:
            if not block.ranges:
                continue
            copy_to(block.ranges[0][0])
            rows = _numbered(spark, found, block.ranges, storage_options)
            rows = rows.withColumn("line", F.when(F.endswith("line", F.lit("\r")), F.left("line", F.length("line") - 1)).otherwise(F.col("line")))
            total = rows.count()
            kept = rows if max_rows is None else rows.where(F.col("row_index") <= max_rows)
            done = anonymise_rows(kept, key, block.name.qualified())
            append_lines(done.select("line"), out, f"{spool}/anonymised-{uuid.uuid4().hex}", storage_options)
            rows_in, here = rows_in + total, total if max_rows is None else min(total, max_rows)
            rows_out, n_fields = rows_out + here, n_fields + here * len(block.columns)
            at = block.ranges[-1][1]
        copy_to(text.size())
        if out is not raw:
            out.close()
    if plain != source:
        store.delete_file(path)
    return Summary(len(found.blocks), rows_in, rows_out, n_fields)


def data_lines(spark: SparkSession, dump: str, storage_options: Mapping[str, str] | None = None) -> DataFrame:
    """All rows of all blocks of a dump, undecoded, in ``text``."""
    plain, _, _ = plain_copy(dump, _spool(spark, dump), storage_options)
    ranges = [r for b in index(plain, options=storage_options).blocks for r in b.ranges]
    if not ranges:
        return spark.createDataFrame([], "text string")
    return block_lines(spark, plain, ranges, options=storage_options).withColumnRenamed("value", "text")


def audit_dumps(spark: SparkSession, source: str, target: str, least: int = 8, storage_options: Mapping[str, str] | None = None) -> Audit:
    """Whether a token of ``least`` characters or more of one dump's data is in the other's."""
    leaked = shared_tokens(data_lines(spark, source, storage_options), data_lines(spark, target, storage_options), "text", least)
    return Audit(leaked.count(), [r.token for r in leaked.orderBy("token").limit(5).collect()])
