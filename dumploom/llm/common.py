"""Shared plumbing: Arrow maps, scratch tables in the cluster's shared folder, hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Arrow batches handed to Python stay near this size whatever the length of a text.
BATCH_BYTES = 6 << 20

_live: list[str] = []
_shipped: dict[str, str] = {}


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as by rows, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # an unset or textual value: leave the session as it is
        spark.conf.set(key, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once an application."""
    context = spark.sparkContext
    if _shipped.get("to") == context.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    code = Path(tempfile.mkdtemp(prefix="dumploom-code-")) / "dumploom_code.zip"
    with zipfile.ZipFile(code, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent).as_posix())
    context.addPyFile(str(code))
    _shipped["to"] = context.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose one machine is all there is, may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="dumploom-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _live.append(path)
    return path


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _live:
        _live.remove(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made and that nothing will read again."""
    for table in tables:
        drop_path(table.sparkSession, table._scratch)


def scratch_tables() -> list[str]:
    """The scratch tables that were made and not deleted."""
    return list(_live)


_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, free: Callable[[], None]) -> None:
    """Say, in a worker, how to free what ``module`` keeps from one task to the next."""
    _kept[module] = free


def _tidy(module: str) -> None:
    """Free what other modules keep in this worker, and give unused memory back to the system."""
    for other in [m for m in _kept if m != module]:
        _kept.pop(other)()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def named(column: str) -> F.Column:
    """The column of that very name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def carried(df: DataFrame, columns: list[str] | tuple[str, ...] | None = None) -> F.Column:
    """``columns`` (or all) of ``df`` in one struct ``_row``, where no name of theirs can clash."""
    return F.struct(*[named(c).alias(c) for c in (df.columns if columns is None else columns)]).alias("_row")


def unpacked(kind: StructType, column: str = "_row") -> list[F.Column]:
    """The columns that ``carried`` put away."""
    return [F.col(column)[f.name].alias(f.name) for f in kind.fields]


def with_cut_texts(rows: DataFrame, kind: StructType) -> DataFrame:
    """The columns of ``kind`` out of ``_row``; where ``cut``, text is ``cut_text``, and n_chars, if there, its length."""
    new = {"text": F.when(F.col("cut"), F.col("cut_text")).otherwise(F.col("_row")["text"].cast("string"))}
    if "n_chars" in kind.names:
        new["n_chars"] = F.when(F.col("cut"), F.length("cut_text")).otherwise(F.col("_row")["n_chars"])
    return rows.select(*[new.get(f.name, F.col("_row")[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def schema_of(rows: DataFrame, columns: list[str] | tuple[str, ...], more: str = "") -> StructType:
    """The fields ``columns`` of ``rows``, then those of the DDL ``more``."""
    extra = _parse_datatype_string(more).fields if more else []
    return StructType([StructField(c, rows.schema[c].dataType) for c in columns] + extra)


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of equally long columns; ``schema`` is Spark DDL or a type."""
    bound_batches(df.sparkSession)
    ship(df.sparkSession)
    fields = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)

    def run(batches):
        _tidy(rows.__module__)
        for out in rows(batches):
            yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)
        _tidy(rows.__module__)

    return df.mapInArrow(run, fields)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null gives no bytes."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_bytes(column) -> F.Column:
    """A text column's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


class RangeHash:
    """62-bit hashes of any byte range of a text, from prefix sums: polynomials modulo two primes, so no repeated pattern collides by itself."""

    #: Primes, and bases that generate long cycles.
    PRIMES = ((2147483647, 911382323), (2147483629, 972663749))

    def __init__(self, raw: np.ndarray):
        self.parts = []
        wide = raw.astype(np.int64) + 1
        for prime, base in self.PRIMES:
            up, down = _powers(prime, base, 1 << max(12, len(raw).bit_length()))
            terms = wide * up[: len(raw)]
            if len(raw) > 1 << 23:
                terms %= prime  # sums of more would not fit
            sums = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(terms, out=sums[1:])
            self.parts.append((prime, sums, down))

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (b - a).astype(np.uint64) << np.uint64(40)
        with np.errstate(over="ignore"):
            for prime, sums, down in self.parts:
                out = mix64(out + ((sums[b] - sums[a]) % prime * down[a] % prime).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return out


@lru_cache(4)
def _powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` to the powers 0 to ``n``, and to their negatives, modulo ``prime``; by doubling."""
    out = []
    for b in (base, pow(base, -1, prime)):
        table = np.ones(1, np.int64)
        while len(table) <= n:
            table = np.append(table, table * pow(b, len(table), prime) % prime)
        out.append(table)
    return out[0], out[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def remainder(column: str, divisor: int) -> F.Column:
    """crc32 of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()
