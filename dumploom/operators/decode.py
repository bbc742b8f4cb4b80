"""Rows of a COPY block as a typed DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dumploom.functions.copytext import Limits, checked, split_row, text, whole_row
from dumploom.functions.pgtypes import resolve, spark_type
from dumploom.functions.values import parse


@dataclass(frozen=True)
class Decoded:
    """``rows`` typed; ``substituted`` counts by column, for an observation; columns whose type is unknown."""

    rows: DataFrame
    substituted: dict[str, Column]
    fallbacks: list[tuple[str, str]]


def decode(lines: DataFrame, columns: tuple[tuple[str, str], ...], *, wide_numeric: bool = False, native_arrays: bool = False, limits: Limits = Limits()) -> Decoded:
    """``lines`` (value: a raw row) by declared ``columns``; narrow, built-in expressions only."""
    types = [resolve(declared) for _, declared in columns]
    as_text = [spark_type(t, wide_numeric, native_arrays).typeName() in ("string", "array") for t in types]
    must = [(i, name) for i, (name, _) in enumerate(columns) if as_text[i]]
    raw = lines.select(whole_row(F.col("value")).alias("_r")).select("_r", split_row(F.col("_r")).alias("_p"))
    parts = [F.col("_p")[i] for i in range(len(columns))]
    if parts:
        parts[0] = checked(F.col("_r"), F.col("_p"), parts[0], len(columns), limits, must)
    texts = raw.select(*[text(part, name, as_text[i]).alias(f"_t{i}") for i, (part, (name, _)) in enumerate(zip(parts, columns, strict=True))])
    out, flags = [], {}
    for i, ((name, _), t) in enumerate(zip(columns, types, strict=True)):
        value, lost = parse(F.col(f"_t{i}"), name, t, wide_numeric, native_arrays)
        out.append(value.cast(spark_type(t, wide_numeric, native_arrays)).alias(f"_v{i}"))
        if t.kind in ("numeric", "date", "timestamp", "timestamptz") and spark_type(t, wide_numeric, native_arrays).typeName() != "string":
            out.append(lost.alias(f"_s{i}"))
            flags[name] = f"_s{i}"
    parsed = texts.select(*out)
    counts = {name: F.count_if(F.col(flag)) for name, flag in flags.items()}
    names = [F.col(f"_v{i}").alias(name) for i, (name, _) in enumerate(columns)]
    fallbacks = [(name, declared) for (name, declared), t in zip(columns, types, strict=True) if not t.recognised]
    return Decoded(parsed.select(*names, *flags.values()) if flags else parsed.select(*names), counts, fallbacks)


def columns_only(decoded: Decoded, columns: tuple[tuple[str, str], ...]) -> DataFrame:
    return decoded.rows.select(*[F.col(f"`{name}`") for name, _ in columns])
