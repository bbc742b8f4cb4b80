"""Shape-preserving anonymisation of COPY fields, and an audit of what two texts share.

A replacement depends on a secret key and on the field's place and length, never on its
content; its kind (boolean, date, timestamp, number) and each character's class stay, and
escapes stay as they are. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([+-][0-9]{2}(:?[0-9]{2})?)?\z"
NUMBER = r"^[+-]?[0-9]+([.][0-9]+)?\z"


def _draw(key: str, place: list[Column], n: Column | int, modulo: int) -> Column:
    """A number under ``modulo`` for the ``n``-th character of the field at ``place``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in place], (F.lit(n) if isinstance(n, int) else n).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % modulo


def _letter(pool: str, n: Column) -> Column:
    return F.substring(F.lit(pool), (n + 1).cast("int"), F.lit(1))


def anonymise_field(field: Column, key: str, place: list[Column]) -> Column:
    place = [*place, F.octet_length(field)]
    two = lambda n, modulo, base=0: F.lpad((_draw(key, place, n, modulo) + base).cast("string"), 2, "0")
    date = F.concat((_draw(key, place, 0, 60) + 1970).cast("string"), F.lit("-"), two(1, 12, 1), F.lit("-"), two(2, 28, 1))
    stamp = F.concat(date, F.lit(" "), two(6, 24), F.lit(":"), two(7, 60), F.lit(":"), two(8, 60))
    tokens = F.regexp_extract_all(field, F.lit(r"(?s)\\.|."), F.lit(0))

    def swap(token: Column, n: Column) -> Column:
        value = F.when(token.rlike(r"^[0-9]\z"), _draw(key, place, n, 10).cast("string"))
        value = value.when(token.rlike(r"^[a-z]\z"), _letter("abcdefghijklmnopqrstuvwxyz", _draw(key, place, n, 26)))
        value = value.when(token.rlike(r"^[A-Z]\z"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _draw(key, place, n, 26)))
        return value.otherwise(token)

    def digit(token: Column, n: Column) -> Column:
        first = (n == F.when(field.rlike("^[+-]"), 1).otherwise(0)) & field.rlike(r"^[+-]?[0-9]{2}")
        drawn = F.when(first, _draw(key, place, n, 9) + 1).otherwise(_draw(key, place, n, 10))
        return F.when(token.rlike(r"^[0-9]\z"), drawn.cast("string")).otherwise(token)

    out = F.when(field.isNull() | (field == "\\N"), field)
    out = out.when(field.isin("t", "f"), F.when(_draw(key, place, 0, 2) == 1, "t").otherwise("f"))
    out = out.when(field.rlike(DATE), date).when(field.rlike(STAMP), stamp)
    out = out.when(field.rlike(NUMBER), F.array_join(F.transform(tokens, digit), ""))
    return out.otherwise(F.array_join(F.transform(tokens, swap), ""))


def anonymise_rows(rows: DataFrame, key: str, table: str, line: str = "line", row_number: str = "row_index") -> DataFrame:
    """``rows`` (a raw COPY row and its number in the block) with every field replaced."""
    parts = F.split(F.col(line), "\t", -1)
    swapped = F.transform(parts, lambda f, i: anonymise_field(f, key, [F.lit(table), i, F.col(row_number)]))
    return rows.withColumn(line, F.array_join(swapped, "\t"))


def identifier(name: str, key: str) -> str:
    """A stable name of the same shape."""
    import hashlib

    noise = hashlib.blake2b(name.encode(), key=key.encode()[:64], digest_size=64).digest()
    pick = lambda i, pool: pool[noise[i % 64] % len(pool)]
    lower = "abcdefghijklmnopqrstuvwxyz"
    return "".join(
        str(noise[i % 64] % 10) if c.isdigit() else pick(i, lower if c.islower() else lower.upper()) if c.isalpha() and c.isascii() else c for i, c in enumerate(name)
    )


def first_rows(rows: DataFrame, n: int, by: str = "table", order: str = "line_no") -> DataFrame:
    """The first ``n`` rows of each block."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def shared_tokens(a: DataFrame, b: DataFrame, column: str = "text", least: int = 8) -> DataFrame:
    """Tokens of ``least`` characters or more, not digits alone, that both texts have: what anonymising left."""
    words = lambda d: d.select(F.explode(F.regexp_extract_all(column, F.lit(rf"[A-Za-z0-9_.@-]{{{least},}}"), F.lit(0))).alias("token")).where(F.col("token").rlike("[^0-9]"))
    return words(a).distinct().join(words(b).distinct(), "token", "left_semi")


def stats(rows: DataFrame, line: str = "line") -> DataFrame:
    return rows.groupBy("table").agg(F.count("*").alias("rows_in"), F.sum(F.size(F.split(line, "\t", -1))).alias("fields"))
