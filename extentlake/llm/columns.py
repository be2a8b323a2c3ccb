"""Column expressions on texts, from built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The runs of characters other than white space, in order; none for null."""
    pieces = F.split(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(WHITE)), _WHITE_RUN)
    return F.when(F.length(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(WHITE))) > 0, pieces).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return let(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(WHITE)), lambda t: F.when(F.length(t) > 0, F.size(F.split(t, _WHITE_RUN))).otherwise(0).cast("long"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sql_words(text: str) -> str:
    """DuckDB: the words of a text as a list."""
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"
