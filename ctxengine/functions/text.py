"""Text functions that mean in Spark what they mean for Unicode text elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalized(c: Column) -> Column:
    """Stripped, lower case, white space squeezed: what two copies have in common."""
    return squeeze(F.lower(strip(c)))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(normalized(c), 256), 1, 16)


def lines(c: Column) -> Column:
    """Lines without an empty one behind the last line's end."""
    return F.split(F.regexp_replace(c, r"\r?\n$", ""), r"\r?\n", -1)


def count_of(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), 0))


def has(c: Column, pattern: str) -> Column:
    """A search in which ^ and $ are the ends of lines, and a line ends at \\n only."""
    return c.rlike("(?md)" + pattern)


def first_of(cases: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in cases])


def let(value: Column, of) -> Column:
    """of(value), with value computed once however often the function uses it."""
    return F.transform(F.array(value), of)[0]
