"""Column helpers that the text operators share. White space is [\\x20\\x09-\\x0D] throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def whole(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than white space; no element is empty."""
    body = F.trim(text, F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_CLASS + "+"))


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bytes of text that are worked on at once.
PORTION = 2 << 20


def portions(texts: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """(start, rows) of portions of a column of texts, each of so many bytes at most, or one text."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and held + (n or 0) > most:
            yield start, i - start
            start, held = i, 0
        held += n or 0
    if len(texts) > start:
        yield start, len(texts) - start
