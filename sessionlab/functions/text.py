"""Key and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_key(col: Column, width: int = 2) -> Column:
    """Zero-pad a key, never truncating longer ones."""
    s = col.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def clean(col: Column) -> Column:
    return F.lower(F.trim(col))


def contains_text(col: Column, needle: str) -> Column:
    return F.contains(F.lower(col), F.lit(needle.lower()))


def prefixed_id(prefix: str, col: Column, width: int = 2) -> Column:
    return F.concat(F.lit(prefix), pad_key(col, width))


def from_epoch_ms(col: Column) -> Column:
    return F.timestamp_millis(col.cast("long"))


def to_epoch_ms(col: Column) -> Column:
    return F.unix_millis(col)
