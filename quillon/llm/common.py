"""What the operators share: tables in the shared folder, and text column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources.shared import drop_path, fresh_path, stored

__all__ = ["drop_path", "fresh_path", "ship", "stored"]

#: The ASCII white space that separates words: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\f\r"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def body(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def hash32(col: Column) -> Column:
    """The first 32 bits of a value's MD5 as a long; the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
