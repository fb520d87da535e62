"""Keys of strings and URLs: SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hex(text: Column) -> Column:
    """SHA-256 as 64 lower-case hex digits; its order is the byte order of the key. Null gives null."""
    return F.sha2(text, 256)


def key_binary(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
