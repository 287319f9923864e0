"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the OID namespace of RFC 4122.
OID = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = OID) -> Column:
    """The version-5 UUID of a name: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def memory_id(name: Column) -> Column:
    """The id of a memory node: its name in lower case, blanks as underscores, without apostrophes."""
    return uuid5(F.regexp_replace(F.regexp_replace(F.lower(name), " ", "_"), "'", ""))


def code_id(file: Column, kind: Column, name: Column, line: Column, column: Column) -> Column:
    """The id of a syntax node: 128 bits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws(":", file, kind, name, line.cast("string"), column.cast("string")), 256), 1, 32)
