"""Documents of any shape as VARIANT: canonical text, digests, and whether one holds another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(x: Column) -> Column:
    """The compact JSON of a JSON text: keys in order at every depth, no white space; a number by its value, so that 1.0, 1
    and 1e0 are one; null where the text is no JSON, or repeats a key."""
    return F.to_json(F.try_parse_json(x))


def fingerprint(*parts: Column) -> Column:
    """The digest of documents in order: SHA-256 of their canonical texts, NUL between them."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(canonical(p), F.lit("")) for p in parts]), 256)
