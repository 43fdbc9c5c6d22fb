"""Contract checks as columns: identifiers, empty claims, violations, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-string grammars. Fixed values.
WINDOW_ID = r"\Aw\d{8}T\d{6}Z\z"
RECORD_ID = r"\A[0-9a-f]{64}\z"
PATH_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
VERSION = r"\A[a-z0-9_]+(?:@[a-z0-9._-]+)?(?:\+[a-z0-9_]+(?:@[a-z0-9._-]+)?)*\z"


def fullmatch(x: Column, pattern: str) -> Column:
    """Whether the whole text matches: a trailing newline does not."""
    return F.coalesce(x.rlike(pattern), F.lit(False)) & ~F.coalesce(x.contains(".."), F.lit(False))


def empty_claim(value: Column, items: Column) -> Column:
    """A slot that is there but says nothing: blank text or no items."""
    return F.coalesce(F.length(F.trim(value)) == 0, F.lit(False)) | F.coalesce(F.size(items) == 0, F.lit(False))


def violations(rules: dict[str, tuple[Column, str]]) -> Column:
    """The broken rules as an array of 'path: message', sorted by path; a null condition is broken."""
    parts = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{path}: {message}")) for path, (ok, message) in sorted(rules.items())]
    return F.array_compact(F.array(*parts))


def gate(rules: dict[str, Column]) -> Column:
    """(passed, reasons): the names of the checks that fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return F.struct((F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("reasons"))
