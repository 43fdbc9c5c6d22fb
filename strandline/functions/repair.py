"""Repair of model replies that should be JSON, as Arrow-batched functions: strict, fenced, balanced, mended, salvaged."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Other names of the wanted keys. Fixed values.
ALIASES = {
    "app": ("app", "application", "program"),
    "activity": ("activity", "action", "task"),
    "description": ("description", "summary", "caption"),
    "sensitive": ("sensitive", "private"),
}
_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})
_DEEPEST = 200


def balanced(text: str) -> str | None:
    """The first {...} whose braces balance outside strings; None if none closes or it nests too deep."""
    start = text.find("{")
    depth, inside, escaped = 0, False, False
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[i]
        if escaped:
            escaped = False
        elif inside:
            escaped = c == "\\"
            inside = c != '"'
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
            if depth > _DEEPEST:
                return None
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def mended(text: str) -> str:
    """Straight quotes, no raw controls inside strings, no commas before a closing bracket."""
    text = re.sub(r"[\x00-\x1f]+", " ", text.translate(_QUOTES))
    return re.sub(r",\s*([}\]])", r"\1", text)


def _loads(text: str | None):
    try:
        got = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _salvaged(text: str) -> dict | None:
    pairs = re.findall(r'"(\w+)"\s*:\s*("(?:[^"\\]|\\.)*"?|true|false)', text)
    found = {}
    for k, v in pairs:
        found[k] = v == "true" if v in ("true", "false") else v.strip('"').replace('\\"', '"')
    return found or None


def _picked(got: dict, want: str):
    lower = {str(k).lower(): v for k, v in got.items()}
    return next((lower[k] for k in ALIASES[want] if lower.get(k) not in (None, "")), None)


def repaired(reply: str | None) -> dict:
    """step (how it was read) and the wanted fields; step ``empty`` for nothing, ``text`` if only text could be kept."""
    text = (reply or "").strip()
    out = {"step": "empty", "app": None, "activity": None, "description": None, "sensitive": None}
    if not text:
        return out
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    ladder = (
        ("strict", lambda: _loads(text)),
        ("fenced", lambda: _loads(fence[1].strip()) if fence else None),
        ("balanced", lambda: _loads(balanced(text))),
        ("mended", lambda: _loads(balanced(mended(text))) or _loads(mended(text))),
        ("salvaged", lambda: _salvaged(mended(text))),
    )
    for step, read in ladder:
        if got := read():
            flag = _picked(got, "sensitive")
            words = {k: " ".join(str(v).split()) if (v := _picked(got, k)) is not None else None for k in ("app", "activity", "description")}
            return {"step": step, **words, "sensitive": flag if isinstance(flag, bool) else str(flag).lower() == "true" if flag is not None else None}
    return out | {"step": "text", "description": " ".join(text.split())}


_REPLY = T.StructType([*(T.StructField(n, T.StringType()) for n in ("step", "app", "activity", "description")), T.StructField("sensitive", T.BooleanType())])


def repair_reply(reply: Column) -> Column:
    """The repair ladder over a column of replies, in Arrow batches."""

    def run(replies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repaired(x) for x in replies], columns=_REPLY.names)

    run.__annotations__ = {}
    return F.pandas_udf(run, _REPLY, F.PandasUDFType.SCALAR)(reply)
