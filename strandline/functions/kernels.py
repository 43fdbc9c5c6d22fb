"""Binary and markup kernels that have no column form, in Arrow batches."""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a change map, a square of 32.
CELLS = 1024
#: File endings by media type. Fixed values.
ENDINGS = {"audio/wav": "wav", "audio/webm": "webm", "video/mp4": "mp4", "video/webm": "webm", "image/jpeg": "jpg", "image/png": "png", "text/plain": "txt"}

_CODE = re.compile(r"`([^`]+)`")
_LINK = re.compile(r"\[([^\]]+)\]\((https?://[^\s)]+)\)")
_STRONG, _EM = re.compile(r"\*\*(.+?)\*\*"), re.compile(r"(?<!\*)\*([^*]+)\*(?!\*)")


def _inline(text: str) -> str:
    """Spans of one line: code first, so that nothing inside it is markup; links only to http."""
    held: list[str] = []

    def keep(made: str) -> str:
        held.append(made)
        return f"\0{len(held) - 1}\0"

    text = _CODE.sub(lambda m: keep(f"<code>{html.escape(m[1])}</code>"), text.replace("\0", ""))
    text = _LINK.sub(lambda m: keep(f'<a href="{html.escape(m[2])}" rel="noopener">{html.escape(m[1])}</a>'), text)
    text = _EM.sub(r"<em>\1</em>", _STRONG.sub(r"<strong>\1</strong>", html.escape(text, quote=False)))
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], text)


def safe_html(text: str | None) -> str | None:
    """A markdown subset (headings, lists, fenced code, paragraphs, spans) as HTML; all other markup is escaped."""
    if text is None:
        return None
    out: list[str] = []
    lines, at = text.split("\n"), 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.startswith("```"):
            body = []
            while at < len(lines) and not lines[at].startswith("```"):
                body.append(lines[at])
                at += 1
            at += 1
            out.append(f"<pre><code>{html.escape(chr(10).join(body))}</code></pre>")
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
        elif m := re.match(r"(?:[-*]|(\d+)\.)\s+", line):
            kind, items = ("ol" if m[1] else "ul"), [line[m.end() :]]
            while at < len(lines) and (n := re.match(r"(?:[-*]|(\d+)\.)\s+", lines[at])) and bool(n[1]) == bool(m[1]):
                items.append(lines[at][n.end() :])
                at += 1
            out.append(f"<{kind}>{''.join(f'<li>{_inline(i)}</li>' for i in items)}</{kind}>")
        elif line.strip():
            body = [line]
            while at < len(lines) and lines[at].strip() and not re.match(r"```|#{1,6}\s|(?:[-*]|\d+\.)\s", lines[at]):
                body.append(lines[at])
                at += 1
            out.append(f"<p>{'<br>'.join(map(_inline, body))}</p>")
    return "\n".join(out)


def markdown_html(text: Column) -> Column:
    """``safe_html`` over a column."""

    def run(rows):
        return rows.map(safe_html)

    return F.pandas_udf(run, T.StringType(), F.PandasUDFType.SCALAR)(text)


def jpeg_dimensions(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from a JPEG's frame header; None if there is none."""
    at = 2 if data and data[:2] == b"\xff\xd8" else 0
    while data and at and at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def jpeg_size(data: Column) -> Column:
    """``jpeg_dimensions`` over a column, nulls where there are none."""

    def run(rows):
        return pd.DataFrame([jpeg_dimensions(x) or (None, None) for x in rows], columns=["width", "height"]).astype("Int32")

    return F.pandas_udf(run, _SIZE, F.PandasUDFType.SCALAR)(data)


def change_maps(data: Column) -> Column:
    """Bytes of whole maps as arrays of cell values, a map each; a torn map at the end is left out."""

    def run(rows):
        return rows.map(lambda x: [m.tolist() for m in np.frombuffer(x[: len(x) // CELLS * CELLS], np.uint8).astype(np.int32).reshape(-1, CELLS)] if x is not None else None)

    return F.pandas_udf(run, T.ArrayType(T.ArrayType(T.IntegerType())), F.PandasUDFType.SCALAR)(data)


def ending(media: Column) -> Column:
    """The file ending of a media type, parameters ignored; bin for others."""
    plain = F.lower(F.trim(F.substring_index(media, ";", 1)))
    pairs = [x for k, v in ENDINGS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), plain), F.lit("bin"))


def safe_identifier(text: Column, most: int = 64) -> Column:
    """Letters, digits, point, dash and underscore of a name; others become underscores; never empty or hidden."""
    kept = F.left(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), r"^\.+", ""), F.lit(most))
    return F.when(F.length(kept) > 0, kept).otherwise("unnamed")
