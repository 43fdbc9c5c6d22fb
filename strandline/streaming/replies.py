"""Replies that come in chunks of bytes: text up to a separator, then a frame of JSON; any chunking gives the same."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: the byte between a reply's text and its frame; it is no part of any other character.
SEPARATOR = b"\x1e"


def framed(tail: Column, seen: Column) -> dict[str, Column]:
    """The frame of a reply, as JSON, and what is wrong with it."""
    raw = F.regexp_replace(tail, r"(?U)\A\s+|\s+\z", "")
    parsed = F.try_parse_json(raw)
    error = (
        F.when(~F.coalesce(seen, F.lit(False)) | F.coalesce(raw == "", F.lit(True)), "missing end frame")
        .when(parsed.isNull(), "malformed end frame")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "the end frame is no object")
    )
    return {"frame": F.when(error.isNull(), F.to_json(parsed)), "error": error}


def split_replies(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """(key, answer, frame, error) of each reply: its chunks' bytes in order are cut at the first separator, then read as UTF-8.
    An answer that is none is null. A reply is what one call returned, so it fits a row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    whole = F.aggregate(parts, F.lit(b""), lambda held, p: F.concat(held, p["d"]))
    one = chunks.where(F.col(data).isNotNull()).groupBy(key).agg(whole.alias("_b"))
    at = F.locate("1E", F.regexp_replace(F.hex("_b"), "(..)", "$1 "))  # pairs of digits, so that a separator is one
    place = F.when(at > 0, F.floor((at - 1) / 3)).cast("int")
    cut = one.withColumn("_at", place)
    said = lambda c: F.try_validate_utf8(c.cast("string"))
    head = F.when(F.col("_at").isNull(), F.col("_b")).otherwise(F.substring("_b", F.lit(1), F.col("_at")))
    tail = F.when(F.col("_at").isNotNull(), F.substring("_b", F.col("_at") + 2, F.octet_length("_b")))
    split = cut.select(key, said(head).alias("answer"), said(tail).alias("_tail"), F.col("_at").isNotNull().alias("_seen"))
    return split.withColumns(framed(F.col("_tail"), F.col("_seen"))).drop("_tail", "_seen")


PIECE = "reply string, n long, text string, tail string, seen boolean, last boolean"
_KEPT = "pending binary, seen boolean, tail string"


def pieces(chunks: DataFrame) -> DataFrame:
    """A row per chunk of the stream (reply, n, data, last): the text that it completes, and with the last one the tail.

    What is kept of a reply is the bytes of a character that is not whole yet, whether the separator was seen, and the tail
    after it. Chunks of a reply come in order, in one batch or in several."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, seen, tail = state.get if state.exists else (b"", False, "")
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        decoder.setstate((bytes(pending), 0))
        out = []
        for r in pd.concat(list(frames)).sort_values("n", kind="stable").itertuples(index=False):
            text = decoder.decode(bytes(r.data or b""), final=bool(r.last))
            said = ""
            if seen:
                tail += text
            else:
                said, mark, rest = text.partition(SEPARATOR.decode())
                seen, tail = bool(mark), tail + rest
            out.append((key[0], r.n, said, tail if r.last else None, seen, bool(r.last)))
        if out and out[-1][-1]:
            state.remove()
        else:
            state.update((decoder.getstate()[0], seen, tail))
        yield pd.DataFrame(out, columns=["reply", "n", "text", "tail", "seen", "last"])

    return chunks.groupBy("reply").applyInPandasWithState(run, PIECE, _KEPT, "append", GroupStateTimeout.NoTimeout)


def put_together(rows: DataFrame) -> DataFrame:
    """(reply, answer, frame, error) of the replies whose last piece came."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: r["text"]), "")
    one = rows.groupBy("reply").agg(said.alias("answer"), F.max("tail").alias("_tail"), F.bool_or("seen").alias("_seen"), F.bool_or("last").alias("_last"))
    return one.where("_last").withColumns(framed(F.col("_tail"), F.col("_seen"))).select("reply", "answer", "frame", "error")
