"""Operator 5, byte-level BPE encoding and decoding.

Boundaries come from the class arrays and the transition-function scan of pretokens.py, without a regular expression;
the slices feed cached pair merging. Each id keeps its piece's offset in the text, and ids decode to bytes through the
table of token bytes. One narrow stage over Arrow batches; nothing is shuffled.

Edge cases: null and empty texts have no ids, and the digests of nothing; texts of any length are encoded whole;
special strings are ordinary text; repeated rows each get a row; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, pretokens
from strandline.llm.merges import Merger, from_ranks

#: Codepoints put through the scan at once; texts are never cut.
BATCH_CODEPOINTS = 1_000_000


@functools.cache
def compiled(path: str) -> tuple[Merger, list[bytes]]:
    """The merger of a rank file and each id's bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return from_ranks(ranks), table


def _slices(batch: pa.RecordBatch, column: int):
    """The batch in slices of about BATCH_CODEPOINTS of text: what a task holds doesn't follow the rows of a batch."""
    a, size = 0, 0
    sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
    for b, n in enumerate(sizes):
        if b > a and size + n > 2 * BATCH_CODEPOINTS:
            yield batch.slice(a, b - a)
            a, size = b, 0
        size += n
    if a < len(sizes):
        yield batch.slice(a)


def encode(texts: list[str], path: str):
    """For each text: (ids as uint32, byte offset of each id in the text)."""
    merger, table = compiled(path)
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_CODEPOINTS):
            size += len(texts[b])
            b += 1
        data, starts, ends, counts, _ = pretokens.slices(texts[a:b])
        got = merger([data[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
        at = 0
        for n in counts.tolist():
            ids = np.array([i for piece in got[at : at + n] for i in piece], dtype="<u4")
            width = sizes[ids]
            yield ids, np.cumsum(width) - width
            at += n
        a = b


def decode(ids, path: str) -> bytes:
    """The bytes the ids stand for."""
    table = compiled(path)[1]
    return b"".join(map(table.__getitem__, ids.tolist()))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the identifier, ids array<int>, offsets array<long> (bytes). ``path``: a rank file on every executor."""
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in (x for b in batches for x in _slices(b, 1)):
            got = list(encode([t or "" for t in batch.column(1).to_pylist()], path))
            ids = pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32()))
            offsets = pa.array([y for _, y in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, offsets], names=[id_col, "ids", "offsets"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, offsets array<long>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of bpe_encode's output: the identifier and data binary, the decoded bytes."""
    common.ship(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [decode(np.array(x or [], np.int64), path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "data"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, data binary")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the identifier, n_tokens, ids_sha256 and decoded_sha256, from one pass of encoding and decoding."""
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in (x for b in batches for x in _slices(b, 1)):
            n, ids_sha, text_sha = [], [], []
            for ids, _ in encode([t or "" for t in batch.column(1).to_pylist()], path):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids, path)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bpe_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Training records: the identifier, source, ids array<int>, n_tokens and decoded_sha256 of each row."""
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in (x for b in batches for x in _slices(b, 1)):
            ids, sha = [], []
            for x, _ in encode([t or "" for t in batch.column(1).to_pylist()], path):
                ids.append(x.astype(np.int32))
                sha.append(hashlib.sha256(decode(x, path)).hexdigest())
            columns = [batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, source_col, "ids", "n_tokens", "decoded_sha256"])

    schema = f"`{id_col}` {kind}, `{source_col}` string, ids array<int>, n_tokens long, decoded_sha256 string"
    return docs.select(id_col, text_col, source_col).mapInArrow(run, schema)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: the multilingual 50k ranks over all documents."""
    import public_tokenizers

    return bpe_digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
