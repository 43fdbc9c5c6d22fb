"""Operator 1, token counts: a finite-state tokenizer whose transitions carry emitted-token counts.

The pre-tokeniser is compiled to a transducer (pretokens.py). A transition that closes a piece emits that piece's
token count, which the vocabulary's merges define; the emissions of a text add up, so chunk state maps compose by a
parallel prefix scan, and a text's count is a difference of two prefix sums. Arrow batches pass through one narrow
stage; nothing is shuffled.

Edge cases: a null or empty text has 0 bytes and 0 tokens; text of any length is counted whole; special strings in a
text count as the library's default treats them (the special token, 1); repeated rows each get their own row; an empty
table gives an empty result; further columns are not read, so clashing names don't matter.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, pretokens
from strandline.llm.merges import Merger, from_merges

#: Codepoints put through the transducer at once; texts are never cut.
BATCH_CODEPOINTS = 1_500_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, to the byte: printable bytes stand for
    themselves, the others take the codepoints from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def compiled(path: str) -> tuple[Merger, regex.Pattern | None]:
    """The transducer's output weights and the pattern of special strings, from a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    special = [t["content"] for t in spec.get("added_tokens", [])]
    return from_merges(merges, counts=True), regex.compile("|".join(map(regex.escape, special))) if special else None


def _count(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text."""
    merger, special = compiled(path)
    n_bytes = np.zeros(len(texts), np.int64)
    n_tokens = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, t in enumerate(texts):
        if special is not None and "<|" in t and (n := len(special.findall(t))):
            n_tokens[i] += n
            n_bytes[i] += sum(len(m.encode()) for m in special.findall(t))
            cut = special.split(t)
            parts += cut
            owner += [i] * len(cut)
        else:
            parts.append(t)
            owner.append(i)
    a = 0
    while a < len(parts):
        b, size = a, 0
        while b < len(parts) and (b == a or size + len(parts[b]) <= BATCH_CODEPOINTS):
            size += len(parts[b])
            b += 1
        data, starts, ends, counts, sizes = pretokens.slices(parts[a:b])
        weights = np.array(merger([data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]), np.int64)
        total = np.concatenate([[0], np.cumsum(weights)])
        upto = np.concatenate([[0], np.cumsum(counts)])
        np.add.at(n_tokens, owner[a:b], total[upto[1:]] - total[upto[:-1]])
        np.add.at(n_bytes, owner[a:b], sizes)
        a = b
    return n_bytes, n_tokens


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the identifier, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path``: a byte-level BPE file of the tokenizers library, present on every executor.
    """
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes, n_tokens = _count(texts, path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: the 50k byte-level vocabulary, limit 1,024, over all documents."""
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
