"""Operator 13, best-fit packing: vector best-fit of document pieces into sequences.

1. Pieces. Each document is encoded whole; only one longer than a sequence is cut. White space is dropped by this kind of
   vocabulary and nothing it does reaches across white space, so a document's ids are those of its stretches between white
   space, which the library encodes once each (a bounded cache). Every task numbers its pieces of each length.
2. Plan. A piece's demand is a vector that its length decides: tokens, one document, and attention cost (the square of the
   length). All pieces of one length are a class, and there are no more classes than a sequence has tokens, whatever the
   corpus holds. The classes are packed longest first: among the open sequences whose residual capacities hold the piece in
   every component, those of least residual norm (or, if asked for, of largest dot product of demand and residual), each
   component weighted, are filled first; new sequences open for the rest. Sequences with one history are one group, so the
   plan is a table whose size follows the number of classes, not that of the pieces: a class splits at most two groups.
3. Places. The number of a piece among all of its length (counts per task, summed in order) finds its row of the plan, and
   there its sequence and offset. Texts are read once and never shuffled; what moves is one small row per piece.

Edge cases: a null or empty text is one piece of the end id alone; a null identifier stays null; rows that repeat an
identifier or a text are documents of their own; texts of any length are encoded whole; special strings in a text are
encoded as the library's default does; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm import common

#: Tokens of a sequence; documents in one, and its attention cost, at most: by default what the tokens allow anyway.
TOKENS = 4096
#: Weights of the components tokens, documents and attention cost in a choice.
WEIGHTS = (1.0, 0.25, 0.25)
#: Stretches of a text that are cached: so many, of so many bytes at most.
CACHED, SHORT = 600_000, 64
#: Stretches encoded in one call, and what stands between them: a piece of its own in any vocabulary.
TOGETHER, MARK = 256, "\x01"
#: Bytes of text encoded at once, about; texts are never cut.
SLICE = 4_000_000


class Encoder:
    """The ids of stretches without white space, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        cut = [t.split() for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        known = self.cache
        new = list(set().union(*cut).difference(known))
        found = self._encoded(new)
        known.update((w, i) for w, i in found.items() if len(w) <= SHORT)
        long = {w: i for w, i in found.items() if len(w) > SHORT}
        if long:
            return [b"".join([known[w] if len(w) <= SHORT else long[w] for w in words]) for words in cut]
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def _encoded(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each new stretch: many in one call with a mark between them, those that hold the mark one by one."""
        alone = [w for w in new if self.mark is None or MARK.encode() in w]
        found = {w: np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in alone}
        joint = [w for w in new if w not in found]
        groups = [joint[a : a + TOGETHER] for a in range(0, len(joint), TOGETHER)]
        lines = [f" {MARK} ".join(w.decode() for w in words) for words in groups]
        for words, e in zip(groups, self.library.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stop = np.append(np.flatnonzero(ids == self.mark), len(ids)) * 4
            raw, begin = ids.tobytes(), np.append(0, stop[:-1] + 4)
            found.update((w, raw[a:b]) for w, a, b in zip(words, begin.tolist(), stop.tolist(), strict=True))
        return found


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, end: int | None = 1, most: int = TOKENS, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth) of every piece, and its ids if asked for. ``part`` is the task
    that made it and ``nth`` its number among those of its length there: they hold once the result is staged."""
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    last = b"" if end is None else np.array([end], "<u4").tobytes()
    step = 4 * most
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * ids

    def run(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        encode = encoder(path)
        for batch in batches:
            texts, a = batch.column(1).cast(pa.large_binary()), 0
            while a < len(texts):
                held, b = [], a
                size = 0
                while b < len(texts) and size < SLICE:
                    held.append(texts[b].as_py() or b"")
                    size += len(held[-1])
                    b += 1
                rows, own = [], []
                for i, x in enumerate(encode(held), a):
                    x += last
                    for k in range(0, max(1, len(x)), step):
                        cut = x[k : k + step]
                        n = len(cut) // 4
                        own.append(i)
                        rows.append((k // step, k // 4, n, zlib.crc32(cut), part, seen[n], cut)[: len(kinds)])
                        seen[n] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *columns], names=names)
                a = b

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * ids
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


class Plan:
    """Where the pieces of each length go. Open sequences with one history are a group: its first sequence, their number,
    and what is left of every capacity."""

    def __init__(self, counts: dict[int, int], tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, weights=WEIGHTS, choice: str = "norm"):
        if choice not in ("norm", "dot"):
            raise ValueError(f"choice is norm or dot, not {choice}")
        self.caps = np.array([tokens, documents or tokens, cost or tokens * tokens], np.int64)
        self.weights, self.choice = np.array(weights, np.float64), choice
        self.first, self.many, self.left = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        self.sequences, self.rows = 0, []
        for length in sorted(counts, reverse=True):
            self._place(length, counts[length])
        rows = np.array(self.rows or np.zeros((0, 5)), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        #: Of each row: its length and first number among the pieces of it, its first sequence, pieces to each sequence, offset.
        self.length, self.begin, self.to, self.times, self.offset = rows.T.copy()

    def _score(self, demand: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The lower, the sooner a group is filled."""
        if self.choice == "dot":
            return -(left / self.caps * (demand / self.caps) * self.weights).sum(1)
        return (((left - demand) / self.caps) ** 2 * self.weights).sum(1)

    def _place(self, length: int, n: int) -> None:
        demand = np.array([length, 1, length * length], np.int64)
        least = int((self.caps // np.maximum(demand, 1)).min())
        if least < 1:
            raise ValueError(f"a piece of {length} tokens is over a sequence's capacities")
        fits = np.flatnonzero((self.left >= demand).all(1))
        fits = fits[np.lexsort((self.first[fits], self._score(demand, self.left[fits])))]
        times = (self.left[fits] // np.maximum(demand, 1)).min(1)
        room = np.cumsum(times * self.many[fits])
        whole = int(np.searchsorted(room, n, side="right"))
        given = 0
        for g, t in zip(fits[:whole].tolist(), times[:whole].tolist()):
            self._row(length, given, g, t)
            given += t * int(self.many[g])
        self.left[fits[:whole]] -= times[:whole, None] * demand
        if given < n and whole < len(fits):
            self._split(fits[whole], int(times[whole]), length, given, n - given, demand)
            return
        if given < n:
            need = -(-(n - given) // least)
            self._open(self.sequences, need, self.caps)
            self.sequences += need
            self._split(len(self.first) - 1, least, length, given, n - given, demand)

    def _row(self, length: int, given: int, group: int, times: int) -> None:
        self.rows.append((length, given, int(self.first[group]), times, int(self.caps[0] - self.left[group, 0])))

    def _open(self, first: int, many: int, left: np.ndarray) -> None:
        self.first, self.many = np.append(self.first, first), np.append(self.many, many)
        self.left = np.concatenate([self.left, left[None]])

    def _split(self, group: int, times: int, length: int, given: int, n: int, demand: np.ndarray) -> None:
        """The class's last ``n`` pieces go to the first sequences of the group; the others stay as they are."""
        full, rest = divmod(n, times)
        first, many, left = int(self.first[group]), int(self.many[group]), self.left[group].copy()
        if full:
            self._row(length, given, group, times)
        if rest:
            self.rows.append((length, given + full * times, first + full, times, int(self.caps[0] - left[0])))
            self._open(first + full, 1, left - rest * demand)
        if untouched := many - full - bool(rest):
            self._open(first + full + bool(rest), untouched, left)
        self.many[group], self.left[group] = full, left - times * demand
        if not full:
            keep = np.arange(len(self.first)) != group
            self.first, self.many, self.left = self.first[keep], self.many[keep], self.left[keep]

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their lengths and numbers among those of the length."""
        key = lambda a, b: (a << 46) + b
        at = np.searchsorted(key(self.length, self.begin), key(length, number), side="right") - 1
        nth = number - self.begin[at]
        return self.to[at] + nth // self.times[at], self.offset[at] + nth % self.times[at] * length


def packed(docs: DataFrame, path: str, end: int | None = 1, tokens: int = TOKENS, documents: int | None = None, cost: int | None = None, weights=WEIGHTS, choice: str = "norm", ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: the identifier, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    ``tokens``, ``documents`` and ``cost`` bound every sequence; ``choice`` is norm or dot."""
    most = min(tokens, math.isqrt(cost)) if cost else tokens
    made = common.staged(pieces(docs, path, end, most, ids, id_col, text_col), "pieces")
    counts = common.staged(made.groupBy("length", "part").agg(F.count("*").alias("own")), "lengths")
    # at most one row for each length up to ``most``
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("own").alias("n")).collect()}
    plan = Plan(by_length, tokens, documents, cost, weights, choice)
    earlier = F.coalesce(F.sum("own").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = counts.select("length", "part", earlier.alias("earlier"))
    numbered = made.join(begun, ["length", "part"]).withColumn("number", F.col("earlier") + F.col("nth"))
    kept = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def place(batches):
        for b in batches:
            sequence, offset = plan.places(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.select(*kept).schema)
    return numbered.select(*kept, "number").mapInArrow(place, f"{fields}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, path: str, id_col: str = "doc_id", **settings) -> DataFrame:
    """The sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), and the documents in them in order with
    piece, offset and length, as an attention mask needs them. A group holds one sequence."""
    rows = packed(docs, path, ids=True, id_col=id_col, **settings)
    entry = F.struct("offset", "length", "piece", F.col(id_col).alias("id"), "ids")
    one = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(entry)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    held = F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return one.select("sequence_id", joined.alias("ids"), held.alias("documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all documents in sequences of 4,096 tokens."""
    import public_tokenizers

    return packed(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
