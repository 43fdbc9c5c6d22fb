"""Operator 6, toxicity: cumulative-link ordinal regression over sparse text features.

Features are hashed words and word beginnings. A bounded sample of labelled rows (SAMPLE per class, lowest hashes)
fits the model on the driver: features whose presence differs between the classes by a z-test are kept, and one weight
vector is shared by the ordered thresholds of a proportional-odds model, P(grade > k) = s(w.x - t_k). The labels know
only toxic or not; the grades are 0 (not toxic), 1 and 2 (toxic, below or from the median of their evidence per word).
Scoring is one narrow stage over Arrow batches of whole texts; the model (thousands of weights) travels with the task.

Edge cases: null and empty texts have no features and are not toxic; without labelled rows of both classes no weight is
fitted and nothing is toxic; null labels are ignored; repeated rows get a row each; an empty table gives an empty
result; other columns are kept by ``reject_toxic`` and ignored by ``toxicity``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 3000
#: Hash space of the features.
SPACE = 1 << 21
#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)
#: Least z of a kept feature's difference in presence between toxic and other rows.
LEAST_Z = 4.0
#: Bands of two minimum hashes by which copies among the sampled rows are found.
BANDS = 12
#: A document is toxic if P(grade > 0) is at least this.
THRESHOLD = 0.3
#: What evidence must add to the probability of a document without features.
MARGIN = 0.05
#: Words a scoring worker remembers.
CACHE = 200_000

_WORD = re.compile(r"\w+")


def _features(word: str) -> tuple[int, ...]:
    marks = {f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)}
    return tuple(sorted({zlib.crc32(m.encode("utf-8", "surrogatepass")) % SPACE for m in marks}))


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, feature ids, counts, words of the row, toxic) of the bounded sample."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = known.withColumn("h", F.xxhash64(F.lit(6), "doc_id"))
    parts = [ranked.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "toxic")
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def extract(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words = Counter(_WORD.findall((text or "").lower()))
                got: Counter = Counter()
                for w, n in words.items():
                    for f in _features(w):
                        got[f] += n
                ids = np.fromiter(got.keys(), np.int32, len(got))
                counts = np.fromiter(got.values(), np.int64, len(got)).clip(max=255).astype(np.uint8)
                out.append((ids.tobytes(), counts.tobytes(), sum(words.values())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64()), batch.column(1).cast(pa.int32())],
                names=["ids", "counts", "words", "toxic"],
            )

    common.ship(spark)
    rows = pairs.mapInArrow(extract, "ids binary, counts binary, words long, toxic int").collect()
    rows.sort(key=lambda r: (r.toxic, bytes(r.ids)))
    sizes = np.array([len(r.ids) // 4 for r in rows], np.int64)
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in rows), np.int32)
    counts = np.frombuffer(b"".join(bytes(r.counts) for r in rows), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return starts, ids, counts, np.array([r.words for r in rows], np.int64), np.array([r.toxic for r in rows], np.int64)


def _without_copies(starts, ids, counts, words, toxic):
    """The sample with one row of each group of near copies: else the words of one much copied row would look toxic."""
    n = len(toxic)
    if n < 2:
        return starts, ids, counts, words, toxic
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    on = (np.bincount(ids, minlength=SPACE) <= max(2, n // 20))[ids]
    own, sizes = ids[on].astype(np.uint32), np.bincount(row[on], minlength=n)
    some = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[some]
    rng, big = np.random.default_rng(6), np.uint32(2**32 - 1)
    seen: set = set()
    keys = []
    for _ in range(2 * BANDS):
        h = (own + np.uint32(1)) * np.uint32(int(rng.integers(2**31)) * 2 + 1)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x9E3779B1)
        low = np.full(n, big)
        low[some] = np.minimum.reduceat(h, begin) if len(some) else big
        keys.append(low)
    keep = np.ones(n, bool)
    for i in range(n):
        own = [(b, keys[2 * b][i], keys[2 * b + 1][i]) for b in range(BANDS) if keys[2 * b][i] != big]
        keep[i] = not any(k in seen for k in own)
        seen.update(own)
    stays = keep[row]
    sizes = np.diff(starts)[keep]
    return np.concatenate([[0], np.cumsum(sizes)]), ids[stays], counts[stays], words[keep], toxic[keep]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: {"weights": {feature: weight}, "thresholds": (t1, t2)}."""
    starts, ids, counts, words, toxic = _without_copies(*_sampled(docs, labels))
    n1, n0 = int((toxic == 1).sum()), int((toxic == 0).sum())
    none = {"weights": {}, "thresholds": (4.0, 6.0)}
    if not n0 or not n1:
        return none
    row = np.repeat(np.arange(len(toxic)), np.diff(starts))
    present = [np.bincount(ids[toxic[row] == k], minlength=SPACE) for k in (0, 1)]
    p = (present[0] + present[1]) / (n0 + n1)
    z = (present[1] / n1 - present[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    # a feature much more frequent in toxic rows, not merely shifted by the rows' lengths
    often = max(5, n1 // 100)
    kept = np.flatnonzero((z >= LEAST_Z) & (present[1] >= often) & (present[1] / n1 >= 10 * (present[0] + 0.25) / n0))
    if not len(kept):
        return none
    place = np.full(SPACE, -1, np.int64)
    place[kept] = np.arange(len(kept))
    on = place[ids] >= 0
    r, f, x = row[on], place[ids[on]], np.log1p(counts[on].astype(float))
    evidence = np.bincount(r, counts[on], len(toxic)) / np.maximum(words, 1)
    grade = np.where(toxic == 1, 1 + (evidence >= np.median(evidence[toxic == 1])), 0)
    weight_of = np.where(toxic == 1, 0.5 / n1, 0.5 / n0)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    w, t1, gap = np.full(len(kept), 1.0), 1.0, 0.0
    params = np.concatenate([w, [t1, gap]])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, 401):
        w, t1, t2 = params[:-2], params[-2], params[-2] + np.exp(params[-1])
        score = np.bincount(r, w[f] * x, len(toxic))
        a, b = sig(score - t1), sig(score - t2)
        da, db = a * (1 - a), b * (1 - b)
        like = np.where(grade == 0, 1 - a, np.where(grade == 1, a - b, b)).clip(1e-9)
        by_a = np.where(grade == 0, -1.0, np.where(grade == 1, 1.0, 0.0)) / like * weight_of
        by_b = np.where(grade == 1, -1.0, np.where(grade == 2, 1.0, 0.0)) / like * weight_of
        by_score = by_a * da + by_b * db
        g_w = np.bincount(f, by_score[r] * x, len(kept)) - 2e-5 * w
        g_t2 = -(by_b * db).sum()
        g = np.concatenate([g_w, [-(by_a * da).sum() + g_t2, g_t2 * np.exp(params[-1])]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = params[:-2]
    return {"weights": dict(zip(kept.tolist(), w.tolist())), "thresholds": (float(params[-2]), float(params[-2] + np.exp(params[-1])))}


def decision(model: dict, threshold: float) -> float:
    """The P(grade > 0) from which a document is toxic: the threshold, and in any case MARGIN over what a document without
    any feature gets, which is high where few rows are labelled."""
    return max(threshold, float(1 / (1 + np.exp(model["thresholds"][0]))) + MARGIN)


def _scorer(model: dict):
    """texts -> (P(grade > 0), expected severity); remembers the features of a bounded number of words."""
    weights, (t1, t2) = model["weights"], model["thresholds"]
    known: dict[str, tuple[int, ...]] = {}

    def score(texts):
        if len(known) > CACHE:
            known.clear()
        total = np.zeros(len(texts))
        for i, text in enumerate(texts):
            got: dict[int, int] = {}
            for w in _WORD.findall((text or "").lower()):
                if (fs := known.get(w)) is None:
                    fs = known[w] = tuple(f for f in _features(w) if f in weights)
                for f in fs:
                    got[f] = got.get(f, 0) + 1
            total[i] = sum(weights[f] * np.log1p(min(n, 255)) for f, n in sorted(got.items()))
        over = [1 / (1 + np.exp(-np.clip(total - t, -30, 30))) for t in (t1, t2)]
        return over[0], over[0] + over[1]

    return score


def toxicity(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, p_toxic, severity (expected grade, 0 to 2), toxic."""
    common.ship(docs.sparkSession)
    kind, threshold = docs.schema["doc_id"].dataType.simpleString(), decision(model, threshold)

    def run(batches):
        score = _scorer(model)
        for batch in batches:
            p, severity = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(severity), pa.array(p >= threshold)], names=["doc_id", "p_toxic", "severity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_toxic double, severity double, toxic boolean")


def reject_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns; no shuffle and no join."""
    common.ship(docs.sparkSession)
    at, threshold = docs.columns.index("text"), decision(model, threshold)

    def run(batches):
        score = _scorer(model)
        for batch in batches:
            p, _ = score(batch.column(at).to_pylist())
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model fitted on the folder's labels."""
    docs = common.table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, common.table(spark, sf_dir, "labels")))
