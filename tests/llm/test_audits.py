"""Source divergence and hard negatives against brute force, on small fixtures and awkward rows."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from strandline.llm import divergence, hard_negatives

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "text string, lang string, source string, doc_id long, term string, n long, docs long, total long"


def audited(rows, least, top):
    """The audit's rows by plain loops over all terms."""
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    held, seen, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        found = TERM.findall(text.translate(LOWER))
        for w in found:
            held[lang, source, w] += 1
        for w in set(found):
            seen[lang, w] += 1
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = sorted(w for (x, w), n in seen.items() if x == lang and n >= least)

        def shares(counts, kept=kept):
            n = sum(counts.values())
            return {w: 1 + 10**9 * (counts[w] + 2) // (n + 2 * len(kept)) for w in kept}

        own = {s: {w: held[lang, s, w] for w in kept} for s in sources}
        p = {s: shares(c) for s, c in own.items()}
        q = shares({w: sum(own[s][w] for s in sources) for w in kept})
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if own[s][w] and p[s][w] > q[w]]
            out |= {(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(sorted(terms)[:top])}
    return out


def corpus(n=300, seed=12):
    rng = random.Random(seed)
    words = [w for _ in range(60) if (w := "".join(rng.choices("abCDé\U0001f600", k=rng.randint(1, 4))))]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "é", None])
        own = words[: 20 + 10 * len(source or "")]
        rows.append((rng.choice([" ", "-", "\x00", "9", "\n"]).join(rng.choices(own, k=rng.randint(0, 30))), lang, source))
    return rows + [(None, "en", "quiet"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("lone words here", "xx", None), ("w " * 200_000, "en", "s1")]


def table(spark, rows):
    return spark.createDataFrame([(*r, i // 2 or None, "t", 1, 2, 3) for i, r in enumerate(rows)], DOCS).repartition(5)


@pytest.mark.parametrize("least", [1, 10])
def test_divergence(spark, least, monkeypatch):
    rows = corpus()
    got = divergence.divergence(table(spark, rows), least=least, top=4).collect()
    assert {tuple(r) for r in got} == audited(rows, least, 4) and len({tuple(r) for r in got}) == len(got)


def test_divergence_many_shards_and_slices(spark, monkeypatch):
    rows = corpus(80, 3)
    monkeypatch.setattr(divergence, "SHARD", 20)
    counts = divergence.term_counts(table(spark, rows))
    assert {tuple(r)[:4] for r in counts.collect()} == {(l or "", s or "", w, n) for (l, s, w), n in plain_counts(rows).items()}
    got = divergence.divergence(table(spark, rows), least=2)
    assert {tuple(r) for r in got.collect()} == audited(rows, 2, 10)


def plain_counts(rows):
    out = Counter()
    for text, lang, source in rows:
        out.update((lang or "", source or "", w) for w in TERM.findall((text or "").translate(LOWER)))
    return {(l or None, s or None, w): n for (l, s, w), n in out.items()}


def test_divergence_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []
    got = divergence.divergence(table(spark, [(None, None, None), ("", "", "b")])).collect()
    assert sorted(tuple(r) for r in got) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


VECTORS = "vec_id long, embedding array<double>, label int, score long, block long, chunk long, anchor string, row string"


def mined(rows, every):
    """Every anchor's positives and their negatives, from all scores."""
    fine = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v)
    use = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and fine(v):
            use.append((k, i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    dot = lambda a, b: sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for k, i, v, label in use:
        if i is None or i % every:
            continue
        all_ = [(dot(v, w), j, r, other == label) for r, j, w, other in use if r != k]
        for s, j, _, _ in sorted((x for x in all_ if x[3]), key=order)[:5]:
            hard = [x for x in all_ if not x[3] and 80 * s <= 100 * x[0] <= 100 * s]
            out += [(i, j, n + 1, x[1], s, x[0]) for n, x in enumerate(sorted(hard, key=order)[:5])]
    return sorted(out, key=str)


def run(spark, rows, every):
    held = spark.createDataFrame([(*r, 1, 2, 3, "a", "r") for r in rows], VECTORS).coalesce(1)  # rows keep their order
    from pyspark.sql import functions as F

    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    got = hard_negatives.hard_negatives(held, every=every, moved=moved)
    return sorted([tuple(r) for r in got.collect()], key=str)


def vectors(n, width=6, seed=1, near=0.15):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    return [(i, [c + rng.gauss(0, near) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(hard_negatives, "BYTES", 8)
        monkeypatch.setattr(hard_negatives, "CHUNK", 3)
        monkeypatch.setattr(hard_negatives, "PART", 10)
    rows = vectors(400)
    assert run(spark, rows, 10) == mined(rows, 10)


def test_hard_negatives_awkward_rows(spark):
    rows = vectors(60, 3, 2) + [
        (100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [float("nan"), 1.0], 1), (104, [float("inf")], 2), (105, [0.0, 0.0, 0.0], 3),
        (106, [1.0], 2), (None, [2.0, 1.0, 0.5], 1), (20, [1.0, 1.0, 1.0], 1), (20, [1.0, 1.0, 1.0], 1), (107, [1.0, 1.0, 1.0], None), (0, [-1.0, -1.0, -1.0], 0),
    ] + [(200 + i, [0.5, 0.5, 0.5], i % 2) for i in range(40)]
    assert run(spark, rows, 10) == mined(rows, 10)
    assert run(spark, [], 10) == [] and run(spark, [(1, None, 1)], 1) == []
    assert run(spark, [(0, [], 1), (1, [], 1), (2, [], 2)], 1) == mined([(0, [], 1), (1, [], 1), (2, [], 2)], 1)


def test_hard_negatives_large_components(spark):
    rows = [(i, [3.0e5 * (i % 5 + 1), 1.0 + i, -2.0e5], i % 3) for i in range(30)]
    assert run(spark, rows, 10) == mined(rows, 10)
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(i, [v * 1e3 for v in x], y) for i, x, y in rows], 10)
