"""The operators over whole corpora against brute force, and on edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import ann, exact_dedup, jaccard_join, mixing, substring_dedup, toxicity

DOCS = "doc_id long, text string, source string"
WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    fresh = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, base = [], fresh(120)
    passage = fresh(30)
    for i in range(70):
        kind = i % 7
        if kind == 0:
            t = base
        elif kind == 1:
            words = base.split(" ")
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            t = " ".join(words)
        elif kind == 2:
            t = fresh(40) + " " + passage + "\n" + fresh(10)
        elif kind == 3:
            t = fresh(3).upper()
        elif kind == 4:
            t = passage + " " + passage
        else:
            t = fresh(80)
        rows.append((i, t, f"s{i % 5}"))
    return rows + [(200, None, None), (201, "", "s1"), (202, " \t\n", "s1"), (203, base.replace(" ", "  "), "s2"), (204, "x" * 5000, "s3"), (205, "x" * 5000, "s3")]


def test_exact_dedup(spark, corpus):
    groups: dict = {}
    for i, t, _ in corpus:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(corpus, DOCS)).collect()}
    assert len(got) == len(corpus)
    for x, own in groups.items():
        for _, i in own:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(own)[1], len(own), i == min(own)[1], hashlib.sha256(x.encode()).hexdigest())


def test_exact_dedup_edges(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, " a", "s"), (None, None, None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.kept for r in got) == [False, False, True, True] and {r.group_size for r in got} == {3, 1}
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a", 2, 3, 4)], "doc_id long, text string, digest int, run int, best int")
    assert exact_dedup.keep_first(clash).columns == clash.columns and exact_dedup.keep_first(clash).count() == 1


@pytest.mark.parametrize("block", [300, 4000, 10**6])
def test_substring_dedup(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(corpus, DOCS)).collect()}
    first: dict = {}
    for i, t, _ in sorted(corpus):
        y = (t or "").encode()
        gone = np.zeros(len(y), bool)
        for k in range(len(y) - 49):
            if first.setdefault(y[k : k + 50], i) < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(y, np.uint8)[~gone].tobytes()).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(y), int(gone.sum()), spans, kept), i


def test_colliding_digests_are_told_apart(corpus, monkeypatch):
    """The operator's steps by hand, with digests of 3 bits: nearly all strings collide, and the checks decide."""
    monkeypatch.setattr(substring_dedup, "DIGEST_BITS", 3)
    S, blocks, bits = substring_dedup, 5, 4

    def grouped(tables, *names):
        every = pa.concat_tables(tables)
        keys = list(zip(*(every.column(n).to_pylist() for n in names)))
        return {k: every.filter(pa.array([x == k for x in keys])) for k in dict.fromkeys(keys)}

    own = [(i, t) for i, t, _ in corpus]
    texts = {b: pa.table({"doc_id": pa.array([i for i, _ in own if i % blocks == b], pa.int64()), "text": pa.array([t for i, t in own if i % blocks == b], pa.string()), "block": pa.array([b for i, _ in own if i % blocks == b], pa.int32())}) for b in range(blocks)}
    shared = grouped([S.shared_anchors(t) for t in grouped([S.anchors_of(t, bits) for t in texts.values()], "range").values()], "block")
    told = {b: shared[(b,)] for b in texts}
    judged = grouped([S.merge_stretches(t) for t in grouped([S.stretches_of(texts[b], told[b], bits) for b in texts], "kind", "range").values()], "block")
    found = grouped([S.candidates(texts[b], told[b], judged[(b,)], bits, bits + 1) for b in texts], "range")
    verdicts = grouped([S.merge_runs(t) for t in found.values()], "block")
    got = {r["doc_id"]: r["n_removed"] for b in texts for r in S.removed(texts[b], verdicts[(b,)], bits + 1).to_pylist()}
    first, want = {}, {}
    for i, t, _ in sorted(corpus):
        y = (t or "").encode()
        gone = np.zeros(len(y), bool)
        for k in range(len(y) - 49):
            if first.setdefault(y[k : k + 50], i) < i:
                gone[k : k + 50] = True
        want[i] = int(gone.sum())
    assert got == want and sum(want.values())


def test_substring_dedup_edges(spark):
    rows = [(7, "y" * 60, None), (7, "y" * 60, None), (None, "y" * 60, None), (8, None, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 0), (7, 60), (7, 60), (8, 0)]
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0


def sets_of(rows):
    out = {}
    for i, t, _ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize(("shard", "region"), [(8, 1000), (10**6, 6)])
def test_jaccard_join(spark, corpus, monkeypatch, shard, region):
    monkeypatch.setattr(jaccard_join, "SHARD", shard)
    monkeypatch.setattr(jaccard_join, "REGION", region)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    sets = sets_of(corpus)
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(spark.createDataFrame(corpus, DOCS)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), root[i]) for i, s in sets.items()}


def test_region_recursion_is_exact():
    rng = np.random.default_rng(8)
    seeds = [np.unique(rng.integers(0, 4000, 90)) for _ in range(6)]
    sets = []
    for _ in range(120):
        s = seeds[rng.integers(6)]
        own = np.concatenate([s[rng.random(len(s)) > rng.random() * 0.25], rng.integers(0, 4000, rng.integers(0, 12))])
        sets.append(np.unique(own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    root = list(range(len(sets)))
    for _ in range(20):
        for a, b in itertools.combinations(range(len(sets)), 2):
            if root[a] != root[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
                root[a] = root[b] = min(root[a], root[b])
    assert jaccard_join.Region(sets).join().tolist() == root


def test_jaccard_edges(spark):
    rows = [(None, "a b c d e f", None), (3, "a b c d e f", None), (3, "a b c d e f", None), (4, "A b c d e f", None), (5, "x", None), (6, "X", None), (7, "", None), (8, None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 2, 0), (3, 2, 3), (3, 2, 3), (4, 2, 3), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 0, 8)]
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(900, None, "a"), (901, "", None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    for s in ("a", "b", "c", "d", None):
        own = [r for r in got if source[r.doc_id] == s]
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
        assert all(r.taken <= 3 * r.size for r in own)
    total = sum(r.size for r in got)
    assert sum({source[r.doc_id]: r.target for r in got}.values()) == pytest.approx(total)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_take_what_the_mix_says(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "b", None]), i, "x", 2) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS + ", row long, whole string, times int")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {i: len(t.split()) for i, t, *_ in rows}
    out: dict = {}
    for r in mixed.collect():
        assert tuple(r) == rows[r.doc_id]
        out[r.doc_id] = out.get(r.doc_id, 0) + words[r.doc_id]
    assert out == {i: n for i, n in taken.items() if n}


def test_targets_and_flow():
    assert mixing.targets({"a": 10, "b": 1000}, {"a": 1, "b": 1}) == {"a": 30.0, "b": 980.0}
    # a document of both sources fills whichever quota is short; repetition only where fresh words run out
    given = mixing.flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10})
    assert sum(given.values()) == 30 and given == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    assert mixing.flow({("a",): 10, ("b",): 10}, {"a": 25, "b": 5}) == {("a",): 25, ("b",): 5}


def test_overlapping_sources(spark):
    rows = [(i, " ".join(["w"] * 20), s) for i, s in enumerate([["a"], ["a", "b"], ["b"], [], None] * 6)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), {"a": 1, "b": 1}).collect()
    assert len(got) == 30 and all(0 <= r.taken <= 60 for r in got)


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(900)]
    rude = ["zorgol", "zorgolen", "zorgolish", "vrekt"]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(3, 9) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(rude))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, toxic))
    rows += [(800, None, None), (801, "", None)]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame(labels[:400] + [(None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    wrong = sum(got[i].toxic != bool(t) for i, t in labels[400:])
    assert wrong <= 3 and not got[800].toxic and not got[801].toxic
    assert all(0 <= r.severity <= 2 and r.severity >= r.p_toxic for r in got.values())
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, none).where("toxic").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(900, 12)), np.tile(rng.normal(size=12), (300, 1))])
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 12), (2200, [float("nan")] * 12), (2300, [1.0] * 3), (2400, [None] + [1.0] * 11)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(table, every=20)
    assert ann.recall(table, got, queries=60) >= 0.9
    y = np.array([r[1] for r in rows[:1200]])
    for r in got.where("query_id % 100 = 0").collect():
        assert r.query_id != r.vec_id and r.score == pytest.approx(np.sqrt(((y[r.query_id] - y[r.vec_id]) ** 2).sum()))
    sizes = got.groupBy("query_id").count().collect()
    assert len(sizes) == 60 and {r["count"] for r in sizes} == {10}
    few = ann.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>"), every=2)
    assert few.count() == 6
    assert ann.nearest(table.limit(0)).count() == 0


def test_pipeline_stages_decide_by_row(spark):
    rng = random.Random(11)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    a, b, c, near = (fresh(40) for _ in range(4))
    rows = [(1, a, "s"), (1, a, "s"), (1, a, "s"), (None, b, "s"), (2, c, "s"), (2, a + " ", "s"), (3, near, "s"), (3, near + " end", "s"), (None, near + " off", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = exact_dedup.keep_first(docs)
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in docs.collect() if r.text != a]))
    one = jaccard_join.one_of_each(kept)
    assert sorted((r.doc_id or 0, r.text[:10]) for r in one.collect()) == sorted([(0, b[:10]), (2, c[:10]), (2, a[:10]), (3, near[:10])])
    mixed = mixing.mixed_documents(one)  # one source: its target is its size, so that each row is taken once
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, one.collect()))


def test_pipeline_keeps_columns_and_matches_its_stages(spark):
    import corpus_pipeline
    from strandline.llm import common

    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.staged(stage(spark, docs, folder), "test")
        assert docs.columns == columns and docs.count() > 0, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id").distinct()).select("doc_id").subtract(before.select("doc_id")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == docs.count() and out.where("n_tokens <> size(ids)").count() == 0


def test_jaccard_repeated_identifiers_with_other_texts(spark):
    """Rows of one identifier with different texts are linked each by its own text."""
    words = lambda a, n=30: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("a"), "s"), (1, words("b"), "s"), (3, words("b") + " z", "s"), (4, words("a") + " y", "s"), (5, words("c"), "s"), (4, words("c") + " x", "s"), (9, words("d"), "s")]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([(1, 26, 1), (1, 26, 1), (3, 27, 1), (4, 27, 1), (5, 26, 4), (4, 27, 4), (9, 26, 9)])


def test_jaccard_regions_by_weight(spark, monkeypatch):
    """A region of few sets with many shingles is cut into blocks too, with the same links."""
    monkeypatch.setattr(jaccard_join, "HELD", 600)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(24):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words), "s"))
    rows += [(100 + i, " ".join(f"y{i}.{k}" for k in range(50)), "s") for i in range(6)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, _ in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == label


def test_nearest_by_brute_force_and_in_parts(spark, monkeypatch):
    """Scores are the distances, recall reaches its target by an independent brute force, parts of queries change nothing."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, ann.nearest(table, k=5, every=10).collect()))
    monkeypatch.setattr(ann, "ASKED", 7)
    assert sorted(map(tuple, ann.nearest(table, k=5, every=10).collect())) == one
    hits = 0
    for q in range(0, 600, 10):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        true = sorted(range(600), key=lambda j: (d[j], j))[:5]
        own = [(r, j, s) for i, r, j, s in one if i == q]
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s - d[j]) < 1e-9 for _, j, s in own)
        hits += len({j for _, j, _ in own} & set(true))
    assert hits >= 0.9 * 300
