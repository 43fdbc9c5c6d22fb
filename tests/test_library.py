"""Operators, functions, sources and streams against brute force and fixtures."""

import itertools
import json
import math
import random
import time
import wave
from collections import Counter
from difflib import SequenceMatcher
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import checks, repair, stats, text, timeaxis
from strandline.operators import continuity, daylog, folds, ledgers, ranges, records, stagegraph
from strandline.sources import files
from strandline.streaming import claims


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_blocks_equal_the_literal_loop(spark):
    rng = random.Random(1)
    rows = [(u, b, f"l{b}", 1) for u in range(6) for b in sorted(rng.sample(range(120), 40))]
    got = daylog.blocks(spark.createDataFrame(rows, "user_id int, bucket long, line string, n long"), 10).collect()
    for u in range(6):
        want, held = [], []
        for b in [r[1] for r in rows if r[0] == u]:
            if held and (b - held[-1] - 1 > daylog.GAP_SEGMENTS or len(held) >= daylog.BLOCK_SEGMENTS):
                want.append(held)
                held = []
            held.append(b)
        want.append(held)
        own = sorted((r for r in got if r.user_id == u), key=lambda r: r.first_bucket)
        assert [r.text for r in own] == ["\n".join(f"l{b}" for b in w) for w in want]
        assert [r.block_id for r in own] == [f"w_b{i:04d}" for i in range(len(want))]


def test_latest_keeps_rows_without_chunk(spark):
    rows = [(1, "c", 5, 1), (2, "c", 5, 1), (3, None, 1, 1), (4, None, 1, 1)]
    df = spark.createDataFrame(rows, "event_id long, chunk_id string, updated_at long, user_id long")
    assert {r.event_id for r in daylog.latest_per_chunk(df).collect()} == {2, 3, 4}


def test_upsert_ignores_equal_bodies(spark):
    log = spark.createDataFrame([(1, "a", "x", 10), (2, "a", "x", 20), (3, "a", "y", 30), (4, "b", None, 5), (5, "b", None, 6)], "seq long, id string, body string, at long")
    got = {r.id: r for r in records.compare_and_upsert(log, "id", "body", "at").collect()}
    assert (got["a"].created_at, got["a"].updated_at, got["a"].n_changes) == (10, 30, 2)
    assert (got["b"].created_at, got["b"].updated_at, got["b"].n_changes) == (5, 5, 1)


def test_retract_needs_a_selector(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    with pytest.raises(ValueError):
        records.retract(df, {})
    assert records.retract(df, {"v": "a"}).count() == 1


@pytest.mark.parametrize("seqs", [[0, 1, 2], [0, 3, 4, 9], [5], [2, 2, 2, 0]])
def test_runs_and_gaps(spark, seqs):
    df = spark.createDataFrame([(1, s) for s in seqs], "stream long, seq long")
    runs = continuity.runs(df, "stream", "seq")
    held = {x for r in runs.collect() for x in range(r.lo, r.hi + 1)}
    missing = {x for r in continuity.gaps(runs, "stream").collect() for x in range(r.lo, r.hi + 1)}
    assert held == set(seqs) and missing == set(range(max(seqs))) - set(seqs)
    info = continuity.missing_info(df, "stream", "seq", 3).first()
    assert info.n_missing == len(missing) and info.missing == sorted(missing)[:3]


def test_range_joins_equal_brute_force(spark):
    rng = random.Random(4)
    a = [(i, s := rng.randrange(200), s + rng.randrange(0, 30)) for i in range(60)]
    b = [(chr(97 + i % 7), s := rng.randrange(200), s + rng.randrange(1, 60)) for i in range(40)]
    left = spark.createDataFrame(a, "key int, a_start long, a_stop long")
    right = spark.createDataFrame(b, "label string, b_start long, b_stop long")
    got = {r.key: (r.label, r.overlap) for r in ranges.best_overlap(left, right, 25, "key", "label").collect()}
    for i, s, e in a:
        met = [(-(min(e, y) - max(s, x)), n) for n, x, y in b if s < y and x < e]
        assert got[i] == ((min(met)[1], -min(met)[0]) if met else (None, None))
    n = sum(x <= s < y for _, s, _ in a for _, x, y in b)
    assert ranges.in_interval(left, right, 25, "a_start", "b_start", "b_stop").count() == n
    near = {r.key: r.b_start for r in ranges.nearest(left, right.select("b_start").distinct(), 5, "key", "a_start", "b_start").collect()}
    for i, s, _ in a:
        met = [(abs(s - x), -x) for _, x, _ in b if abs(s - x) <= 5]
        assert near[i] == (-min(met)[1] if met else None)


def test_ledgers(spark):
    log = spark.createDataFrame([(1, 1, "a", "active"), (1, 2, "b", "active"), (1, 3, "a", "rolled_back"), (1, 4, "b", "rolled_back"), (1, 5, "c", "gate_failed")], "u int, pos int, name string, status string")
    assert ledgers.active_stack(log, "u", "pos", "name", "status").first().stack == ["a"]
    pool = spark.createDataFrame([(1, i, 4) for i in range(6)], "g int, i int, size int")
    assert ledgers.take_budget(pool, "g", "size", 10, "i").count() == 3
    out = spark.createDataFrame([(1, d, d == 2) for d in range(6)] + [(2, d, True) for d in range(2)] + [(3, 0, False), (3, 0, False)], "u int, d int, ok boolean")
    assert {r.u: (r.strikes, r.frozen) for r in ledgers.strikes(out, "u", "d", "ok", 3).collect()} == {1: (3, True), 2: (0, False), 3: (1, False)}
    even = ledgers.even_subset(spark.range(20).withColumn("g", F.lit(1)), "g", 4, "id").collect()
    assert sorted(r.id for r in even) == [round(i * 19 / 3) for i in range(4)]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.squeezed(lit(" a  b\n"))) == "a b"
    assert one(spark, text.cut_at_word(lit("hello brave world"), 12)) == "hello brave"
    assert one(spark, text.cut_at_word(lit("abcdefghijkl"), 5)) == "abcde"
    assert one(spark, text.cut_at_sentence(lit("One two. Three four five."), 14)) == "One two."
    cards = one(spark, text.redaction(lit("card 4111 1111 1111 1111 not 4111 1111 1111 1112")))
    assert (cards.text, cards.n) == ("card [redacted:secret] not 4111 1111 1111 1112", 1)
    assert one(spark, text.tokens(lit("The cat, a dog!"))) == ["cat", "dog"]
    assert one(spark, text.token_f1(text.tokens(lit("cat cat dog")), text.tokens(lit("cat dog dog")))) == pytest.approx(2 / 3)
    assert one(spark, text.order_score(lit("b then a then c"), ["a", "b", "c"])) == pytest.approx(2 / 3)
    assert one(spark, text.caption(lit("App"), lit(" "), lit("does"))) == "App. does"
    assert one(spark, text.n_words(lit("  "))) == 0
    assert [len(c) for c in one(spark, text.flat_chunks(F.sequence(lit(1), lit(50)), 20))] == [20, 20]
    s = one(spark, text.split_once(lit("a\u001eb\u001ec"), "\u001e"))
    assert (s.text, s.tail) == ("a", "b\u001ec")
    assert one(spark, text.char_budget(lit(2.5), 1.0)) == 2


def test_time_functions(spark):
    t = timeaxis.instant(F.lit("2024-03-31T01:30:00.5+00:00"))
    assert one(spark, timeaxis.iso(t)) == "2024-03-31T01:30:00.500000Z"
    assert one(spark, timeaxis.window_id(timeaxis.instant(F.lit("2024-03-31T01:30:00Z")))) == "w20240331T013000Z"
    a, b = timeaxis.local_day(F.lit("2024-03-31").cast("date"), "Europe/Paris")
    assert one(spark, timeaxis.span_seconds(a, b)) == 23 * 3600
    assert one(spark, timeaxis.next_floor(F.lit(60.0), 30)) == 90
    zones = spark.createDataFrame([("Asia/Tokyo",)], "zone string")
    rows = spark.createDataFrame([("Asia/Tokyo",), ("Nowhere/X",), (None,)], "z string").withColumn("t", timeaxis.instant(F.lit("2024-01-01T00:00:00Z")))
    got = {r.z: r.l for r in timeaxis.civil(rows, "t", "z", zones, "Europe/Paris").select("z", F.date_format("local", "HH").alias("l")).collect()}
    assert got == {"Asia/Tokyo": "09", "Nowhere/X": "01", None: "01"}


def test_statistics(spark):
    a, b = [1.0, 2.0, 3.5, 4.0], [3.0, 4.5, 5.0, 6.0, 2.0]
    pooled, seen = a + b, abs(np.mean(a) - np.mean(b))
    splits = [abs(np.mean(c) - (sum(pooled) - sum(c)) / len(b)) for c in itertools.combinations(pooled, len(a))]
    got = stats.permutation_test(spark, a, b).first()
    assert got.n_splits == math.comb(9, 4) and got.n_extreme == sum(x >= seen - 1e-12 for x in splits)
    df = spark.createDataFrame([(3, 4, 1, 5), (0, 0, 1, 5)], "a int, n int, b int, m int")
    p = [r.p for r in df.select(stats.fisher_greater("a", "n", "b", "m").alias("p")).collect()]
    assert p[0] == pytest.approx(sum(math.comb(4, k) * math.comb(5, 4 - k) for k in (3, 4)) / math.comb(9, 4)) and p[1] is None
    values = spark.createDataFrame([(float(v),) for v in range(100)], "v double")
    hist = stats.histogram(values, "v", [10.0, 50.0])
    assert {r.le: r.n for r in hist.collect()} == {"10": 11, "50": 51, "+Inf": 100}
    assert stats.bucket_quantile(hist.withColumn("g", F.lit(1)), 0.31, "g").first().quantile == pytest.approx(30.0)


def test_checks(spark):
    for x, ok in (("w20240101T000000Z", True), ("w20240101T000000Z\n", False), ("w2024", False), (None, False)):
        assert one(spark, checks.fullmatch(F.lit(x).cast("string"), checks.WINDOW_ID)) is ok
    assert one(spark, checks.fullmatch(F.lit("a..b"), checks.PATH_ID)) is False
    assert one(spark, checks.empty_claim(F.lit(" "), F.lit(None).cast("array<int>"))) is True
    v = checks.violations({"b": (F.lit(None).cast("boolean"), "missing"), "a": (F.lit(False), "bad"), "c": (F.lit(True), "")})
    assert one(spark, v) == ["a: bad", "b: missing"]
    g = one(spark, checks.gate({"x": F.lit(True), "y": F.lit(False)}))
    assert (g.passed, g.reasons) == (False, "y")


def test_folds_equal_loops(spark):
    rng = random.Random(5)
    rows = [(g, i, "".join(rng.choices("ab", k=6))) for g in range(4) for i in range(20)]
    got = {(r.g, r.i) for r in folds.drop_near_repeats(spark.createDataFrame(rows, "g int, i int, t string"), "g", "i", "t", 0.8).collect()}
    want = set()
    for g in range(4):
        last = None
        for _, i, t in (r for r in rows if r[0] == g):
            if last is None or SequenceMatcher(None, last, t).ratio() < 0.8:
                want.add((g, i))
                last = t
    assert got == want
    levels = spark.createDataFrame([(1, i, 0.0 if i in (14, 15, 16) else 50.0 if i % 4 == 0 else 1000.0) for i in range(60)], "g int, i int, level double")
    cuts = folds.cut_points(levels, "g", "i", "level", 3, 10, 25)
    assert sorted(r.cut for r in cuts.collect()) == [15, 40]
    totals = spark.createDataFrame([(1, 60), (2, 5)], "g int, total long")
    assert sorted((r.g, r.start, r.stop) for r in folds.adjacent_spans(cuts, totals, "g", "total").collect()) == [(1, 0, 15), (1, 15, 40), (1, 40, 60), (2, 0, 5)]


@pytest.mark.parametrize(
    ("reply", "step", "app"),
    [
        ('{"app": "A"}', "strict", "A"),
        ('```json\n{"application": "A"}\n```', "fenced", "A"),
        ('So: {"app": "A {x}"} done', "balanced", "A {x}"),
        ("{“app”: “A”,}", "mended", "A"),
        ('{"app": "A", "activity": "b', "salvaged", "A"),
        ("just words", "text", None),
        ("  ", "empty", None),
        (None, "empty", None),
        ("{" * 20000, "text", None),
    ],
)
def test_reply_repair(reply, step, app):
    got = repair.repaired(reply)
    assert (got["step"], got["app"]) == (step, app)


def test_stage_graph(spark):
    r = stagegraph.Registry()
    r.add(stagegraph.Stage("a", "sa", lambda: F.col("v"), required=True))
    r.add(stagegraph.Stage("b", "sb", lambda x: F.when(x > 1, x), needs=("sa",)))
    r.add(stagegraph.Stage("c", "sc", lambda x: x + 1, needs=("sb",)))
    got = stagegraph.enrich(spark.createDataFrame([(1,), (2,), (None,)], "v int"), r).collect()
    assert [(x.sa.status, x.sb.status, x.sc.status, x.record_ok) for x in got] == [("ok", "failed", "cancelled", True), ("ok", "ok", "ok", True), ("failed", "cancelled", "cancelled", False)]
    with pytest.raises(ValueError):
        r.add(stagegraph.Stage("a", "other", lambda: F.lit(1)))
    bad = stagegraph.Registry()
    bad.add(stagegraph.Stage("x", "sx", lambda y: y, needs=("sy",)))
    bad.add(stagegraph.Stage("y", "sy", lambda x: x, needs=("sx",)))
    with pytest.raises(ValueError, match="cycle"):
        bad.resolved()


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 3]
    assert files.torn_lines(spark, str(tmp_path / "x.jsonl"), "a int").count() == 1
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg" / "r1.json").write_text(json.dumps({"id": "r1", "v": 2}))
    assert files.registry(spark, str(tmp_path / "reg"), "id string, v int").first().v == 2
    (tmp_path / "reg" / "r2.json").write_text(json.dumps({"id": "zz", "v": 2}))
    with pytest.raises(Exception, match="differs"):
        files.registry(spark, str(tmp_path / "reg"), "id string, v int").collect()
    (tmp_path / "q.txt").write_text("q0\nq1\n")
    (tmp_path / "g.txt").write_text("g0\ng1\n")
    pair = files.zipped(files.positional(spark, str(tmp_path / "q.txt")), files.positional(spark, str(tmp_path / "g.txt")))
    assert sorted((r.question, r.gold) for r in pair.collect()) == [("q0", "g0"), ("q1", "g1")]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(np.full(250, 100, "<i2").tobytes())
    got = files.wav_chunks(spark, str(tmp_path / "a.wav"), 1.0).collect()
    assert [(r.chunk, r.stop_s) for r in got] == [(0, 1.0), (1, 2.0), (2, 2.5)] and got[0].rms == 100.0
    blocks = files.anchored_blocks(spark.createDataFrame([("b", "t", 3, None)], "block_id string, text string, day int, zone string"))
    assert blocks.first().anchors == {"day": "3"}
    line = files.exposition(spark.createDataFrame([('a"b\\', 2)], "l string, n long"), "m", "n", "l").first().line
    assert line == 'm{l="a\\"b\\\\"} 2'
    assert files.synthetic(spark, 50, 3).exceptAll(files.synthetic(spark, 50, 3)).count() == 0


DELIVERY = "chunk_id string, seq long, version string, ok boolean"


def test_claim_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"c{rng.randrange(8)}", i, "v1" if i < 60 else "v2", rng.random() < 0.5) for i in range(120)]
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], DELIVERY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(T.StructType.fromDDL(DELIVERY)).parquet(str(tmp_path / "in"))
    q = claims.claims_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = claims.claims_batch(spark.createDataFrame(rows, DELIVERY))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 120


def test_claims_are_kept_by_buckets(spark, tmp_path, monkeypatch):
    """The fold is called once a bucket, not once a chunk; numbers keep all their digits beside null ones."""
    monkeypatch.setattr(claims, "BUCKETS", 4, raising=False)
    rng = random.Random(8)
    rows = [(f"c{rng.randrange(60)}", 2**60 + i, rng.choice(("v1", "v2")), rng.random() < 0.5) for i in range(300)]
    for k in range(3):
        part = rows[k * 100 : k * 100 + 100] + ([("none", None, "v1", True)] if k == 2 else [])
        spark.createDataFrame(part, DELIVERY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(T.StructType.fromDDL(DELIVERY)).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = claims.claims_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 4
    got = spark.read.parquet(str(tmp_path / "out"))
    want = claims.claims_batch(spark.createDataFrame([*rows, ("none", None, "v1", True)], DELIVERY)).select(got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 301


def test_continuity_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    kinds = "stream_id long, sequence long, chunk_id string, at long"
    rows = [(rng.randrange(3), rng.randrange(12), f"c{rng.randrange(2)}", i) for i in range(60)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(T.StructType.fromDDL(kinds)).parquet(str(tmp_path / "in"))
    seen = []
    q = claims.continuity_stream(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: seen.extend(df.collect())).start()
    q.awaitTermination(120)
    want = {r.stream_id: r for r in claims.continuity_batch(spark.createDataFrame(rows, kinds)).collect()}
    assert len(seen) == 3
    for r in seen:
        w = want[r.stream_id]
        assert (r.received, r.duplicates, r.conflicts, r.max_sequence, r.runs) == (w.received, w.duplicates, w.conflicts, w.max_sequence, w.runs)


def test_near_repeats_compare_whole_texts(spark, tmp_path):
    from strandline.plans import catalogue

    head = "the same words stand at the beginning of every turn of this talk, "
    texts = [head + "a" * 90, head + "b" * 90, head + "b" * 89 + "c"]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.queries()["near_repeats"](spark, str(tmp_path)).collect()
    assert sorted((r.turn, r.text) for r in got) == [(0, texts[0]), (1, texts[1])]


def test_fisher_of_large_samples():
    exact = lambda a, n, b, m: Fraction(sum(math.comb(a + b, k) * math.comb(n + m - a - b, n - k) for k in range(a, min(a + b, n) + 1)), math.comb(n + m, n))
    for row in [(3, 4, 1, 5), (0, 4, 0, 5), (4, 4, 5, 5), (0, 7, 7, 7), (7, 7, 0, 7), (1500, 2000, 1100, 2500), (700, 2000, 1100, 2500)]:
        assert stats._fisher(*row) == float(exact(*row))
    begin = time.monotonic()
    # the normal tail, with the correction for whole numbers: with numbers of a million digits this took hours
    n, a, b = 10**6, 501_000, 500_000
    z = (a - 0.5 - (a + b) / 2) / math.sqrt(n * n * (a + b) * (2 * n - a - b) / ((2 * n) ** 2 * (2 * n - 1)))
    assert stats._fisher(a, n, b, n) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-4)
    assert stats._fisher(n, n, 0, n) == 0.0 and stats._fisher(0, n, n, n) == 1.0
    assert time.monotonic() - begin < 30


def test_fisher_of_null_counts(spark):
    df = spark.createDataFrame([(None, 4, 1, 5), (3, 4, 1, 5)], "a int, n int, b int, m int")
    assert [r.p is None for r in df.select(stats.fisher_greater("a", "n", "b", "m").alias("p")).collect()] == [True, False]


def test_redaction_counts_and_reads_once(spark):
    import re

    def plain(x):
        n = 0
        for pattern in text.SECRETS:
            x, k = re.subn(pattern, text.REDACTED, x)
            n += k
        return x, n

    key = "AKIA" + "A1B2" * 4
    texts = [key, f"[redacted:secret]{key}[redacted:secret]", f"a {key} sk-{'x' * 20} {'Q' * 40}== ****** end", "[redacted:secret", "", "-----BEGIN KEY----- xoxb-" + "1a" * 8, "ghp_" + "a" * 24 + "[redacted:" + "b" * 33 + "]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "4111 1111 1111 1111 and 4111 1111 1111 1111 and 4111 1111 1111 1112"])], "i int, t string")
    got = df.select("i", text.redaction(F.col("t")).alias("r")).select("i", "r.n", "r.text", F.md5("r.text").alias("h"))
    held = [(r.text, r.n) for r in sorted(got.collect())]
    assert held[:-2] == [plain(t) for t in texts] and held[-2] == (None, None)
    assert held[-1] == ("[redacted:secret] and [redacted:secret] and 4111 1111 1111 1112", 2)
    # every rule runs once over a text
    assert got._jdf.queryExecution().optimizedPlan().toString().count("AKIA") == 1


def test_token_f1_of_long_texts(spark):
    pairs = [([], []), (["a"], []), (["b", "a", "b"], ["b", "b", "b", "c"]), (["w"] * 60_000 + [str(i) for i in range(60_000)], [str(i % 50_000) for i in range(100_000)])]
    df = spark.createDataFrame([(i, g, h) for i, (g, h) in enumerate(pairs)], "i int, g array<string>, h array<string>").cache()
    df.count()
    begin = time.monotonic()
    got = [r.f1 for r in sorted(df.select("i", text.token_f1(F.col("g"), F.col("h")).alias("f1")).collect())]
    both = [sum((Counter(g) & Counter(h)).values()) for g, h in pairs]
    assert got == [2.0 * b / (len(g) + len(h)) if b else 0.0 for b, (g, h) in zip(both, pairs)]
    assert time.monotonic() - begin < 30
