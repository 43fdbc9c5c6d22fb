"""Micro-batches that commit once, stages that go on after a kill, day-logs on demand, bounded streams."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import cycle, materialized, profiles, stagegraph
from strandline.operators.stages import Stages, key_of
from strandline.streaming import claims, continuity, ingest
from strandline.streaming.store import Store, Table


class Killed(RuntimeError):
    pass


def graph(version="v1"):
    r = stagegraph.Registry()
    r.add(stagegraph.Stage("asr", "asr", lambda: F.decode("data", "utf-8"), required=True, version=version))
    r.add(stagegraph.Stage("tags", "tags", lambda a: F.when(~a.startswith("holey"), F.upper(a)), needs=("asr",)))
    return r


def delivery(chunk, seq, bad=False):
    from hashlib import sha256

    return (chunk, "u", "audio", "2024-01-01T00:00:00Z", "2024-01-01T00:00:05Z", f"ref-{chunk}", "bad" if bad else sha256(chunk.encode()).hexdigest(), seq)


BATCHES = [
    [delivery("a", 1), delivery("a", 2), delivery("holey", 3), delivery("gone", 4), delivery("unknown", 5), delivery("torn", 6, True)],
    [delivery("a", 7), delivery("holey", 8), delivery("unknown", 9), delivery("b", 10)],
    [delivery("holey", 11), delivery("gone", 12), delivery("unknown", 13)],
    [delivery("holey", 14), delivery("unknown", 15)],
    [delivery("holey", 16), delivery("unknown", 17), delivery("b", 18)],
]


def blobs(spark):
    rows = [(f"ref-{c}", c.encode(), c == "gone") for c in ("a", "b", "holey", "gone", "torn")]
    return spark.createDataFrame(rows, "blob_ref string, data binary, deleted boolean")


def tables(held):
    rows = lambda t: sorted(map(str, held.read(t).collect()))
    return {t: rows(t) for t in ingest.TABLES}


def run(spark, path, every=2, repeat=False, die=None):
    held = ingest.store(spark, path, every)
    for n, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, ingest.DELIVERY)
        if die is not None and n == 2:

            def after(table, die=die):
                if table == die:
                    raise Killed(table)

            with pytest.raises(Killed):
                ingest.ingest(held, graph(), blobs(spark), after)(batch, n)
        for _ in range(2 if repeat else 1):
            ingest.ingest(held, graph(), blobs(spark))(batch, n)
    return held


def test_ingest_of_micro_batches(spark, tmp_path):
    held = run(spark, str(tmp_path / "one"))
    state = {r.chunk_id: r for r in held.read("ledger").collect()}
    assert (state["a"].state, state["a"].green, state["a"].heals, state["a"].done_final) == ("processed", True, 0, False)
    assert (state["holey"].state, state["holey"].green, state["holey"].heals, state["holey"].done_final) == ("processed", False, 3, True)
    assert (state["gone"].state, state["gone"].reason) == ("dead_letter", "bytes are deleted")
    assert (state["torn"].state, state["torn"].reason) == ("dead_letter", "bytes differ from their digest")
    assert (state["unknown"].state, state["unknown"].attempts) == ("dead_letter", ingest.ATTEMPTS)
    answers = {(r.chunk_id, r.seq): (r.verdict, r.record_id) for r in held.read("answers").collect()}
    assert [answers["a", s][0] for s in (1, 2, 7)] == ["fresh", "inflight", "skip"] and len({answers["a", s][1] for s in (1, 2, 7)}) == 1
    assert [answers["holey", s][0] for s in (3, 8, 11, 14, 16)] == ["fresh", "heal", "heal", "heal", "skip"]
    assert answers["gone", 12] == ("fresh", None)
    records = {r.chunk_id: r for r in held.read("records").collect()}
    assert set(records) == {"a", "b", "holey"} and records["holey"].batch == 0  # a heal that changes nothing rewrites nothing
    assert '"tags"' not in records["holey"].record_json and '"tags":{"value":"A"' in records["a"].record_json


@pytest.mark.parametrize("die", [None, "ledger"])
def test_ingest_again_and_after_a_kill(spark, tmp_path, die):
    plain = tables(run(spark, str(tmp_path / "plain"), every=100))
    assert tables(run(spark, str(tmp_path / "other"), every=2, repeat=die is None, die=die)) == plain


def test_another_version_moves_forward(spark, tmp_path):
    held = run(spark, str(tmp_path / "one"))
    batch = spark.createDataFrame([delivery("a", 50), delivery("holey", 51)], ingest.DELIVERY)
    ingest.ingest(held, graph("v2"), blobs(spark))(batch, len(BATCHES))
    state = {r.chunk_id: r for r in held.read("ledger").collect()}
    assert {c: (state[c].pipeline_version, state[c].superseded, state[c].heals) for c in ("a", "holey")} == {c: (graph("v2").version(), graph().version(), 0) for c in ("a", "holey")}
    # a heal whose bytes are lost keeps the record, and counts
    lost = blobs(spark).withColumn("deleted", F.lit(True))
    ingest.ingest(held, graph("v2"), lost)(spark.createDataFrame([delivery("holey", 52)], ingest.DELIVERY), len(BATCHES) + 1)
    row = held.read("ledger").where("chunk_id = 'holey'").first()
    assert (row.state, row.heals, row.record_id) == ("processed", 1, state["holey"].record_id)


def test_store_reads_snapshots(spark, tmp_path):
    held = Store(spark, str(tmp_path / "s"), {"t": Table("k long, v long", ("k",)), "log": Table("k long")}, every=3)
    want, log = {}, 0
    rng = random.Random(1)
    for n in range(8):
        own = {k: n for k in rng.sample(range(6), 3)}
        held.write("t", spark.createDataFrame(list(own.items()), "k long, v long"), n)
        held.write("log", spark.createDataFrame([(n,)], "k long"), n)
        assert {r.k: r.v for r in held.read("t").collect()} == want  # not committed yet
        held.commit(n)
        want |= own
        log += 1
        assert {r.k: r.v for r in held.read("t").collect()} == want and held.read("log").count() == log
    assert sorted(p.name for p in (tmp_path / "s" / "t.whole").glob("batch=*")) == ["batch=2", "batch=5"]
    assert held.last() == 7 and len(list((tmp_path / "s" / "commits").glob("[0-9]*"))) <= 2


def day_blocks(spark, window, users=("u1", "u3")):
    p = profiles.PROFILES["days"]
    rows = []
    for u in users:
        for b in range(3):
            rows.append((u, window, b, f"b{b}", b, f"day {b}: " + f"{u} went on {window} " * (12 if u != "u3" else 1), 0.9, {"day": str(b), "place": "town"}))
    assert set(p.anchors) == {"day", "place"}
    return spark.createDataFrame(rows, "user_id string, window_id string, block long, block_id string, first_bucket long, text string, quality double, anchors map<string,string>")


RECIPE, POLICY = cycle.Recipe("r1", ok_rate_min=0.5), {"min_probes": 120, "new_day_recall_min": 0.12, "traps_pass_min": 0.1, "heldout_alpha": 0.05, "heldout_backstop": 0.45, "heldout_probes": 60, "freeze": 2, "policy_id": "p1"}


def nights(spark, path, windows=("w1", "w2"), after=None, backend=None):
    stages = Stages(spark, path, cycle.OWNER, after)
    out = []
    for w in windows:
        out += [tuple(r) for r in cycle.night(stages, day_blocks(spark, w), RECIPE, POLICY, backend or cycle.mock()).collect()]
    return stages, sorted(out, key=str), sorted(tuple(r) for r in cycle.published(stages).collect())


def test_cycle_goes_on_after_any_kill(spark, tmp_path):
    plain, outcome, log = nights(spark, str(tmp_path / "plain"))
    assert {(u, w): s for u, w, s, *_ in outcome} == {(u, w): "aborted" if u == "u3" else "published" for u in ("u1", "u3") for w in ("w1", "w2")}
    assert [s for s, *_ in plain.ran] == ["daylog", "amplify", "mix", "train", "publish"] * 2
    texts = {(r[0], r[1]): r[-1] for r in log}
    assert "w1" in texts["u1", "w1"] and "w2" not in texts["u1", "w1"]
    again, same, _ = nights(spark, str(tmp_path / "plain"), ("w2",))
    assert same == [x for x in outcome if x[1] == "w2"] and all(new == 0 for _, new, _ in again.ran)
    for die in [("mix", "memo")]:
        path = str(tmp_path / "-".join(die))

        def after(stage, what, die=die):
            if (stage, what) == die:
                raise Killed(stage)

        with pytest.raises(Killed):
            nights(spark, path, after=after)
        went, *rest = nights(spark, path)
        assert rest == [outcome, log]
        order = ["daylog", "amplify", "mix", "train", "publish"]
        held = order.index(die[0]) + (die[1] == "memo")
        assert [new == 0 for _, new, _ in went.ran[:5]] == [i < held for i in range(5)]


def test_failed_nights_freeze_a_user(spark, tmp_path, monkeypatch):
    fail = cycle.Backend(cycle.mock().generate, cycle.mock().train, lambda rows: cycle.mock().evaluate(rows).withColumn("traps_pass", F.lit(0.0)))
    path = str(tmp_path / "n")
    monkeypatch.setitem(POLICY, "freeze", 1)
    _, outcome, log = nights(spark, path, ("w1", "w3"), backend=fail)
    assert {s for u, w, s, *_ in outcome if u == "u1" and w == "w1"} == {"gate_failed"}
    assert {s for u, w, s, *_ in outcome if u == "u1" and w == "w3"} == {"frozen"}
    assert all(r[-1] is None for r in log)
    stages = Stages(spark, path, cycle.OWNER)
    forced = {r.user_id: r.status for r in cycle.night(stages, day_blocks(spark, "w3", ("u1",)), RECIPE, POLICY, cycle.mock(), force=True).collect()}
    assert forced == {"u1": "published"}


def test_stages_build_only_what_changed(spark, tmp_path):
    stages, built = Stages(spark, str(tmp_path / "s"), ("o",)), []

    def build(own):
        built.append(sorted(r.o for r in own.collect()))
        return own.select("o", F.lit(len(built)).alias("n"))

    ask = lambda rows: sorted(tuple(r) for r in stages.run("x", spark.createDataFrame(rows, "o string, v int").select("o", key_of(F.col("v")).alias("key")), "o string, n int", build)[0].collect())
    assert ask([("a", 1), ("b", 1)]) == [("a", 1), ("b", 1)]
    assert ask([("a", 2), ("b", 1), ("c", None)]) == [("a", 2), ("b", 1), ("c", 2)]
    assert ask([("a", 1)]) == [("a", 1)]
    assert built == [["a", "b"], ["a", "c"]]


def test_profiles(spark):
    p = profiles.PROFILES["days"]
    rows = [("x" * 130 + " 4", "4"), ("x" * 130, "4"), ("x 4", "4"), ("RECORD " + "x" * 130 + " 4", "4"), (None, "4")]
    df = spark.createDataFrame(rows, "t string, day string").select("t", F.create_map(F.lit("day"), F.col("day")).alias("a"))
    assert [r[0] for r in df.select(p.valid(F.col("t"), F.col("a"))).collect()] == [True, False, False, False, False]
    said = spark.createDataFrame([("Contrary to what you heard, no.",), ("It rained.",), ("x" * 300 + " did not",)], "t string")
    assert [r[0] for r in said.select(p.calibrates(F.col("t"))).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        profiles.PROFILES["nights"]
    with pytest.raises(ValueError):
        profiles.PROFILES.add("days", p)
    blocks = day_blocks(spark, "w1")
    jobs = profiles.planned(blocks, p, 4, 0.25, 3, cycle.OWNER)
    assert jobs.count() == 24 and 2 <= jobs.where("negative").count() <= 18
    assert jobs.where("not negative").select("style").distinct().count() == len(p.styles)
    assert profiles.planned(blocks, p, 2, 0.0, 3, cycle.OWNER).where("negative").count() == 0


def test_day_logs_on_demand(spark, tmp_path):
    held = materialized.store(spark, str(tmp_path / "d"))
    windows = spark.createDataFrame([("a", "w1"), ("a", "w2"), ("b", "w1"), ("c", "w1")], "user_id string, window_id string")
    asked = []

    def build(todo):
        asked.append(sorted((r.user_id, r.window_id, r.home_tz) for r in todo.collect()))
        return todo.where("window_id = 'w1'").select("user_id", "window_id", F.lit(2).alias("n_blocks"), F.concat("user_id", F.lit("/"), "home_tz").alias("corpus"), F.lit("f").alias("content_fingerprint"))

    def fetch(profiles_, version="1"):
        home = spark.createDataFrame(profiles_, "user_id string, home_tz string")
        return {(r.user_id, r.window_id): (r.state, r.corpus) for r in materialized.fetched(held, windows, home, version, "r", build).collect()}

    assert fetch([("a", "UTC"), ("b", "UTC")]) == {("a", "w1"): ("built", "a/UTC"), ("a", "w2"): ("built", ""), ("b", "w1"): ("built", "b/UTC"), ("c", "w1"): ("refused", None)}
    assert fetch([("a", "UTC"), ("b", "X")])["b", "w1"] == ("built", "b/X") and asked[-1] == [("b", "w1", "X")]
    assert fetch([("a", "UTC")]) == {("a", "w1"): ("cached", "a/UTC"), ("a", "w2"): ("cached", ""), ("b", "w1"): ("cached", "b/X"), ("c", "w1"): ("refused", None)}
    materialized.forgotten(held, windows.where("user_id = 'a' and window_id = 'w1'"))
    assert fetch([("a", "UTC")])["a", "w1"] == ("built", "a/UTC") and asked[-1] == [("a", "w1", "UTC")]
    assert fetch([("a", "UTC")], "2")["a", "w2"] == ("built", "")


def stream_of(spark, tmp_path, batches, schema):
    """A file stream with one batch a file."""
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_first_deliveries_within_a_watermark(spark, tmp_path):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    batches = [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(30)), ("c", at(200))], [("d", at(400))], [("d", at(401)), ("c", at(210)), ("a", at(400))]]
    rows = stream_of(spark, tmp_path, batches, "chunk_id string, _at string").select("chunk_id", F.to_timestamp("_at").alias("at"))
    q = claims.first_deliveries(rows, "1 hour").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = sorted((r.chunk_id, r.at.hour * 60 + r.at.minute) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # late repeats inside the hour are gone, a later one (a at 400) is a delivery of its own, c at 210 came behind the watermark
    assert [x for x in got if x[0] != "a"] == [("b", 1), ("c", 200), ("d", 400)] and [m for c, m in got if c == "a"] in ([0, 400], [2, 400])
    # once the watermark passed the expiry (400 - 60 + ...), only the newest keys are held
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_tracked_continuity_forgets_chunks(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, continuity.PROVIDER)
    try:
        minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
        batches = [
            [(1, 0, "a", minute(0)), (1, 1, "b", minute(1)), (1, 0, "x", minute(2)), (2, 5, "p", minute(0))],
            [(1, 3, "c", minute(100)), (1, 1, "b", minute(101)), (1, 1, "y", minute(102))],
            [(1, 2, "d", minute(300)), (2, 6, "q", minute(300))],
            [(1, 9, "n", minute(600))],
            [(2, 7, "r", minute(610))],
            [(1, 1, "z", minute(620)), (1, 9, "m", minute(621))],
        ]
        rows = stream_of(spark, tmp_path, batches, "stream_id long, sequence long, chunk_id string, _at string").withColumn("at", F.to_timestamp("_at"))
        seen = []
        q = continuity.tracked(rows, "3 hours").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    last = {r[0]: r for r in seen}
    # 0/x, 1/y and 9/m are conflicts; by the time of 1/z the chunk of number 1 is forgotten, so that it is a duplicate like 1/b
    assert last[1] == (1, 5, 2, 3, 9, "0-3,9-9", 2) and last[2][:6] == (2, 3, 0, 0, 7, "5-7")


def test_joined_runs():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        held, lo, hi = set(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _ in range(4):
            new = [x for x in rng.sample(range(40), rng.randint(0, 12)) if x not in held]
            held |= set(new)
            lo, hi = continuity.joined(lo, hi, np.array(new, np.int64))
            assert {x for a, b in zip(lo, hi) for x in range(a, b + 1)} == held
            assert all(a > b + 1 for a, b in zip(lo[1:], hi[:-1]))


def test_ingested_chunks_makes_its_blobs_once(spark, monkeypatch):
    """Every micro-batch joins the written blobs instead of making them from the events again."""
    from strandline.plans import ingest_queries

    seen, own = [], ingest.ingest
    monkeypatch.setattr(ingest, "ingest", lambda held, registry, blobs, after=None: seen.append(blobs.inputFiles()) or own(held, registry, blobs, after))
    assert ingest_queries.ingested_chunks(spark, "/root/testdata/sf0.001").count()
    assert seen and not any("events" in f for files in seen for f in files)


def test_nightly_cycle_makes_its_blocks_once(spark, monkeypatch):
    """Both nights read the written blocks instead of making them from the events again."""
    from strandline.plans import ingest_queries

    seen, own = [], ingest_queries.cycle.night
    monkeypatch.setattr(ingest_queries.cycle, "night", lambda stages, blocks, *more: seen.append(blocks.inputFiles()) or own(stages, blocks, *more))
    assert ingest_queries.nightly_cycle(spark, "/root/testdata/sf0.001").count()
    assert len(seen) == 2 and not any("events" in f for files in seen for f in files)
