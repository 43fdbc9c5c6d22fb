"""Rehearsal and plans on fixtures, with loops in plain Python as the other side."""

import hashlib
import json
import random

import pytest

from strandline.operators import rehearsal
from strandline.sources import files

NIGHT = "u string, before string, target int"


def held(spark, rows):
    return spark.createDataFrame(rows, "u string, w string, part int, text string")


def taken(rows, user, seed, budget, known=lambda p: True):
    pool = [(hashlib.md5(f"{seed}:{u}:{w}:{part}:{n}".encode()).hexdigest(), p) for u, w, part, t in rows if u == user and t is not None for n, p in enumerate(p for p in t.split("\n\n") if len(p) > 100) if known(p)]
    out, used = [], 0
    for _, p in sorted(pool):
        if used >= budget:
            break
        out.append(p)
        used += len(p)
    return out


def test_draws_against_a_loop(spark):
    rng = random.Random(1)
    para = lambda: rng.choice(["No: ", ""]) + "x" * rng.randrange(90, 300)
    rows = [(u, f"w{i:02}", p, "\n\n".join(para() for _ in range(rng.randrange(6)))) for u in "ab" for i in range(20) for p in range(2)] + [("a", "w50", 0, None), ("c", "w00", 0, "short")]
    tonight = spark.createDataFrame([("a", "w99", 9000), ("b", "w99", 100), ("c", "w99", 500), ("d", "w99", 500)], NIGHT)
    plain = {r.u: r.text for r in rehearsal.rehearsal(held(spark, rows), tonight, "u", "w", 0.3, 5).collect()}
    boost = {r.u: r.text for r in rehearsal.rehearsal(held(spark, rows), tonight, "u", "w", 0.3, 5, 0.1, lambda p: p.startswith("No: ")).collect()}
    for u, target in (("a", 9000), ("b", 100), ("c", 500)):
        assert plain[u] == "\n\n".join(taken(rows, u, 5, 0.3 * target))
        known = taken(rows, u, "5/boost", 0.3 * 0.1 * target, lambda p: p.startswith("No: "))
        assert boost[u] == "\n\n".join(known) + "\n\n" + "\n\n".join(taken(rows, u, 5, 0.3 * 0.9 * target))
    assert plain["d"] == boost["d"] == "" and len(plain["a"]) >= 2700
    assert {r.text for r in rehearsal.rehearsal(held(spark, rows), tonight, "u", "w", 0.0, 5).collect()} == {""}
    with pytest.raises(ValueError, match="calibrate"):
        rehearsal.rehearsal(held(spark, rows), tonight, "u", "w", 0.3, 5, 0.1)


def test_only_published_earlier_windows_are_sources(spark):
    rows = [("a", "w1", 0, "one"), ("a", "w2", 0, "two"), ("a", "w3", 0, "three"), ("a", "w4", 0, "tonight")]
    state = spark.createDataFrame([("a", "w1", "consolidated", "published"), ("a", "w2", "consolidated", "failed"), ("a", "w3", "open", None), ("a", "w4", "consolidated", "published")], "u string, w string, state string, outcome string")
    tonight = spark.createDataFrame([("a", "w4", 10)], NIGHT)
    raw = rehearsal.sources("rawlog", tonight, "u", "w", blocks=held(spark, rows), windows=state)
    assert [r.text for r in raw.collect()] == ["one"]
    assert sorted(r.text for r in rehearsal.sources("amp", tonight, "u", "w", corpora=held(spark, rows)).collect()) == ["one", "three", "two"]
    with pytest.raises(ValueError, match="dream"):
        rehearsal.sources("dream", tonight, "u", "w")


def test_a_ledger_without_bodies_refuses(spark):
    tonight = spark.createDataFrame([("a", "w4", 10), ("b", "w4", 10)], NIGHT)
    entries = spark.createDataFrame([("a", "w1"), ("b", "w4")], "u string, w string")
    assert [r.text for r in rehearsal.without_bodies(entries, tonight, "u", "w", 0.0).collect()] == ["", ""]
    assert rehearsal.without_bodies(entries, tonight, "u", "w", 0.3).where("u = 'b'").first().text == ""
    with pytest.raises(Exception, match="no bodies"):
        rehearsal.without_bodies(entries, tonight, "u", "w", 0.3).collect()


def test_a_plan_keeps_the_order_of_its_file(spark, tmp_path):
    rows = [{"chunk_key": f"k{i * 7 % 500}", "t_start": "s", "t_end": "e", "audio": "x" * (i % 50)} for i in range(500)]
    (tmp_path / "plan.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        plan = files.replay_plan(spark, str(tmp_path / "plan.jsonl"))
        assert [r.chunk_key for r in plan.orderBy("place").collect()] == [r["chunk_key"] for r in rows]
        assert files.positional(spark, str(tmp_path / "plan.jsonl")).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "bad.jsonl").write_text('{"chunk_key": "k"}\n')
    with pytest.raises(Exception, match="lacks t_start"):
        files.replay_plan(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        files.replay_plan(spark, str(tmp_path / "empty.jsonl"))


def test_windows_of_one_user_meet_tonight_in_parts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(F.lit("u").alias("user_id"), F.format_string("w%05d", "id").alias("window_id"), F.lit(0).alias("part"), F.lit("t").alias("text"))
    tonight = spark.createDataFrame([("u", "w01500", 10)], "user_id string, before string, target int")
    set_to = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        got = rehearsal.sources("amp", tonight, "user_id", "window_id", corpora=rows)
        parts = got.groupBy(F.spark_partition_id()).count().collect()
        assert got.columns == ["user_id", "window_id", "part", "text"]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in parts) == 1500 and len(parts) > 1
