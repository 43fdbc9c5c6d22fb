"""Packs and recipes against a plain parser, replies against any chunking."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import packs
from strandline.streaming import replies

GOOD = "---\nid: a\nrole: clip\nscenario: x, y\nmax_tokens: 9\ntemperature: 0.5\nschema: s\n---\n\n[system]\nBe brief.  \n\nReally.\n\n[user]\nWhat is it: [system] or [user]?\n\n"


def parsed(spark, texts, schemas=(("s", '{"b":1, "a":2}'),)):
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    return packs.packs(files, spark.createDataFrame(list(schemas), "schema_name string, schema string"))


def test_packs(spark):
    texts = [
        GOOD, GOOD.replace("\n", "\r\n"), "[system]\ns\n[user]\nu", "---\nid: a\nrole: b\n[system]\ns\n[user]\nu", "---\nid: a\nrole: b\n---\n[user]\nu\n[system]\ns", GOOD.replace("schema: s", "schema: t"),
        GOOD.replace("0.5", "warm"), GOOD.replace("schema: s", "schema: NONE"), "---\nid: a\nid: b\nrole: r: q\n---\n[system]\n[user]\n", None,
    ]
    got = {r.n: r for r in parsed(spark, texts).collect()}
    one = got[0]
    assert (one.id, one.role, one.scenarios, one.max_tokens, one.temperature, one.schema, one.faults) == ("a", "clip", ["x", "y"], 9, 0.5, '{"a":2,"b":1}', [])
    assert one.system == "Be brief.  \n\nReally." and one.user == "What is it: [system] or [user]?"
    assert got[1].system == one.system and got[1].user == one.user
    assert got[2].faults == ["no id or role"] and got[2].max_tokens == 512 and got[2].temperature == 0.0
    assert got[3].faults[0] == "the front matter is not closed" and got[4].faults == ["no [system] section with a [user] section after it"]
    assert got[5].faults == ["an unknown schema"] and got[6].faults == ["max_tokens or temperature is no number"]
    assert got[7].schema == "{}" and got[7].faults == [] and (got[8].id, got[8].role, got[8].system, got[8].user) == ("b", "r: q", "", "")


def test_pack_digests(spark):
    held = parsed(spark, [GOOD, GOOD.replace("brief.  ", "brief."), GOOD.replace("brief", "long"), GOOD.replace("max_tokens: 9", "max_tokens: 8")])
    form = "\x1e".join(["id=a", "role=clip", "max_tokens=9", "temperature=0.5", 'schema={"a":2,"b":1}', "system=\nBe brief.\n\nReally.", "user=\nWhat is it: [system] or [user]?"])
    got = [r.digest for r in packs.pack_digests(held).orderBy("n").collect()]
    assert got[0] == got[1] == hashlib.sha256(form.encode()).hexdigest()[:8] and len(set(got)) == 3
    two = parsed(spark, [GOOD.replace("id: a", "id: z"), GOOD]).withColumn("g", F.lit(1))
    whole = "\0".join([form, form.replace("id=a", "id=z")]) + "\0ROUTES\0" + '{"a":1,"b":{}}'
    assert packs.set_digest(two, F.lit('{"b": {}, "a": 1}'), "g").first().digest == hashlib.sha256(whole.encode()).hexdigest()[:8]
    with pytest.raises(Exception, match="has faults"):
        packs.pack_digests(parsed(spark, ["nothing"])).collect()


def test_recipes(spark):
    whole = {"recipe_id": "r", "note": "n", "amplify": {"variants": 48, "neg_frac": 0.15, "ok_rate_min": 0.85}, "replay": {"frac": 0.3, "source": "amp", "neg_boost": 0}, "train": {"lora_r": 8, "lora_alpha": 16, "lr": 1e-4, "epochs": 3, "batch_size": 2, "chunk_tokens": 1024, "objective": "o"}, "corpus": {"quality_min": 0.5, "block_segments": 12, "segment_seconds": 10}, "window": {"boundary_local_time": "04:00"}}
    less = json.loads(json.dumps(whole))
    del less["train"]["lr"], less["window"]
    less["amplify"]["variants"] = "many"
    files = spark.createDataFrame([(0, json.dumps(whole)), (1, json.dumps(less)), (2, "[]"), (3, "{"), (4, None)], "n int, text string")
    got = {r.n: r for r in packs.artifacts(files, packs.RECIPE).collect()}
    assert (got[0].recipe_id, got[0].amplify_variants, got[0].replay_neg_boost, got[0].train_lr, got[0].faults) == ("r", 48, 0.0, 1e-4, [])
    assert sorted(got[1].faults) == ["amplify.variants: no int", "train.lr: missing", "window.boundary_local_time: missing"] and got[1].train_epochs == 3
    assert got[2].faults == got[3].faults == got[4].faults == ["no JSON object"]


REPLIES = {"a": "héllo \U0001f600 wörld\x1e{\"id\": [1, \"é\x1e\"]}".encode(), "b": b"no frame", "c": b"x\x1e  ", "d": b"\x1e[1]", "e": "é".encode() + b"\x1e{", "f": b"", "g": b"plain\x1e {\"z\": 1, \"a\": null}\n"}
WANT = {"a": ("héllo \U0001f600 wörld", None), "b": ("no frame", "missing end frame"), "c": ("x", "missing end frame"), "d": ("", "the end frame is no object"), "e": ("é", "malformed end frame"), "f": ("", "missing end frame"), "g": ("plain", None)}


def cuts(seed):
    rng, rows = random.Random(seed), []
    for key, data in REPLIES.items():
        at, n = 0, 0
        while at < len(data) or not n:
            size = rng.randint(1, 4)
            rows.append((key, n, bytearray(data[at : at + size]), at + size >= len(data)))
            at, n = at + size, n + 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_replies_in_any_chunks(spark, tmp_path, seed):
    rows = cuts(seed)
    kind = "reply string, n long, data binary, last boolean"
    whole = replies.split_replies(spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), kind), "reply", "n", "data")
    got = {r.reply: (r.answer, r.error) for r in whole.collect()}
    frames = {r.reply: r.frame for r in whole.collect()}
    assert {k: v for k, v in got.items() if k != "a"} == {k: v for k, v in WANT.items() if k != "a"} and frames["g"] == '{"a":null,"z":1}'
    assert got["a"][0] == WANT["a"][0]

    folder = str(tmp_path / "in")
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    q = replies.pieces(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    streamed = replies.put_together(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.collect()))


def test_packs_of_odd_texts_are_as_in_sql(spark, tmp_path):
    import duckdb

    from strandline.plans import artifact_queries

    texts = [None, "", "   ", "12 34", "\n\n", "\t\n x", " x ", "你好 🙂🙂", "[user]", "[system]\n", "a b " * 50000, "--- id: x", "🙂" * 3000]
    rows = [(10 * i + k, t, "en") for i, t in enumerate(texts) for k in range(10)] + [(5, " ", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("prompt_packs", "pack_sets"):
        query, sql = artifact_queries.QUERIES[name]
        got = query(spark, str(tmp_path))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()))


def test_a_pack_of_any_length(spark):
    # characters of one and of two units in turn
    body = "a🙂" * 100_000
    held = parsed(spark, [f"[system]\n{body}\n[user]\nsay\n", "[user]\n[system]\nx\n[user]\ny\n", "[system]\n[systematic]\n[user] \n[user]\ny\n"]).orderBy("n").collect()
    assert [(r.system, r.user) for r in held] == [(body, "say"), ("", ""), ("[systematic]", "[user]\ny")]
