"""Sources by key: uploads spooled in batches, WAV levels by byte range, plans and synthetic captures."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import named, spool, waves
from strandline.streaming import uploads

ZONES = "zone string"


def upload(capture, number, body, at, **more):
    return {"capture_id": capture, "segment_num": number, "user_id": "u", "device_id": "d", "t_start": "2024-01-01T00:00:00Z", "t_end": "2024-01-01T00:00:10Z", "mime": "audio/wav", "device_tz": None, "sha256": None, "received_at": at, "body": body} | more


FIELDS = "capture_id string, segment_num long, user_id string, device_id string, t_start string, t_end string, mime string, device_tz string, sha256 string, received_at long, body binary"


def checked(spark, rows):
    return spool.checked(spark.createDataFrame(rows, FIELDS), spark.createDataFrame([("Europe/Paris",), ("EST5EDT",)], ZONES))


def test_uploads_are_refused(spark):
    bad = [
        upload("a/b", 0, b"x", 1), upload("..", 0, b"x", 2), upload("c", -1, b"x", 3), upload("c", 0, b"", 4), upload("c", 0, b"x", 5, sha256="00"),
        upload("c", 0, b"x", 6, device_tz="EST5EDT"), upload("c", 0, b"x", 7, device_tz="No/Where"), upload("c", 0, b"x", 8, t_start="soon"), upload("c", 0, None, 9), upload(None, 0, b"x", 10),
        upload("c", 0, b"x", 11, device_tz="  "), upload("c", 0, b"x", 12, device_tz=" Europe/Paris "), upload("c\n", 0, b"x", 13),
    ]
    got = {r.received_at: [f.split(":")[0] for f in r.faults] for r in checked(spark, bad).collect()}
    assert {k: v for k, v in got.items() if not v} == {11: [], 12: []}
    assert got[1] == got[2] == got[10] == got[13] == ["capture_id"] and got[3] == ["segment_num"] and got[4] == ["body"] and got[5] == ["sha256"]
    assert got[6] == got[7] == ["device_tz"] and got[8] == ["t_start"] and got[9] == ["body"]


def test_receipts_are_kept_by_buckets(spark, tmp_path, monkeypatch):
    """Many captures share a key of the state, and a spooled batch is read in pieces of so many bytes."""
    monkeypatch.setattr(uploads, "BUCKETS", 2, raising=False)
    folder = str(tmp_path / "spool")
    sent = [upload(f"c{i % 20}", i % 3, b"one" if i % 4 else b"two", i) for i in range(200)]
    for n in range(2):
        spool.spool(spool.accepted(checked(spark, sent[n * 100 : n * 100 + 100])), folder, n)
    rows = named.stream_source(spark, "segment_spool", path=folder)
    q = uploads.receipts(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "rows"))
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 2
    got = spark.read.parquet(str(tmp_path / "rows"))
    want = uploads.receipts_batch(named.source(spark, "segment_spool", path=folder)).select(got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 200
    monkeypatch.setattr(spool, "BATCH", 1)
    reader = spool.SpoolReader({"path": folder})
    assert {b.num_rows for part in reader.partitions() for b in reader.read(part)} == {1}


def test_spool_streams_each_batch_once(spark, tmp_path):
    folder, out = str(tmp_path / "spool"), str(tmp_path / "rows")
    batches = [
        [upload("c", 0, b"one", 1), upload("c", 1, b"two", 2), upload("c", 0, b"one", 3)],
        [upload("c", 0, b"other", 4), upload("c", 2, b"three", 5)],
        [upload("c", 2, b"three", 6), upload("e", 0, b"x", 7)],
    ]
    rows = named.stream_source(spark, "segment_spool", path=folder)

    def drain():
        q = uploads.receipts(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted((r.received_at, r.status) for r in spark.read.schema(uploads.RECEIPT).parquet(out).collect())

    for n in (0, 2):  # batch 1 is still being written: 2 has to wait
        spool.spool(spool.accepted(checked(spark, batches[n])), folder, n)
    first = [(1, "received"), (2, "received"), (3, "duplicate")]
    assert drain() == first
    assert drain() == first  # a restart repeats nothing
    spool.spool(spool.accepted(checked(spark, batches[1])), folder, 1)
    whole = [*first, (4, "conflict"), (5, "received"), (6, "duplicate"), (7, "received")]
    assert drain() == whole
    held = named.source(spark, "segment_spool", path=folder)
    assert sorted((r.received_at, r.status) for r in uploads.receipts_batch(held).collect()) == whole
    assert held.where("received_at = 5").first().n_bytes == 5
    marks = spark.createDataFrame([("c", 1), ("c", None), ("e", 4)], "capture_id string, ended_at_segment long")
    got = {r.capture_id: (r.segments, r.duplicates, r.conflicts, r.state) for r in uploads.ledger(uploads.receipts_batch(held), marks).collect()}
    assert got == {"c": (3, 2, 1, "reopened"), "e": (1, 0, 0, "ended")}


def test_spool_forgets_committed_batches(spark, tmp_path):
    folder = str(tmp_path / "spool")
    rows = named.stream_source(spark, "segment_spool", path=folder, retain=1)
    for n in range(4):
        spool.spool(spool.accepted(checked(spark, [upload("c", n, b"x", n)])), folder, n)
        q = rows.select("segment_num").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "rows"))
        q.awaitTermination()
    assert sorted(r.segment_num for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [0, 1, 2, 3]
    assert len(list((tmp_path / "spool").glob("batch=*"))) < 4


def test_unknown_sources_and_options(spark):
    for key, options in (("nothing", {}), ("synthetic_captures", {}), ("synthetic_captures", {"rows": 3, "size": 1}), ("wav_levels", {"split": 4})):
        with pytest.raises(ValueError):
            named.source(spark, key, **options)
    with pytest.raises(Exception, match="nothing"):
        spark.read.format("nothing").load()


def test_plan_and_synthetic_captures(spark, tmp_path):
    plan = tmp_path / "plan.jsonl"
    lines = [{"chunk_key": f"k{i}", "t_start": "a", "t_end": "b", "audio": f"{i}.wav", "media": None if i else "m"} for i in (3, 1, 2)]
    plan.write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    got = named.source(spark, "replay_plan", path=str(plan)).orderBy("place").collect()
    assert [(r.place, r.chunk_key) for r in got] == [(0, "k3"), (1, "k1"), (2, "k2")]
    plan.write_text('{"chunk_key": "a", "t_start": "x", "t_end": "y"}\n')
    with pytest.raises(Exception, match="lacks audio"):
        named.source(spark, "replay_plan", path=str(plan)).collect()
    plan.write_text("\n")
    with pytest.raises(Exception, match="is empty"):
        named.source(spark, "replay_plan", path=str(plan)).collect()
    one, again = (named.source(spark, "synthetic_captures", rows=1000, seed=5).orderBy("seq").collect() for _ in range(2))
    assert one == again and len(one) == 1000
    other = named.source(spark, "synthetic_captures", rows=1000, seed=6)
    assert other.where("seq = 7").first() != one[7]
    late = sum((r.updated_at - r.t_start).days == 1 for r in one)
    assert 60 < late < 150 and {r.user_id for r in one} == set(range(20))


def wav(path, samples, rate=1000, extra=b""):
    data = np.asarray(samples, "<i2").tobytes()
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVE" + head + extra + b"data" + struct.pack("<I", len(data)) + data
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


def plain_cuts(x, rate, least_s, most_s, hop_ms=30, pause_ms=300):
    """Cuts of a whole recording by one loop."""
    hop = max(1, round(rate * hop_ms / 1000))
    rms = [math.sqrt(float((x[i : i + hop].astype(float) ** 2).sum()) / hop) for i in range(0, len(x) - hop + 1, hop)]
    least, most = max(1, round(least_s * rate)), round(most_s * rate)
    middles = []
    if rms:
        quiet = [r < max(200.0, 2.5 * float(np.percentile(rms, 20))) for r in rms]
        begin = None
        for i, q in enumerate([*([False] * len(quiet) if all(quiet) else quiet), False]):
            if q and begin is None:
                begin = i
            elif not q and begin is not None:
                if i - begin >= math.ceil(pause_ms / hop_ms):
                    middles.append((begin * hop + min(i * hop, len(x))) // 2)
                begin = None
    at, cuts = 0, []
    while True:
        near = [m for m in middles if m >= at + least]
        if near and near[0] <= at + most:
            at = near[0]
        elif len(x) - at > most:
            at += most
        else:
            return cuts
        cuts.append(at)


def test_pauses_join_across_byte_ranges(spark, tmp_path):
    rng = random.Random(3)
    files = {}
    for name in ("a", "b", "c"):
        x = []
        while len(x) < 40_000:
            loud = rng.random() < 0.6
            x += [rng.randint(-9000, 9000) if loud else rng.randint(-40, 40) for _ in range(rng.randint(100, 2500))]
        files[name] = np.array(x, np.int16)
    files["quiet"], files["short"], files["empty"] = np.zeros(9000, np.int16), np.ones(7, np.int16), np.zeros(0, np.int16)
    for name, x in files.items():
        wav(tmp_path / f"{name}.wav", x, extra=b"LIST" + struct.pack("<I", 5) + b"abcde\0" if name == "b" else b"")
    (tmp_path / "note.txt").write_text("no sound")
    for split in (1 << 20, 4001):
        levels = named.source(spark, "wav_levels", path=str(tmp_path), split=split)
        got: dict = {}
        for r in waves.carved(levels, 1.0, 4.0).orderBy("file", "chunk").collect():
            assert r.start_s == r.start / 1000
            got.setdefault(r.file, []).append((r.start, r.stop))
        for name, x in files.items():
            points = [0, *plain_cuts(x, 1000, 1.0, 4.0), len(x)]
            assert got.get(f"{name}.wav", []) == [(a, b) for a, b in zip(points, points[1:]) if b > a], (name, split)
    assert levels.where("file = 'a.wav'").select(F.count_distinct("range")).first()[0] > 10
    with pytest.raises(ValueError):
        waves.carved(levels, 0.0, 1.0)


def test_other_wav_formats_raise(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 4) + b"abcd")
    with pytest.raises(Exception, match="mono"):
        named.source(spark, "wav_levels", path=str(tmp_path)).collect()
