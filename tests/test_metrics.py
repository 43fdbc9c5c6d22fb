"""Metric families against a plain renderer, ledger snapshots and block statistics by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import metrics


def shown(x):
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def test_numbers(spark):
    values = [0.0, -3.0, 2.5, 1e15, 123456789012345.0, 0.1, 1e-7, 1.5e300, float("inf"), float("-inf"), float("nan"), 12345678.9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(metrics.number(F.col("v"))).collect()]
    assert [float(g) if g not in ("NaN",) else g for g in got] == [float(shown(v)) if not math.isnan(v) else "NaN" for v in values]
    assert got[:5] == ["0", "-3", "2.5", "1.0e15", "123456789012345"] and got[8:11] == ["+Inf", "-Inf", "NaN"]


def test_families(spark):
    rows = spark.createDataFrame([("a", 0.01), ("a", 4.0), ("a", None), ("b", 1000.0), (None, 0.3)], "kind string, v double")
    hist = metrics.histogram(rows, "v", ["kind"], (0.5, 0.01, 5.0, float("inf")))
    held = {r.kind: ([(b.le, b.n) for b in r.buckets], r["sum"], r["count"]) for r in hist.collect()}
    assert held["a"] == ([(0.01, 1), (0.5, 1), (5.0, 2), (math.inf, 2)], 4.01, 2) and held["b"][0][-2:] == [(5.0, 0), (math.inf, 1)]
    lines = [r.line for r in metrics.rendered(hist.where("kind = 'b'"), "took", "histogram", "Time.", ["kind"]).orderBy("place").collect()]
    assert lines == ["# HELP took Time.", "# TYPE took histogram", 'took_bucket{kind="b",le="0.01"} 0', 'took_bucket{kind="b",le="0.5"} 0', 'took_bucket{kind="b",le="5"} 0', 'took_bucket{kind="b",le="+Inf"} 1', 'took_sum{kind="b"} 1000', 'took_count{kind="b"} 1']
    odd = spark.createDataFrame([('q"\\\n', 1.0), (None, 2.5)], "kind string, value double")
    assert [r.line for r in metrics.rendered(odd, "n", "counter", "N.", ["kind"]).orderBy("place").collect()][2:] == ['n{kind=""} 2.5', 'n{kind="q\\"\\\\\\n"} 1']
    alone = spark.createDataFrame([(7.0,)], "value double")
    assert [r.line for r in metrics.rendered(alone, "g", "gauge", "G.", []).orderBy("place").collect()] == ["# HELP g G.", "# TYPE g gauge", "g 7"]
    assert metrics.rendered(alone.limit(0), "g", "gauge", "G.", []).count() == 0
    with pytest.raises(ValueError):
        metrics.rendered(alone, "g", "summary", "G.", [])
    with pytest.raises(ValueError):
        metrics.exposed([])


def test_quantiles(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 900.0)], "kind string, v double")
    got = {r.kind: r.quantile for r in metrics.quantile(metrics.histogram(rows, "v", ["kind"], (2.5, 5.0, 10.0)), 0.5, ["kind"]).collect()}
    assert got == {"a": pytest.approx(5.0), "b": 10.0}
    low = {r.kind: r.quantile for r in metrics.quantile(metrics.histogram(rows, "v", ["kind"], (2.5, 5.0, 10.0)), 0.1, ["kind"]).collect()}
    assert low["a"] == pytest.approx(1.25)


def test_snapshot_and_blocks(spark):
    captures = spark.createDataFrame([(1, 5), (2, None), (3, 2), (4, 1)], "capture_id int, expected int")
    segments = spark.createDataFrame([(1, 0, "emitted"), (1, 3, "failed"), (1, 3, "failed"), (2, 9, "received"), (3, 4, "emitted")], "capture_id int, segment_num int, state string")
    chunks = spark.createDataFrame([("accepted", None), ("accepted", "done")], "status string, dp_state string")
    got = {(r.family, r.state): r.n for r in metrics.ledger_snapshot(captures, segments, chunks).collect()}
    assert got["missing", "ended"] == (5 - 2) + (5 - 1) + 1 and got["captures", "open"] == 1 and got["segments", "failed"] == 2 and got["dp_state", "unknown"] == 1
    blocks = spark.createDataFrame([("u", "abc", 2), ("u", "abcdef", 2), ("u", "", 12)], "user_id string, text string, n int")
    assert metrics.block_stats(blocks, ["user_id"], "text", "n", 5).first().asDict() == {"user_id": "u", "blocks": 3, "chars_mean": 3, "chars_max": 6, "chars_total": 9, "over_cap": 1, "sizes": "2:2 12:1"}
