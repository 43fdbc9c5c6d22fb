"""Running sums by buckets against one loop, with ties, nulls and a hot group."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import running


@pytest.mark.parametrize("budget", [None, 500])
def test_running_sums(spark, monkeypatch, budget):
    monkeypatch.setattr(running, "RANGES", 7)
    monkeypatch.setattr(running, "DIGITS", 1)
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randint(0, 40)) for i in range(300)] + [("only", 5000, 900), ("b", None, 3)]
    docs = spark.createDataFrame(rows, "g string, i long, n int").withColumn("u", F.md5(F.coalesce(F.col("i").cast("string"), F.lit(""))))
    limit = None if budget is None else F.lit(budget)
    place = {"id": lambda r: (r[1] is not None, r[1] or 0), "hash": lambda r: (hashlib.md5(b"" if r[1] is None else str(r[1]).encode()).hexdigest(), r[1] or 0)}
    got = {
        "id": running.before(docs, "g", running.by_range(docs, "i"), ["i"], F.col("n"), limit),
        "hash": running.before(docs, "g", running.by_digits(F.col("u")), ["u", "i"], F.col("n"), limit),
    }
    for kind, df in got.items():
        want = set()
        for g in {r[0] for r in rows}:
            used = 0
            for r in sorted((r for r in rows if r[0] == g), key=place[kind]):
                if budget is None or used < budget:
                    want.add((g, r[1], used))
                used += r[2]
        assert {(r.g, r.i, r.used_before) for r in df.collect()} == want
        assert df.columns == [*docs.columns, "used_before"]


def test_ranks(spark):
    rows = [(i % 2, i * 1000) for i in range(50)]
    docs = spark.createDataFrame(rows, "g int, i long")
    got = running.ranked(docs, "g", running.by_range(docs, "i", falling=True), [F.desc("i")])
    assert {(r.g, r.i, r["rank"]) for r in got.collect()} == {(g, i, sorted((x for h, x in rows if h == g), reverse=True).index(i) + 1) for g, i in rows}
    none = docs.limit(0)
    assert running.ranked(none, "g", running.by_range(none, "i"), ["i"]).count() == 0
