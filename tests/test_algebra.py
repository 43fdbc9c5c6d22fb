"""Run lists against sets, nested documents against dictionaries, suites against plain scoring."""

import itertools
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import nested as documents
from strandline.operators import nested, runlists, suites
from strandline.plans import algebra_queries


def runs_of(numbers):
    out = []
    for n in sorted(numbers):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("far", [1, 10**15])
def test_run_lists_as_sets(spark, far):
    rng = random.Random(6)
    sides = []
    for _ in range(2):
        rows = []
        for g in range(5):
            for _ in range(rng.randint(0, 6)):
                a = rng.randint(-10, 30)
                rows.append((g, a, a + rng.randint(-1, 6)))  # overlaps, touching runs and empty ones too
        sides.append(rows)
    # far: runs of 10^15 numbers, which nothing may expand
    frames = [spark.createDataFrame([(g, a * far, (b + 1) * far - 1) for g, a, b in rows], "g int, lo long, hi long") for rows in sides]
    sets = [{g: {n for h, a, b in rows if h == g for n in range(a, b + 1)} for g in range(5)} for rows in sides]
    for name, op in (("union", set.union), ("intersection", set.intersection), ("difference", set.difference)):
        got = getattr(runlists, name)(*frames, "g")
        want = [(g, a * far, (b + 1) * far - 1) for g in range(5) for a, b in runs_of(op(sets[0][g], sets[1][g]))]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), name
    one = runlists.union(frames[0], frames[0], "g")
    assert {r.g: r.n for r in runlists.widths(one, "g").collect()} == {g: len(s) * far for g, s in sets[0].items() if s}
    assert {tuple(r) for r in runlists.clipped(one, F.lit(0), F.lit(5)).collect()} == {(r.g, max(0, r.lo), min(5, r.hi)) for r in one.collect() if r.lo <= 5 and r.hi >= 0}
    few = {r.g: (len(r.runs), r.n_runs) for r in runlists.capped(one, "g", 2).collect()}
    assert all(a == min(2, n) for a, n in few.values())


def test_canonical_text(spark):
    texts = ['{"b": 1, "a": [3, {"z": null, "y": "é\\u0001"}], "c": {}}', '{ "c":{}, "a":[3,{"y":"é\\u0001","z":null}],"b":1}', "[]", "null", "{", '{"a":1,"a":2}', None, "1.50", '"x"']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(documents.canonical(F.col("t"))).collect()]
    assert got[0] == got[1] and json.loads(got[0]) == json.loads(texts[0]) and " " not in got[0].replace("é", "")
    assert list(json.loads(got[0])) == ["a", "b", "c"] and got[2:5] == ["[]", "null", None] and got[6] is None and got[7:] == ["1.5", '"x"']
    prints = spark.createDataFrame([(texts[0], texts[2]), (texts[1], texts[2]), (texts[2], texts[1])], "a string, b string").select(documents.fingerprint(F.col("a"), F.col("b"))).collect()
    assert prints[0] == prints[1] != prints[2]


def gaps(expected, actual, path=""):
    if not isinstance(actual, dict):
        return [(path, "no object")]
    out = []
    for k, v in expected.items():
        here = f"{path}.{k}" if path else k
        if k not in actual:
            out.append((here, "missing"))
        elif isinstance(v, dict):
            out += gaps(v, actual[k], here)
        elif actual[k] != v:
            out.append((here, "differs"))
    return out


def test_subset_match_of_nested_documents(spark):
    rng = random.Random(9)

    def made(depth):
        kind = rng.random()
        if depth and kind < 0.6:
            return {rng.choice("abc"): made(depth - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([1, 2, "x", None, True, [1, {"k": 2}], [{"k": 2}, 1], {}])

    docs = [(i, {"r": made(3)}, {"r": made(3)}) for i in range(60)] + [(100 + i, d := {"r": made(4)}, d) for i in range(5)]
    docs += [(200, {}, [1]), (201, {}, {"a": 1}), (202, {"a": {}}, {"a": 1}), (203, {"a": {}}, {})]
    frame = lambda i: spark.createDataFrame([(x[0], json.dumps(x[i])) for x in docs], "k int, d string")
    got = sorted(tuple(r) for r in nested.mismatches(frame(1), frame(2), "k", "d").collect())
    assert got == sorted((k, p, w) for k, a, b in docs for p, w in gaps(a, b))


def plain_order(gold, answer):
    places = json.loads(gold)
    found = [(i, at) for i, c in enumerate(places) if (at := answer.lower().find(c.split(",")[0].split(" then ")[0].strip().lower())) >= 0]
    if len(found) < 2:
        return 0.0
    pairs = list(itertools.combinations(found, 2))
    return sum(a[1] < b[1] for a, b in pairs) / len(pairs) * len(found) / len(places)


def test_suites(spark, tmp_path):
    rows = [("s0_d1", "p1", "where?", "the red house", "In the Red house."), ("s0_d1", "p2", "who?", "Ann", "That never happened"), ("s0_d2", "p3", "when?", "", ""), ("s0_d2", "p4", "when?", "noon", None)]
    answers = spark.createDataFrame(rows, "suite string, probe_id string, q string, gold string, pred string")
    got = {r.probe_id: r for r in suites.judged(suites.scored(answers, "f1", "contains", "trap"), "match").collect()}
    assert got["p1"].f1 == pytest.approx(0.8) and got["p1"].contains == 1.0 and got["p1"].judge == 1 and got["p2"].trap == 1.0 and got["p2"].judge == 0
    assert got["p3"].f1 == 0.0 and got["p4"].f1 in (0.0, None)
    for bad in (lambda: suites.scored(answers, "bleu"), lambda: suites.judged(answers, "coin"), lambda: suites.scored(answers.withColumn("gold", F.lit(1)), "f1")):
        with pytest.raises(ValueError):
            bad()
    route = ["Rome", "Oslo, Norway", "Lima then Cusco", "Kyiv"]
    said = ["rome, oslo, lima, kyiv", "kyiv then lima then oslo", "only rome", "Lima Rome", ""]
    order = suites.scored(spark.createDataFrame([("s", str(i), "q", json.dumps(route), t) for i, t in enumerate(said)], answers.schema), "order")
    assert {r.probe_id: r.order for r in order.collect()} == pytest.approx({str(i): plain_order(json.dumps(route), t) for i, t in enumerate(said)})

    suites.write_scored(answers.withColumn("judge", F.when(F.col("probe_id") == "p1", 1).cast("int")), str(tmp_path / "scored"))
    lines = [json.loads(line) for p in sorted((tmp_path / "scored").glob("*.json")) for line in p.read_text().splitlines()]
    assert sorted(x["probe_id"] for x in lines) == ["p1", "p2", "p3", "p4"] and all(set(x) == {"suite", "probe_id", "gold", "pred", "judge"} for x in lines)
    assert [x["judge"] for x in lines if x["probe_id"] != "p1"] == [None] * 3

    days = spark.createDataFrame([(1, "a", "q1", "g"), (2, "b", "q2", "g")], "day int, probe_id string, q string, gold string")
    held = spark.createDataFrame([("h", "q3", "g")], "probe_id string, q string, gold string")
    model = lambda name: lambda rows: rows.withColumn("pred", F.concat(F.lit(name), "q"))
    out = {(r.suite, r.probe_id): r.pred for r in suites.with_floor(days, held, model("t:"), model("b:"), 4).collect()}
    assert out == {("s4_d1", "a"): "t:q1", ("s4_d2", "b"): "t:q2", ("s4_heldout", "h"): "t:q3", ("base_d1", "a"): "b:q1", ("base_d2", "b"): "b:q2", ("base_heldout", "h"): "b:q3"}


def test_table_of_readouts(spark):
    kinds = "label string, seen_mean double, separation double, micro double, heldout double, base_mean double, retention double, traps double"
    rows = [("b", 0.25, None, 0.5, 0.125, 0.1, float("nan"), 1.0), ("a" * 30, 0.1, -0.05, None, None, 0.0, 0.5, None)]
    lines = [r.line for r in suites.table_of(spark.createDataFrame(rows, kinds)).orderBy("place").collect()]
    assert lines[0].split() == ["run", "seen", "sep", "micro", "heldout", "base", "ret(d0)", "traps"] and set(lines[1]) == {"-"} and len(lines[1]) == len(lines[0])
    assert lines[2].startswith("a" * 30) and lines[3] == f"{'b':<22}{0.25:>8.4f}{'nan':>9}{0.5:>8.4f}{0.125:>9.4f}{0.1:>8.4f}{'nan':>9}{1.0:>7.2f}"


def test_readouts_round_as_printf(spark):
    kinds = "label string, seen_mean double, separation double, micro double, heldout double, base_mean double, retention double, traps double"
    # exact halves, halves that no double holds, and what has no digit left of the last one
    odd = [0.28125, 0.40625, 0.93165, 0.97705, 0.475, 0.625, 0.375, 0.565, 0.0005, 0.00005, -0.00005, -0.98125, -0.8015, 0.0, 1.0, 2.5, float("inf")]
    rows = [(f"r{i:02d}", x, -x, x / 2, x, 1 - x, x, x) for i, x in enumerate(odd)]
    lines = [r.line for r in suites.table_of(spark.createDataFrame(rows, kinds)).where("place >= 0").orderBy("place").collect()]
    assert lines == [f"{r[0]:<22}{r[1]:>8.4f}{r[2]:>9.4f}{r[3]:>8.4f}{r[4]:>9.4f}{r[5]:>8.4f}{r[6]:>9.3f}{r[7]:>7.2f}" for r in rows]


def test_readout_table_of_odd_documents(spark, tmp_path):
    """As its SQL on means that end in halves, long and equal beginnings of languages, and identifiers below 0 or missing."""
    rng = random.Random(3)
    rows = [(rng.randint(0, 10**6), f"l{n:03d}") for n in range(1, 200) for _ in range(n)]
    rows += [(i, "y" * 22 + end) for end in "ba" for i in range(9)] + [(-i, "below") for i in range(1, 12)] + [(None, "none"), (None, "some"), (5, "some"), (1, None), (2, ""), (3, "日本語" * 9)]
    spark.createDataFrame(rows, "doc_id long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    query, sql = algebra_queries.QUERIES["readout_table"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {r.place: r.line for r in query(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(sql).fetchall()) and None in got.values()


def test_levels_of_nodes_start_from_the_level_above(spark):
    from strandline.operators import nested as walked

    docs = spark.createDataFrame([(1, '{"b": {"c": {}}, "a": "{", "l": [{}], "n": null}'), (2, "[{}]"), (3, "no"), (4, None)], "id int, doc string")
    got = walked.nodes(docs, "id", "doc")
    assert sorted((r.id, r.path, r.parent, r.is_object, r.value) for r in got.where("path <> ''").collect()) == [
        (1, "a", "", False, '"{"'), (1, "b", "", True, '{"c":{}}'), (1, "b.c", "b", True, "{}"), (1, "l", "", False, "[{}]"), (1, "n", "", False, "null"),
    ]
    assert sorted((r.id, r.is_object) for r in got.where("path = ''").collect()) == [(1, True), (2, False)]
    # documents are parsed once, not again for every level
    assert "parse" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_all_kinds_of_run_lists_in_one_sweep(spark):
    """The lists are made once for all kinds, whatever their number."""
    rng = random.Random(7)
    sides = [[(rng.randint(0, 3), a, a + rng.randint(-1, 6)) for a in (rng.randint(-10, 30) for _ in range(20))] for _ in range(2)]
    frames = [spark.createDataFrame([*rows, (None, 1, 3)], "g int, lo long, hi long") for rows in sides]
    got = {tuple(r) for r in runlists.algebra(*frames, "g").collect()}
    assert got == {(k, *r) for k in runlists.KINDS for r in getattr(runlists, k)(*frames, "g").collect()}


def test_run_algebra_reads_its_lists_once_and_deals_them_by_rows(spark, monkeypatch):
    from strandline.plans import algebra_queries

    monkeypatch.setattr(algebra_queries, "ROWS", 10, raising=False)
    found = algebra_queries.run_algebra(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2  # one a side; six when each kind made its own
    assert found.rdd.getNumPartitions() > 4
