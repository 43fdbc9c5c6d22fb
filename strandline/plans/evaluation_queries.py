"""Queries over gates, readouts, ensembles and judged answers, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import evaluation
from strandline.plans.record_queries import E, _events
from strandline.sources.tables import table

POLICY = {"min_probes": 120, "new_day_recall_min": 0.12, "traps_pass_min": 0.1, "heldout_alpha": 0.05, "heldout_backstop": 0.45, "heldout_probes": 60}


def _scores(spark, d):
    e = _events(spark, d)
    own, held = F.col("k") % 2 == 0, F.col("k") % 10 < 4
    hit = F.col("event_type") == "purchase"
    return e.groupBy(F.col("user_id").alias("run")).agg(
        (F.count("*") * 2).alias("n_probes"),
        F.coalesce(F.avg(F.when(own, hit.cast("double"))), F.lit(0.0)).alias("new_day_recall"),
        F.avg((F.col("event_type") == "click").cast("double")).alias("traps_pass"),
        F.count_if(held & (hit | (F.col("k") % 4 == 1))).alias("heldout_hits"),
        F.count_if(held).alias("heldout_n"),
        F.count_if(~held & hit & (F.col("k") % 3 == 0)).alias("base_hits"),
        F.count_if(~held).alias("base_n"),
    )


def _gated(spark, d):
    return evaluation.gate(_scores(spark, d), POLICY)


def gate_checks(spark, d):
    g = _gated(spark, d)
    return g.select("run", "ok_probes", "ok_recall", "ok_traps", "ok_heldout", "passed", F.size("reasons").alias("n_reasons"), "underpowered", F.round("p_value", 6).alias("p_value"))


def gate_rescore(spark, d):
    kind = F.when(F.col("run") % 10 == 0, "control").when(F.col("run") % 2 == 0, "ours").otherwise("reference")
    return evaluation.rescored(_gated(spark, d).withColumn("kind", kind), "kind", "control")


def trap_rates(spark, d):
    return evaluation.trap_rates(_events(spark, d).withColumns({"step": F.col("k") % 7, "s": (F.col("event_type") == "error").cast("double")}), "step", "s")


def _matrix(spark, d):
    """Recall of five days after five steps, for eight runs."""
    e = _events(spark, d).withColumns({"run": F.concat(F.lit("run"), (F.col("user_id") % 8).cast("string")), "step": F.col("k") % 5, "day": F.floor(F.col("k") / 5) % 5, "ok": (F.col("event_type") == "purchase").cast("double")})
    return e, e.where("day <= step").groupBy("run", "step", "day").agg(F.avg("ok").alias("score"))


def _readouts(spark, d):
    e, m = _matrix(spark, d)
    base = e.where("event_id % 3 = 0").groupBy("run", "day").agg(F.avg("ok").alias("score"))
    held = e.where("event_id % 4 = 0").groupBy("run").agg(F.avg("ok").alias("score"))
    return evaluation.readout(m, base, held, "run")


def run_readouts(spark, d):
    return _readouts(spark, d).select("run", *[F.round(c, 4).alias(c) for c in ("seen_mean", "base_mean", "heldout", "separation", "retention_longest_path", "retention_micro")])


def retention(spark, d):
    return evaluation.retained(_matrix(spark, d)[1], "run")


def readout_lines(spark, d):
    r = spark.createDataFrame([("a", 0.25, 0.125, 0.0625, 0.5), ("b", None, None, None, None)], "run string, seen_mean double, separation double, base_mean double, retention_longest_path double")
    return evaluation.table_lines(r, "run")


def verdict_ladder(spark, d):
    r = _readouts(spark, d)
    n = F.substring("run", 4, 1).cast("int")
    parts = {"all": (r.where(n < 3), r.where(n.between(3, 5)), r.where(n > 5)), "no_control": (r, r, r.where(n > 99)), "no_baseline": (r.where(n < 3), r.where(n > 99), r.where(n > 5)), "itself": (r, r, r)}
    out = None
    for name, (ours, base, control) in parts.items():
        one = evaluation.survival(ours, base, control, "separation").select(F.lit(name).alias("ensemble"), "verdict")
        out = one if out is None else out.unionByName(one)
    return out


def training_dynamics(spark, d):
    o = table(spark, d, "orders").withColumns({"night": F.col("o_custkey") % 50, "chunks": F.col("o_orderkey") % 6, "steps": F.col("o_orderkey") % 4})
    ours = o.where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "label")
    return evaluation.dynamics(o.where("o_orderpriority = '5-LOW'"), ours, "night", ("chunks", "steps"), "o_totalprice", "label")


def generator_independence(spark, d):
    models = F.array(*[F.lit(x) for x in ("cloud/Gemini-2.5-flash", "gemini-pro", "org/Qwen3-32B", "house-model", "")])
    n = table(spark, d, "nation")
    pick = lambda by: F.element_at(models, (by % 5 + 1).cast("int"))
    return n.select("n_nationkey", evaluation.independence(pick(F.col("n_nationkey")), pick(F.floor(F.col("n_nationkey") / 5))).alias("independence"), evaluation.family(pick(F.col("n_nationkey"))).alias("family"))


def _scored(spark, d):
    e = _events(spark, d)
    reply = F.when(F.col("k") % 9 == 0, "no idea").when(F.col("k") % 9 == 1, '{"correct": maybe}').otherwise(F.concat(F.lit('Sure: {"why": "x", "correct" : '), (F.col("k") % 2).cast("string"), F.lit("} done")))
    return e.select("event_id", "event_type", evaluation.judged(reply).alias("judge"))


def judge_verdicts(spark, d):
    return _scored(spark, d)


def judged_means(spark, d):
    return evaluation.judged_means(_scored(spark, d), "event_type", "judge").withColumn("judge_exact", F.round("judge_exact", 6))


def unjudged_share(spark, d):
    return evaluation.checked_unjudged(_scored(spark, d), "judge", 0.5)


def mock_scores(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round(evaluation.mock_scores(F.col("s_name")).new_day_recall, 9).alias("recall"))


def _amplified(spark, d):
    docs = table(spark, d, "documents")
    return evaluation.amplified(docs.withColumn("valid", F.coalesce(F.length("text") > 100, F.lit(False))), "source", "valid", "text", 0.85)


def amplified_days(spark, d):
    return _amplified(spark, d)


def amplify_reports(spark, d):
    ref = table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("ok"))
    return evaluation.against_reference(_amplified(spark, d), ref, "source")


def matched_budgets(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("tokens")).select("source", evaluation.matched_budget(F.col("tokens"), 2048).alias("chunks"))


_SCORES = E + """, s as (select user_id as run, count(*) * 2 as n_probes, coalesce(avg(case when k % 2 = 0 then (event_type = 'purchase')::int end), 0) as recall, avg((event_type = 'click')::int) as traps,
  count(*) filter (k % 10 < 4 and (event_type = 'purchase' or k % 4 = 1)) as a, count(*) filter (k % 10 < 4) as n1, count(*) filter (k % 10 >= 4 and event_type = 'purchase' and k % 3 = 0) as b, count(*) filter (k % 10 >= 4) as n2 from e group by 1),
 ch as (select run, unnest(range(a, least(a + b, n1) + 1)) as j from s where n1 > 0 and n2 > 0),
 lf as (select i, sum(ln(greatest(i, 1))) over (order by i) as f from range(0, 100001) r(i)),
 pv as (select run, sum(exp(g.f - j.f - gj.f + t.f - nj.f - tj.f - tn.f + m1.f + m2.f)) as p from ch join s using (run)
  join lf g on g.i = a + b join lf j on j.i = ch.j join lf gj on gj.i = a + b - ch.j join lf t on t.i = n1 + n2 - a - b join lf nj on nj.i = n1 - ch.j join lf tj on tj.i = n2 - a - b + ch.j
  join lf tn on tn.i = n1 + n2 join lf m1 on m1.i = n1 join lf m2 on m2.i = n2 group by 1),
 q as (select s.*, coalesce(p, 1.0) as p, case when n1 > 0 then a / n1::double else 0 end as held from s left join pv using (run)),
 c as (select *, n_probes >= 120 as ok_probes, recall >= 0.12 as ok_recall, traps >= 0.1 as ok_traps, not (p < 0.05 or held > 0.45) as ok_heldout from q) """
_M = E + """, x as (select *, 'run' || user_id % 8 as run, k % 5 as step, k // 5 % 5 as day, (event_type = 'purchase')::int::double as ok from e),
 m as (select run, step, day, avg(ok) as score from x where day <= step group by 1, 2, 3),
 f as (select run, day, min(step) as s, arg_min(score, step) as f from m group by 1, 2),
 l as (select run, max(step) as last, min(day) as day0 from m group by 1),
 c as (select m.*, s, f, last, day0, case when f > 1e-6 then score / f end as kept from m join f using (run, day) join l using (run)),
 o as (select run, avg(score) filter (step = last) as seen_mean, round(max(kept) filter (step = last and day = day0), 3) as retention_longest_path, round(avg(kept) filter (step > s), 3) as retention_micro from c group by 1),
 ba as (select run, avg(score) as base_mean from (select run, day, avg(ok) as score from x where event_id % 3 = 0 group by 1, 2) group by 1), he as (select run, avg(ok) as heldout from x where event_id % 4 = 0 group by 1),
 r as (select run, seen_mean, base_mean, heldout, round(seen_mean - heldout, 4) as separation, retention_longest_path, retention_micro from o left join ba using (run) left join he using (run)) """
_JUDGED = E + ", s as (select event_id, event_type, case when k % 9 > 1 then cast(k % 2 as integer) end as judge from e) "
_AMP = "with a as (select source, count(*) as planned, count(*) filter (length(text) > 100) as ok, cast(coalesce(sum(length(trim(text, ' '))) filter (length(text) > 100), 0) as bigint) as chars from documents group by 1) "

QUERIES = {
    "gate_checks": (gate_checks, _SCORES + """select run, ok_probes, ok_recall, ok_traps, ok_heldout, ok_probes and ok_recall and ok_traps and ok_heldout as passed,
        cast((not ok_probes)::int + (not ok_recall)::int + (not ok_traps)::int + (p < 0.05)::int + (held > 0.45)::int as integer) as n_reasons, n1 > 0 and n1 < 60 as underpowered, round(p, 6) as p_value from c"""),
    "gate_rescore": (gate_rescore, _SCORES + """, k as (select case when run % 10 = 0 then 'control' when run % 2 = 0 then 'ours' else 'reference' end as kind, ok_probes and ok_recall and ok_traps and ok_heldout as passed from c)
        select kind, count(*) filter (passed) as n_passed, count(*) as n, case when kind = 'control' then count(*) filter (passed) = 0 end as control_blocked from k group by 1"""),
    "trap_rates": (trap_rates, E + "select k % 7 as step, round(avg((event_type = 'error')::int), 3) as rate from e group by 1"),
    "run_readouts": (run_readouts, _M + "select run, round(seen_mean, 4) as seen_mean, round(base_mean, 4) as base_mean, round(heldout, 4) as heldout, separation, retention_longest_path, retention_micro from r"),
    "retention": (retention, _M + "select run, day, round(arg_max(score, step) / any_value(f), 3) as retention from c where f > 1e-6 group by 1, 2"),
    "readout_lines": (readout_lines, "select 'a' as run, rpad('a', 22, ' ') || '  0.2500   0.1250  0.0625    0.500' as line union all select 'b', rpad('b', 22, ' ') || '     NaN      NaN     NaN      NaN'"),
    "verdict_ladder": (verdict_ladder, _M + """, n as (select *, cast(run[4:] as integer) as n from r),
        p as (select 'all' as ensemble, avg(separation) filter (n < 3) as mean, min(separation) filter (n between 3 and 5) as lo, max(separation) filter (n between 3 and 5) as hi, max(separation) filter (n > 5) as top from n
        union all select 'no_control', avg(separation), min(separation), max(separation), null from n union all select 'no_baseline', avg(separation) filter (n < 3), null, null, max(separation) filter (n > 5) from n
        union all select 'itself', avg(separation), min(separation), max(separation), max(separation) from n)
        select ensemble, case when top is null then 'INDETERMINATE (no control runs found)' when mean <= top then 'COLLAPSED' when lo is null then 'SURVIVED (no baseline to compare)' when mean < lo then 'SURVIVED (weakened)' when mean > hi then 'SURVIVED (stronger)' else 'SURVIVED' end as verdict from p"""),
    "training_dynamics": (training_dynamics, """with o as (select *, o_custkey % 50 as night, o_orderkey % 6 as chunks, o_orderkey % 4 as steps from orders),
        g as (select night, list(distinct chunks) as c, list(distinct steps) as s, min(o_totalprice) as loss_least, max(o_totalprice) as loss_most from o where o_orderpriority = '5-LOW' group by 1)
        select night, o_orderkey as label, list_contains(c, chunks) and list_contains(s, steps) as shape_exact, loss_least, loss_most, o_totalprice between loss_least and loss_most as loss_inside from o join g using (night) where o_orderpriority = '1-URGENT'"""),
    "generator_independence": (generator_independence, """with m as (select n_nationkey, ['gemini', 'gemini', 'qwen', 'house-model', ''][n_nationkey % 5 + 1] as p, ['gemini', 'gemini', 'qwen', 'house-model', ''][n_nationkey // 5 % 5 + 1] as c from nation)
        select n_nationkey, case when p = '' then 'unknown' when p = c then 'same_family' else 'independent' end as independence, p as family from m"""),
    "judge_verdicts": (judge_verdicts, _JUDGED + "select * from s"),
    "judged_means": (judged_means, _JUDGED + "select event_type, count(*) as n, count(*) filter (judge is null) as n_unjudged, round(avg(judge), 6) as judge_exact from s group by grouping sets ((event_type), ())"),
    "unjudged_share": (unjudged_share, _JUDGED + "select count(*) as n, count(*) filter (judge is null) as n_unjudged from s"),
    "mock_scores": (mock_scores, "select s_suppkey, round(0.26::double + cast('0x' || sha256(s_name)[1:2] as integer) / 255.0::double * 0.05::double, 9) as recall from supplier"),
    "amplified_days": (amplified_days, _AMP + "select source, planned, ok, chars, ok >= 0.85 * planned as enough from a"),
    "amplify_reports": (amplify_reports, _AMP + """, r as (select source, sum(n_chars) / count(*)::double as r from documents where text is not null group by 1)
        select source, round(chars / greatest(1, ok)::double, 1) as chars_per_paragraph, round(r, 1) as reference, round(chars / greatest(1, ok)::double / r, 4) as ratio from a left join r using (source)"""),
    "matched_budgets": (matched_budgets, "with t as (select source, cast(sum(n_chars) as bigint) as n from documents group by 1) select source, n // 2048 + case when n % 2048 > 16 then 1 else 0 end as chunks from t"),
}
