"""Evaluation of training runs: the publish gate, readouts of decay, ensembles, provenance and judged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import stats

# Generator families, and how a judge states its verdict.
FAMILIES = ("gemini", "gpt", "claude", "qwen", "llama", "mistral", "deepseek")
VERDICT = r'\{[^{}]*"correct"\s*:\s*([01])[^{}]*\}'
#: The least first score of a day that counts as written.
WRITTEN = 1e-6


def gate(scores: DataFrame, policy: dict) -> DataFrame:
    """``scores`` with p_value, a check each (ok_probes, ok_recall, ok_traps, ok_heldout), passed, reasons and notes.

    Held-out recall fails where it is significantly above the run's own base (one-sided exact test) or over the absolute
    backstop; too few held-out probes are noted but fail nothing."""
    p = stats.fisher_greater("heldout_hits", "heldout_n", "base_hits", "base_n")
    recall = F.when(F.col("heldout_n") > 0, F.col("heldout_hits") / F.col("heldout_n")).otherwise(0.0)
    out = scores.withColumns({"p_value": F.coalesce(p, F.lit(1.0)), "heldout_recall": recall})
    above, over = F.col("p_value") < policy["heldout_alpha"], F.col("heldout_recall") > policy["heldout_backstop"]
    checks = {
        "ok_probes": F.col("n_probes") >= policy["min_probes"],
        "ok_recall": F.col("new_day_recall") >= policy["new_day_recall_min"],
        "ok_traps": F.col("traps_pass") >= policy["traps_pass_min"],
        "ok_heldout": ~(above | over),
    }
    say = [
        F.when(~checks["ok_probes"], F.format_string("probe count %d under %d", F.col("n_probes"), F.lit(policy["min_probes"]))),
        F.when(~checks["ok_recall"], F.format_string("new-day recall %.3f under %s", F.col("new_day_recall"), F.lit(str(policy["new_day_recall_min"])))),
        F.when(~checks["ok_traps"], F.format_string("trap pass rate %.3f under %s", F.col("traps_pass"), F.lit(str(policy["traps_pass_min"])))),
        F.when(above, F.format_string("held-out recall %d/%d above base %d/%d", "heldout_hits", "heldout_n", "base_hits", "base_n")),
        F.when(over, F.format_string("held-out recall %.3f over the backstop", "heldout_recall")),
    ]
    weak = (F.col("heldout_n") > 0) & (F.col("heldout_n") < policy["heldout_probes"])
    passed = checks["ok_probes"] & checks["ok_recall"] & checks["ok_traps"] & checks["ok_heldout"]
    return out.withColumns({**checks, "passed": passed, "reasons": F.array_compact(F.array(*say)), "underpowered": weak})


def rescored(gated: DataFrame, kind: str, control: str) -> DataFrame:
    """Per kind of run: how many pass of how many, and whether all runs of the control are blocked."""
    n = gated.groupBy(kind).agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n"))
    return n.withColumn("control_blocked", F.when(F.col(kind) == control, F.col("n_passed") == 0))


def trap_rates(answers: DataFrame, step: str, score: str) -> DataFrame:
    """Mean trap score of each step, to three places; a step without traps has no row."""
    return answers.groupBy(step).agg(F.round(F.avg(score), 3).alias("rate"))


def readout(matrix: DataFrame, base: DataFrame, heldout: DataFrame, run: str, step: str = "step", day: str = "day", score: str = "score") -> DataFrame:
    """Per run: seen_mean and base_mean (final step), separation (seen less held out), retention of the first day (the
    longest path) and retention_micro, pooled over every cell after a day's first one. Days whose first score is not over
    WRITTEN were never written and are skipped. ``matrix``: (run, step, day, score), a day's first step is where it was
    written; ``base``: (run, day, score); ``heldout``: (run, score)."""
    last = matrix.groupBy(run).agg(F.max(step).alias("_last"), F.min(day).alias("_day0"))
    first = matrix.groupBy(run, day).agg(F.min(step).alias("_s"), F.min_by(score, step).alias("_f"))
    cells = matrix.join(first, [run, day]).join(last, run)
    final, kept = F.col(step) == F.col("_last"), F.when(F.col("_f") > WRITTEN, F.col(score) / F.col("_f"))
    own = cells.groupBy(run).agg(
        F.avg(F.when(final, F.col(score))).alias("seen_mean"),
        F.round(F.max(F.when(final & (F.col(day) == F.col("_day0")), kept)), 3).alias("retention_longest_path"),
        F.round(F.avg(F.when(F.col(step) > F.col("_s"), kept)), 3).alias("retention_micro"),
    )
    bases = base.groupBy(run).agg(F.avg(score).alias("base_mean"))
    out = own.join(bases, run, "left").join(heldout.select(run, F.col(score).alias("heldout")), run, "left")
    return out.withColumn("separation", F.round(F.col("seen_mean") - F.col("heldout"), 4))


def retained(matrix: DataFrame, run: str, step: str = "step", day: str = "day", score: str = "score") -> DataFrame:
    """Per run and day its final score over its first one, to three places, where that is over WRITTEN."""
    ends = matrix.groupBy(run, day).agg(F.min_by(score, step).alias("_f"), F.max_by(score, step).alias("_l"))
    return ends.where(F.col("_f") > WRITTEN).select(run, day, F.round(F.col("_l") / F.col("_f"), 3).alias("retention"))


def table_lines(readouts: DataFrame, run: str) -> DataFrame:
    """A line of fixed-width text per readout."""
    cell = lambda c, f: F.format_string(f, F.coalesce(c, F.lit(float("nan"))))
    parts = [F.rpad(run, 22, " "), cell("seen_mean", "%8.4f"), cell("separation", "%9.4f"), cell("base_mean", "%8.4f"), cell("retention_longest_path", "%9.3f")]
    return readouts.select(run, F.concat(*parts).alias("line"))


def survival(ours: DataFrame, baseline: DataFrame, control: DataFrame, value: str) -> DataFrame:
    """One row, the verdict on an ensemble: COLLAPSED where its mean is not over the control's greatest value, else
    SURVIVED, weakened or stronger where the mean is under or over the baseline's range; INDETERMINATE without a control."""
    a = ours.agg(F.avg(value).alias("mean"))
    b = baseline.agg(F.min(value).alias("least"), F.max(value).alias("most"))
    c = control.agg(F.max(value).alias("ceiling"))
    ladder = (
        F.when(F.col("ceiling").isNull(), "INDETERMINATE (no control runs found)")
        .when(F.col("mean") <= F.col("ceiling"), "COLLAPSED")
        .when(F.col("least").isNull(), "SURVIVED (no baseline to compare)")
        .when(F.col("mean") < F.col("least"), "SURVIVED (weakened)")
        .when(F.col("mean") > F.col("most"), "SURVIVED (stronger)")
        .otherwise("SURVIVED")
    )
    return a.crossJoin(b).crossJoin(c).withColumn("verdict", ladder)  # one row each


def dynamics(reference: DataFrame, ours: DataFrame, night: str, shape: tuple[str, ...], loss: str, label: str) -> DataFrame:
    """Per night and run of ours: whether each part of its shape is one of the reference's, and the reference's loss range."""
    sets = [F.collect_set(c).alias(f"_{c}") for c in shape]
    seen = reference.groupBy(night).agg(*sets, F.min(loss).alias("loss_least"), F.max(loss).alias("loss_most"))
    exact = F.lit(True)
    for c in shape:
        exact = exact & F.array_contains(f"_{c}", F.col(c))
    return ours.join(seen, night).select(night, label, exact.alias("shape_exact"), "loss_least", "loss_most", F.col(loss).between(F.col("loss_least"), F.col("loss_most")).alias("loss_inside"))


def family(model: Column) -> Column:
    """The generator family a model id names, in lower case; the id itself where it names none."""
    named = F.lower(F.regexp_extract(F.coalesce(model, F.lit("")), "(?i)(" + "|".join(FAMILIES) + ")", 1))
    return F.when(named != "", named).otherwise(F.lower(F.trim(F.coalesce(model, F.lit("")))))


def independence(probes: Column, corpus: Column) -> Column:
    """Whether probes may judge a corpus: ``unknown`` without a probe generator, ``same_family``, or ``independent``."""
    return F.when(F.coalesce(probes, F.lit("")) == "", "unknown").when(family(probes) == family(corpus), "same_family").otherwise("independent")


def judged(reply: Column) -> Column:
    """The 0 or 1 a judge's reply states, else null."""
    return F.regexp_extract(reply, VERDICT, 1).try_cast("int")


def judged_means(scored: DataFrame, suite: str, verdict: str) -> DataFrame:
    """Per suite and for all (suite null): n, n_unjudged and the mean of the verdicts there are; the mean over all answers
    is the micro mean."""
    return scored.groupingSets([[F.col(suite)], []], suite).agg(F.count("*").alias("n"), F.count_if(F.col(verdict).isNull()).alias("n_unjudged"), F.avg(verdict).alias("judge_exact"))


def checked_unjudged(scored: DataFrame, verdict: str, most: float = 0.05) -> DataFrame:
    """One row (n, n_unjudged); raises where more than ``most`` of the answers have no verdict."""
    n = scored.agg(F.count("*").alias("n"), F.count_if(F.col(verdict).isNull()).alias("n_unjudged"))
    bad = F.col("n_unjudged") > most * F.greatest(F.lit(1), F.col("n"))
    return n.select("n", F.when(bad, F.raise_error(F.lit("too many answers without a verdict")).cast("bigint")).otherwise(F.col("n_unjudged")).alias("n_unjudged"))


def mock_scores(name: Column) -> Column:
    """Passing scores that differ a little by name, for runs without a model: struct(new_day_recall, traps_pass)."""
    jitter = F.conv(F.left(F.sha2(name, 256), F.lit(2)), 16, 10).cast("double") / 255.0 * 0.05
    return F.struct((F.lit(0.26) + jitter).alias("new_day_recall"), F.lit(0.5).alias("traps_pass"))


def amplified(jobs: DataFrame, day: str, valid: str, text: str, least: float) -> DataFrame:
    """Per day: planned, ok, chars (of valid texts) and whether the ok rate reaches ``least``."""
    ok = F.col(valid)
    out = jobs.groupBy(day).agg(F.count("*").alias("planned"), F.count_if(ok).alias("ok"), F.coalesce(F.sum(F.when(ok, F.length(F.trim(text)))), F.lit(0)).alias("chars"))
    return out.withColumn("enough", F.col("ok") >= least * F.col("planned"))


def against_reference(ours: DataFrame, reference: DataFrame, day: str) -> DataFrame:
    """Per day the characters per paragraph, the reference's and their ratio."""
    per = lambda c, n: F.round(F.col(c) / F.greatest(F.lit(1), F.col(n)), 1)
    ref = reference.select(day, (F.col("chars") / F.col("ok")).alias("_r"))
    mean = F.col("chars") / F.greatest(F.lit(1), F.col("ok"))
    return ours.join(ref, day, "left").select(day, per("chars", "ok").alias("chars_per_paragraph"), F.round("_r", 1).alias("reference"), F.round(mean / F.col("_r"), 4).alias("ratio"))


def matched_budget(tokens: Column, length: int, least: int = 16) -> Column:
    """Training chunks a text of so many tokens makes alone: slices of ``length``, a last one of ``least`` or fewer left out."""
    return F.floor(tokens / length) + F.when(tokens % length > least, 1).otherwise(0)
