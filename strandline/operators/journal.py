"""Ledgers that outlive a process: rehydrated continuity, done rows, publication logs, memos, blobs and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: the beginning of a paragraph that corrects an assumption.
CORRECTION = "Contrary to what one might assume"
#: The fields of a prompt template.
FIELD = r"\[\[(\w+)\]\]"


def rehydrated(processed: DataFrame, dead: DataFrame, accepted: DataFrame, stream: str, seq: str, chunk: str, at: str) -> DataFrame:
    """Continuity per stream as a journal knows it: every number of the three classes counts as received (a floor of what
    was), processed beats dead, and a number's chunk is its first one by class and arrival.

    (stream, received, n_processed, n_dead, max_sequence, first_seen, last_seen, first_chunks)"""
    parts = [df.select(stream, seq, chunk, at, F.lit(i).alias("_c")) for i, df in enumerate((processed, dead, accepted))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    one = every.groupBy(stream, seq).agg(F.min("_c").alias("_c"), F.min_by(chunk, F.struct("_c", at, chunk)).alias("_k"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    return one.groupBy(stream).agg(
        F.count("*").alias("received"),
        F.count_if(F.col("_c") == 0).alias("n_processed"),
        F.count_if(F.col("_c") == 1).alias("n_dead"),
        F.max(seq).alias("max_sequence"),
        F.min("_a").alias("first_seen"),
        F.max("_b").alias("last_seen"),
        F.count_distinct("_k").alias("first_chunks"),
    )


def unseen(live: DataFrame, restored: DataFrame, stream: str) -> DataFrame:
    """What a restart takes from the journal: live streams keep their own state, only others are restored."""
    return live.unionByName(restored.join(live.select(stream), stream, "left_anti"), allowMissingColumns=True)


def done_rows(asked: DataFrame, receipts: DataFrame, dialects: DataFrame, chunk: str, modality: str) -> DataFrame:
    """The full receipt of each chunk asked for, with ``green`` (no stage failed; a receipt from before stages were
    recorded reads green) and ``answer``: fresh without a receipt, reprocess where its version is not the modality's
    current one (none known: any will do), else heal or skip."""
    now = dialects.select(modality, F.col("version").alias("_now"))
    both = asked.select(chunk).join(receipts, chunk, "left").join(now, modality, "left")
    green = F.coalesce(F.forall(F.map_values("stage_status"), lambda s: s == "ok"), F.lit(True))
    stale = F.col("_now").isNotNull() & (F.col("_now") != F.col("pipeline_version"))
    answer = F.when(F.col("pipeline_version").isNull(), "fresh").when(stale, "reprocess").when(~green & ~F.coalesce("done_final", F.lit(False)), "heal").otherwise("skip")
    return both.withColumns({"green": green, "answer": answer}).drop("_now")


def charged(pending: DataFrame, redriven: DataFrame, chunk: str) -> DataFrame:
    """``pending`` with one attempt more for each accepted chunk that is re-driven now; others stay."""
    own = redriven.select(chunk).distinct().withColumn("_r", F.lit(1))
    both = pending.join(own, chunk, "left")
    hit = F.col("_r").isNotNull() & (F.col("state") == "accepted")
    return both.withColumn("attempts", F.col("attempts") + F.when(hit, 1).otherwise(0)).drop("_r")


def cleared(pending: DataFrame, skips: DataFrame, chunk: str, epoch: str) -> DataFrame:
    """``pending`` without the accepted rows that a skip resolved at the same epoch; a row accepted again since stays."""
    gone = skips.select(chunk, epoch, F.lit("accepted").alias("state")).distinct()
    return pending.join(gone, [chunk, epoch, "state"], "left_anti")


def work_list(pending: DataFrame, lane: str, at: str, chunk: str) -> DataFrame:
    """Accepted rows, oldest first in each lane."""
    return pending.where("state = 'accepted'").withColumn("place", F.row_number().over(W.partitionBy(lane).orderBy(at, chunk)))


def live_activations(log: DataFrame, user: str, position: str, name: str, status: str, window: str) -> DataFrame:
    """The activations that are live at the end of a log: (user, position, name, window).

    An activation is pushed, and popped by a rollback of the same name while it is on top; a rollback of anything else
    says nothing. A user's log is one fold: a row a night."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(name).alias("n"), F.col(status).alias("s"), F.col(window).alias("w"))))
    kind = log.select(position, name, window).schema
    empty = F.array().cast(f"array<struct<p:{kind[0].dataType.simpleString()},n:{kind[1].dataType.simpleString()},w:{kind[2].dataType.simpleString()}>>")

    def step(stack, r):
        pops = (r.s == "rolled_back") & (F.size(stack) > 0) & (F.try_element_at(stack, F.lit(-1)).n == r.n)
        pushed = F.concat(stack, F.array(F.struct(r.p.alias("p"), r.n.alias("n"), r.w.alias("w"))))
        return F.when(r.s == "active", pushed).when(pops, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)

    held = log.groupBy(user).agg(F.aggregate(rows, empty, step).alias("_s"))
    return held.select(user, F.inline("_s")).toDF(user, position, name, window)


def resumed_from(log: DataFrame, user: str, position: str, name: str, status: str, window: str, before) -> DataFrame:
    """The activation each user's training of the window ``before`` goes on from: of those live among entries of strictly
    earlier windows the one of the latest window, wherever it stands in the log."""
    live = live_activations(log.where(F.col(window) < before), user, position, name, status, window)
    best = F.row_number().over(W.partitionBy(user).orderBy(F.desc(window), position))
    return live.withColumn("_r", best).where("_r = 1").drop("_r")


def publication(live: DataFrame, candidates: DataFrame, user: str, window: str, name: str) -> DataFrame:
    """The log rows that publishing appends: nothing where the same version is live for the window; else a rollback of each
    other live version of it and the activation; a failed gate leaves a row of its own and touches nothing.

    ``candidates``: (user, window, name, passed). (user, window, name, status, step)"""
    own = live.select(user, window, F.col(name).alias("_live"))
    met = candidates.join(own, [user, window], "left")
    same = met.groupBy(user, window, name, "passed").agg(F.coalesce(F.bool_or(F.col("_live") == F.col(name)), F.lit(False)).alias("_same"), F.collect_list("_live").alias("_old"))
    out = F.concat(
        F.transform(F.when(F.col("passed") & ~F.col("_same"), F.array_sort("_old")).otherwise(F.array().cast("array<string>")), lambda v: F.struct(v.cast("string").alias("name"), F.lit("rolled_back").alias("status"), F.lit(0).alias("step"))),
        F.array_compact(F.array(F.when(~F.col("passed"), F.struct(F.col(name).cast("string").alias("name"), F.lit("gate_failed").alias("status"), F.lit(1).alias("step"))).when(~F.col("_same"), F.struct(F.col(name).cast("string").alias("name"), F.lit("active").alias("status"), F.lit(1).alias("step"))))),
    )
    return same.select(user, window, F.inline(out))


def corpus_entries(corpora: DataFrame, text: str) -> DataFrame:
    """Admitted corpora with chars, sha and the number of their correcting paragraphs."""
    n = F.size(F.filter(F.split(text, "\n\n"), lambda p: p.startswith(CORRECTION)))
    return corpora.withColumns({"chars": F.length(text), "sha": F.sha2(text, 256), "neg_paragraphs": n}).drop(text)


def ledger_bodies(entries: DataFrame, user: str, window: str, recipe: str, before=None) -> DataFrame:
    """Per user the ledger of entries of windows strictly before one (ids compare as text), in order of window and recipe,
    in the envelope of its contract."""
    rows = entries if before is None else entries.where(F.col(window).cast("string") < before)
    listed = F.array_sort(F.collect_list(F.struct(F.col(window), F.col(recipe), *[c for c in entries.columns if c not in (user, window, recipe)])))
    head = F.struct(F.lit("C14").alias("contract"), F.lit("0").alias("version"), F.lit(before).cast("string").alias("before_window"))
    return rows.groupBy(user).agg(listed.alias("entries")).withColumn("head", head)


def fresh_stages(asked: DataFrame, memo: DataFrame, files: DataFrame, stage: str, key: str, at: str) -> DataFrame:
    """Which stages need not run again: the newest memo of the stage has the same key, and all its files are there."""
    newest = memo.groupBy(stage).agg(F.max_by(F.struct(key, "outputs"), at).alias("_m"))
    lost = newest.select(stage, F.explode("_m.outputs").alias("path")).join(files.select("path"), "path", "left_anti").groupBy(stage).agg(F.count("*").alias("_lost"))
    both = asked.join(newest, stage, "left").join(lost, stage, "left")
    return both.withColumn("fresh", F.coalesce((F.col(f"_m.{key}") == F.col(key)) & F.col("_lost").isNull(), F.lit(False))).drop("_m", "_lost")


def streams_of(arrivals: DataFrame, capture: str, modality: str, order: str) -> DataFrame:
    """Get-or-create: one stream per capture and modality, its id by their digest, its codec that of the first arrival."""
    one = arrivals.groupBy(capture, modality).agg(F.min_by("codec", order).alias("codec"))
    return one.withColumn("stream_id", F.sha2(F.concat_ws("\0", F.col(capture).cast("string"), modality), 256))


def blobs_read(asked: DataFrame, blobs: DataFrame, ref: str) -> DataFrame:
    """The bytes of each reference asked for: null where it is unknown or deleted."""
    live = blobs.where(~F.col("deleted")).select(ref, "data")
    return asked.join(live, ref, "left")


def body_faults(body: DataFrame, formats: tuple[str, ...], recipe: str) -> Column:
    """Why a day-log body is refused: contract, version, address, dialect, recipe; an empty array if it is taken."""
    bad = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    return F.array_compact(
        F.array(
            bad((F.col("contract") == "C10") & (F.col("version").cast("string") == "2"), "contract"),
            bad((F.col("user_id") == F.col("asked_user")) & (F.col("window_id") == F.col("asked_window")), "address"),
            bad(F.col("format_version").cast("string").isin(*formats), "dialect"),
            bad(F.col("recipe_id") == recipe, "recipe"),
        )
    )


def prompts_built(requests: DataFrame, text: str, key: Column) -> DataFrame:
    """Requests with a text that is not blank, with ids minted where they lack them: session_id and turn_id by digests of a key."""
    mint = lambda prefix: F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\0", F.lit(prefix), key.cast("string")), 256), F.lit(16)))
    ok = requests.where(F.length(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))) > 0)
    return ok.withColumns({"session_id": F.coalesce("session_id", mint("s-")), "turn_id": F.coalesce("turn_id", mint("t-"))})


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with its fields filled from ``values``; a field they lack raises, further values are ignored."""
    fields = F.regexp_extract_all(template, F.lit(FIELD), F.lit(1))
    lacking = F.array_except(fields, F.array(*map(F.lit, values)).cast("array<string>"))
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit(f"[[{name}]]"), value.cast("string"))
    return F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("missing field "), F.array_join(lacking, ", "))).cast("string")).otherwise(out)


def text_digest(pack: Column) -> Column:
    """Eight hex digits that ignore line endings, white space at line ends and blank lines at the end."""
    lines = F.regexp_replace(F.regexp_replace(pack, r"\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return F.left(F.sha2(F.regexp_replace(lines, r"\n+\z", ""), 256), F.lit(8))


def fields_rendered(anchor: Column, fields: dict[str, Column]) -> Column:
    """An anchor line and a labelled line for each field that says something: null, blank, none and n/a do not."""
    parts = []
    for label, value in fields.items():
        said = F.trim(value.cast("string"))
        parts.append(F.when(~F.lower(said).isin("", "none", "n/a"), F.concat(F.lit(f"{label}: "), said)))
    return F.concat_ws("\n", anchor, *parts)


def merged_maps(anchors: Column, extra: Column) -> Column:
    """The union of two maps; of a key in both the second one's value."""
    own = F.map_filter(anchors, lambda k, v: ~F.map_contains_key(extra, k))
    return F.map_concat(own, extra)


def sorted_map(x: Column) -> Column:
    """A map's entries by key, as text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat_ws("=", e.key, e["value"].cast("string"))), ",")
