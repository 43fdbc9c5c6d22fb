"""The nightly cycle over all users of a night: day-log, amplify, mix with rehearsal, train, gate, publish.

Each verb is a resumable stage (stages.py) under a key of what its result depends on, per (user, window). The publication log,
the reservoir of learnt texts and the strikes are read from the rows that earlier nights' stages committed, so there is
nothing to repair after a kill: what has no memo has not happened. Models stand behind a ``Backend`` of batch functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import evaluation, ledgers, profiles, rehearsal, slots
from strandline.operators.stages import Stages, key_of

OWNER = ("user_id", "window_id")
_HEAD = "user_id string, window_id string"


@dataclass(frozen=True)
class Recipe:
    """What a night does; every field that a stage's result depends on is in the stage's key."""

    recipe_id: str
    profile: str = "days"
    segment_seconds: int = 60
    block_segments: int = 12
    variants: int = 2
    neg_frac: float = 0.1
    ok_rate_min: float = 0.85
    quality_min: float = 0.0
    replay_frac: float = 0.3
    rank: int = 16
    rate: float = 1e-4
    epochs: int = 1


@dataclass(frozen=True)
class Backend:
    """The models. ``generate``: a retelling for each job, as a column of its text and prompt; ``train``: the name of the
    weights that a text makes of the weights it goes on from; ``evaluate``: (owner, version) to the scores that a gate reads."""

    generate: Callable[[Column, Column], Column]
    train: Callable[[Column, Column], Column]
    evaluate: Callable[[DataFrame], DataFrame]


def published(stages: Stages, tonight: DataFrame | None = None) -> DataFrame:
    """The outcomes of all nights (or of those before a user's own of tonight): owner, status, version, sha, text."""
    rows = stages.rows("publish", PUBLISHED)
    if tonight is None:
        return rows
    own = tonight.select("user_id", F.col("window_id").alias("_now"))
    return rows.join(own, "user_id").where("window_id < _now").drop("_now")


PUBLISHED = f"{_HEAD}, recipe_id string, version string, status string, reasons string, sha string, text string"


def frozen(stages: Stages, limit: int) -> DataFrame:
    """Users whose last ``limit`` windows or more all failed: they rest until they are forced."""
    outcomes = stages.rows("publish", PUBLISHED).withColumn("passed", F.col("status") == "published")
    return ledgers.strikes(outcomes, "user_id", "window_id", "passed", limit).where("frozen").select("user_id")


def night(stages: Stages, blocks: DataFrame, recipe: Recipe, policy: dict, backend: Backend, seed: int = 0, force: bool = False) -> DataFrame:
    """One night of every user in ``blocks`` (user_id, window_id, block, block_id, first_bucket, text, quality, anchors; a
    user has one window a night): (user_id, window_id, status, version, reasons), status being published, gate_failed,
    skipped_no_data, frozen or aborted (too few valid retellings; the earlier weights keep serving)."""
    profile = profiles.PROFILES[recipe.profile]
    rests = frozen(stages, policy["freeze"]).withColumn("_rests", F.lit(not force))
    asked = stages.held(blocks.select(*OWNER).distinct().join(rests, "user_id", "left").select(*OWNER, F.coalesce("_rests", F.lit(False)).alias("rests")))
    awake = asked.where("not rests").select(*OWNER)
    prior = stages.held(published(stages, awake).where("status = 'published'"))
    own_of = lambda rows, own: rows.join(own, list(OWNER), "left_semi")

    fields = ["block", "block_id", "first_bucket", "text", "quality", "anchors"]
    kind = f"{_HEAD}, block long, block_id string, first_bucket long, text string, quality double, anchors map<string,string>"
    today = own_of(blocks, awake).select(*OWNER, *fields)
    keys = slots.window_bodies(today, OWNER).select(*OWNER, key_of(F.col("content_fingerprint"), F.col("window_id"), F.lit(recipe.segment_seconds), F.lit(recipe.block_segments)).alias("key"))
    day, keys = stages.run("daylog", keys, kind, lambda own: own_of(today, own))
    eligible = day.where(F.col("quality").isNull() | (F.col("quality") >= recipe.quality_min))

    corpus = slots.window_bodies(eligible, OWNER).select(*OWNER, F.sha2("corpus", 256).alias("corpus"))
    made = [F.lit(getattr(recipe, f)) for f in ("recipe_id", "variants", "neg_frac")]
    keys = keys.join(corpus, list(OWNER)).select(*OWNER, key_of(F.col("key"), F.col("corpus"), *made, F.lit(seed)).alias("key"))

    def amplify(own: DataFrame) -> DataFrame:
        jobs = profiles.planned(own_of(eligible, own), profile, recipe.variants, recipe.neg_frac, seed, OWNER)
        told = jobs.withColumn("generated", backend.generate(F.col("text"), F.col("prompt")))
        return profiles.collected(told, profile, "generated", recipe.ok_rate_min, seed, OWNER)

    amplified, keys = stages.run("amplify", keys, f"{_HEAD}, planned long, ok long, negatives long, neg_frac double, ok_rate double, enough boolean, text string", amplify)
    live = amplified.where("enough").select(*OWNER, F.col("text").alias("new"))

    ledger = prior.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "window_id", "sha"))), ";").alias("ledger"))
    keys = own_of(keys, live).join(ledger, "user_id", "left").select(*OWNER, key_of(F.col("key"), F.col("ledger"), F.lit(recipe.replay_frac)).alias("key"))

    def mix(own: DataFrame) -> DataFrame:
        now = own_of(live, own)
        tonight = now.select("user_id", F.col("window_id").alias("before"), F.length("new").alias("target"))
        earlier = rehearsal.sources("amp", tonight, "user_id", "window_id", corpora=prior)
        old = rehearsal.rehearsal(earlier, tonight, "user_id", "window_id", recipe.replay_frac, seed).select("user_id", F.col("text").alias("old"))
        text = F.when(F.length("old") > 0, F.concat_ws("\n\n", "new", "old")).otherwise(F.col("new"))
        return now.join(old, "user_id").select(*OWNER, "new", text.alias("text"))

    mixed, keys = stages.run("mix", keys, f"{_HEAD}, new string, text string", mix)

    last = prior.groupBy("user_id").agg(F.max_by("version", "window_id").alias("from"))
    settings = [F.lit(getattr(recipe, f)) for f in ("recipe_id", "rank", "rate", "epochs")]
    keys = keys.join(last, "user_id", "left").select(*OWNER, key_of(F.col("key"), *settings, F.col("from")).alias("key"))

    def train(own: DataFrame) -> DataFrame:
        now = own_of(mixed, own).join(last, "user_id", "left")
        return now.select(*OWNER, backend.train(F.col("text"), F.coalesce("from", F.lit(""))).alias("version"), "new")

    trained, keys = stages.run("train", keys, f"{_HEAD}, version string, new string", train)
    # a policy decides what is shipped, never what is done again: it is in no key
    keys = keys.select(*OWNER, key_of(F.col("key"), F.lit("terminal")).alias("key"))

    def publish(own: DataFrame) -> DataFrame:
        now = own_of(trained, own)
        judged = evaluation.gate(backend.evaluate(now.select(*OWNER, "version")), policy).select(*OWNER, "passed", F.array_join("reasons", "; ").alias("reasons"))
        status = F.when(F.col("passed"), "published").otherwise("gate_failed")
        learnt = F.when(F.col("passed"), F.col("new"))  # only a night that passed is rehearsed later
        return now.join(judged, list(OWNER)).select(*OWNER, F.lit(recipe.recipe_id).alias("recipe_id"), "version", status.alias("status"), "reasons", F.sha2(learnt, 256).alias("sha"), learnt.alias("text"))

    outcome, _ = stages.run("publish", keys, PUBLISHED, publish)
    why = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("rests"), "frozen")
        .when(F.col("enough").isNull(), "skipped_no_data")
        .otherwise("aborted")
    )
    both = asked.join(amplified.select(*OWNER, "enough"), list(OWNER), "left").join(outcome.select(*OWNER, "status", "version", "reasons"), list(OWNER), "left")
    return stages.held(both.select(*OWNER, why.alias("status"), "version", "reasons"))


def mock() -> Backend:
    """Models that only look like some, for runs without any: a retelling quotes its block, weights are named by a digest."""

    def generate(text: Column, prompt: Column) -> Column:
        return F.concat(F.lit("Told again: "), F.left(text, F.lit(2000)), F.lit(" ("), F.left(F.sha2(prompt, 256), F.lit(8)), F.lit(")."))

    def train(text: Column, start: Column) -> Column:
        return F.left(F.sha2(F.concat_ws("\0", start, text), 256), F.lit(12))

    def evaluate(rows: DataFrame) -> DataFrame:
        scores = evaluation.mock_scores(F.col("version"))
        return rows.select(*OWNER, scores["new_day_recall"].alias("new_day_recall"), scores["traps_pass"].alias("traps_pass"), *[F.lit(n).alias(c) for c, n in (("n_probes", 140), ("heldout_hits", 2), ("heldout_n", 60), ("base_hits", 2), ("base_n", 60))])

    return Backend(generate, train, evaluate)
