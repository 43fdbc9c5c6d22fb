"""Day-logs on demand: fetched from the store where a rendering still fits, built and stored where it does not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import slots
from strandline.streaming.store import Store, Table

DAY_LOG = "user_id string, window_id string, format_version string, recipe_id string, home_tz string, n_blocks long, corpus string, content_fingerprint string"
OWNER = ("user_id", "window_id")


def store(spark: SparkSession, path: str) -> Store:
    """The store of rendered day-logs."""
    return Store(spark, path, {"day_logs": Table(DAY_LOG, OWNER)})


def fetched(held: Store, windows: DataFrame, profiles: DataFrame, version: str, recipe: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(user_id, window_id, state, home_tz, n_blocks, corpus, content_fingerprint) of each window asked for.

    state: cached where the stored rendering has this format version, recipe and the user's zone now (any zone, if the user
    has no profile any more); built, and stored, where it has not; refused where there is nothing to build with. ``build``:
    windows with their home_tz to (user_id, window_id, n_blocks, corpus, content_fingerprint). A window without blocks has an
    empty rendering, and that is stored too."""
    cache = held.read("day_logs").where("format_version is not null")
    states = slots.cache_states(windows, cache, profiles, version, recipe, OWNER)
    todo = states.where("state = 'build'").select(*OWNER).join(profiles.select("user_id", "home_tz"), "user_id")
    number = held.last() + 1
    made = todo.join(build(todo).select(*OWNER, "n_blocks", "corpus", "content_fingerprint"), list(OWNER), "left")
    empty = {"n_blocks": F.coalesce("n_blocks", F.lit(0)), "corpus": F.coalesce("corpus", F.lit("")), "format_version": F.lit(version), "recipe_id": F.lit(recipe)}
    step = f"{held.path}/asked/batch={number}"
    states.write.mode("overwrite").parquet(step)  # what the store held before this call
    held.write("day_logs", made.withColumns(empty), number)
    held.commit(number)
    asked = held.spark.read.schema(states.schema).parquet(step)
    state = F.when(F.col("state") == "build", "built").otherwise(F.col("state"))
    rows = held.read("day_logs", number + 1).select(*OWNER, "home_tz", "n_blocks", "corpus", "content_fingerprint")
    live = asked.where("state <> 'refused'").join(rows, list(OWNER), "left")
    refused = asked.where("state = 'refused'")
    return live.unionByName(refused, allowMissingColumns=True).withColumn("state", state)


def forgotten(held: Store, stale: DataFrame) -> None:
    """Drop the renderings of these windows (user_id, window_id): the next fetch builds them again."""
    number = held.last() + 1
    held.write("day_logs", stale.select(*OWNER, *[F.lit(None).alias(c) for c in ("format_version", "recipe_id", "home_tz", "n_blocks", "corpus", "content_fingerprint")]), number)
    held.commit(number)
