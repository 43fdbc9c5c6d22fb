"""Rehearsal: which earlier nights may be mixed into tonight's text, and the paragraphs a budget draws from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import text as texts

#: Hex digits of the seeded order by which running sums are taken in two steps: 4096 buckets a user.
BUCKET = 3
#: Parts in which a user's windows are compared to tonight's.
SALTS = 512


def _before(rows: DataFrame, tonight: DataFrame, user: str, window: str) -> DataFrame:
    """Rows of windows strictly before each user's own of tonight; ids compare as text. A user's rows meet the own window in
    SALTS parts, so that no task reads all of them."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    own = tonight.select(user, F.col("before").cast("string").alias("_before"), salts.alias("_salt"))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(window), F.lit(SALTS)))
    return dealt.join(own, [user, "_salt"]).where(F.col(window).cast("string") < F.col("_before")).drop("_before", "_salt")


def prior_windows(windows: DataFrame, tonight: DataFrame, user: str, window: str) -> DataFrame:
    """The windows each user may rehearse: consolidated and published, before tonight's. A window that failed was never
    learnt. ``windows``: (user, window, state, outcome); ``tonight``: (user, before)."""
    return _before(windows.where("state = 'consolidated' and outcome = 'published'"), tonight, user, window)


def sources(kind: str, tonight: DataFrame, user: str, window: str, corpora: DataFrame | None = None, blocks: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """(user, window, part, text) to rehearse: ``amp`` takes the admitted corpora of earlier windows, ``rawlog`` the blocks
    (user, window, part, text) of the published earlier ones. Another kind, or one without its tables, raises."""
    if kind == "amp" and corpora is not None:
        return _before(corpora, tonight, user, window).select(user, window, F.lit(0).alias("part"), "text")
    if kind == "rawlog" and blocks is not None and windows is not None:
        live = prior_windows(windows, tonight, user, window).select(user, window)
        return blocks.join(live, [user, window], "left_semi").select(user, window, "part", "text")
    raise ValueError(f"can't rehearse from {kind!r} with these tables")


def without_bodies(entries: DataFrame, tonight: DataFrame, user: str, window: str, frac: float) -> DataFrame:
    """(user, text) where only the ledger of corpora is at hand: empty if the fraction is 0 or nothing came before; a night
    that would have rehearsed raises instead of training without."""
    had = _before(entries, tonight, user, window).select(user).distinct().withColumn("_had", F.lit(frac > 0))
    refused = F.raise_error(F.lit("the ledger has no bodies to rehearse")).cast("string")
    return tonight.select(user).join(had, user, "left").select(user, F.when(F.col("_had"), refused).otherwise("").alias("text"))


def pooled(held: DataFrame, user: str, window: str, seed: str) -> DataFrame:
    """(user, window, part, n, text, size, _u): the sources' paragraphs with their place ``_u`` in a seeded order."""
    rows = held.select(user, window, "part", F.posexplode(texts.paragraphs(F.col("text"))).alias("n", "text"))
    key = [F.col(c).cast("string") for c in (user, window, "part", "n")]
    return rows.withColumns({"size": F.length("text"), "_u": F.md5(F.concat_ws(":", F.lit(seed), *key))})


def drawn(pool: DataFrame, budgets: DataFrame, user: str, window: str) -> DataFrame:
    """Paragraphs in the seeded order while what stands before them is under the user's budget: the last may overshoot.

    Sums run over buckets of the order, then inside the buckets that a budget reaches: no task sorts a user's whole pool."""
    rows = pool.withColumn("_b", F.left("_u", F.lit(BUCKET)))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(user, "_b").agg(F.sum("size").alias("_s"))
    sums = sums.withColumn("_held", F.coalesce(F.sum("_s").over(upto(W.partitionBy(user).orderBy("_b"))), F.lit(0)))
    reached = sums.join(budgets.select(user, "budget"), user).where("_held < budget").drop("_s")
    inside = upto(W.partitionBy(user, "_b").orderBy("_u", window, "part", "n"))
    used = F.col("_held") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.join(reached, [user, "_b"]).withColumn("used_before", used).where("used_before < budget").drop("_b", "_held", "budget")


def rehearsal(held: DataFrame, tonight: DataFrame, user: str, window: str, frac: float, seed: int, neg_boost: float = 0.0, calibrates=None) -> DataFrame:
    """(user, text) for each of tonight's users (user, before, target): paragraphs of about ``frac`` of the target's
    characters, empty without sources. ``neg_boost`` of that goes to paragraphs that ``calibrates`` (Column -> Column)
    knows, which stand first; the others are drawn from all. A user's draw passes the budget by its last paragraph at most."""
    if neg_boost > 0 and calibrates is None:
        raise ValueError("neg_boost needs to know which paragraphs calibrate")
    if frac <= 0:
        return tonight.select(user, F.lit("").alias("text"))
    share = lambda part: tonight.select(user, (F.col("target") * part).alias("budget"))
    draws = drawn(pooled(held, user, window, str(seed)), share(frac * (1 - neg_boost)), user, window).withColumn("draw", F.lit(1))
    if neg_boost > 0:
        known = pooled(held, user, window, f"{seed}/boost").where(calibrates(F.col("text")))
        draws = draws.unionByName(drawn(known, share(frac * neg_boost), user, window).withColumn("draw", F.lit(0)))
    taken = draws.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("draw", F.col("_u").alias("u"), F.col(window).alias("w"), "part", "n", "text"))).alias("_t"))
    both = tonight.select(user).join(held.select(user).distinct().withColumn("_had", F.lit(True)), user, "left").join(taken, user, "left")
    part = lambda k: F.coalesce(F.array_join(F.transform(F.filter("_t", lambda r: r.draw == k), lambda r: r.text), "\n\n"), F.lit(""))
    said = F.concat(part(0), F.lit("\n\n"), part(1)) if neg_boost > 0 else part(1)
    return both.select(user, F.when(F.col("_had"), said).otherwise("").alias("text"))
