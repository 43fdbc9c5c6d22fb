"""Profiles: how one domain renders records to blocks, asks for retellings and knows a good one, as columns, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.journal import fields_rendered
from strandline.operators.registry import Registry

# The characters a retelling must have more of, what only an echo of the request says, the characters in which a
# correcting paragraph denies, how it does, and the characters of a record that a request quotes.
LEAST_CHARS, ECHO, SCAN, EXCERPT = 120, "RECORD", 300, 6000
DENIES = r"(?i)contrary to|it is not true|never happened|did not|didn.t|was not|wasn.t|one might assume|not the case"


@dataclass(frozen=True)
class Profile:
    """A domain. ``fields``: labels of a record's fields in order; ``styles``: of retellings, and the one that corrects;
    ``request``: a template with the fields [[style]], [[excerpt]] and those of the anchors; ``anchor``: the anchor a retelling
    must name."""

    name: str
    fields: dict[str, str]
    styles: tuple[str, ...]
    correcting: str
    request: str
    anchor: str
    anchors: tuple[str, ...]

    def rendered(self, line: Column, field: Callable[[str], Column]) -> Column:
        """A block's text: the anchor line, and the labelled fields that say something."""
        return fields_rendered(line, {label: field(name) for name, label in self.fields.items()})

    def anchored(self, value: Callable[[str], Column]) -> Column:
        """The anchors of a block, as text by name."""
        return F.create_map(*[x for name in self.anchors for x in (F.lit(name), F.coalesce(value(name).cast("string"), F.lit("")))])

    def asked(self, text: Column, anchors: Column, style: Column) -> Column:
        """The request for one retelling of a block."""
        out = F.lit(self.request)
        for name in self.anchors:
            out = F.replace(out, F.lit(f"[[{name}]]"), anchors[name])
        return F.replace(F.replace(out, F.lit("[[style]]"), style), F.lit("[[excerpt]]"), F.left(text, F.lit(EXCERPT)))

    def valid(self, text: Column, anchors: Column) -> Column:
        """Whether a retelling is long enough, no echo of the request, and names its block's anchor."""
        own = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
        return F.coalesce((F.length(own) > LEAST_CHARS) & ~own.contains(ECHO) & own.contains(anchors[self.anchor]), F.lit(False))

    def calibrates(self, text: Column) -> Column:
        """Whether a paragraph denies early, and so corrects an assumption."""
        return F.left(text, F.lit(SCAN)).rlike(DENIES)


PROFILES: Registry[Profile] = Registry("profile")
PROFILES.add(
    "days",
    Profile(
        "days",
        {"setting": "Setting", "activity": "Activity", "details": "Details"},
        ("a plain account", "a list of who was there", "what came before and after", "answers to questions"),
        "a correction of a false claim",
        "Retell this part of day [[day]] in [[place]] as [[style]]. Name the day.\n\n=== RECORD ===\n[[excerpt]]\n=== END RECORD ===",
        "day",
        ("day", "place"),
    ),
)


def planned(blocks: DataFrame, profile: Profile, variants: int, share: float, seed: int, owner: tuple[str, ...]) -> DataFrame:
    """A job per block (owner, block_id, text, anchors) and variant: owner, block_id, variant, style, negative, prompt.

    A seeded ``share`` of the jobs corrects; the others turn through the styles, each block from a place of its own."""
    jobs = blocks.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))) if variants > 0 else blocks.withColumn("variant", F.lit(0)).limit(0)
    key = [F.col(c).cast("string") for c in (*owner, "block_id")]
    at = lambda salt, *more: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *key, *more), F.lit(1_000_000))
    negative = at(1, F.col("variant")) < F.lit(int(share * 1_000_000))
    turned = F.pmod(F.col("variant") + at(2), F.lit(len(profile.styles))).cast("int")
    style = F.when(negative, F.lit(profile.correcting)).otherwise(F.element_at(F.array(*map(F.lit, profile.styles)), turned + 1))
    out = jobs.withColumns({"style": style, "negative": negative})
    return out.withColumn("prompt", profile.asked(F.col("text"), F.col("anchors"), F.col("style")))


def collected(jobs: DataFrame, profile: Profile, generated: str, least: float, seed: int, owner: tuple[str, ...]) -> DataFrame:
    """Per owner: planned, ok, negatives, neg_frac, ok_rate, enough, and the valid texts in a seeded order, joined.

    A night whose share of valid texts is under ``least`` has enough = false and no text: it must not be learnt."""
    good = profile.valid(F.col(generated), F.col("anchors"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*owner, "block_id", "variant")]))
    rows = jobs.withColumns({"_ok": good, "_u": place, "_t": F.regexp_replace(F.col(generated), r"(?U)\A\s+|\s+\z", "")})
    out = rows.groupBy(*owner).agg(
        F.count("*").alias("planned"),
        F.count_if("_ok").alias("ok"),
        F.count_if("negative").alias("negatives"),
        F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("_u", "_t")))).alias("_texts"),
    )
    rate = F.col("ok") / F.col("planned")
    enough = rate >= least
    text = F.when(enough, F.array_join(F.col("_texts._t"), "\n\n"))
    return out.select(*owner, "planned", "ok", "negatives", (F.col("negatives") / F.col("planned")).alias("neg_frac"), rate.alias("ok_rate"), enough.alias("enough"), text.alias("text"))
