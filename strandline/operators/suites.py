"""Evaluation suites: probes answered by an injected model, scored by scorers and a judge picked by name, in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import evaluation
from strandline.operators.registry import Registry

# What an answer says that refuses or corrects a false premise.
TRAP_MARKERS = (
    "didn't", "did not", "never", "wasn't", "was not", "no record", "not part",
    "doesn't appear", "does not appear", "not visit", "only 35", "35 days",
    "no evidence", "i don't", "unknown", "not aware", "no information",
    "fictional", "fabricated", "made up", "there is no", "there was no",
    "isn't", "is not", "cannot find", "can't find", "not mention",
)


@dataclass(frozen=True)
class Scorer:
    """A score of an answer against its gold: a function of both columns, the type the gold must have, and the score's."""

    score: Callable[[Column, Column], Column]
    gold: str = "string"
    gives: str = "double"


def _ordered(gold: Column, answer: Column) -> Column:
    """Share of pairs of the gold's places (JSON, in order) that the answer names in the same order, times the share named."""
    short = lambda p: F.lower(F.trim(F.split_part(F.split_part(p, F.lit(","), F.lit(1)), F.lit(" then "), F.lit(1))))
    places = F.from_json(gold, "array<string>")
    at = F.transform(places, lambda p: F.instr(F.lower(answer), short(p)))
    named = F.filter(F.transform(at, lambda x, i: F.struct(i.alias("i"), x.alias("at"))), lambda r: r["at"] > 0)
    pairs = F.flatten(F.transform(named, lambda a: F.transform(F.filter(named, lambda b: b["i"] > a["i"]), lambda b: (a["at"] < b["at"]).cast("int"))))
    right = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    n = F.size(named)
    return F.when(n < 2, F.lit(0.0)).otherwise(right / F.size(pairs) * n / F.size(places))


SCORERS: Registry[Scorer] = Registry("scorer")
SCORERS.add("f1", Scorer(lambda gold, answer: text.token_f1(text.tokens(answer), text.tokens(gold))))
SCORERS.add("contains", Scorer(lambda gold, answer: text.contains_gold(text.tokens(answer), text.tokens(gold)).cast("double")))
SCORERS.add("trap", Scorer(lambda gold, answer: text.marked(answer, list(TRAP_MARKERS)).cast("double")))
SCORERS.add("order", Scorer(_ordered))

#: A judge gives 0, 1 or null (no verdict) for (question, gold, answer).
JUDGES: Registry[Callable[[Column, Column, Column], Column]] = Registry("judge")
JUDGES.add("match", lambda q, gold, answer: text.contains_gold(text.tokens(answer), text.tokens(gold)).cast("int"))
JUDGES.add("replies", lambda q, gold, answer: evaluation.judged(answer))


def answered(probes: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(suite, probe_id, q, gold, pred) of probes (suite, probe_id, q, gold). ``answer`` adds ``pred`` to all rows it is given:
    a column function, or a model in batches."""
    return answer(probes.select("suite", "probe_id", "q", "gold")).select("suite", "probe_id", "q", "gold", "pred")


def with_floor(day_probes: DataFrame, heldout: DataFrame, tuned: Callable[[DataFrame], DataFrame], base: Callable[[DataFrame], DataFrame], step: int) -> DataFrame:
    """The answers of one step: the suites s{step}_d{day} of the days so far and s{step}_heldout by the tuned model, and the same
    questions by the base model (base_d{day}, base_heldout): what it knows without. ``day_probes``: (day, probe_id, q, gold)."""
    own = lambda name: day_probes.select(F.concat(F.lit(f"{name}_d"), F.col("day").cast("string")).alias("suite"), "probe_id", "q", "gold")
    held = lambda name: heldout.select(F.lit(f"{name}_heldout").alias("suite"), "probe_id", "q", "gold")
    both = lambda name: own(name).unionByName(held(name))
    return answered(both(f"s{step}"), tuned).unionByName(answered(both("base"), base))


def scored(answers: DataFrame, *names: str) -> DataFrame:
    """``answers`` with a column per scorer; all in one projection. An unknown name, or a gold of another type, raises here."""
    chosen = {n: SCORERS[n] for n in names}
    kind = answers.schema["gold"].dataType.simpleString()
    for n, s in chosen.items():
        if s.gold != kind:
            raise ValueError(f"the scorer {n} takes a gold of type {s.gold}, not {kind}")
    return answers.withColumns({n: s.score(F.col("gold"), F.col("pred")).cast(s.gives) for n, s in chosen.items()})


def judged(answers: DataFrame, judge: str) -> DataFrame:
    """``answers`` with the named judge's verdict as ``judge``."""
    return answers.withColumn("judge", JUDGES[judge](F.col("q"), F.col("gold"), F.col("pred")).cast("int"))


def write_scored(rows: DataFrame, path: str) -> None:
    """A verdict per answer as JSON lines with suite, probe_id, gold, pred and judge: one without a verdict says null."""
    rows.select("suite", "probe_id", "gold", "pred", "judge").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def table_of(readouts: DataFrame, shown: Column | None = None) -> DataFrame:
    """(place, line): readouts (label, seen_mean, separation, micro, heldout, base_mean, retention, traps) as a text table, in
    order of label; a missing number reads nan. ``shown`` stands in the line instead of the padded label; where it is null, so
    is the line."""
    head = f"{'run':<22}{'seen':>8}{'sep':>9}{'micro':>8}{'heldout':>9}{'base':>8}{'ret(d0)':>9}{'traps':>7}"
    number = lambda c, width, digits: F.lpad(F.coalesce(text.fixed(F.col(c), digits), F.lit("nan")), width, " ")
    label = F.when(F.length("label") >= 22, F.col("label")).otherwise(F.rpad("label", 22, " ")) if shown is None else shown
    shape = (("seen_mean", 8, 4), ("separation", 9, 4), ("micro", 8, 4), ("heldout", 9, 4), ("base_mean", 8, 4), ("retention", 9, 3), ("traps", 7, 2))
    lines = readouts.select(F.col("label").alias("_l"), F.concat(label, *[number(*s) for s in shape]).alias("line"))
    spark = readouts.sparkSession
    first = spark.createDataFrame([(-2, head), (-1, "-" * len(head))], "place long, line string")
    # an ensemble has a row a run
    return first.unionByName(lines.select((F.row_number().over(W.orderBy("_l")) - 1).cast("long").alias("place"), "line"))
