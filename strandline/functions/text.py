"""Text functions as columns: budgets, redaction, normalisation, scoring, rendering, identifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII punctuation. Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Articles that token normalisation drops. Fixed values.
ARTICLES = ("a", "an", "the")
# What is redacted, in order of application, and what stands for it.
SECRETS = (
    r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|A3T[A-Z0-9])[A-Z0-9]{16}\b",
    r"\bsk-(?:proj-)?[A-Za-z0-9_-]{16,}\b",
    r"\bgh[porsu]_[A-Za-z0-9]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"-----BEGIN [A-Z0-9 ]+-----",
    r"\b[A-Za-z0-9+/]{32,}={0,2}\b",
    r"[•●]{3,}",
    r"(?<!\S)\*{6,}(?!\S)",
)
CARD = r"\b\d(?:[ -]?\d){12,18}\b"
REDACTED = "[redacted:secret]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def squeezed(x: Column) -> Column:
    """Runs of Unicode white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def cut_at_word(x: Column, cap: int) -> Column:
    """At most ``cap`` characters, ending at a word; a first word that is too long is cut hard."""
    head = F.left(x, F.lit(cap))
    at_word = F.when(F.substring(x, cap + 1, 1) == " ", head).otherwise(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    return F.when(F.length(x) <= cap, x).when(F.length(at_word) == 0, head).otherwise(F.rtrim(at_word))


def cut_at_sentence(x: Column, cap: int) -> Column:
    """At most ``cap`` characters, ending at a sentence; else at a word."""
    sentence = F.regexp_extract(F.left(x, F.lit(cap + 1)), r"(?s)^(.*[.!?])(?=\s|$)", 1)
    fits = (F.length(sentence) > 0) & (F.length(sentence) <= cap)
    return F.when(F.length(x) <= cap, x).when(fits, sentence).otherwise(cut_at_word(x, cap))


def char_budget(span: Column, rate: float) -> Column:
    """Characters for a span of seconds at a rate: rounded half to even, never negative."""
    return F.greatest(F.lit(0), F.bround(span * F.lit(rate)).cast("long"))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, as printf and Python write it: the value the double has decides, exact halves go to even.
    format_string rounds the shortest decimal that reads back as the double instead, halves up."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: f"{v:.{digits}f}")

    # a batch holds nulls as NaN
    return F.when(x.isNotNull(), F.pandas_udf(run, T.StringType())(x.cast("double")))


def _bound(x: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _marks(x: Column) -> Column:
    """How often REDACTED stands in a text."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(REDACTED), F.lit("")))) / len(REDACTED)).cast("int")


def redaction(x: Column) -> Column:
    """struct(text, n): ``x`` with each secret replaced, and how many were; one rule after another, then the runs of 13 to
    19 digits whose check digit holds. No rule can match a part of a mark, so that the marks count what was replaced."""
    marked = x
    for pattern in SECRETS:
        marked = F.regexp_replace(marked, pattern, REDACTED)
    edge = lambda c: F.concat(F.lit(r"\b"), c, F.lit(r"\b"))
    clean = lambda held, runs: F.aggregate(F.array_distinct(runs), held, lambda y, c: F.regexp_replace(y, edge(c), F.lit(REDACTED)))
    found = lambda held: F.filter(F.regexp_extract_all(held, F.lit(f"({CARD})"), F.lit(1)), lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[ -]", "")))
    both = lambda held: _bound(found(held), lambda runs: F.struct(clean(held, runs).alias("text"), (_marks(held) - _marks(x) + F.size(runs)).alias("n")))
    return _bound(marked, both)


def tokens(x: Column) -> Column:
    """Lower-case words: ASCII punctuation is space, articles are dropped."""
    words = F.split(F.trim(F.regexp_replace(F.translate(F.lower(x), PUNCTUATION, " " * len(PUNCTUATION)), r"\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 0) & ~w.isin(*ARTICLES))


def _numbered(words: Column) -> Column:
    """The words, each with its number among equal ones: a multiset as a set. In order, equal words are a run."""

    def runs(held: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        return _bound(first, lambda at: F.flatten(F.transform(at, lambda a, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(at, k + 1), F.size(held)) - a - 1), lambda j: F.concat_ws("\0", F.get(held, a), j.cast("string"))))))

    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(_bound(F.sort_array(words), runs))


def token_f1(guess: Column, gold: Column) -> Column:
    """Multiset token F1 of two token arrays: 0 if one is empty, or both."""
    both = F.size(F.array_intersect(_numbered(guess), _numbered(gold)))
    return F.when(both > 0, 2.0 * both / (F.size(guess) + F.size(gold))).otherwise(0.0)


def contains_gold(guess: Column, gold: Column) -> Column:
    """1 if the joined guess tokens contain the joined gold tokens; empty gold counts as contained."""
    return F.array_join(guess, " ").contains(F.array_join(gold, " ")).cast("double")


def marked(x: Column, markers: list[str]) -> Column:
    """Whether any marker occurs, without regard to case."""
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.lower(x).contains(m))


def order_score(x: Column, items: list[str]) -> Column:
    """Share of the found items' pairs that occur in the given order; 0 with fewer than two found."""
    places = F.filter(F.array(*[F.instr(F.lower(x), i) for i in items]), lambda p: p > 0)
    pairs = F.size(places) * (F.size(places) - 1) / 2
    later = lambda p, i: F.size(F.filter(F.slice(places, i + 2, F.greatest(F.size(places), F.lit(1))), lambda q: q > p))
    right = F.aggregate(F.transform(places, later), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(places) < 2, 0.0).otherwise(right / pairs)


def paragraphs(x: Column, least: int = 100) -> Column:
    """Paragraphs of more than ``least`` characters."""
    return F.filter(F.split(x, "\n\n"), lambda p: F.length(p) > least)


def n_words(x: Column) -> Column:
    """White-space separated words; blank text has none."""
    return F.when(F.length(F.trim(x)) == 0, 0).otherwise(F.size(F.split(F.trim(x), r"\s+")))


def record_id(*parts: Column) -> Column:
    """sha256 over the parts with NUL between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def sharded_ref(digest: Column) -> Column:
    """A blob's place aa/bb/digest."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def composed_version(parts: Column) -> Column:
    """Stage versions sorted and joined by +."""
    return F.array_join(F.array_sort(parts), "+")


def split_once(x: Column, mark: str) -> Column:
    """(text, tail): what stands before and after the first mark; the tail is null without one."""
    at = F.instr(x, mark)
    return F.struct(F.when(at > 0, F.substr(x, F.lit(1), at - 1)).otherwise(x).alias("text"), F.when(at > 0, F.substr(x, at + len(mark))).alias("tail"))


def caption(app: Column, activity: Column, description: Column) -> Column:
    """'app — activity. description' from what there is."""
    some = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    head = F.concat_ws(" — ", some(app), some(activity))
    return F.concat_ws(". ", F.when(F.length(head) > 0, head), some(description))


def flat_chunks(ids: Column, size: int, least: int = 17) -> Column:
    """Slices of ``size`` of an array; a last one shorter than ``least`` is dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(size))
    return F.filter(F.transform(starts, lambda s: F.slice(ids, s + 1, size)), lambda c: F.size(c) >= least)
