"""Text on screens: boxes, roles, reading order, rendered lines and the choice of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import text as texts
from strandline.operators import folds

# Fixed value: the roles a region may have.
ROLES = ("titlebar", "tab", "sidebar", "main", "compose", "message", "toolbar", "statusbar", "dialog", "notification")


def normal_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1) in shares of the frame; coordinates that are shares already (all within 1) stay as they are,
    a frame without a size counts as 1, and a box that lacks a coordinate is all 0."""
    most = F.greatest(F.abs(x0), F.abs(y0), F.abs(x1), F.abs(y1))
    one = lambda n: F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).otherwise(n.cast("double"))
    w, h = F.when(most <= 1, 1.0).otherwise(one(width)), F.when(most <= 1, 1.0).otherwise(one(height))
    whole = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    part = lambda v, by, name: F.when(whole, v.cast("double") / by).otherwise(0.0).alias(name)
    return F.struct(part(x0, w, "x0"), part(y0, h, "y0"), part(x1, w, "x1"), part(y1, h, "y1"))


def role_of(box: Column) -> Column:
    """The role a box's place suggests; a box without area is main. The first rule that fits decides."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x0, y0, x1, y1 = (clamp(box[c]) for c in ("x0", "y0", "x1", "y1"))
    cx, cy, w, h = (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0
    modal = cx.between(0.30, 0.70) & cy.between(0.30, 0.70) & w.between(0.15, 0.45) & h.between(0.06, 0.30)
    return (
        F.when((w <= 0) | (h <= 0), "main")
        .when(cy <= 0.05, "titlebar")
        .when((cy <= 0.30) & (cx >= 0.82), "notification")
        .when(cy <= 0.12, F.when(cx < 0.5, "tab").otherwise("toolbar"))
        .when(cy >= 0.95, "statusbar")
        .when(cx <= 0.18, "sidebar")
        .when(modal, "dialog")
        .when(cy >= 0.70, "compose")
        .otherwise("main")
    )


def screen_items(regions: DataFrame, least_conf: float, least_chars: int) -> DataFrame:
    """The regions that are rendered: sure enough, long enough once white space is single, secrets replaced, with a role.

    ``regions``: (chunk, t_offset, place, conf, role, box, text); adds line, n_redactions and order (frame time, then top
    to bottom and left to right by the box rounded to four places, then the engine's own place)."""
    squeezed = texts.squeezed(F.col("text"))
    rows = regions.where((F.col("conf") >= least_conf) & (F.length(squeezed) >= least_chars))
    rows = rows.withColumn("_x", texts.redaction(squeezed))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(role_of(F.col("box")))
    order = F.struct("t_offset", F.round("box.y0", 4).alias("y"), F.round("box.x0", 4).alias("x"), "place")
    return rows.withColumns({"line": F.col("_x.text"), "n_redactions": F.col("_x.n"), "role": role, "order": order}).where("line <> ''").drop("_x")


def screen_lines(items: DataFrame, chunk: str, ratio: float, spans: DataFrame, rate: float) -> DataFrame:
    """Per chunk: line (its items in order, one that nearly repeats the last kept one left out, cut at a word by the span's
    budget of characters), n_redactions and truncated. ``spans``: (chunk, seconds); chunks without items have an empty line."""
    nth = F.row_number().over(W.partitionBy(chunk).orderBy("order"))
    rows = items.select(chunk, nth.alias("nth"), "role", "t_offset", "line", F.lower("line").alias("folded"))
    kept = folds.drop_near_repeats(rows, chunk, "nth", "folded", ratio)
    stamp = F.concat(F.lit("+"), F.bround("t_offset").cast("int").cast("string"), F.lit("s "), "role", F.lit(": "), "line")
    joined = kept.groupBy(chunk).agg(F.array_join(F.array_sort(F.collect_list(F.struct("nth", stamp.alias("s")))).s, " · ").alias("full"))
    counts = items.groupBy(chunk).agg(F.sum("n_redactions").alias("n_redactions"))
    both = spans.join(joined, chunk, "left").join(counts, chunk, "left")
    full = F.coalesce("full", F.lit(""))
    cut = F.when(F.length(full) <= texts.char_budget(F.col("seconds"), rate), full)
    both = both.withColumns({"full": full, "cap": texts.char_budget(F.col("seconds"), rate)})
    head = F.left("full", F.col("cap").cast("int"))
    at_word = F.when(F.substring(F.col("full"), F.col("cap").cast("int") + 1, F.lit(1)) == " ", head).otherwise(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    line = F.coalesce(cut, F.when(F.length(at_word) == 0, head).otherwise(F.rtrim(at_word)))
    return both.select(chunk, line.alias("line"), F.coalesce("n_redactions", F.lit(0)).alias("n_redactions"), (line != F.col("full")).alias("truncated"))


def read_outcome(selected: Column, attempted: Column, errors: Column) -> Column:
    """What reading a chunk's frames comes to: ``unmatched`` (times were selected, no frame fits), ``failed`` (most frames
    in error), or ``read``, with an empty text an honest answer."""
    return F.when((selected > 0) & (attempted == 0), "unmatched").when((attempted > 0) & (errors / attempted > 0.5), "failed").otherwise("read")


def variant(frames: Column, idle: Column, default: Column) -> Column:
    """The prompt a clip is described with: single for one frame or none, idle for a clip without change, else the default."""
    return F.when(frames <= 1, "single").when(idle, "idle").otherwise(default)


def floor_and_events(floor: DataFrame, events: DataFrame, *keys: str) -> DataFrame:
    """Frame times to read: the even floor and the changes, each once."""
    return floor.select(*keys).unionByName(events.select(*keys)).distinct()
