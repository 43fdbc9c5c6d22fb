"""Day-logs from slot records: the slot walk, grid segments, blocks of anchored text, and the cache of rendered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import timeaxis
from strandline.operators import ranges
from strandline.operators.daylog import BLOCK_SEGMENTS, GAP_SEGMENTS

#: Slots of a record as the walk reads them.
SLOTS = (
    "struct<caption:struct<value:string>,ocr:struct<value:string>,transcript:struct<splits:array<struct<value:string,speaker:string,t_start:timestamp>>>,"
    "asr:struct<value:string,splits:array<struct<value:string,t_start:timestamp>>>>"
)
#: Separates the parts of a content digest.
NUL = "\0"


def _line(kind: str, at: Column, value: Column, speaker: Column | None = None) -> Column:
    speaker = F.lit(None).cast("string") if speaker is None else speaker
    return F.struct(F.lit(kind).alias("kind"), at.cast("timestamp").alias("at"), F.trim(value).alias("text"), speaker.alias("speaker"))


def slot_lines(records: DataFrame, t_start: str = "t_start", slots: str = "slots") -> DataFrame:
    """``records`` by the lines their slots say: kind (scene, screen, heard), at, text, speaker, pos (order in the record).

    Scene and screen text stand at the record's own time, a split of speech at its own. Speech is the transcript's splits;
    only where that slot is absent it is the recogniser's, by splits or else as one line; a transcript that is there but
    empty is an answer. Blank lines say nothing. Records without a line are left out."""
    s, own = F.col(slots), F.col(t_start)
    none = F.array().cast("array<struct<kind:string,at:timestamp,text:string,speaker:string>>")
    aligned = F.transform(s.transcript.splits, lambda x: _line("heard", x.t_start, x["value"], x.speaker))
    plain = F.transform(s.asr.splits, lambda x: _line("heard", x.t_start, x["value"]))
    whole = F.array(_line("heard", own, s.asr["value"]))
    heard = F.when(s.transcript.isNotNull(), aligned).when(F.size(s.asr.splits) > 0, plain).when(s.asr.isNotNull(), whole)
    every = F.concat(F.array(_line("scene", own, s.caption["value"]), _line("screen", own, s.ocr["value"])), F.coalesce(heard, none))
    said = F.filter(every, lambda x: F.coalesce(F.length(x.text) > 0, F.lit(False)))
    return records.select("*", F.posexplode(said).alias("pos", "_l")).select(*records.columns, "pos", "_l.*")


def text_blocks(lines: DataFrame, seconds: int, home: str, zones: DataFrame, keys=("user_id", "window_id"), seq: str = "event_id", t_start: str = "t_start", tz: str = "device_tz", most: int = BLOCK_SEGMENTS) -> DataFrame:
    """Blocks of text per window: (keys, block, block_id, first_bucket, n_segments, zone, date, text).

    Lines stand in segments of ``seconds`` on the epoch grid; a block ends after GAP_SEGMENTS silent segments or at
    ``most`` segments. Its clock is that of the first segment that names a zone (each by its first line that does), if
    that zone is known (``zones``, a bounded list), else ``home``; a second zone is not tried."""
    keys = list(keys)
    order = F.struct(t_start, seq, "pos")
    rows = lines.withColumn("bucket", F.floor(F.unix_micros("at") / F.lit(seconds * 1_000_000)))
    named = F.when(F.col(tz).isNotNull(), order)
    line = F.struct(order.alias("o"), "kind", "text", "speaker")
    segs = rows.groupBy(*keys, "bucket").agg(F.min_by(tz, named).alias("tz"), F.array_sort(F.collect_list(line)).alias("lines"))
    run = W.partitionBy(*keys).orderBy("bucket")
    far = F.col("bucket") - F.lag("bucket").over(run) - 1 > GAP_SEGMENTS
    segs = segs.withColumn("island", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(run))
    place = F.row_number().over(W.partitionBy(*keys, "island").orderBy("bucket")) - 1
    segs = segs.withColumn("part", F.floor(place / F.lit(most)))
    grouped = segs.groupBy(*keys, "island", "part").agg(
        F.min("bucket").alias("first_bucket"),
        F.max("bucket").alias("last_bucket"),
        F.count("*").alias("n_segments"),
        F.min_by("tz", F.when(F.col("tz").isNotNull(), F.col("bucket"))).alias("tz"),
        F.flatten(F.array_sort(F.collect_list(F.struct("bucket", "lines")))["lines"]).alias("lines"),
    )
    grouped = grouped.withColumn("block", F.row_number().over(W.partitionBy(*keys).orderBy("first_bucket")) - 1)
    edges = grouped.withColumns({"a": F.timestamp_seconds(F.col("first_bucket") * seconds), "b": F.timestamp_seconds((F.col("last_bucket") + 1) * seconds)})
    local = timeaxis.civil(edges, "a", "tz", zones, home).withColumnRenamed("local", "a_local")
    local = timeaxis.civil(local, "b", "tz", zones, home).withColumnRenamed("local", "b_local")
    of = lambda kind: F.filter("lines", lambda x: x.kind == kind)
    said = F.transform(of("heard"), lambda x: F.concat_ws(": ", x.speaker, x.text))
    part = lambda title, texts, by: F.when(F.size(texts) > 0, F.concat(F.lit(title), F.array_join(texts, by)))
    date = F.date_format("a_local", "yyyy-MM-dd")
    anchor = F.concat(F.lit("On "), date, F.lit(", around "), F.date_format("a_local", "HH:mm"), F.lit("–"), F.date_format("b_local", "HH:mm"), F.lit(" local time:"))
    body = F.concat_ws("\n", anchor, part("Scene: ", of("scene").text, " "), part("Heard: ", said, " | "), part("World text (OCR): ", of("screen").text, " | "))
    name = F.concat(F.col(keys[-1]).cast("string"), F.lit("_b"), F.lpad(F.col("block").cast("string"), 4, "0"))
    return local.select(*keys, "block", name.alias("block_id"), "first_bucket", "n_segments", "tz", date.alias("date"), body.alias("text"))


def window_bodies(blocks: DataFrame, keys=("user_id", "window_id")) -> DataFrame:
    """Per window: n_blocks, the joined text of its blocks (``corpus``) and a digest of their content."""
    held = F.array_sort(F.collect_list(F.struct("block", "text"))).text
    return blocks.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.array_join(held, "\n\n").alias("corpus"), F.sha2(F.array_join(held, NUL), 256).alias("content_fingerprint"))


def cache_states(windows: DataFrame, cache: DataFrame, profiles: DataFrame, version: str, recipe: str, keys=("user_id", "window_id")) -> DataFrame:
    """What a fetch of each window does: ``cached`` where the stored rendering has the current format version, recipe and
    home zone (any, without a profile), else ``build``, or ``refused`` where there is no profile to build with."""
    held = cache.select(*keys, F.col("format_version").alias("_f"), F.col("recipe_id").alias("_r"), F.col("home_tz").alias("_h"))
    homes = profiles.select(keys[0], F.col("home_tz").alias("_p"))
    both = windows.select(*keys).join(held, list(keys), "left").join(homes, keys[0], "left")
    fits = (F.col("_f") == version) & (F.col("_r") == recipe) & (F.col("_p").isNull() | (F.col("_h") == F.col("_p")))
    state = F.when(F.coalesce(fits, F.lit(False)), "cached").when(F.col("_p").isNull(), "refused").otherwise("build")
    return both.select(*keys, state.alias("state"))


def dissolved(windows: DataFrame, writes: DataFrame, width: int, user: str = "user_id", window: str = "window_id", was: str = "was", now: str = "now") -> DataFrame:
    """The cached windows a batch of writes makes stale: those that hold a record's new stamp (late data joins the window
    open at its write, whatever its event time) and those that held its old one. ``width``: microseconds of a join bucket."""
    stamps = writes.select(user, F.explode(F.array_distinct(F.array_compact(F.array(was, now)))).alias("_s"))
    met = ranges.in_interval(stamps, windows, width, "_s", "t_start", "t_end", on=(user,))
    return met.select(user, window).distinct()


def opened(requests: DataFrame, windows: DataFrame, user: str = "user_id") -> DataFrame:
    """Get-or-create: a user's open window (of several the least id), or a new one from the last closed end on.

    ``requests``: (user, now); ``windows``: (user, window_id, t_start, t_end, state)."""
    own = windows.groupBy(user).agg(
        F.min(F.when(F.col("state") == "open", F.struct("window_id", "t_start", "t_end"))).alias("_o"),
        F.max(F.when(F.col("state") == "closed", F.col("t_end"))).alias("_last"),
    )
    both = requests.join(own, user, "left")
    new = F.struct(timeaxis.window_id(F.timestamp_micros("now")).alias("window_id"), F.coalesce("_last", F.lit(0)).alias("t_start"), F.col("now").alias("t_end"))
    return both.withColumn("_w", F.coalesce("_o", new)).select(user, "_w.*", F.col("_o").isNull().alias("created"))


def listed(windows: DataFrame, user: str, state: str | None = None, before: str | None = None) -> DataFrame:
    """A user's windows in order of id, of one state if named, and strictly before an id if named."""
    out = windows
    if state is not None:
        out = out.where(F.col("state") == state)
    if before is not None:
        out = out.where(F.col("window_id") < before)
    return out.withColumn("place", F.row_number().over(W.partitionBy(user).orderBy("window_id")))
