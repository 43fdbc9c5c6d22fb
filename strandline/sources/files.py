"""File sources and sinks: torn-line tolerant JSONL, artifacts, registries, manifests, positional pairs, WAV, exposition."""

from __future__ import annotations

import io
import wave
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are torn or no objects are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def torn_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that ``read_jsonl`` leaves out: (file, line)."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return rows.where(F.from_json("line", full, {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull())


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines: new files, made visible by the committer when they are whole."""
    df.write.mode("append").json(path)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; a torn one reads as absent."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def registry(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Registered documents; a file whose content does not carry its own name as identifier raises when it is read."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_f", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    checked = F.when(F.col(key) == F.col("_f"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("identifier differs from file name: "), F.col("_f"))))
    return rows.withColumn(key, checked.cast("string")).drop("_f")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header; all columns are text."""
    return spark.read.option("header", True).csv(path)


def named_files(spark: SparkSession, path: str, pattern: str, *groups: str) -> DataFrame:
    """(file, text, the named parts of the file name) of text files whose names match."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    parts = [F.regexp_extract("file", pattern, i + 1).alias(g) for i, g in enumerate(groups)]
    return rows.where(F.col("file").rlike(pattern)).select("file", "text", *parts)


def positional(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, from 0: numbered inside each block of the file, blocks by where they start."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a block
    return rows.join(blocks.withColumn("_before", before), "_at").select((F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def replay_plan(spark: SparkSession, path: str) -> DataFrame:
    """(place, chunk_key, t_start, t_end, audio, media) of a plan in JSON lines; ``place`` keeps the order of the file, which
    is the order of capture. An empty plan raises here; a row that lacks a required key, or is no JSON, when it is read."""
    lines = positional(spark, path).where(F.length(F.trim("value")) > 0)
    if lines.isEmpty():
        raise ValueError(f"the plan {path} is empty")
    needed = ("chunk_key", "t_start", "t_end", "audio")
    rows = lines.select(F.col("line").alias("place"), F.from_json("value", "chunk_key string, t_start string, t_end string, audio string, media string", {"mode": "FAILFAST"}).alias("r"))
    checked = [F.coalesce(F.col(f"r.{c}"), F.raise_error(F.lit(f"a row of the plan lacks {c}")).cast("string")).alias(c) for c in needed]
    return rows.select("place", *checked, "r.media")


def zipped(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """Two positional sources side by side; a line without its partner raises."""
    both = questions.withColumnRenamed("value", "question").join(gold.withColumnRenamed("value", "gold"), "line", "full")
    ok = F.col("question").isNotNull() & F.col("gold").isNotNull()
    return both.withColumn("line", F.when(ok, F.col("line")).otherwise(F.raise_error(F.lit("the files have different numbers of lines")).cast("bigint")))


def anchored_blocks(rows: DataFrame, reserved: tuple[str, ...] = ("block_id", "text")) -> DataFrame:
    """Blocks with all columns but the reserved ones gathered in a map, nulls left out."""
    rest = [c for c in rows.columns if c not in reserved]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rest]) if rest else None
    anchors = F.map_from_entries(F.filter(pairs, lambda e: e.v.isNotNull())) if rest else F.create_map().cast("map<string,string>")
    return rows.select(*reserved, anchors.alias("anchors"))


def wav_chunks(spark: SparkSession, path: str, seconds: float) -> DataFrame:
    """(file, chunk, start_s, stop_s, rms) of WAV files cut at fixed lengths; a file is read by one task."""

    def cut(frames):
        import numpy as np

        for f in frames:
            out = []
            for name, data in zip(f["path"], f["content"]):
                with wave.open(io.BytesIO(data)) as w:
                    rate, x = w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float)
                step = max(1, int(rate * seconds))
                for k in range(-(-len(x) // step)):
                    part = x[k * step : (k + 1) * step]
                    out.append((PurePosixPath(name).name, k, k * step / rate, (k * step + len(part)) / rate, float(np.sqrt((part**2).mean()))))
            yield pd.DataFrame(out, columns=["file", "chunk", "start_s", "stop_s", "rms"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "file string, chunk long, start_s double, stop_s double, rms double")


def synthetic(spark: SparkSession, n: int, seed: int, start: str = "2024-01-01 00:00:00", stragglers: float = 0.1) -> DataFrame:
    """Seeded capture records: (seq, user_id, t_start, updated_at, text); a share lands after a day's delay."""
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1_000_000)) / 1e6
    t = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (h(1) * 86_400_000_000).cast("long"))
    late = F.when(h(2) < stragglers, F.make_dt_interval(days=F.lit(1))).otherwise(F.make_dt_interval(secs=F.lit(5)))
    return spark.range(n).select(F.col("id").alias("seq"), F.floor(h(3) * 20).alias("user_id"), t.alias("t_start"), (t + late).alias("updated_at"), F.concat(F.lit("event "), F.col("id").cast("string")).alias("text"))


def exposition(counts: DataFrame, name: str, value: str, *labels: str) -> DataFrame:
    """Metric lines in the text exposition format; label values are escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), esc(c), F.lit('"')) for c in labels])
    return counts.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
