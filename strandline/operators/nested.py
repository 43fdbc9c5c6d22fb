"""Nested documents walked level by level: their nodes as rows, and where one document fails to hold another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.tables import shared_folder

#: Levels of objects that are walked at most; a deeper document raises.
DEEPEST = 64


def nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, parent, is_object, value) of every node of the documents' objects: path joined by dots ('' for the root),
    value its canonical text. Lists are values. A document that is no JSON has no nodes.

    Each level is written to the shared folder and read again: the next one starts from its texts, not from the documents."""
    spark = docs.sparkSession
    folder = shared_folder(spark)

    def level(rows: DataFrame, depth: int) -> DataFrame:
        shown = rows.select(key, "path", "parent", F.to_json("v").alias("value"))
        # the text of an object, and of no other value, begins with a brace
        shown = shown.select(key, "path", "parent", F.coalesce(F.col("value").startswith("{"), F.lit(False)).alias("is_object"), "value")
        shown.write.parquet(f"{folder}/{depth}")
        return spark.read.schema(shown.schema).parquet(f"{folder}/{depth}")

    held = [level(docs.select(key, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(text).alias("v")).where("v is not null"), 0)]
    for depth in range(DEEPEST):
        inner = held[-1].where("is_object")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, held)
        fields = inner.withColumn("v", F.parse_json("value")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_k"), F.col("value").alias("_v")))
        held.append(level(fields.select(key, F.concat_ws(".", F.nullif("path", F.lit("")), "_k").alias("path"), F.col("path").alias("parent"), F.col("_v").alias("v")), depth + 1))
    raise ValueError(f"a document is deeper than {DEEPEST} objects")


def mismatches(expected: DataFrame, actual: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, problem) where a key's actual document does not hold the expected one: every field expected must be there
    with an equal value, objects field by field; further fields are free. Below a field that is missing or no object
    nothing more is said."""
    want, got = nodes(expected, key, text), nodes(actual, key, text)
    have = got.select(key, "path", F.col("is_object").alias("_o"), F.col("value").alias("_v"))
    above = got.where("is_object").select(key, F.col("path").alias("parent"), F.lit(True).alias("_up"))
    both = want.join(have, [key, "path"], "left").join(above, [key, "parent"], "left")
    problem = (
        F.when(F.col("parent").isNotNull() & F.col("_up").isNull(), None)
        .when(F.col("is_object"), F.when(~F.coalesce("_o", F.lit(False)), F.when(F.col("_v").isNull(), "missing").otherwise("no object")))
        .when(F.col("_v").isNull(), "missing")
        .when(F.col("_v") != F.col("value"), "differs")
    )
    return both.withColumn("problem", problem).where("problem is not null").select(key, "path", "problem")
