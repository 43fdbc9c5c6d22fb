"""Readers for the parquet tables of one data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``; filters and column choice reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files, with the schema the files have now."""
    ship(spark)
    path = f"{sf_dir}/{name}.parquet"
    held = spark.read.parquet(path)
    source = spark.readStream.schema(held.schema)
    if all(f.endswith(f"/{name}.parquet") for f in held.inputFiles()):  # the table is one file: a stream reads its folder
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return source.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or where that is unset in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/strandline-{uuid.uuid4().hex}"
