"""What the corpus operators share: the shared folder for staged tables, shipping code to executors, input readers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partial results of one key are merged from so many parts: bounds what any task sees of a hot key.
RUNS = 64

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[2]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((top / "strandline").rglob("*.py")):
            z.write(p, p.relative_to(top))
    # addPyFile uploads the archive from the driver; executors fetch it from there
    folder = tempfile.mkdtemp(prefix="strandline-code-")
    path = os.path.abspath(os.path.join(folder, "strandline_code.zip"))
    Path(path).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_strandline_stage"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` staged with a key of its own for each row, and the key's column name."""
    key = "_row"
    while key.lower() in map(str.lower, df.columns):
        key += "_"
    return staged(df.withColumn(key, F.monotonically_increasing_id()), name), key


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of the folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def run_of(id_col: str, runs: int = RUNS) -> Column:
    """A part number in 0..runs-1 of a row by its identifier."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int")


def parallel(spark: SparkSession, per_core: int = 4) -> int:
    """Partitions for Python-heavy work: the session's shuffle partitions, or a few per core if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)
