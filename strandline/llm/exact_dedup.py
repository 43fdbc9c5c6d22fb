"""Operator 3, exact dedup [native]: a tree-merge of sorted digest runs in binomial rounds.

Rows are reduced to a digest of the normalised text (verified by a second digest and the length). Each row belongs to
one of several runs, as many as the rows need; within a run equal digests are merged by a sort aggregation, then runs
meet in binomial rounds: in round k a run with bit k set is exchanged to the partner without it, the two sorted runs are
merged, and the verified best row (longest, then smallest identifier) of each digest is retained. A round is dealt by
digest and run, so that no task holds a run whole, nor more than two rows of a digest. The winner then goes back to every
run's rows, so that no task ever holds more than a run's share of one group of copies. Only DataFrame functions are used.

Edge cases: null counts as the empty text, and all empty or white-space texts are equal; ties in length go to the
smallest identifier (null first), and of rows that repeat an identifier one stays; an empty table gives an empty
result; other columns are neither read nor changed, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

#: Rows of a run, about, beyond common.RUNS runs.
RUN_ROWS = 1 << 22
#: The white space that normalisation deletes.
WHITE = r"[\x20\x09-\x0D]+"
KEY = ["digest", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, run, digest, check, length): the leaves of the tree; the texts themselves go no further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    leaves = docs.select(F.col(id_col).alias("id"), row.alias("row"), text.alias("t")).withColumn("x", F.regexp_replace("t", WHITE, ""))
    return leaves.select(
        "id",
        "row",
        F.unhex(F.sha2(F.col("x"), 256)).alias("digest"),
        (F.xxhash64("x").bitwiseXOR(F.octet_length("x"))).alias("check"),
        F.length("t").alias("length"),
    ).withColumn("spread", F.xxhash64("id", "row"))


def dealt(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``leaves`` with a run each, and the number of runs: a power of two that follows the rows."""
    runs = common.RUNS
    while runs * RUN_ROWS < leaves.count():  # of a staged table: its Parquet footers tell
        runs *= 2
    return leaves.withColumn("run", F.pmod("spread", F.lit(runs)).cast("int")).drop("spread"), runs


def merged(leaves: DataFrame, runs: int = common.RUNS) -> DataFrame:
    """(digest, check, run, best, size): every (digest, run) with its whole group's best row and size."""
    order = F.struct((-F.col("length")).alias("short"), "id", "row")
    level = leaves.groupBy(*KEY, "run").agg(F.min(order).alias("best"), F.count("*").alias("size"))
    bottom, bit = level.select(*KEY, "run"), 1
    while bit < runs:
        partner = F.col("run").bitwiseAND(F.lit(~bit))
        level = level.withColumn("run", partner).groupBy(*KEY, "run").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        bit *= 2
    return bottom.join(level.drop("run"), KEY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    leaves, runs = dealt(common.staged(digests(docs, id_col, text_col), "digests"))
    return leaves.join(merged(leaves, runs), [*KEY, "run"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, whatever their identifiers are."""
    keyed, key = common.keyed(docs, "documents")
    leaves, runs = dealt(common.staged(digests(keyed, id_col, text_col, key), "digests"))
    kept = leaves.join(merged(leaves, runs), [*KEY, "run"]).where(F.col("row") == F.col("best.row")).select(F.col("row").alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as x from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by x) as group_size,
       doc_id = first_value(doc_id) over w as kept, sha256(x) as text_sha256
from d window w as (partition by x order by length(t) desc, doc_id)
"""
