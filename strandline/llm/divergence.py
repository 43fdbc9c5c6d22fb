"""Operator 12, source divergence audit: term counts of sources and languages, by DuckDB over shards; Spark merges.

1. Terms. Each task turns batches of texts into (row, term) columns and counts them by SQL in DuckDB, in slices of a bounded
   number of bytes: occurrences, and rows that hold the term, per (lang, source, term). Spark sums these over tasks, map side
   first, so that a term which stands in every document is one row per source before it meets a shard.
2. Shards. The sums are dealt to shards by hash of (lang, term), as many as the rows need. In each shard SQL keeps the terms
   of enough documents and adds the language's own counts; Spark sums the totals of every group from these.
3. Partial pair sums. In each shard SQL gives every kept term its exact share in each group that holds it, and from that
   - for two sources that both hold a term, what this adds to the sum of their pair beyond what either adds alone;
   - per source and share, the number of terms: all that its sum with a source without the term needs;
   - the shard's first terms of each group by divergence.
   Terms that neither of two sources holds have one constant share a source, so they are counted, not listed: work follows
   the counts that occur, not sources times terms.
4. Spark adds the pair sums of all shards, and ranks pairs and terms.

The result holds every ordered pair of a language's sources, so its size is the square of their number there.

All arithmetic is of integers: 128 bits where a count is scaled, 64 else (a divergence is below twice SCALE).

Edge cases: null text, lang and source count as empty; a text without terms still makes its group occur; a language without
kept terms has pairs of value 0; rows that repeat an identifier count each; texts are read whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm import common

#: Documents of its language that a kept term is in, at least; the scale of shares; ranks of terms that are returned.
LEAST, SCALE, TOP = 10, 1_000_000_000, 10
#: Bytes of text counted at once, about, and partial rows a task holds before it hands them on.
SLICE, HELD = 4_000_000, 400_000
#: Rows of a shard, about.
SHARD = 150_000
#: Keys that a language is dealt to where its sources' shares meet all its other sources.
SALTS = 32
#: Memory of DuckDB in a task; it keeps nothing on disk.
MEMORY = "400MB"
#: Letters and all beyond ASCII, A-Z lowered; any other byte parts terms.
_TERMS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _duck(**tables: pa.Table):
    """A DuckDB of this task's own over the tables."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    for name, held in tables.items():
        con.register(name, held)
    return con


_COUNT = """
select g.lang, g.source, c.term, sum(c.n)::bigint as n, count(*) as docs
from (select doc, term, count(*) as n from terms where term <> '' group by doc, term) c join docs g using (doc)
group by g.lang, g.source, c.term
"""
_ADD = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held group by lang, source, term"


def _slices(text: pa.Array):
    """(begin, stop) of rows of about SLICE bytes; a longer text is alone."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))])
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + SLICE, side="right")) - 1)
        yield a, b
        a = b


def _counted(texts: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of these rows."""
    texts = pa.concat_arrays([texts.take(pa.array(np.arange(len(texts))))])
    _, offsets, data = texts.buffers()
    lowered = pa.py_buffer((data.to_pybytes() if data else b"").translate(_TERMS))
    words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, lowered))
    row = pc.list_parent_indices(words).cast(pa.int64())
    docs = pa.table({"doc": pa.array(np.arange(len(texts))), "lang": lang, "source": source})
    return _duck(terms=pa.table({"doc": row, "term": words.flatten()}), docs=docs).sql(_COUNT).to_arrow_table()


_PARTIAL = "lang string, source string, term string, n long, docs long"
_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            text, lang, source = (c.cast(pa.large_string()) for c in batch.columns)
            for a, b in _slices(text):
                held.append(_counted(text[a:b], lang[a:b], source[a:b]))
                rows += held[-1].num_rows
                if rows > HELD:
                    one = _duck(held=pa.concat_tables(held)).sql(_ADD).to_arrow_table()
                    held, rows = [one], one.num_rows
                    if rows > HELD // 2:
                        yield from one.cast(_SCHEMA).to_batches()
                        held, rows = [], 0
        if held:
            yield from _duck(held=pa.concat_tables(held)).sql(_ADD).to_arrow_table().cast(_SCHEMA).to_batches()

    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    return own.mapInArrow(run, _PARTIAL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_KEEP = """
with often as (select lang, term, sum(n)::bigint as n from held group by lang, term having sum(docs) >= {least})
select h.lang, false as whole, h.source, h.term, h.n from held h semi join often using (lang, term)
union all select lang, true, '', term, n from often
"""


def kept_counts(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(shard, lang, whole, source, term, n) of the kept terms; ``whole``: the count is the language's own."""
    shards = max(1, -(-counts.count() // SHARD))  # of a staged table: its Parquet footers tell
    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    kinds = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("whole", pa.bool_()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(key, table):
        got = _duck(held=table).sql(_KEEP.format(least=least)).to_arrow_table()
        return got.add_column(0, "shard", pa.array(np.full(got.num_rows, key[0].as_py(), np.int32))).cast(kinds)

    return dealt.groupBy("shard").applyInArrow(run, "shard int, lang string, whole boolean, source string, term string, n long")


_F = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
_SHARES = f"""
create table t as select lang, whole, source, term, n,
  (1 + ({SCALE}::hugeint * (n + 2)) // (total + 2 * v))::bigint as p, (1 + {2 * SCALE} // (total + 2 * v))::bigint as z
from held
"""
#: Per shard: what pairs add beyond each one's own, the numbers of terms by share, and the first terms of each group.
_SUMS = f"""
select 'pair' as part, a.lang, a.source, b.source as item, null::bigint as p,
  sum({_F.format("a.p", "b.p")} - {_F.format("a.p", "b.z")} - {_F.format("a.z", "b.p")} + {_F.format("a.z", "b.z")})::bigint as value
from t a join t b on a.lang = b.lang and a.term = b.term and a.source < b.source where not a.whole and not b.whole group by a.lang, a.source, b.source
union all
select 'share', lang, source, null, p, count(*) from t where not whole group by lang, source, p
union all
select 'term', lang, source, term, null, value from (
  select a.lang, a.source, a.term, {_F.format("a.p", "l.p")} as value
  from t a join t l on a.lang = l.lang and a.term = l.term where not a.whole and l.whole and a.p > l.p
  qualify row_number() over (partition by a.lang, a.source order by value desc, a.term) <= {{top}})
"""


def partial_sums(kept: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """(part, lang, source, item, p, value) of every shard, by SQL over its kept terms."""
    kinds = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("p", pa.int64()), ("value", pa.int64())])

    def run(table):
        con = _duck(held=table)
        con.execute(_SHARES)
        return con.sql(_SUMS.format(top=top)).to_arrow_table().cast(kinds)

    both = kept.join(totals, ["lang", "whole", "source"])
    return both.groupBy("shard").applyInArrow(run, "part string, lang string, source string, item string, p long, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: how far sources of a language are apart, and by which terms."""
    common.ship(docs.sparkSession)
    name = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    groups = common.staged(docs.select(name(lang_col, "lang"), name(source_col, "source")).distinct(), "groups")
    counts = common.staged(term_counts(docs, text_col, lang_col, source_col), "terms")
    kept = common.staged(kept_counts(counts, least), "kept")
    sums = kept.groupBy("lang", "whole", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    sums = common.staged(sums, "totals")
    kinds = sums.where("whole").select("lang", F.col("terms").alias("v"))
    totals = sums.join(kinds, "lang").select("lang", "whole", "source", "total", "v")
    found = common.staged(partial_sums(kept, totals, top), "sums")

    own = sums.where("not whole").select("lang", "source", "total")
    sized = groups.join(kinds, "lang", "left").join(own, ["lang", "source"], "left")
    sized = sized.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    # the share of a term that a group doesn't hold
    sized = sized.withColumn("z", F.when(F.col("v") > 0, 1 + F.expr(f"{2 * SCALE} div (total + 2 * v)")).otherwise(1).cast("long"))
    other = sized.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    apart = lambda p, q: F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")

    none = sized.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * apart("z", "y")).alias("value"))
    shares = found.where("part = 'share'").groupBy("lang", "source", "p").agg(F.sum("value").alias("many"))
    # a language with a third of all rows is SALTS keys
    salted = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = shares.join(sized.select("lang", "source", "z"), ["lang", "source"]).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    alone = alone.join(salted, ["lang", "salt"]).where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("many") * (apart("p", "y") - apart("z", "y"))).alias("value"))
    both = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = [none, alone, turned(alone), both, turned(both)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    pairs = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)}).select(*columns)
    first = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*columns)
    return ranked.unionByName(first)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return divergence(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
w as (select doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct doc) >= 10),
own as (select lang, source, term, count(*) as n from w group by lang, source, term),
groups as (select distinct lang, source from d),
sizes as (select lang, count(*) as v, sum(n) as total from kept group by lang),
full_counts as (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as n
  from groups g join kept k on k.lang = g.lang left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
p as (
  select f.lang, f.source, f.term, f.n,
    1 + (1000000000::hugeint * (f.n + 2)) // (sum(f.n) over (partition by f.lang, f.source) + 2 * s.v) as p
  from full_counts f join sizes s on s.lang = f.lang),
q as (select k.lang, k.term, 1 + (1000000000::hugeint * (k.n + 2)) // (s.total + 2 * s.v) as q from kept k join sizes s on s.lang = k.lang),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(c.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) c on c.lang = a.lang and c.source = a.source and c.item = b.source),
terms as (
  select p.lang, p.source, p.term as item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) as value
  from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select lang, source, 'term', item, value::bigint, row_number() over (partition by lang, source order by value desc, item)::int from terms
qualify row_number() over (partition by lang, source order by value desc, item) <= 10
"""
