"""Every corpus operator and every pipeline stage on awkward rows: no crash, one row per row, and the stated results."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from strandline.llm import ann, bpe_codec, common, exact_dedup, jaccard_join, main_text, mixing, queries, substring_dedup, token_counts, toxicity, warc

LONG = "lorem ipsum dolor sit amet consectetur " * 4000 + "x" * 20000
#: Columns whose names the operators use themselves.
EXTRA = "block long, row long, digest string, size long, toxic int, ids string, text_sha256 string, component_id string, bucket int, pattern string"
ROWS = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, " \t\n\x0b"), (6, LONG), (6, LONG), (7, "é\u0000\U0001f600  "), (None, "a b c d e f g"), (8, "a  b c d e f g "), (9, "x")]


def documents(spark, rows=ROWS):
    tail = (1, 2, "d", 3, 1, "i", "t", "c", 4, "p")
    full = [(i, t, None if k % 3 == 0 else f"s{k % 2}", None, None, *tail) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, source string, lang string, n_chars long, {EXTRA}")


def model(spark):
    return {"weights": {1: 2.0}, "thresholds": (1.0, 2.0)}


OPERATORS = {
    "token_counts": lambda s, d: token_counts.token_counts(d, P.path("byte_bpe_50k.json"), 1024),
    "substring_dedup": lambda s, d: substring_dedup.substring_dedup(d),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "jaccard_join": lambda s, d: jaccard_join.jaccard_components(d),
    "bpe_digests": lambda s, d: bpe_codec.bpe_digests(d, P.path("byte_bpe_multi_50k.tiktoken")),
    "bpe_records": lambda s, d: bpe_codec.bpe_records(d, P.path("byte_bpe_multi_50k.tiktoken")),
    "toxicity": lambda s, d: toxicity.toxicity(d, model(s)),
    "mixing": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_operator(spark, name):
    docs = documents(spark)
    got = OPERATORS[name](spark, docs)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []
    only_null = OPERATORS[name](spark, documents(spark, [(None, None), (None, None)])).collect()
    assert len(only_null) == 2


def test_whole_long_text(spark):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(spark)).collect()}
    assert got[6].n_bytes == len(LONG) and got[6].n_removed == 0
    counted = {r.doc_id: r.n_bytes for r in token_counts.token_counts(documents(spark), P.path("byte_bpe_50k.json"), 9).collect()}
    assert counted[6] == len(LONG) and counted[3] == 0


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (ROWS, [], [(None, None)]):
        docs = documents(spark, rows)
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.staged(stage(spark, docs, str(tmp_path)), "edge")
            assert docs.columns == columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.count() == docs.count()
    kept = corpus_pipeline.STAGES[1][1](spark, documents(spark), str(tmp_path))
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {5, 6, 7, 8, 9}


def test_pages_operators(spark):
    kinds = "page_id long, url string, html string, text string, host string, block string, headers string"
    rows = [(1, "http://a/", "<article>" + "w " * 50000 + "</article>"), (1, None, None), (None, "::bad::", "<p>open"), (2, "http://a/", "<p>open"), (3, "http://a/", "")]
    pages = spark.createDataFrame([(*r, "t", "h", "b", "x") for r in rows], kinds)
    got = main_text.main_text(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert max(r.n_chars for r in got) == 99999
    assert warc.derive(warc.responses(pages)).count() == 10
    assert main_text.main_text(pages.limit(0)).count() == 0 and warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_nearest_with_clashing_columns(spark):
    kinds = "vec_id long, embedding array<float>, label int, v int, leaf int, bin int, score int"
    rows = [(i % 7, [float(i), 1.0], 0, 1, 2, 3, 4) for i in range(12)] + [(None, [1.0, 1.0], 0, 1, 2, 3, 4)]
    got = ann.nearest(spark.createDataFrame(rows, kinds), k=3, every=2).collect()
    assert all(r.query_id != r.vec_id and r.query_id % 2 == 0 for r in got)
    assert ann.nearest(spark.createDataFrame([], kinds)).count() == 0


def test_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 14)), "pipeline"} and set(queries.oracle_sql()) <= set(names)
