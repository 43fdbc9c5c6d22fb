"""Markup and binary kernels on fixtures."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.operators import lifecycle


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# A *b*", "<h1>A <em>b</em></h1>"),
        ("a\nb\n\nc", "<p>a<br>b</p>\n<p>c</p>"),
        ("- x\n- **y**\n1. z", "<ul><li>x</li><li><strong>y</strong></li></ul>\n<ol><li>z</li></ol>"),
        ("```\n<b> *x*\n```", "<pre><code>&lt;b&gt; *x*</code></pre>"),
        ("<script>1</script> `a*b*<`", "<p>&lt;script&gt;1&lt;/script&gt; <code>a*b*&lt;</code></p>"),
        ("[t](https://a.b/?x=1&y) [u](javascript:1)", '<p><a href="https://a.b/?x=1&amp;y" rel="noopener">t</a> [u](javascript:1)</p>'),
        ("```\nopen", "<pre><code>open</code></pre>"),
        ("", ""),
        (None, None),
    ],
)
def test_markdown(text, want):
    assert kernels.safe_html(text) == want


def test_columns(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x02\x03\x04" + b"\0" * 8
    rows = spark.createDataFrame([("# A", jpeg, bytes([0] * 1023 + [40]) + b"torn", "image/JPEG; q=1", "../a b"), (None, b"x", None, None, "...")], "t string, j binary, m binary, k string, n string")
    got = rows.select(
        kernels.markdown_html(F.col("t")).alias("h"), kernels.jpeg_size(F.col("j")).alias("s"), kernels.change_maps(F.col("m")).alias("m"), kernels.ending(F.col("k")).alias("e"), kernels.safe_identifier(F.col("n")).alias("n")
    ).collect()
    assert got[0].h == "<h1>A</h1>" and got[1].h is None
    assert (got[0].s.width, got[0].s.height) == (772, 258) and got[1].s.width is None
    assert len(got[0].m) == 1 and got[0].m[0][1023] == 40 and got[1].m is None
    assert [r.e for r in got] == ["jpg", "bin"] and [r.n for r in got] == ["_a_b", "unnamed"]
    s = spark.range(1).select(lifecycle.map_summary(F.array(*map(F.lit, (0, 13, 40, 3)))).alias("s"), lifecycle.map_summary(F.array().cast("array<int>")).alias("t")).first()
    assert (s.s.peak, s.s.spread) == (40, 2) and (s.t.peak, s.t.spread) == (0, 0)
