"""The per-text operators against the public libraries and brute force, and on edge cases."""

import base64
import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import bpe_codec, main_text, pretokens, suffixes, token_counts, warc

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
EDGE = ["", " ", "'s", "x's 're", "''s  's\n's!'s", "a  b\t\tc\n", "don't've'll'x", "<|endoftext|>x<|endoftext|>", "\x1c a\x85b", "日本語 ١٢ x²", "\U0001f600" * 30, "a" * 3000 + "!?" * 90]
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return Tokenizer.from_file(JSON), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_and_ids_equal_the_libraries(library):
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choices("ab's tdmrvel1!  \n\té’", k=rng.randint(0, 40))) for _ in range(3000)]
    n_bytes, n_tokens = token_counts._count(texts, JSON)
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]
    assert n_tokens.tolist() == [len(e.ids) for e in library[0].encode_batch(texts, add_special_tokens=False)]
    got = list(bpe_codec.encode(texts, RANKS))
    for t, (ids, offsets) in zip(texts, got):
        assert ids.tolist() == library[1].encode_ordinary(t)
        assert bpe_codec.decode(ids, RANKS) == t.encode()
        assert offsets.tolist() == sorted(offsets.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(library, texts):
    assert token_counts._count(texts, JSON)[1].tolist() == [len(e.ids) for e in library[0].encode_batch(texts, add_special_tokens=False)]


def test_boundaries_do_not_depend_on_chunks(monkeypatch):
    text = ["it's  a\n\n test 12ab " * 50]
    whole = pretokens.slices(text)[1]
    monkeypatch.setattr(pretokens, "CHUNK", 7)
    assert np.array_equal(whole, pretokens.slices(text)[1])


def test_token_queries_on_edges(spark):
    rows = [(i, t, "a") for i, t in enumerate(EDGE)] + [(99, None, None), (99, None, None), (None, "x", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    got = token_counts.token_counts(docs, JSON, 2).collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got if r.doc_id == 99) == 0
    assert all(r.over_limit == (r.n_tokens > 2) for r in got)
    coded = bpe_codec.bpe_digests(docs, RANKS).collect()
    assert {r.decoded_sha256 for r in coded if r.doc_id == 99} == {hashlib.sha256(b"").hexdigest()}
    back = bpe_codec.bpe_decode(bpe_codec.bpe_encode(docs, RANKS), RANKS).where("doc_id < 99").collect()
    assert {r.doc_id: bytes(r.data) for r in back} == {i: t.encode() for i, t in enumerate(EDGE)}
    assert token_counts.token_counts(docs.limit(0), JSON, 2).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, n_tokens long, ids long")
    assert bpe_codec.bpe_digests(docs, RANKS).first().n_tokens == 2
    assert token_counts.token_counts(docs, JSON, 9).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><nav><a>Menu</a></nav><div class=\"ad\">Buy</div>"
    "<article><h1>Head&amp;line</h1><p>One <b>two</b>\n three<p>four<br>five<aside>side</aside><ul><li>a<li>b</ul><div class='comments'>rude</div></article>"
    "<footer>&copy; f</footer></body></html>"
)


def test_main_text_by_structure(spark):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None), (3, "http://h/b", ""), (4, "http://h/c", PAGE[: PAGE.index("four")])], "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text.main_text(pages).collect()}
    assert got[1].text == "Head&line One two three four five a b" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and got[2].n_chars == 0
    assert got[4].text == "Head&line One two three"
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_blocks_of_a_full_page():
    page = (
        '<header class="top"><form>Search</form></header><div role="navigation">Home</div><div class="cookie-notice">We</div><main><div class="breadcrumbs">a</div>'
        '<article class="post"><h2>Title &#233; &lt;x&gt;</h2><p>First <em>para</em>graph&nbsp;he<script>"</p>"</script>re<img src=x>.<p>Second<div class=advert>ADV</div>'
        "<table><tr><td>c1<td>c2</tr></table><pre> code\n x</pre><!-- <p>no</p> --><figcaption>Cap</figcaption><ul><li>one<li>two</ul><aside>No</aside>"
        '<section id="comments"><article class="comment">rude</article></section><p hidden>no</p></article><div class="sidebar">No</div></main><footer>No</footer>'
    )
    assert " ".join(t for z, t in main_text.blocks(page) if z == "article") == "Title é <x> First paragraph here. Second c1 c2 code x Cap one two"
    assert main_text.blocks("<p>a &amp &#x41; &bogus; < 3")[0] == ("open", "a & A &bogus; < 3")


def test_main_text_by_host(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    bodies = [" ".join(word() for _ in range(60)) for _ in range(12)]
    notice = "please accept our rules before you go on reading this site today"
    rows = [(i, "https://x.example/p", f"<body><div>{notice}</div><div>{b}</div></body>") for i, b in enumerate(bodies)]
    copies = [(100 + i, "https://y.example/", f"<body><p>{bodies[0]}</p></body>") for i in range(4)]
    got = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == bodies
    assert all(got[100 + i] == bodies[0] for i in range(4))


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'aria-hidden="false"', "class='post has-sidebar'", 'class="with-comments no-ads"', 'data-x="class=ad hidden"', 'title="a hidden ad" id=post'])
def test_attributes_that_hide_nothing(attrs):
    assert main_text.blocks(f"<body {attrs}><article {attrs}><p {attrs}>text</p></article></body>") == [("article", "text")]


@pytest.mark.parametrize("attrs", ["hidden", 'x="y"hidden=""', 'aria-hidden="true"', "class='box cookie-notice'", "class=ad", 'id="comment-12"', "role=navigation"])
def test_attributes_that_drop(attrs):
    assert main_text.blocks(f"<body hidden><article>a<div {attrs}>no</div></article></body>") == [("article", "a")]


def fresh(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


NOTICE = "please accept our rules before you go on reading this site today"


def test_main_text_searches_all_pages_of_a_host(spark):
    rng = random.Random(4)
    bodies = [fresh(rng, 60) for _ in range(12)]
    html = lambda own, i: f"<body><div>{NOTICE}</div>{own.format(bodies[i])}</body>"
    # the only marker stands in a dropped element; the notice of pages with an article counts; main is narrowed, an article protected
    aside = [(i, "https://x.example/", html("<div>{}</div><aside><article>no</article></aside>", i)) for i in range(4)]
    two = [(i, "https://y.example/", html("<div>{}</div>" if i < 6 else "<article>{}</article>", i)) for i in range(4, 8)]
    inner = [(i, "https://z.example/", f"<body><main><p>{NOTICE}</p>{bodies[i]}</main></body>") for i in range(8, 11)]
    held = [(20 + i, "https://w.example/", f"<article>{NOTICE} {bodies[i]}</article>") for i in range(3)]
    rows = aside + two + inner + held
    got = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(11)] == bodies[:11]
    assert [got[20 + i] for i in range(3)] == [f"{NOTICE} {b}" for b in bodies[:3]]


def test_main_text_does_not_depend_on_groups(spark, monkeypatch):
    rng = random.Random(5)
    bodies = [fresh(rng, 40) for _ in range(30)]
    shared = [fresh(rng, n) for n in (6, 7, 9)]  # on 3, 3 and 2 pages
    places = ((1, 11, 21), (2, 12, 28), (3, 13))
    lines = lambda i: "".join(f"<div>{s}</div>" for s, at in zip(shared, places) if i in at)
    kind = lambda i: "article" if i in (21, 28) else "div"
    rows = [(i, "https://x.example/", f"<body><div>{NOTICE}</div>{lines(i)}<{kind(i)}>{b}</{kind(i)}></body>") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [f"{shared[2]} {b}" if i in places[2] else b for i, b in enumerate(bodies)]
    for size in (10**7, 3000, 1):
        monkeypatch.setattr(main_text, "GROUP", size)
        got = {r.page_id: r.text for r in main_text.main_text(pages).collect()}
        assert [got[i] for i in range(30)] == want, size


def test_boilerplate_slots_inside_articles(spark):
    rng = random.Random(6)
    bodies = [fresh(rng, 40) for _ in range(9)]
    shared = fresh(rng, 20)
    # every article ends in the same call (a slot of its own) and a third of them quote one passage, which stays
    html = lambda i: f"<article><h1>{fresh(rng, 3)}</h1><p>{bodies[i]} {shared if i % 3 == 0 else ''}</p><p class='call-{i}'>{NOTICE}</p></article>"
    rows = [(None if i == 8 else 9007199254740993 + i, "https://x.example/", html(i)) for i in range(9)]
    copies = [(i, "https://x.example/copy", f"<article><p>{bodies[0]}</p><p class='call-'>{NOTICE}</p></article>") for i in range(3)]
    few = [(10 + i, "https://few.example/", f"<article><p>{bodies[i]}</p><p class='call-'>{NOTICE}</p></article>") for i in range(2)]
    pages = spark.createDataFrame(rows + copies + few, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.text.split(" ") for r in main_text.main_text(pages).collect()}
    for i, (page_id, url, _) in enumerate(rows):
        want = bodies[i].split(" ") + (shared.split(" ") if i % 3 == 0 else [])
        assert got[page_id, url][3:] == want
    assert all(" ".join(got[10 + i, "https://few.example/"]) == f"{bodies[i]} {NOTICE}" for i in range(2))


@pytest.mark.parametrize("page", ["<div class='layout with-sidebar'><article>a b</article></div>", "<article>a <span class='share-price'>b</span></article>", "<article><p class='x'\">a b</p></article>", "<article><p class=\"article-banner-text\">a b</article>"])
def test_text_that_stays(page):
    assert [t for _, t in main_text.blocks(page)] == ["a b"]


def test_covered_against_brute_force():
    rng = random.Random(7)
    for letters, size in ((2, 30), (3, 60), (40, 60)):
        pages = [[rng.randrange(letters) for _ in range(rng.randrange(size))] for _ in range(8)]
        n, places = main_text.RUN, {}
        for i, p in enumerate(pages):
            for at in range(len(p) - n + 1):
                places.setdefault(tuple(p[at : at + n]), set()).add(i)
        got = main_text.Streams([np.array(p, np.uint32) for p in pages]).covered(np.zeros(0, np.int64))
        for p, hit in zip(pages, got):
            want = [any(len(places[tuple(p[b : b + n])]) >= main_text.PAGES for b in range(max(0, at - n + 1), min(at, len(p) - n) + 1)) for at in range(len(p))]
            assert hit.tolist() == want


def test_suffix_array_and_prefixes_against_sorting():
    rng = np.random.default_rng(3)
    for n, letters, depth in ((1, 2, 4), (300, 2, 9), (700, 3, 50), (400, 1, 16)):
        s = rng.integers(1, letters + 1, n)
        sa, rank = suffixes.suffix_array(s, 1, depth)
        cut = [tuple(s[i : i + depth]) for i in range(n)]
        assert [cut[i] for i in sa] == sorted(cut)
        assert all((rank[a] == rank[b]) == (cut[a] == cut[b]) for a, b in zip(sa[:-1], sa[1:]))
        lcp = suffixes.common_prefixes(s, sa, depth, lanes=16)
        for k in range(1, n):
            a, b = cut[sa[k - 1]], cut[sa[k]]
            want = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == want


def test_warc_links_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    source = {r.page_id: r for r in warc.responses(pages).collect()}
    made = warc.derive(warc.responses(pages)).collect()
    assert len(made) == 6
    for r in made:
        h, block = r.headers, bytes(r.block)
        assert h["WARC-Refers-To"] == source[r.page_id].headers["WARC-Record-ID"]
        assert h["WARC-Payload-Digest"] == source[r.page_id].headers["WARC-Payload-Digest"]
        assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert h["Content-Length"] == str(len(block)) and ("WARC-Target-URI" in h) == (r.page_id == 1)
        assert list(warc.parse(warc.serialise(h, block))) == [(h, block, None)]
    meta = next(bytes(r.block).decode() for r in made if r.page_id == 1 and r.headers["WARC-Type"] == "metadata")
    assert "http-status: 200" in meta and "http-header-content-type: text/html; charset=utf-8" in meta
    text = next(bytes(r.block).decode() for r in made if r.page_id == 1 and r.headers["WARC-Type"] == "conversion")
    assert text.startswith("Menu\nBuy\nHead&line\nOne two")
    assert warc.derive(warc.derive(warc.responses(pages))).count() == 0
    (tmp_path / "x.warc").write_bytes(b"".join(warc.serialise(r.headers, bytes(r.block)) for r in made))
    assert warc.read_warc(spark, str(tmp_path / "x.warc")).count() == 6


def test_warc_of_the_wild(spark, tmp_path):
    import gzip
    import zlib

    page = "<p>Grüße &amp; more</p>".encode()
    packed = gzip.compress(page)
    chunked = b"%x\r\n%s\r\n5;x=y\r\n%s\r\n0\r\n\r\n" % (len(packed) - 5, packed[:-5], packed[-5:])
    plain = b"HTTP/1.1 200 OK\r\ncontent-type: text/html; Charset=\"utf-8\"\r\n\r\n" + page
    blocks = [
        plain,
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked,
        b"HTTP/1.1 200 OK\nContent-Encoding: deflate\n\n" + zlib.compress(page),
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + packed[:-9],
        b"HTTP/1.1 200\r\nContent-Encoding: br\r\nContent-Type: text/html; charset=nonsense\r\n\r\nabc",
    ]
    kinds = [{"warc-type": "Response", "WARC-RECORD-ID": f"<urn:{i}>", "content-length": str(len(x))} for i, x in enumerate(blocks)]
    records = [warc.serialise(h, x) for h, x in zip(kinds, blocks)]
    for name, data in (("a.warc", b"".join(records)), ("b.warc.gz", b"".join(map(gzip.compress, records))), ("c.warc.gz", gzip.compress(b"".join(records)))):
        (tmp_path / name).write_bytes(data)
        got = warc.read_warc(spark, str(tmp_path / name))
        assert [(r.headers["WARC-RECORD-ID"], bytes(r.block), r.error) for r in got.collect()] == [(f"<urn:{i}>", x, None) for i, x in enumerate(blocks)]
    made = warc.derive(got.withColumnRenamed("path", "page_id")).collect()
    texts = {r.headers["WARC-Refers-To"]: bytes(r.block).decode() for r in made if r.headers["WARC-Type"] == "conversion"}
    assert [texts[f"<urn:{i}>"] for i in (0, 1, 2, 4)] == ["Grüße & more"] * 3 + ["abc"]
    faults = {r.headers["WARC-Refers-To"]: b"source-error" in bytes(r.block) for r in made if r.headers["WARC-Type"] == "metadata"}
    assert [faults[f"<urn:{i}>"] for i in range(5)] == [False, False, False, True, True]
    torn = b"noise WARC/1.0\r\nbad line\r\nWARC-Type:response\r\n folded\r\n\r\nx\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\nabc"
    assert list(warc.parse(torn)) == [({"WARC-Type": "response folded"}, b"x\r\n\r\n", "malformed header; no length"), ({"Content-Length": "9"}, b"abc", "torn block")]
    assert list(warc.parse(b"WARC/1.0\r\nWARC-Type: x")) == [({"WARC-Type": "x"}, b"", "torn header; no length")] and list(warc.parse(b"")) == []
W = "word " * 30


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<form><nav>n</nav><article><p>{W}</p></article></form>", "{W}"),
        ("<div class='content modal'><article><p>{W}</p></article></div>", "{W}"),
        ("<nav><ul><li>Home<article><p>{W}</p></article><footer>f</footer>", "{W}"),
        ("<aside>side<article><p>{W}</p></article>", "{W}"),
        ("<article><p>{W}</p><section class='promotion'><p>Raised.</p></section><p id='notice'>note</p><p class='related'>rel</p><p>Press <button>OK</button> now</p></article>", "{W} Raised. note rel Press OK now"),
        ("<article><p>{W}</p><aside>side<p>follows {W}</p></article>", "{W} side follows {W}"),
        ("<article><div class='widget'><p>{W}</p></div><p>end</p></article>", "{W} end"),
        ("<article><p>{W}</p><p class='ad'>Buy</p><div class='related'><a>x</a></div><button>Share</button><p>end</p></article>", "{W} end"),
        ("<main><nav>n</nav><p>Lead.</p><article><p>{W}</p></article><article><p>tease</p></article></main>", "Lead. {W}"),
        ("<main><p>{W}</p></main><aside><article>teaser</article></aside>", "{W}"),
        ("<article><p>{W}</p></article><aside class='related'><article><p>{W} other</p></article></aside>", "{W}"),
    ],
)
def test_articles_that_wrappers_and_names_do_not_lose(page, text):
    found = main_text.slotted(page.replace("{W}", W))
    kind = main_text.kind_of([z for z, _, _ in found])
    assert " ".join(t for z, _, t in found if z == kind) == text.replace("{W}", W.strip())


def test_warc_payloads_that_are_no_text():
    from strandline.llm import warc

    def made(kind, body):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body
        return warc.derivatives({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>"}, block)

    image = made("image/png", b"\x89PNG\r\n\x00\xff")
    assert [h["WARC-Type"] for h, _ in image] == ["metadata"] and b"the payload is no text" in image[0][1] and b"source-length: 8" in image[0][1]
    for kind in ("text/html", "application/xhtml+xml; charset=utf-8", "application/json", "image/svg+xml"):
        assert len(made(kind, b"<p>word</p>")) == (1 if kind.startswith("image") else 2)


def test_main_text_of_articles_does_not_depend_on_groups(spark, monkeypatch):
    # a slot of all articles of a host without other pages, each page a group of its own: 6 KB of 4 MB would be one group
    tell = "read more about all of this in our archive below"
    page = lambda i: f"<article><p>{' '.join(f'w{i}x{k}' for k in range(40))}</p><div class='tell'>{tell}</div><p>{' '.join(f'v{i}y{k}' for k in range(9))}</p></article>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)] + [(90, "http://b.example/", page(90)), (91, "http://a.example/s", "<p>short one</p>"), (92, "http://a.example/t", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for size in (1_000_000, 1500, 100):
        monkeypatch.setattr(main_text, "GROUP", size)
        found.append(sorted((r.page_id, r.text) for r in main_text.main_text(pages).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert all((tell in t) == (i == 90) for i, t in found[0] if i < 91)


def test_groups_exchange_little(spark):
    # three groups of one host: 1.25 million tokens, nearly all windows different; whole digests were 6 bytes a window
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.substring(F.md5(F.concat_ws("x", "id", k)), 1, 7)))
    html = F.concat(F.lit("<article><p>"), text, F.lit("</p></article>"))
    pages = spark.range(2500).select(F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"), html.alias("html"))
    sc = spark.sparkContext
    sc.setJobGroup("main_text", "")
    try:
        assert main_text.main_text(pages).agg(F.sum("n_chars")).first()[0] == 2500 * (500 * 8 - 1)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("main_text") for s in sc.statusTracker().getJobInfo(j).stageIds}
    written = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert 4 * 2500 * 500 < written < 6.5 * 2500 * 500


@pytest.mark.parametrize("bits", [4, 9, 40])
def test_short_digests_lose_no_window(monkeypatch, bits):
    # whatever collides in short digests, the windows that reach PAGES pages over the groups come back, and only those
    monkeypatch.setattr(main_text, "short_bits", lambda groups: bits)
    rng = random.Random(bits)
    groups = 9
    pages = [(i, i % groups, "".join(f"<div>{' '.join(rng.choices('abcde', k=rng.choice([3, 6, 9])))}</div>" for _ in range(rng.randint(1, 6)))) for i in range(90)]
    tables = {}
    for g in range(groups):
        rows = [(i, "u", "h", g, groups, html) for i, at, html in pages if at == g]
        tables[g] = pa.Table.from_batches(main_text.streams_of([pa.table(list(zip(*rows)), names=[*"abcdef"]).to_batches()[0]]))

    def met(shards, of):
        shards = pa.concat_tables(shards)
        back = [of(shards.filter(pc.equal(shards.column("shard"), s))) for s in set(shards.column("shard").to_pylist())]
        back = pa.concat_tables(back)
        return {g: back.filter(pc.equal(back.column("g"), g)) for g in tables}

    may = met([main_text.short_windows(t) for t in tables.values()], main_text.candidates)
    reached = met([main_text.windows(t, may[g]) for g, t in tables.items()], main_text.reaching)
    alone = {g: main_text.counted(main_text.Group(t)) for g, t in tables.items()}
    total = Counter()
    for digest, _, _ in alone.values():
        total.update(dict.fromkeys(digest.tolist(), 0))
    for t in tables.values():
        for codes in main_text.Group(t).codes:  # each page a group of its own
            one = SimpleNamespace(codes=[codes], mine=[np.ones(len(codes), bool)])
            total.update(main_text.counted(one)[0].tolist())
    for g, (digest, held, wanted) in alone.items():
        want = {d for d, p, w in zip(digest.tolist(), held.tolist(), wanted.tolist()) if w and p < main_text.PAGES <= total[d]}
        got = [d for x in reached[g].column("digests").to_pylist() for d in main_text._unpacked(x).tolist()]
        assert sorted(got) == sorted(want)
    assert any(len(r) for r in reached.values())
