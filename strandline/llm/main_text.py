"""Operator 8, HTML extraction: a suffix array over each host's token streams, with page structure as the check.

Pages are cut into blocks of text, each in a zone: inside an article or main element, or open; blocks of menus, headers,
footers, forms, scripts, adverts, reader comments and the like are hard elements and not text. The token streams of all
pages of a host are concatenated (32-bit codes of tokens), a suffix array finds substrings of at least RUN tokens that
repeat across PAGES distinct pages, and covered boilerplate is removed:

- On pages without an article the covered tokens go and unique runs stay, of the main element's blocks if there are any.
- Inside an article repeated passages are text, for articles quote and share them; what is boilerplate there is a slot, the
  place of a block by the names and classes of the elements around it, whose tokens on the host's pages are covered for the
  most part (SLOT). Its blocks go from every page of the host. Counts of slots are summed over the whole host.
- A page most of whose own text (over MOSTLY) repeats is a copy of an article, not boilerplate: it stays whole and says
  nothing about slots.

What is an article: a wrapper that holds the only articles of a page is no form, menu or notice, and one that is never closed ends
where an article begins; so a page whose article the lists would drop is read once more with such wrappers open, and that
counts where it gives more text. Inside an article the lists speak of containers, and only those that hold less than
LARGE of its text and are closed in it; of paragraphs, headings and the like only words for adverts do. Paragraphs
of the main element that lead up to the article belong to it, and an article that is much shorter than another one of
the page (TEASER) is a teaser.

A host's pages are dealt to groups of about GROUP bytes of html by hash, so that a host with a third of all pages is many
tasks' work; the groups of a host exchange digests of their windows of RUN tokens with counts of pages, in order and packed,
so that every substring's pages are counted over the whole host and the result does not depend on the groups. They do so
twice: first all windows, by as many bits as tell a host's windows apart for the most part (SPARE), which leaves those that
may stand in several groups and on PAGES pages; then these by 64 bits, which decide. What moves is 3 to 4 bytes a token (codes,
deflated by page), of hosts of several groups about 5 bits and log2(groups) for a different window of a group, and the
texts of pages without an article; articles are read a second time for the result.

Edge cases: null or empty html gives the empty text; a null url belongs to the host ""; html of any length is read whole
and may be cut off anywhere; repeated rows get a row each; null identifiers stay null; an empty table gives an empty
result; other columns are not read. Two different tokens have the same code with a chance of 1 in 4.3e9 a pair.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, suffixes

#: Tokens of a repeated substring, and distinct pages it must occur in, to be boilerplate.
RUN, PAGES = 6, 3
#: Bytes of html of a host whose streams are searched together, about.
GROUP = 4_000_000
#: Bits of short digests beyond those that count a host's windows, one for every eight bytes of html; groups whose windows a
#: range of digests holds, about.
SPARE, RANGE = 3, 4
#: Share of a page's own tokens beyond which repetition means a copied page.
MOSTLY = 0.8
#: Share of a slot's tokens that repetition must cover for the slot to be boilerplate inside an article.
SLOT = 0.9

#: Share of an article's characters from which a part of it is no boilerplate, whatever it is called; share of the longest
#: article's text under which another article of the page is a teaser.
LARGE, TEASER = 0.3, 0.34

# Elements and tokens of class, id and role attributes that are not main text.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object svg button select textarea dialog menu head title".split())
HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "footer sidebar aside widget related recommended share sharing social cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup "
    "comment comments commentlist disqus reply replies respond pagination pager search login complementary contentinfo alert alertdialog".split()
)
ADVERTS = frozenset("ad ads advert advertisement adverts advertising banner sponsor sponsored".split())
#: Elements of running text: inside an article only words for adverts drop them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tbody tr td th dl dt dd li a abbr b cite code em i mark q s small span strong sub sup u".split())
LEADS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr ins del".split())
CLOSED_BY_BLOCK = frozenset(("p",))
CLOSED_BY_SELF = frozenset("li td th tr dt dd option".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_WORD = re.compile(r"[a-z]+")


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes by name, in lower case; of a repeated name the first."""
    out: dict[str, str] = {}
    for name, *value in _ATTR.findall(attrs):
        if name:
            out.setdefault(name.lower(), "".join(value).lower())
    return out


def _hints(values: list[str]) -> set[str]:
    """HINTS among the values' tokens; a compound counts only if all its words are hints: cookie-notice, not has-sidebar."""
    found = [_WORD.findall(t) for v in values for t in v.split()]
    return {w for words in found if HINTS.issuperset(words) for w in words}


def _zone(name: str, attrs: str, parent: str, within: str = "") -> str:
    """keep, drop or open: of an element with this name and attributes inside a zone; ``within``: the block's element."""
    if parent == "drop":
        return "drop"
    inside = parent in ("article", "main")
    found = _attributes(attrs) if attrs and not attrs.isspace() else {}
    page = name in ("body", "html")
    if not page and ("hidden" in found or found.get("aria-hidden", "").strip() == "true"):
        return "drop"
    if name in DROPPED and not (name == "header" and inside) and not (name == "button" and parent == "article" and within in PROSE):
        return "drop"
    hints = _hints([found[k] for k in ("class", "id", "role") if k in found]) if found and not page else ()
    if hints and parent == "article" and name in PROSE:
        hints = hints & ADVERTS
    if hints and not (hints <= {"header"} and inside):
        return "drop"
    if name == "article" or "articlebody" in found.get("itemprop", "").split():
        return "article"
    if name == "main" or "main" in found.get("role", "").split():
        return "article" if parent == "article" else "main"
    return parent


@functools.cache
def _ends(name: str) -> re.Pattern:
    return re.compile(f"<(/?){re.escape(name)}(?=[\\s/>])", re.I)


def _closed(page: str, name: str, at: int, stop: int) -> int | None:
    """Where the element of this name whose start tag ends at ``at`` is closed, before ``stop``; None if it is not."""
    depth = 1
    for m in _ends(name).finditer(page, at, stop):
        depth += -1 if m[1] else 1
        if not depth:
            return m.start()
    return None


def _length(page: str, at: int, stop: int) -> int:
    """Characters of text, about, in a part of a page."""
    return sum(len(t) for t in _TAG.sub("\0", page[at:stop]).split("\0"))


def _label(name: str, attrs: str) -> str:
    """An element's part of a slot: its name and classes, without numbers."""
    held = _attributes(attrs).get("class", "") if "class" in attrs.lower() else ""
    return f"{name}.{re.sub('[0-9]+', '', held)}" if held else name


def _article_at(page: str, at: int) -> tuple[int, int]:
    """(begin, stop) of the next article element from ``at`` on; the page's end twice if there is none."""
    m = _ARTICLE.search(page, at)
    if m is None:
        return len(page), len(page)
    return m.start(), _closed(page, "article", m.end(), len(page)) or len(page)


_ARTICLE = re.compile(r"<article(?=[\s>])", re.I)


def _parsed(page: str, lenient: bool = False) -> tuple[list[tuple[str, str, str, int]], set[int]]:
    """((zone, slot, text, article) of the page's blocks, the articles that a main element holds); articles are numbered from
    1. ``lenient``: wrappers of an article, and elements that are not closed before one, are no zones of their own."""
    out: list[tuple[str, str, str, int]] = []
    nested: set[int] = set()
    stack: list[tuple[str, str, str]] = []
    zone, slot, parts, at, n = "open", "", [], 0, len(page)
    articles, begun, stop, size = 0, 0, n, None

    def flush():
        if parts:
            if zone != "drop" and (text := " ".join(html_lib.unescape("".join(parts)).split())):
                out.append((zone, slot, text, articles if zone == "article" else 0))
            parts.clear()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if m[1]:
            held = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in INLINE:
                flush()
            if held is not None:
                if stack[held][1] != zone:
                    flush()
                _, zone, slot = stack[held]
                del stack[held:]
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID and name != "hr":
            continue
        if name not in INLINE:
            pressed = name == "button" and zone == "article" and stack and stack[-1][0] in PROSE
            if not pressed:
                flush()
            closes = name if name in CLOSED_BY_SELF else "p"
            if stack and stack[-1][0] == closes or name in CLOSED_BY_SELF and any(x[0] == name for x in stack[-3:]):
                held = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == closes)
                if not pressed:
                    _, zone, slot = stack[held]
                    del stack[held:]
            elif any(x[0] == "p" for x in stack[-4:]) and name not in ("button",):
                held = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p")
                _, zone, slot = stack[held]
                del stack[held:]
        inner = _zone(name, m[3], zone, stack[-1][0] if stack else "")
        if inner == "drop" and zone != "drop":
            if zone == "article":
                end = _closed(page, name, at, stop)
                if end is None:
                    inner = zone
                elif end - at > LARGE * (stop - begun):  # a part with so much text has at least so many bytes, nearly always
                    size = _length(page, begun, stop) if size is None else size
                    inner = zone if _length(page, at, end) >= LARGE * size else inner
            elif lenient and name not in ("head", "title"):
                begin, _ = _article_at(page, at)
                end = _closed(page, name, at, n)
                inner = zone if begin < n and (end is None or end > begin) else inner
        if name == "hr":
            continue
        if inner != zone:
            flush()
        if inner == "article" and zone != "article":
            articles, begun, size = articles + 1, at, None
            stop = _closed(page, name, at, n) or n
            if zone == "main":
                nested.add(articles)
        stack.append((name, zone, slot))
        zone = inner
        if name not in INLINE:
            slot = f"{slot}/{_label(name, m[3])}"
    flush()
    return out, nested


def _chosen(found: list[tuple[str, str, str, int]], nested: set[int]) -> list[tuple[str, str, str]]:
    """The blocks with the article's own in the zone article: without teasers, with the paragraphs that lead up to it."""
    sizes: dict[int, int] = {}
    for zone, _, text, k in found:
        if zone == "article":
            sizes[k] = sizes.get(k, 0) + len(text)
    least = TEASER * max(sizes.values(), default=0)
    first = next((i for i, x in enumerate(found) if x[0] == "article" and sizes[x[3]] >= least), None)
    out = []
    for i, (zone, slot, text, k) in enumerate(found):
        if zone == "article" and sizes[k] < least:
            zone = "open"
        elif zone == "main" and first is not None and i < first and found[first][3] in nested and slot.rsplit("/", 1)[-1].split(".")[0] in LEADS:
            zone = "article"
        out.append((zone, slot, text))
    return out


def slotted(page: str) -> list[tuple[str, str, str]]:
    """(zone, slot, text) of the page's blocks in order: white space single, references decoded, empty ones left out."""
    found = _chosen(*_parsed(page))
    if any(z == "article" for z, _, _ in found) or not _ARTICLE.search(page):
        return found
    kind = kind_of([z for z, _, _ in found])
    again = _chosen(*_parsed(page, lenient=True))
    size = lambda rows, zone: sum(len(t) for z, _, t in rows if z == zone)
    return again if size(again, "article") > size(found, kind) else found


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the page's blocks in order."""
    return [(zone, text) for zone, _, text in slotted(page)]


def kind_of(zones: list[str]) -> str:
    """What decides the page: article, main or open."""
    return next((z for z in ("article", "main") if z in zones), "open")


class Streams:
    """The token streams of one host group's pages, one after another, in a suffix array of depth RUN."""

    def __init__(self, codes: list[np.ndarray]):
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.own, flat = np.unique(np.concatenate(codes), return_inverse=True)
        ends = np.cumsum(self.sizes + 1) - 1
        self.codes = np.empty(int(self.sizes.sum()) + len(codes), np.int64)
        token = np.ones(len(self.codes), bool)
        token[ends] = False
        self.codes[token] = flat + 1
        self.codes[ends] = len(self.own) + 1 + np.arange(len(ends))  # a separator of its own after each page
        self.starts = ends - self.sizes
        owner = np.repeat(np.arange(len(codes)), self.sizes + 1)
        self.sa, _ = suffixes.suffix_array(self.codes, 1, RUN)
        self.group = np.cumsum(suffixes.common_prefixes(self.codes, self.sa, RUN) < RUN)
        pairs = np.unique(self.group * len(codes) + owner[self.sa])
        #: Distinct pages of each group of equal windows.
        self.pages = np.bincount(pairs // len(codes), minlength=self.group.max() + 1)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """(group, digest) of the windows of RUN tokens inside a page, one of each group of equal ones."""
        ends = np.cumsum(np.append(self.codes, len(self.own) + 1) > len(self.own))
        at = np.arange(max(0, len(self.codes) - RUN + 1))
        whole = np.zeros(len(self.codes), bool)
        whole[at] = ends[at + RUN - 1] == np.where(at > 0, ends[at - 1], 0)
        groups, first = np.unique(self.group, return_index=True)
        first = self.sa[first]
        groups, first = groups[whole[first]], first[whole[first]]
        words = np.append(np.uint64(0), (self.own.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))
        digest = np.zeros(len(first), np.uint64)
        for k in range(RUN):
            digest = (digest ^ (digest >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[self.codes[first + k]]
        return groups, digest.view(np.int64)

    def covered(self, elsewhere: np.ndarray) -> list[np.ndarray]:
        """Per page and token: whether a window that repeats across PAGES pages here, or one of these digests, covers it."""
        repeats = self.pages >= PAGES
        if len(elsewhere):
            groups, digest = self.digests()
            repeats[groups[np.isin(digest, elsewhere)]] = True
        repeated = np.zeros(len(self.codes) + 1, np.int64)
        hits = self.sa[repeats[self.group]]
        np.add.at(repeated, hits, 1)
        np.add.at(repeated, np.minimum(hits + RUN, len(self.codes)), -1)
        on = np.cumsum(repeated)[:-1] > 0
        return [on[a : a + n] for a, n in zip(self.starts.tolist(), self.sizes.tolist())]


def codes_of(text: str, known: dict) -> np.ndarray:
    """The tokens of a text as 32-bit codes; ``known`` remembers them."""
    out = []
    for w in text.split(" "):
        if (c := known.get(w)) is None:
            c = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(c)
    return np.array(out, np.uint32)


def unique_run(texts: list[str], mine: np.ndarray, hit: np.ndarray) -> str:
    """The page's own tokens (``mine``) that repetition (``hit``) does not cover; all of them if it is a copy."""
    tokens = [w for t in texts for w in t.split(" ")]
    whole = mine.any() and hit[mine].mean() > MOSTLY
    return " ".join(w for w, c, m in zip(tokens, hit.tolist(), mine.tolist()) if m and (whole or not c))


_SCHEMA = "page_id long, url string, text string, n_chars long"
_STREAM = "page_id long, url string, host string, g int, groups int, kind string, codes binary, sizes binary, slots binary, own binary, texts array<string>"
_FOUND = "page_id long, url string, text string, host string, slot long, pages long, covered long, total long"
_L, _S, _B = pa.int64(), pa.string(), pa.binary()


def _rows(rows: list[tuple], names: str, kinds: list) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


def streams_of(batches):
    """A stream per page that has text: codes of its tokens, and of its blocks their sizes, slots and whether they are the
    page's own; of pages without an article the texts too."""
    known: dict = {}
    for b in batches:
        if len(known) > 500_000:
            known.clear()
        rows = []
        for page_id, url, host, g, groups, page in zip(*(b.column(i).to_pylist() for i in range(6))):
            if not (found := slotted(page or "")):
                continue
            kind = kind_of([z for z, _, _ in found])
            texts = [t for _, _, t in found]
            codes = [codes_of(t, known) for t in texts]
            slots = np.array([zlib.crc32(s.encode("utf-8", "surrogatepass")) for _, s, _ in found], np.int64)
            own = np.array([z == kind for z, _, _ in found], np.uint8)
            shown = (None, None, None) if kind == "article" else (page_id, url, texts)
            rows.append((*shown[:2], host, g, groups, kind, zlib.compress(np.concatenate(codes).tobytes(), 1), np.array([len(c) for c in codes], np.int32).tobytes(), slots.tobytes(), own.tobytes(), shown[2]))
        kinds = [_L, _S, _S, pa.int32(), pa.int32(), _S, _B, _B, _B, _B, pa.list_(_S)]
        names = "page_id url host g groups kind codes sizes slots own texts"
        yield from _rows(rows, names, kinds).combine_chunks().to_batches()


class Group:
    """The streams of one group, and which of their tokens are the pages' own."""

    def __init__(self, table: pa.Table):
        of = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        self.host, self.g, self.groups = (table.column(c)[0].as_py() for c in ("host", "g", "groups"))
        self.kinds, self.slots, self.sizes = table.column("kind").to_pylist(), of("slots", np.int64), of("sizes", np.int32)
        self.codes = [np.frombuffer(zlib.decompress(x), np.uint32) for x in table.column("codes").to_pylist()]
        self.mine = [np.repeat(o.astype(bool), n) for o, n in zip(of("own", np.uint8), self.sizes)]


def short_bits(groups: int) -> int:
    """Bits of the short digests of a host of so many groups."""
    return min(64, (groups * GROUP // 8).bit_length() + SPARE)


def counted(group: Group, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, pages, wanted) of a group's different windows of RUN tokens in order: the distinct pages it stands on here, PAGES
    at most, and whether it stands over a page's own token, so that it matters here. ``among``: only windows of these short
    digests, which are in order."""
    sizes = np.array([len(c) for c in group.codes])
    words = (np.concatenate(group.codes).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(max(0, len(words) - RUN + 1))
    at = at[owner[at] == owner[at + RUN - 1]]
    digest = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        digest = (digest ^ (digest >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
    if among is not None:
        short = digest >> np.uint64(64 - short_bits(group.groups))
        held = among[np.minimum(np.searchsorted(among, short), len(among) - 1)] == short
        digest, at = digest[held], at[held]
    sums = np.concatenate([[0], np.cumsum(np.concatenate(group.mine))])
    order = np.argsort(digest, kind="stable")  # windows of one digest stay in order of pages
    digest, at = digest[order], at[order]
    first = np.append(True, digest[1:] != digest[:-1])[: len(digest)]
    page = first | np.append(True, owner[at[1:]] != owner[at[:-1]])[: len(digest)]
    starts = np.flatnonzero(first)
    if not len(starts):
        return digest, np.zeros(0, np.int64), np.zeros(0, bool)
    return digest[starts], np.minimum(np.add.reduceat(page.astype(np.int64), starts), PAGES), np.logical_or.reduceat(sums[at + RUN] > sums[at], starts)


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, those of one place together, deflated."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _packed(digests: np.ndarray) -> bytes:
    """Digests in order, as differences."""
    return _planes(np.diff(digests, prepend=np.uint64(0)))


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _ranges(group: Group, bits: int, digest: np.ndarray, flags: np.ndarray) -> pa.Table:
    """(host, shard, g, digests, flags) of a group's digests of so many bits by ranges, one for every RANGE groups of the host."""
    shards = -(-group.groups // RANGE)
    width = -(-(2**bits) // shards)
    cuts = np.searchsorted(digest, np.array([k * width for k in range(1, shards)], np.uint64)).tolist()
    rows = []
    for shard, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(digest)])):
        if b > a:
            rows.append((group.host, shard, group.g, _packed(digest[a:b]), _planes(flags[a:b].astype(np.uint8))))
    return _rows(rows, "host shard g digests flags", [_S, pa.int32(), pa.int32(), _B, _B])


def _met(table: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of one range of a host's digests: each group's digests and flags, the places of those among the different ones, and of
    these the sums of pages and the number of groups."""
    held = [(_unpacked(d), np.frombuffer(zlib.decompress(f), np.uint8)) for d, f in zip(table.column("digests").to_pylist(), table.column("flags").to_pylist())]
    own, at = np.unique(np.concatenate([d for d, _ in held]), return_inverse=True)
    pages = np.bincount(at, np.concatenate([f >> 1 for _, f in held]), len(own))
    return held, np.split(at, np.cumsum([len(d) for d, _ in held])[:-1]), pages, np.bincount(at, minlength=len(own))


def short_windows(table: pa.Table) -> pa.Table:
    """The short digests of a group of several, with the pages of all windows that have one, PAGES at most."""
    if table.column("groups")[0].as_py() == 1:
        return _rows([], "host shard g digests flags", [_S, pa.int32(), pa.int32(), _B, _B])
    group = Group(table)
    bits = short_bits(group.groups)
    digest, pages, _ = counted(group)
    short = digest >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.append(True, short[1:] != short[:-1])[: len(short)])
    pages = np.minimum(np.add.reduceat(pages, starts), PAGES) if len(starts) else pages
    return _ranges(group, bits, short[starts], 2 * pages)


def candidates(table: pa.Table) -> pa.Table:
    """(host, g, digests): of one range of a host's short digests those that several groups hold and that reach PAGES pages in
    all, for each group that holds them. No window that reaches PAGES pages only with others' is left out."""
    held, places, pages, groups = _met(table)
    may = (pages >= PAGES) & (groups > 1)
    rows = []
    for g, (digest, _), at in zip(table.column("g").to_pylist(), held, places):
        if len(back := digest[may[at]]):
            rows.append((table.column("host")[0].as_py(), g, _packed(back)))
    return _rows(rows, "host g digests", [_S, pa.int32(), _B])


def windows(table: pa.Table, back: pa.Table) -> pa.Table:
    """The digests of a group's windows that are candidates, with a bit for wanted ones and pages above it."""
    if not table.num_rows or not back.num_rows:
        return _rows([], "host shard g digests flags", [_S, pa.int32(), pa.int32(), _B, _B])
    group = Group(table)
    digest, pages, wanted = counted(group, np.sort(np.concatenate([_unpacked(x) for x in back.column("digests").to_pylist()])))
    return _ranges(group, 64, digest, 2 * pages + wanted)


def reaching(table: pa.Table) -> pa.Table:
    """(host, g, digests): of one range of a host's windows those that reach PAGES pages in all, for each group that wants them
    and has fewer."""
    held, places, pages, _ = _met(table)
    rows = []
    for g, (digest, flags), at in zip(table.column("g").to_pylist(), held, places):
        if len(back := digest[(pages[at] >= PAGES) & (flags & 1 > 0) & (flags >> 1 < PAGES)]):
            rows.append((table.column("host")[0].as_py(), g, _packed(back)))
    return _rows(rows, "host g digests", [_S, pa.int32(), _B])


def searched(table: pa.Table, back: pa.Table) -> pa.Table:
    """Of one group: the texts of pages without an article, and the counts of the slots of articles."""
    names, kinds = "page_id url text host slot pages covered total", [_L, _S, _S, _S, _L, _L, _L, _L]
    if not table.num_rows:
        return _rows([], names, kinds)
    group = Group(table)
    elsewhere = [_unpacked(x).view(np.int64) for x in back.column("digests").to_pylist()]
    hits = Streams(group.codes).covered(np.concatenate(elsewhere) if elsewhere else np.zeros(0, np.int64))
    rows, counts = [], {}
    ids, urls, texts = (table.column(c).to_pylist() for c in ("page_id", "url", "texts"))
    for i, (kind, hit, mine) in enumerate(zip(group.kinds, hits, group.mine)):
        if kind != "article":
            rows.append((ids[i], urls[i], unique_run(texts[i], mine, hit), None, None, None, None, None))
        elif hit[mine].mean() <= MOSTLY:
            slot, at = np.unique(np.repeat(group.slots[i], group.sizes[i])[mine], return_inverse=True)
            for s, c, n in zip(slot.tolist(), np.bincount(at, hit[mine], len(slot)).tolist(), np.bincount(at, minlength=len(slot)).tolist()):
                old = counts.get(s, (0, 0, 0))
                counts[s] = (old[0] + 1, old[1] + int(c), old[2] + n)
    rows += [(None, None, None, group.host, s, *c) for s, c in counts.items()]
    return _rows(rows, names, kinds)


def articles(batches):
    """Per page with an article, or without any text: the article's blocks but for those of boilerplate slots."""
    for b in batches:
        rows = []
        for page_id, url, bad, page in zip(*(b.column(i).to_pylist() for i in range(4))):
            found = slotted(page or "")
            if not found or kind_of([z for z, _, _ in found]) == "article":
                gone = set(bad or ())
                text = " ".join(t for z, s, t in found if z == "article" and not (gone and zlib.crc32(s.encode("utf-8", "surrogatepass")) in gone))
                rows.append((page_id, url, text, len(text)))
        yield from _rows(rows, "page_id url text n_chars", [_L, _S, _S, _L]).combine_chunks().to_batches()


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    common.ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")

    # hosts of several groups: no more than there are GROUPs of html; staged, so that its size decides the join
    parts = F.ceil(F.sum(F.octet_length("html")) / GROUP).cast("int")
    large = common.staged(pages.groupBy("host").agg(parts.alias("groups")).where("groups > 1"), "hosts")
    dealt = pages.join(large, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("groups")).cast("int"))
    streams = dealt.select("page_id", "url", "host", "g", "groups", "html").mapInArrow(streams_of, _STREAM).repartition("host", "g")
    by_group = streams.groupBy("host", "g")

    # the groups of a host exchange short digests of their windows, then whole ones of those that may reach PAGES pages in
    # all; those that do go back to the groups that hold them
    held, back = "host string, shard int, g int, digests binary, flags binary", "host string, g int, digests binary"
    met = lambda shards, of: shards.groupBy("host", "shard").applyInArrow(of, back).groupBy("host", "g")
    may = met(by_group.applyInArrow(short_windows, held), candidates)
    reached = met(by_group.cogroup(may).applyInArrow(windows, held), reaching)
    found = common.staged(by_group.cogroup(reached).applyInArrow(searched, _FOUND), "found")

    sums = found.where("slot is not null").groupBy("host", "slot").agg(*(F.sum(c).alias(c) for c in ("pages", "covered", "total")))
    bad = sums.where((F.col("pages") >= PAGES) & (F.col("covered") >= SLOT * F.col("total"))).groupBy("host").agg(F.collect_set("slot").alias("bad"))
    again = pages.join(common.staged(bad, "slots"), "host", "left").select("page_id", "url", "bad", "html")
    rest = found.where("slot is null").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    return again.mapInArrow(articles, _SCHEMA).unionByName(rest)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all pages."""
    return main_text(common.table(spark, sf_dir, "pages"))
