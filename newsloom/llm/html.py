"""Main text of web pages by equivalence-class template deduction.

1. Every page is read as tokens: its elements, each named by the path of elements and class, id and role attributes down to it,
   and its text blocks with the element they stand in. An element has the size of the open text below it: text that isn't in a
   link, nor in an element that is marked as something else than main text.
2. Per host, a token's occurrence vector is its count on each page; vectors are compared by a fold of hashes over the host's
   different pages. Tokens of equal vectors form an equivalence class. A class is valid if it has several tokens and spans
   SUPPORT of the pages.
3. Tokens of valid classes that occur once a page are nested by their paths into the host's template. What lies between them are
   its slots. The smallest element of the template that holds HELD of the host's open text is the one of the main slots. Text
   blocks of valid classes are template, too.
4. The slots under that element are read out of each page, without template texts and without elements that are marked as menus,
   headers, footers, sidebars, notices, adverts, forms or comments. Marks on what lies around the element don't count. Where it
   is inside an article or main element, that one is read; where it holds one with most of its text, that one.

A host with fewer than PAGES different pages shows no template: an article or main element, or the smallest element that holds
HELD of the page's own open text, takes its place, chosen by the same rules.

Copies of a page count once: they are dropped by a grouped hash, so that results don't depend on partitions or order. A host's
template holds tokens on at least SUPPORT of its pages, so its size follows a page's, not the host's; templates are broadcast
after a check of their size, else joined by host, which Spark splits for a hot one. A page takes memory in proportion to its length.

Defined results: null html is an empty page: empty text. Null url: a host of its own. Broken markup is read to its end. Repeated
rows are handled row by row; an empty table gives no rows. A null id is kept. Of further columns none is read.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._shared import shared_dir, stored

#: Share of a host's pages that a class spans, least different pages and tokens of a class, share of open text that the main element
#: holds, bytes of templates that are broadcast.
SUPPORT, PAGES, TOKENS, HELD, FEW = 0.9, 4, 2, 0.95, 16 << 20

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas textarea title select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr mi mn mo mrow msup msub mfrac msqrt".split())
GONE = frozenset("head nav header footer aside form dialog menu".split()) | RAW
MAIN = frozenset("article main".split())
NEVER = frozenset("head nav footer aside menu dialog".split()) | RAW
#: Words of class, id and role attributes that mark what isn't main text, and words that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer form header login masthead menu menubar nav navbar navigation newsletter notice notices pagination popup promo related respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
BESIDE = frozenset(
    "area article articles bar block body bottom box button buttons container content email form foot global group holder icons inline inner items left line links list main "
    "mobile module outer overlay page panel post posts primary right row secondary section site slot small stories text thread top unit wide wrap wrapper".split()
)
#: What a start tag closes if it is open: itself or the others named.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"\s+")
_marked: dict[str, bool] = {}


def marked(value: str) -> bool:
    """Whether a class, id or role says that this isn't main text: one of its names consists of such words, and words beside them."""
    known = _marked.get(value)
    if known is None:
        known = False
        for name in value.split():
            own = _WORD.findall(_HUMP.sub("-", name).lower())
            known |= any(w in MARKS for w in own) and all(w in MARKS or w in BESIDE for w in own)
        if len(_marked) > 100_000:
            _marked.clear()
        _marked[value] = known
    return known


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


class Page:
    """A page's elements and text blocks in the order of the page. Element 0 is the page itself."""

    def __init__(self, source: str) -> None:
        self.parent, self.token, self.name = [-1], [0], [""]
        self.odd: list[bool] = [False]  # marked itself
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(source)
        self.after = [0] * len(self.parent)  # one past the last element below each
        for i in range(len(self.parent) - 1, -1, -1):
            self.after[i] = max(self.after[i], i + 1)
            if i:
                self.after[self.parent[i]] = max(self.after[self.parent[i]], self.after[i])
        self.heads = [i for i, name in enumerate(self.name) if name == "h1"]
        whole = self._below([(i, len(text)) for i, text, _ in self.blocks])
        for i, odd in enumerate(self.odd):  # what holds the headline and nearly all text isn't beside it
            if odd and self.name[i] not in NEVER and 10 * whole[i] >= 9 * whole[0] and self._headed(i):
                self.odd[i] = False
        self.gone = self._gone(0)
        self.open = self._below([(i, max(0, len(text) - linked)) for i, text, linked in self.blocks if not self.gone[i]])

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, int, bool]] = []  # name, element, place of the innermost block frame at or below, hides
        count: dict[str, int] = {}  # open elements by name
        parts: list[str] = []
        at, n, here, hidden, links, linked = 0, len(source), 0, 0, 0, 0
        token, attribute, white, unescape = _TOKEN, _ATTR, _WHITE, entities.unescape

        def flush() -> None:
            nonlocal linked
            if parts:
                text = white.sub(" ", "".join(parts)).strip()
                parts.clear()
                if text:
                    self.blocks.append((here, text, min(linked, len(text))))
            linked = 0

        def pop() -> None:
            nonlocal hidden, links
            name, _, _, hides = stack.pop()
            count[name] -= 1
            hidden -= hides
            links -= name == "a"

        def block_frame() -> int:
            return stack[-1][2] if stack else -1

        while at < n:
            found = token.search(source, at)
            begin = found.start() if found else n
            if begin > at and not hidden:
                piece = unescape(source[at:begin])
                parts.append(piece)
                if links:
                    linked += len(piece)
            if not found:
                break
            at = found.end()
            if found[2] is None:
                if found[0].startswith("<![CDATA[") and not hidden:
                    parts.append(found[0][9:].removesuffix("]]>"))
                continue
            closing, name, rest = found[1], found[2].lower(), found[3]
            if closing:
                if not count.get(name):
                    continue
                if name not in INLINE:
                    flush()
                while stack:
                    last = stack[-1][0]
                    pop()
                    if last == name:
                        break
                now = stack[block_frame()][1] if block_frame() >= 0 else 0
                if now != here:
                    flush()
                    here = now
                continue
            if name in RAW:
                if not rest.endswith("/") or name not in ("svg", "object", "iframe"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else n
                self._element(here, name, "", False)
                continue
            if name == "br":
                parts.append(" ")
            if name not in INLINE:
                flush()
                shut = CLOSES.get(name, {"p"} if name not in VOID else ())
                while (k := block_frame()) >= 0 and stack[k][0] in shut:
                    while len(stack) > k:
                        pop()
                here = stack[block_frame()][1] if block_frame() >= 0 else 0
            marks = [a[2] or a[3] or a[4] or "" for a in attribute.finditer(rest)] if "=" in rest else []
            odd = bool(marks) and any(marked(m) for m in marks)
            if name in INLINE:
                self._element(here, name, " ".join(marks), False)
                if name in VOID or rest.endswith("/"):
                    continue
                links += name == "a"
                hidden += odd
                stack.append((name, here, block_frame(), odd))
            else:
                role = name in MAIN or any(m.strip().lower() == "main" for m in marks)
                element = self._element(here, "main" if role and name not in MAIN else name, " ".join(marks), name in GONE or odd and not role and name not in ("html", "body"))
                if name in VOID or rest.endswith("/"):
                    continue
                here = element
                stack.append((name, element, len(stack), False))
            count[name] = count.get(name, 0) + 1
        flush()

    def _element(self, parent: int, name: str, marks: str, odd: bool) -> int:
        self.parent.append(parent)
        self.token.append(_hash(f"{self.token[parent]}/{name}.{_WHITE.sub('.', marks.strip().lower())}") & ~1)
        self.name.append(name)
        self.odd.append(odd)
        return len(self.parent) - 1

    def _gone(self, root: int) -> list[bool]:
        """Of the elements from root on: which are marked, or below one that is. The marks of root and around it don't count, nor
        those around an article or main element, unless it is beside the main text; an article's header and headline are its own."""
        out = [True] * root + [False] * (self.after[root] - root)
        beside = [False] * self.after[root]
        for i in range(root + 1, self.after[root]):
            up = self.parent[i]
            name = self.name[i]
            beside[i] = beside[up] or name in ("nav", "aside", "footer")
            if name in MAIN and not beside[i] and not self.odd[i]:
                out[i] = False
            else:
                out[i] = out[up] or self.odd[i] and not (name in ("header", "div", "section") and self._inside(up, root) and (name == "header" or self._headed(i)))
        return out

    def _headed(self, i: int) -> bool:
        k = bisect.bisect(self.heads, i)
        return k < len(self.heads) and self.heads[k] < self.after[i]

    def _inside(self, i: int, root: int) -> bool:
        while i > root and self.name[i] not in MAIN:
            i = self.parent[i]
        return self.name[i] in MAIN

    def _below(self, sizes: list[tuple[int, int]]) -> list[int]:
        """Sums of sizes of blocks, by element, over all below each."""
        out = [0] * len(self.parent)
        for i, size in sizes:
            out[i] += size
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def held(self, root: int, share: float) -> int:
        """The smallest element below root that holds a share of its open text."""
        i, wanted = root, share * self.open[root]
        while wanted:
            below, last = i + 1, self.after[i]
            while below < last and self.open[below] < wanted:
                below = self.after[below]
            if below >= last:
                return i
            i = below
        return root

    def chosen(self, template: int | None, share: float = HELD) -> int:
        """The element whose slots are the main text; template: the token of the host's main element."""
        places = [i for i, t in enumerate(self.token) if t == template] if template is not None else []
        i = max(places, key=lambda x: (self.open[x], -x)) if places else 0
        around = i
        while around and self.name[around] not in MAIN:
            around = self.parent[around]
        if around:
            up = around
            while up and self.name[up] != "article":
                up = self.parent[up]
            i = up or around
        inner = [x for x in range(i + 1, self.after[i]) if self.name[x] in MAIN and not self.gone[x]]
        outer: list[int] = []
        for x in inner:
            if not outer or x >= self.after[outer[-1]]:
                outer.append(x)
        if self.name[i] != "article" and outer:
            best = max(outer, key=lambda x: (self.open[x], -x))
            if 2 * self.open[best] >= self.open[i]:
                below = [x for x in inner if best < x < self.after[best] and self.name[x] == "article"] if self.name[best] == "main" else []
                most = max(below, key=lambda x: (self.open[x], -x), default=best)
                return most if 2 * self.open[most] >= self.open[best] else best
        if not places and not around:
            i = self.held(i, share)
            headings = [x for x in self.heads if not self.gone[x]]
            while i and len(headings) == 1 and not i <= headings[0] < self.after[i]:
                i = self.parent[i]  # the headline stands apart
        return i

    def tokens(self) -> tuple[list[int], list[int], list[int]]:
        """Different tokens with their number and size: elements (even; their open text), open blocks (odd; 0)."""
        counts: dict[int, list[int]] = {}
        for i, t in enumerate(self.token):
            own = counts.setdefault(t, [0, 0])
            own[0] += 1
            own[1] += self.open[i]
        for i, text, _ in self.blocks:
            if not self.gone[i]:
                counts.setdefault(self.block(i, text), [0, 0])[0] += 1
        return list(counts), [c for c, _ in counts.values()], [s for _, s in counts.values()]

    def block(self, i: int, text: str) -> int:
        return _hash(f"{self.token[i]}\n{text}") | 1

    def text(self, template: int | None, fixed: set[int]) -> str:
        """The main text, by the host's main element and its template's text blocks."""
        root = self.chosen(template)
        gone = self._gone(root)
        main = [(i, text) for i, text, _ in self.blocks if root <= i < self.after[root] and not gone[i]]
        own = [(i, text) for i, text in main if self.block(i, text) not in fixed] if fixed else main
        if 2 * sum(len(t) for _, t in own) < sum(len(t) for _, t in main):  # the pages are near copies: no slot is filled by a template
            own = main
        return "\n\n".join(t for _, t in own)


def host_of(url: str | None) -> str:
    text = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", text, maxsplit=1)[0].rpartition("@")[2].lower().removeprefix("www.")


def tokens(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page, token, n, size): the tokens of every different page of a host; page is a hash. Copies are dropped first within
    a task, then among tasks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in stream:
            rows: list[tuple[str, int, pa.Array, pa.Array, pa.Array]] = []
            for address, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, source = host_of(address), source or ""
                own = _hash(f"{host}\n{source}")
                if own in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(own)
                token, n, size = Page(source).tokens()
                rows.append((host, own, np.array(token, np.uint64).view(np.int64), n, size))
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64))]
            columns += [pa.array([r[i] for r in rows], pa.list_(t)) for i, t in ((2, pa.int64()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "page", "tokens", "ns", "sizes"])

    rows = pages.select(url, html).mapInArrow(run, "host string, page long, tokens array<long>, ns array<int>, sizes array<int>")
    rows = rows.dropDuplicates(["host", "page"])
    return rows.select("host", "page", F.explode(F.arrays_zip("tokens", "ns", "sizes")).alias("t")).select("host", "page", F.col("t.tokens").alias("token"), F.col("t.ns").alias("n"), F.col("t.sizes").alias("size"))


def templates(found: DataFrame, support: float = SUPPORT, least: int = PAGES, held: float = HELD) -> DataFrame:
    """Per host of `least` pages: main, the token of the smallest element that holds most open text, and texts, the template's blocks."""
    vectors = found.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("size").alias("size"))
    vectors = stored(vectors.where("pages > 1 OR token = 0"), shared_dir(found.sparkSession))
    hosts = vectors.where("token = 0").select("host", F.col("pages").alias("n_pages"), F.col("size").alias("whole")).where(F.col("n_pages") >= least)
    wide = vectors.where("pages > 1").join(hosts.hint("merge"), "host").where(F.col("pages") >= support * F.col("n_pages"))
    is_text = F.col("token").bitwiseAND(1) == 1
    classes = wide.groupBy("host", "vector").agg(
        F.count("*").alias("tokens"),
        F.collect_list(F.when(is_text, F.col("token"))).alias("texts"),
        F.min(F.when(~is_text & (F.col("pages") == F.col("total")) & (F.col("size") >= held * F.col("whole")), F.struct("size", F.col("token").alias("main")))).alias("main"),
    )
    return classes.where(F.col("tokens") >= TOKENS).groupBy("host").agg(F.min("main")["main"].alias("main"), F.flatten(F.collect_list("texts")).alias("texts"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", support: float = SUPPORT, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    known = stored(templates(tokens(pages, url, html), support, least), shared_dir(pages.sparkSession))
    size = known.agg(F.coalesce(F.sum(F.size("texts") * 8 + F.length("host") + 64), F.lit(0))).first()[0]
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "^.*?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"([^@]*)$", 1)), r"^www\.", "")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    rows = rows.join(known.hint("broadcast" if size <= FEW else "merge"), "host", "left")
    kind = pages.schema[page_id].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_host: dict[str, tuple[int | None, set[int]]] = {}
        for batch in stream:
            texts = []
            for n, (name, source) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if name not in of_host:
                    if len(of_host) > 1_000:
                        of_host.clear()
                    main, fixed = batch.column(4)[n].as_py(), batch.column(5)[n].as_py()
                    of_host[name] = (None if main is None else main % 2**64, {t % 2**64 for t in fixed or ()})
                texts.append(Page(source or "").text(*of_host[name]))
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes)], [page_id, url, "text", "n_chars"])

    return rows.select("page_id", "url", "host", "html", "main", "texts").mapInArrow(run, f"`{page_id}` {kind}, `{url}` string, text string, n_chars long")
