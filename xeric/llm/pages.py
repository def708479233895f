"""Main text of web pages by a consensus of each host's pages on where the text stands.

Each page's containers are scored by the plain text below them. In Spark, a host's pages vote on the generalised
tag-class path of their best container, and each page is then read again at the host's winning paths.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_skewed, materialise, read_table

# HTML's elements by what they do to text, and words that name a part of a page in its class, id or role.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object select button canvas audio video datalist".split())
STRUCTURE = frozenset("body main article section div center table tbody thead tfoot tr td th nav header footer aside form fieldset details dialog menu hgroup search".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address summary caption legend hr listing".split())
HOLDERS = frozenset("ul ol dl li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
ASIDE_TAGS = frozenset("nav footer aside form dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDE_WORDS = frozenset(
    """nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs crumbs masthead footer footnav sidebar sidenav rail ad ads adv advert
    adverts advertisement advertising adsense adbox adslot banner promo promos promotion sponsor sponsors sponsored cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register search share sharing
    shares social related recommended recommendations trending popular widget widgets comment comments commentlist discussion disqus replies
    respond pagination pager toolbar topbar skip""".split()
)
TEXT_WORDS = frozenset("article content post entry story main text body".split())
#: Words before such a word that say that the element merely goes with it: "has-sidebar", "no-comments".
BESIDE = frozenset("has with without no hide show open".split())

#: What a container's score keeps at each level upwards, and what its name adds.
DECAY, ARTICLE, MAIN, NAMED = 0.8, 1.5, 1.3, 1.25
#: Paths with this share of a host's votes win, so there are five at most.
WINS = 0.2
#: What a winning path counts in a page whose score is lower, and the share of the best that nameless twins must reach.
FLOOR, TWIN = 0.05, 0.25
#: Hosts and characters of a table of winners that is broadcast; a larger one is joined by a shuffle.
MOST_HOSTS, MOST_CHARS = 50_000, 16_000_000

#: A comment, a tag with its attributes, a tag whose quotes don't close, a declaration. No part goes past the next "<".
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>|<[!?][^<>]*>""",
    re.DOTALL,
)
NUMBERED = re.compile(r"[a-zA-Z]*\d[\w-]*")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+")
#: Raw elements that reach to the end of the page if they are not closed; other open tags are passed over.
TO_THE_END = frozenset("script style textarea title iframe noembed noframes xmp".split())
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


class Page:
    """A page's containers and its blocks of text; read in one pass over its tags, with HTML's rules for open ends."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.names, self.aside = ["body"], [-1], [()], [False]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self.heading: list[bool] = []  # of each block
        self.named: set[int] = set()  # called article, content, post and the like
        self.top: set[int] = set()  # those that hold a main heading
        self._by_name: set[int] = set()  # set aside by a name, which what they hold may prove wrong
        self._heads: set[int] = set()  # headers: inside of a text only their headings are text
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        stack, run, in_link, linked, heading, at = [0], [], False, 0, False, 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = "".join(run)
                text = " ".join((entities.unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
                    self.heading.append(heading)
                run.clear()
            linked = 0

        pos = 0
        while m := TOKEN.search(source, pos):
            if m.start() > at:
                run.append(source[at : m.start()])
                linked += (m.start() - at) * in_link
            at = pos = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            end, rest = m[1] or m[4], m[3] or m[6] or ""
            if tag == "a":
                in_link = not end
            elif tag == "br":
                run.append(" ")
            elif tag in RAW:
                if not end and not rest.endswith("/"):
                    close = ENDS[tag].search(source, pos)
                    if close or tag in TO_THE_END:
                        at = pos = close.start() if close else len(source)
            elif tag in STRUCTURE or tag in LEAVES:
                flush()
                in_link = False
                heading = tag in HEADINGS and not end
                if end:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == tag:
                            del stack[k:]
                            break
                    continue
                if self.tag[stack[-1]] == "p" or (heading and self.tag[stack[-1]] in HEADINGS):
                    stack.pop()
                if tag in ITEMS:
                    self._close(stack, ITEMS[tag], LISTS.get(tag, ("table",)))
                if tag == "h1":
                    self.top.add(stack[-1])
                # Paragraphs and the like are containers only if they have a name, which may set them aside.
                if (tag in STRUCTURE and tag != "body") or tag in HOLDERS or (tag != "body" and tag != "hr" and ATTRIBUTE.search(rest)):
                    stack.append(self._open(tag, rest, stack[-1]))
        if at < len(source):
            run.append(source[at:])
        flush()

    def _close(self, stack: list[int], items: tuple[str, ...], lists: tuple[str, ...]) -> None:
        """End the open item that a new one follows, if no list of its own was opened in between."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in lists:
                return
            if tag in items:
                del stack[k:]
                if self.tag[stack[-1]] not in items:
                    return

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        node, found = len(self.tag), {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        words = set()
        for name in (found.get("class", "") + " " + found.get("id", "")).split():
            previous = ""
            for w in map(str.lower, WORD.findall(name)):
                if previous not in BESIDE:
                    words.add(w)
                previous = w
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(tuple(sorted({NUMBERED.sub("#", c) for c in found.get("class", "").split()})))
        by_name = tag not in ("main", "nav", "footer", "menu") and (tag in ASIDE_TAGS or bool(words & ASIDE_WORDS))
        self.aside.append(by_name or tag in ASIDE_TAGS or found.get("role", "").lower() in ASIDE_ROLES)
        if by_name:
            self._by_name.add(node)
        if tag == "header" or "header" in words:
            self._heads.add(node)
        if words & TEXT_WORDS:
            self.named.add(node)
        return node

    def _settle(self) -> None:
        """Take back what a name sets aside or makes a header though it holds the text, then hand down what is aside."""
        n = len(self.tag)
        top = [k in self.top or self.tag[k] == "main" for k in range(n)]
        article = [self.tag[k] == "article" and not self.aside[k] for k in range(n)]
        for k in range(n - 1, 0, -1):
            if k in self._by_name and (top[k] or (article[k] and self.tag[k] in ("form", "dialog"))):
                self.aside[k] = False
            if top[k] and self.tag[k] == "main" or article[k]:
                self._heads.discard(k)
            up = self.parent[k]
            top[up], article[up] = top[up] or top[k], article[up] or article[k]
        inside, self.head = [False] * n, [False] * n
        for k in range(1, n):
            up = self.parent[k]
            inside[k] = inside[up] or self.tag[k] in ("main", "article") or k in self.named
            self.head[k] = self.head[up] or k in self._heads
            self.aside[k] = self.aside[k] or self.aside[up] or (k in self._heads and not inside[up])

    def text_blocks(self) -> Iterator[tuple[int, str, int]]:
        for (node, text, linked), heading in zip(self.blocks, self.heading, strict=True):
            if not self.aside[node] and (heading or not self.head[node]):
                yield node, text, linked

    def scores(self) -> dict[int, float]:
        """Characters outside of links below each container that may hold the text; less for each level between."""
        found = dict.fromkeys((k for k, t in enumerate(self.tag) if t in STRUCTURE and not self.aside[k]), 0.0)
        own = dict.fromkeys(range(len(self.tag)), 0.0)
        for node, text, linked in self.text_blocks():
            own[node] += max(0, len(text) - linked)
        for k in range(len(self.tag) - 1, -1, -1):
            if self.parent[k] >= 0:
                own[self.parent[k]] += own[k] * (DECAY if self.tag[k] in STRUCTURE else 1.0)
            if k in found:
                t = self.tag[k]
                found[k] = own[k] * (ARTICLE if t == "article" else MAIN if t == "main" else NAMED if k in self.named else 1.0)
        return found

    def paths(self) -> list[str]:
        """Each container's path of tags and classes, digits and what hangs on them generalised; a long one as its hash."""
        out = [""]
        for k in range(1, len(self.tag)):
            path = f"{out[self.parent[k]]}/{'.'.join((self.tag[k], *self.names[k]))}"
            out.append(path if len(path) <= 400 else "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest())
        return out

    def vote(self) -> str | None:
        """The path of the container with the best score; none on a page without text."""
        scores, paths = self.scores(), self.paths()
        best = max(scores.values())
        return max(paths[k] for k, v in scores.items() if v == best) if best > 0 else None

    def text(self, winners: dict[str, float]) -> str:
        """The blocks at the winning path that this page supports most (share of votes by own score); else at its own best."""
        scores, paths = self.scores(), self.paths()
        best, at = max(scores.values()), {}
        for k, v in scores.items():
            at.setdefault(paths[k], []).append((v, k))
        own = {p: max(v)[0] / best if best > 0 else 0.0 for p, v in at.items()}
        there = [p for p in at if p in winners]
        path = max(there, key=lambda p: (winners[p] * max(FLOOR, own[p]), p)) if there else max(at, key=lambda p: (own[p], p))
        most = max(at[path])[0]
        nameless = "." not in path.rsplit("/", 1)[-1] and path.rsplit("/", 1)[-1] not in ("article", "main")
        chosen = {k for v, k in at[path] if not nameless or v >= TWIN * most}
        for k in range(1, len(self.tag)):
            if self.parent[k] in chosen:
                chosen.add(k)
        return "\n\n".join(text for node, text, _ in self.text_blocks() if node in chosen)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, n): a batch's votes, counted."""
    for b in batches:
        found = Counter((h, Page(source).vote()) for h, source in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True))
        rows = [(h, p, n) for (h, p), n in found.items() if p is not None]
        yield pa.RecordBatch.from_pylist([dict(zip(("host", "path", "n"), r, strict=True)) for r in rows], VOTE)


VOTE = pa.schema([("host", pa.string()), ("path", pa.string()), ("n", pa.int64())])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, winners): the paths that win on each host with their share of its votes; of (host, html) without nulls."""
    votes = pages.select("host", "html").mapInArrow(_vote, "host string, path string, n long")
    votes = materialise(votes.groupBy("host", "path").agg(F.sum("n").alias("n")), "votes")
    total = votes.groupBy("host").agg(F.sum("n").alias("total"))
    share = join_skewed(votes, total, ["host"]).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).filter(F.col("share") >= WINS)
    winners = materialise(share.groupBy("host").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "share")))).alias("winners")), "winners")
    discard(votes)
    return winners


def page_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text): each page's main text, its blocks joined by an empty line.

    A host's pages vote on the tag-class path of their text; each page is read again at the winning path that it
    supports most, or at its own best container if it has none of them. Menus, headers (but the headings of an
    article's own header), footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
    out by tag, role, class or id. Blocks are what block elements and cells hold; white space, as Unicode has it, is
    one space in them.

    A null or empty page has an empty text. A page without a host (null or odd url) votes with the others of that kind.
    Broken markup ends where HTML ends it; an open comment or script reaches to the page's end. Pages of any length are
    read whole. Rows that repeat a key are pages of their own and vote each; equal votes go to the larger path. Other
    columns are ignored. An empty table gives an empty one.
    """
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    source = F.coalesce(F.col(html).cast("string"), F.lit(""))
    d = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), source.alias("html"))
    winners = winning_paths(d)
    size = winners.agg(F.count("*").alias("n"), F.sum(F.aggregate(F.map_keys("winners"), F.lit(0), lambda a, p: a + F.length(p))).alias("chars")).first()
    if size["n"] <= MOST_HOSTS and (size["chars"] or 0) <= MOST_CHARS:
        joined = d.join(F.broadcast(winners), "host", "left")
    else:
        joined = join_skewed(d, winners, ["host"], "left")

    def read(batches):
        for b in batches:
            texts = [Page(source).text(dict(w or ())) for source, w in zip(b["html"].to_pylist(), b["winners"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], b["url"], pa.array(texts, pa.string())], ["key", "url", "text"])

    kind = dict(d.dtypes)
    out = joined.select("key", "url", "html", "winners").mapInArrow(read, f"key {kind['key']}, url {kind['url']}, text string")
    return out.withColumnsRenamed({"key": key, "url": url})


def op11_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_texts(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
