"""The main text of web pages, by paths on which the pages of a host agree.

1. Each page is read into elements and blocks of text. Its containers are
   scored: a block weighs its characters outside links less those inside, and
   nothing if boilerplate; a container's score is the harmonic mean of the share
   of the page's weight that it holds and the share of weight in its own
   characters (of equals the innermost).
2. Each page votes with the path of its best container: tags and classes from
   the root, digits and case levelled. Votes are added up per host in Spark.
3. Each page is read again with its host's paths, most votes first. A path may
   win if its elements leave out no text of the page's best container (but
   boilerplate) and have at least ``ENOUGH`` of its score; a later one takes the
   place of an earlier one if it scores higher and holds no less weight. A page
   on which none may win keeps its own best container.

A host offers its ``PATHS`` paths with most votes; pages of rarer shapes keep
their own container. Whatever wins holds all text of the page's own best
container, so neither that bound nor ``ENOUGH`` can take from it.

Boilerplate, left out of the text too: scripts, styles, forms, menus, headers
without heading, footers, sidebars, notices, adverts, comments and the like. An
element is boilerplate by its tag, its role, or if it is hidden. Names are weaker:

* A class counts by its head, the last of its words but for words of place and
  shape: "ad-slot" is about an ad, "social-policy" about a policy. A class that
  says what its element is laid out with ("has-sidebar") names no boilerplate.
* Heads that hardly name anything else ("newsletter") are enough, unless the
  element holds the page's main part or an article. Others ("related", "menu")
  are believed only of a block at least half of whose characters stand in links.
* An id is believed like such a doubtful class, as ids are made from headings too;
  only a few whole ids of reader comments and frames ("comments") are enough.
* Headings are no boilerplate by name, nor are articles (but comments).

A form that holds the main part or an article is no boilerplate either. Formulas
stay. Character references are decoded, white space in a block becomes one space,
blocks are joined by a line feed. A line break inside a block is white space. A
null html is empty, and an empty page has no text; a null or odd url counts as
host ''. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govaudit.session import ship_package

PATHS = 8
ENOUGH = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span "
                    "strike strong sub sup time tt u var wbr br img picture "
                    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded "
                    "mphantom mfenced menclose mtable mtr mtd mmultiscripts annotation annotation-xml".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset(("td", "th"))
_DROPPED = frozenset("nav footer aside form button dialog menu head title annotation annotation-xml".split())
#: Words that are enough as the head of a class, and those that links have to confirm.
_SURE = frozenset("ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored sponsors promo promos promotion promoted "
                  "banner banners cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
                  "subscription signup sidebar sidebars navbar navigation breadcrumb breadcrumbs footer comment comments reply replies disqus "
                  "toolbar pagination pager masthead".split())
_DOUBTFUL = frozenset("rail menu menus nav foot respond discussion share sharing social related recommended recommendations widget widgets skip "
                      "login".split())
_SURE_IDS = frozenset("comments disqus_thread respond sidebar footer navbar navigation breadcrumbs newsletter".split())
#: Words of place and shape, which say nothing of what a class is about, and words of layout.
_SHAPES = frozenset("site page top bottom left right main global primary secondary box slot block area section container wrapper wrap inner outer "
                    "content bar list item items link links unit zone panel module body row col column fixed sticky mobile desktop form icon icons "
                    "button buttons posts articles stories".split())
_LAYOUT = frozenset("with has no without layout grid template is".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())
#: A start tag of the key closes an open element of these.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}


def _head(name: str) -> str:
    """The word that a class or id is about: the last one but words of shape; '' if it tells of a layout."""
    words = [x.lower() for x in _PIECES.findall(name) if not x.isdigit()]
    if not _LAYOUT.isdisjoint(words):
        return ""
    return next((x for x in reversed(words) if x not in _SHAPES), "")


class Page:
    """Elements (parent, path label, dropped) and blocks (element, text, characters in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.dropped, self.headed = [-1], [""], [""], [False], [False]
        self.header: list[int] = []
        self.named: list[int] = []  # boilerplate by name, or a form, unless it holds a main part or an article
        self.doubtful: list[int] = []  # boilerplate if links confirm it
        self.central = [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        for k in self.header:  # a header goes with all it holds, unless it has a heading
            self.dropped[k] = self.dropped[k] or not self.headed[k]
        for k in self.named:
            self.dropped[k] = not self.central[k]
        if self.doubtful:
            self._confirm()
        for k in range(1, len(self.parent)):
            self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]]

    def _confirm(self) -> None:
        """Drops the doubtful elements at least half of whose characters stand in links."""
        size, linked = dict.fromkeys(self.doubtful, 0), dict.fromkeys(self.doubtful, 0)
        for at, text, links in self.blocks:
            while at >= 0:
                if at in size:
                    size[at] += len(text)
                    linked[at] += links
                at = self.parent[at]
        for k in self.doubtful:
            self.dropped[k] = self.dropped[k] or 2 * linked[k] >= size[k]

    def _read(self, source: str) -> None:
        stack, text, links, inside = [0], [], 0, 0

        def flush() -> None:
            nonlocal links
            if text:
                clean = " ".join(references.unescape("".join(text)).split())
                if clean:
                    at = stack[-1]
                    while at and self.tag[at] in _INLINE and not self.dropped[at]:
                        at = self.parent[at]
                    self.blocks.append((at, clean, min(links, len(clean))))
                text.clear()
            links = 0

        def pop(k: int) -> None:
            nonlocal inside
            del stack[k:]
            inside = sum(self.tag[x] == "a" for x in stack)

        for m in _TOKEN.finditer(source):
            part = m["text"]
            if part is not None:
                text.append(part)
                links += len(part) if inside else 0
                continue
            tag = m["tag"]
            if tag is None:
                if m["raw"]:
                    text.append(" ")
                continue
            tag = tag.lower()
            if tag in _VOID:
                if tag == "hr":
                    flush()
                else:
                    text.append(" " if tag == "br" else "")
                continue
            if m["close"]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        if tag in _CELLS:
                            text.append(" ")
                        elif tag not in _INLINE or self.dropped[stack[k]]:
                            flush()
                        pop(k)
                        break
                continue
            names = {k.lower(): v.strip("\"'") for k, v in _NAMES.findall(m["rest"])} if m["rest"] else {}
            named = self._named(tag, names) if names else 0
            drop = self._is_dropped(tag, names) or named == 2
            if tag in _CELLS:
                text.append(" ")
            elif tag not in _INLINE or drop:
                flush()
            if tag not in _INLINE:
                closed = ("p", *_CLOSES.get(tag, ())) if tag not in _CELLS else _CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in closed:
                        pop(k)
                        break
                    if name not in _INLINE and name != "p":
                        break
            if tag in _HEADINGS:
                for x in stack:
                    self.headed[x] = True
            if tag == "main" or tag == "article" and not drop:
                for x in stack:
                    self.central[x] = True
            if tag == "header" or any(_head(x) == "header" for x in names.get("class", "").split()):
                self.header.append(len(self.parent))
            elif tag not in _INLINE and (tag == "form" or named == 2 and not self._is_dropped(tag, names)):
                self.named.append(len(self.parent))
            elif tag not in _INLINE and named == 1:
                self.doubtful.append(len(self.parent))
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.label.append(tag + "".join("." + re.sub(r"\d+", "0", x.lower()) for x in sorted(names.get("class", "").split())))
            self.dropped.append(drop)
            self.headed.append(False)
            self.central.append(False)
            stack.append(len(self.parent) - 1)
            inside += tag == "a"
            if m["rest"].endswith("/") and tag in _INLINE:
                pop(len(stack) - 1)
        flush()

    @staticmethod
    def _named(tag: str, names: dict[str, str]) -> int:
        """2: boilerplate by its class or id, 1: if links confirm it, 0: no."""
        if tag in _HEADINGS or tag in ("html", "body", "main"):
            return 0
        heads = {_head(x) for x in names.get("class", "").split()}
        name = names.get("id", "").strip().lower()
        if tag == "article":
            return 2 if heads & {"comment", "comments", "reply"} else 0
        if heads & _SURE or name in _SURE_IDS:
            return 2
        return 1 if heads & _DOUBTFUL or _head(name) in _SURE | _DOUBTFUL else 0

    @staticmethod
    def _is_dropped(tag: str, names: dict[str, str]) -> bool:
        if tag in _DROPPED:
            return True
        if not names or tag in ("html", "body"):
            return False
        hidden = "hidden" in names or names.get("aria-hidden", "").lower() == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
        return hidden or names.get("role", "").lower() in _ROLES

    def path(self, k: int) -> str:
        parts = []
        while k:
            parts.append(self.label[k])
            k = self.parent[k]
        return ">".join(reversed(parts))

    def scores(self) -> dict[int, float]:
        """The score of every container of a block with weight."""
        self.weight, self.size, self.clean = {}, {}, {}  # clean: characters but boilerplate
        for at, text, links in self.blocks:
            clean = 0 if self.dropped[at] else len(text)
            good = max(0, clean - 2 * links)
            while at >= 0:
                self.weight[at] = self.weight.get(at, 0) + good
                self.size[at] = self.size.get(at, 0) + len(text)
                self.clean[at] = self.clean.get(at, 0) + clean
                at = self.parent[at]
        return {k: self.score([k]) for k, w in self.weight.items() if w and not self.dropped[k]}

    def score(self, elements: list[int]) -> float:
        """Of elements that don't hold each other: the harmonic mean of weight / total and weight / size."""
        return 2 * sum(self.weight[k] for k in elements) / (self.weight[0] + sum(self.size[k] for k in elements))

    def covers(self, elements: list[int], whole: int) -> bool:
        """Whether elements of one path hold all text of another one but boilerplate."""
        def under(k: int, top: int) -> bool:
            while k > top:  # what holds an element has a smaller number
                k = self.parent[k]
            return k == top

        return any(under(whole, k) for k in elements) or sum(self.clean[k] for k in elements if under(k, whole)) == self.clean[whole]

    def best(self, scores: dict[int, float]) -> tuple[int, float]:
        if not scores:
            return 0, 0.0
        k = max(scores, key=lambda x: (scores[x], x))
        while self.tag[k] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "tr") and self.parent[k] > 0:
            k = self.parent[k]  # a single block stands for what holds it
        return k, scores[k]

    def text(self, roots: set[int]) -> str:
        lines = []
        for at, text, _ in self.blocks:
            if self.dropped[at]:
                continue
            while at >= 0 and at not in roots:
                at = self.parent[at]
            if at >= 0:
                lines.append(text)
        return "\n".join(lines)


def extract(source: str, paths: list[str]) -> tuple[str, str]:
    """A page's main text and the path that it came by."""
    page = Page(source)
    scores = page.scores()
    own, score = page.best(scores)
    if not score:
        return "", ""
    found: dict[str, list[int]] = {}
    for k in scores:
        found.setdefault(page.path(k), []).append(k)
    chosen, at_least, most = None, 0, ENOUGH * score
    for path in paths:
        elements = found.get(path)
        if not elements or not page.covers(elements, own):
            continue
        weight, mark = sum(page.weight[k] for k in elements), page.score(elements)
        if weight >= at_least and (mark > most or chosen is None and mark == most):
            chosen, at_least, most = path, weight, mark
    if chosen is not None:
        return page.text(set(found[chosen])), chosen
    return page.text({own}), page.path(own)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], float] = {}  # added up per batch already
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(source or "")
            k, score = page.best(page.scores())
            if score:
                key = (host, page.path(k))
                votes[key] = votes.get(key, 0.0) + score
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()),
                                          pa.array([round(1000 * v) for v in votes.values()], pa.int64())], names=["host", "path", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [extract(source or "", paths or []) for source, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()),
                                          pa.array([x[1] for x in got], pa.string())], names=["page_id", "url", "text", "path"])


def host_of(url: str) -> str:
    """SQL: the host of a url, without user and port; '' where there is none."""
    return f"lower(regexp_extract(coalesce({url}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths (most votes first) of ``pages`` (url, html)."""
    ship_package(pages.sparkSession)
    votes = (pages.select(F.expr(host_of("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, votes long")
             .groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    # per host the first few of its distinct paths, ties by path; Spark limits them before the shuffle too
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(f"rank <= {PATHS}")
    paths = ranked.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("paths"))
    return paths.select("host", F.expr("transform(paths, x -> x.path)").alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, path (of the container) for each row of ``pages`` (page_id, url, html)."""
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.expr(host_of("url")).alias("host"))
    return (hosted.join(host_paths(pages), "host", "left").select("page_id", "url", "html", "paths")
            .mapInArrow(_texts, "page_id long, url string, text string, path string"))
