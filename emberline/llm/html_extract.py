"""Main-text extraction by consensus host paths.

Pass 1 scores every page's containers and votes, per host, for the generalised path (tags and
classes, digits dropped) of its best one. Pass 2 reads the pages again and takes the text of the
container at the path that won its host; a page without such a container uses its own best one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import lean
from .shared import staged

#: Paths that win on a host at most, best first; shares of the votes below this don't win.
WINNERS, LEAST_SHARE = 3, 0.1

#: Of a block's worth, what goes to its container, that one's parent and grandparent; an article's start.
SHARES, ARTICLE_BONUS = (1.0, 0.6, 0.3), 25.0
#: A path longer than this goes on from a checksum of its head, so deep nesting stays cheap.
LONGEST_PATH = 300

# HTML's element kinds and common names of page furniture.
RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option input svg math object canvas audio video map dialog menu label fieldset".split())
BLOCK = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd article section main header hgroup blockquote pre table thead tbody tfoot tr caption"
    " figure figcaption address details summary center hr td th nav footer aside form fieldset dialog menu".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"td", "th", "html", "body"}
CONTAINER = frozenset("body div article section main td blockquote center".split())
ENDS_WITH_PARENT = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion promoted sponsor sponsored sponsors nav navbar"
    " navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers footnav masthead topbar header comment comments commentlist"
    " disqus respond reply replies cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay newsletter subscribe"
    " subscription signup signin login register share sharing social related recommended recommendations trending widget widgets toolbar"
    " pagination pager paginator search searchbox skip hidden copyright disclaimer legal feedback rating ratings tags outbrain taboola responses discussion".split()
)
# Words of layout that stand beside those, and of those the ones that name a part of the page wherever they stand.
LAYOUT = frozenset(
    "area bar bars block blocks body bottom box boxes btn button buttons card cards center col column columns component container content count counter cta desktop entry field fields first fixed float footer full global"
    " grid group head heading home icon icons icn inline inner item items label last layer layout left link links list lists main meta mini mobile module modules more nav new outer page panel panels post posts primary"
    " region right root row rows secondary section sections side site slot small sticky story strip tab tabs text title toggle tool tools top ui unit user view wide wrap wrapper zone".split()
)
PLACED = frozenset(
    "adsense advert adverts advertisement banner banners breadcrumb breadcrumbs commentlist comments cookie cookies disqus footer footers footnav gdpr masthead modal nav navbar navigation newsletter outbrain overlay paginator"
    " pagination popup promo sidebar sidebars signup skip sponsored subscribe taboola topbar widget widgets".split()
)
#: Letters of a name's part that may be a prefix of any meaning; plain characters that make a suspect in an article text, if its names may be those of a topic too.
PREFIX, PROSE = 3, 300
NEIGHBOUR = frozenset("has no with without".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies responses discussion".split())
NEVER_TEXT = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion promoted sponsor sponsored sponsors outbrain taboola cookie cookies consent gdpr"
    " notice notices alert alerts warning popup modal overlay newsletter subscribe subscription signup signin login register sidebar sidebars footer footers related recommended".split()
)
BOILERPLATE = frozenset("copyright disclaimer legal tags breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager paginator".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|[=\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")) for name, value in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}


def is_furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is menu, form, hidden or the like by its tag, attributes or role; its content is never read.

    An article's own header holds its title and so stays.
    """
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in FURNITURE_ROLES or bool(HIDDEN.search(attrs.get("style", "")))


def furniture_names(attrs: dict[str, str], in_article: bool) -> set[str]:
    """The words of an element's class and id that furniture has.

    A name says furniture if all its words are those of furniture, of layout or short prefixes: `rating-box` does, `rating-agencies` is a topic. Outside an
    article a few words say so wherever they stand. `has-sidebar` names a neighbour, `header` in an article is the title's.
    """
    found: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = {part.lower() for part in NAME_PART.findall(name)}
        if parts & NEIGHBOUR:
            continue
        if all(p in FURNITURE or p in LAYOUT or len(p) <= PREFIX for p in parts) or not in_article and parts & PLACED:
            found |= parts & FURNITURE
    return found - {"header"} if in_article else found


class Suspect:
    """An element that is furniture by its names: it is left out unless it turns out to wrap the page's text, or to be text of an article."""

    __slots__ = ("names", "around", "in_article", "chars", "link_chars", "article", "out")

    def __init__(self, names: set[str], around: "Suspect | None", in_article: bool):
        self.names, self.around, self.in_article, self.chars, self.link_chars, self.article, self.out = names, around, in_article, 0, 0, False, False

    def left_out(self, total: int) -> bool:
        """Whether it is furniture: it holds neither an article or main part (but for comments), nor most of the page's text outside links, nor, in an article, a good
        deal of prose; adverts, comments, notices and the like may hold the latter two."""
        if self.article and not self.names & COMMENTS:
            return False
        if self.names & NEVER_TEXT:
            return True
        prose = self.in_article and self.chars >= PROSE and 5 * self.link_chars <= self.chars and not self.names & BOILERPLATE
        return not (prose or 2 * self.chars > total)


class Element:
    __slots__ = ("tag", "skipped", "container", "in_article", "suspect")

    def __init__(self, tag: str, skipped: bool, container: "Container | None", in_article: bool, suspect: Suspect | None):
        self.tag, self.skipped, self.container, self.in_article, self.suspect = tag, skipped, container, in_article, suspect


class Block:
    """A block's text, what it is worth to its container, whether it is a heading, and the innermost suspect around it."""

    __slots__ = ("text", "worth", "plain", "container", "heading", "byline", "suspect")

    def __init__(self, text: str, worth: float, plain: int, container: "Container | None", heading: bool, byline: bool, suspect: Suspect | None):
        self.text, self.worth, self.plain, self.container, self.heading, self.byline, self.suspect = text, worth, plain, container, heading, byline, suspect


class Container:
    """A container's path, its classes without digits, its place among the page's blocks, and its score."""

    __slots__ = ("tag", "classes", "path", "parent", "inside", "first", "last", "score")

    def __init__(self, tag: str, classes: frozenset[str], path: str, parent: "Container | None", first: int):
        self.tag, self.classes, self.path, self.parent, self.first, self.last, self.score = tag, classes, path, parent, first, -1, 0.0
        self.inside: list[Container] = []


class Page:
    """Blocks of text outside page furniture, and the containers around them, in one pass.

    Elements with the names of furniture are suspects until the whole page is read. If all the text is in such, the
    names don't count.
    """

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.suspects: list[Suspect] = []
        self.containers: list[Container] = []
        self.stack: list[Element] = []
        #: What is open: the places of each tag in the stack, the containers, the innermost suspect.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.inside: list[Container] = []
        self.suspect: Suspect | None = None
        self.text: list[str] = []
        self.chars = self.link_chars = self.links = 0
        self.skipping = 0
        self._parse(html)
        total = sum(b.plain for b in self.blocks)
        for suspect in reversed(self.suspects):  # what is inside comes after what is around it
            if suspect.around is not None:
                suspect.around.chars += suspect.chars
                suspect.around.link_chars += suspect.link_chars
                suspect.around.article |= suspect.article
        for suspect in self.suspects:
            suspect.out = suspect.left_out(total) or suspect.around is not None and suspect.around.out
        self.kept = [not b.byline and not (b.suspect is not None and b.suspect.out) for b in self.blocks]
        if not any(self.kept):
            self.kept = [not b.byline for b in self.blocks]
        #: Characters, those outside links and headings of the kept blocks before each.
        self.sums = [(0, 0, 0)]
        for block, kept in zip(self.blocks, self.kept):
            chars, plain, headings = self.sums[-1]
            self.sums.append((chars + len(block.text), plain + block.plain, headings + block.heading) if kept else self.sums[-1])
            container = block.container if kept else None
            for share in SHARES:
                if container is not None:
                    container.score += share * block.worth
                    container = container.parent

    def _flush(self) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            if block:
                linked = self.link_chars / max(1, self.chars)
                heading = any(self.places[tag] for tag in HEADING)
                plain = int(len(block) * (1 - linked))
                if self.suspect is not None:
                    self.suspect.chars += plain
                    self.suspect.link_chars += len(block) - plain
                container = self.inside[-1] if self.inside else None
                self.blocks.append(Block(block, len(block) * max(0.0, 1 - 2 * linked), plain, container, heading, not heading and bool(self.places["header"]), self.suspect))
            self.text = []
        self.chars = self.link_chars = 0

    def _pop(self) -> None:
        element = self.stack[-1]
        if element.tag in BLOCK and element.tag not in ("td", "th"):
            self._flush()
        self.stack.pop()
        self.places[element.tag].pop()
        if element.container is not None:
            element.container.last = len(self.blocks)
            self.inside.pop()
        if element.skipped:
            self.skipping -= 1
        if element.suspect is not None:
            self.suspect = element.suspect.around
        if element.tag == "a":
            self.links -= 1

    def _close(self, tag: str, barriers: tuple[str, ...] = ()) -> None:
        """Close the nearest open `tag`, and what is open inside it; text blocks stop at barriers."""
        if not self.places[tag]:
            return
        at = self.places[tag][-1]
        if not any(self.places[b] and self.places[b][-1] > at for b in barriers):
            while len(self.stack) > at:
                self._pop()

    def _open(self, tag: str, raw: str) -> None:
        if tag in CLOSES_P:
            self._close("p", ("table", "td", "th", "article", "section", "div", "body", "li"))
        if tag in ENDS_WITH_PARENT:
            self._close(tag, ENDS_WITH_PARENT[tag])
        if tag == "a" and self.links:
            self._close("a")
        if tag in BLOCK and tag not in ("td", "th"):
            self._flush()
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag in VOID:
            return
        attrs = _attributes(raw) if raw else {}
        in_article = tag in ("article", "main") or bool(self.stack and self.stack[-1].in_article)
        skipped = is_furniture(tag, attrs, in_article)
        names = furniture_names(attrs, in_article) if attrs and tag not in ("html", "body", "article", "main") and not skipped else None
        if tag in ("article", "main") and not self.skipping and self.suspect is not None:
            self.suspect.article = True
        suspect = Suspect(names, self.suspect, in_article) if names else None
        if suspect is not None:
            self.suspects.append(suspect)
            self.suspect = suspect
        container = None
        if tag in CONTAINER and not skipped and not self.skipping:
            classes = frozenset(re.sub(r"\d+", "", attrs.get("class", "")).split())
            step = ".".join([tag, *sorted(classes)])
            parent = self.inside[-1] if self.inside else None
            above = parent.path if parent else ""
            if len(above) > LONGEST_PATH:
                above = f"#{crc32(above.encode()):08x}"
            container = Container(tag, classes, f"{above}>{step}" if above else step, parent, len(self.blocks))
            if parent is not None:
                parent.inside.append(container)
            self.inside.append(container)
            if tag in ("article", "main"):
                container.score = ARTICLE_BONUS
            self.containers.append(container)
        self.places[tag].append(len(self.stack))
        self.stack.append(Element(tag, skipped, container, in_article, suspect))
        self.skipping += skipped
        self.links += tag == "a"

    def _parse(self, html: str) -> None:
        at, match = 0, TOKEN.search
        while (token := match(html, at)) is not None:
            if token.start() > at:
                self._add(html[at : token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["end"]:
                if tag == "br":
                    self.text.append(" ")
                else:
                    self._close(tag)
            elif tag in RAW and not token["attrs"].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            else:
                self._open(tag, token["attrs"])
        self._add(html[at:])
        while self.stack:
            self._pop()
        self._flush()

    def _add(self, raw: str) -> None:
        if not self.skipping and raw:
            text = unescape(raw) if "&" in raw else raw
            self.text.append(text)
            size = len(text)
            self.chars += size
            if self.links:
                self.link_chars += size

    def best(self) -> Container | None:
        """The container of the largest score, the inner one of equals; the article around it, or the
        main part where the page marks no article, if it stands in one, for the sake of the title. On pages of divs alone, the
        nearest container around it that adds a heading, if what it adds is not mostly links and is less than it has."""
        found = max(reversed(self.containers), key=lambda c: c.score, default=None)
        around = "article" if any(c.tag == "article" for c in self.containers) else "main"
        above = found
        while above is not None and above.tag != around:
            above = above.parent
        if above is not None or found is None:
            return above or found
        inner = self._facts(found)
        above = found.parent
        while above is not None and above.tag != "body" and not inner[2]:
            chars, plain, heading = self._facts(above)
            if plain - inner[1] < max(0.5 * (chars - inner[0]), 1) or chars > 2 * inner[0]:
                break
            if heading:
                return above
            above = above.parent
        return found

    def _facts(self, c: Container) -> tuple[int, int, bool]:
        """The characters of a container's text, those outside links, and whether it has a heading."""
        (a, b, c_), (x, y, z) = self.sums[c.first], self.sums[c.last]
        return x - a, y - b, z > c_

    def kin(self, c: Container) -> list[Container]:
        """The container and, beside it, those of its tag that share a class with it other than layout's, or have none as it has none, and hold text outside links for the most part."""
        if c.parent is None or c.tag in ("article", "main", "body"):
            return [c]
        kind = {name for name in c.classes if not {part.lower() for part in NAME_PART.findall(name)} <= LAYOUT}  # a column or a row is no kind of text
        alike = [s for s in c.parent.inside if s is c or s.tag == c.tag and (s.classes & kind or not s.classes and not c.classes)]
        return [s for s in alike if s is c or 2 * self._facts(s)[1] > max(1, self._facts(s)[0])]

    def text_of(self, containers: list[Container]) -> str:
        """The blocks of the outermost of the containers given, in page order."""
        parts, upto = [], 0
        for c in sorted(containers, key=lambda c: (c.first, -c.last)):
            parts += [b.text for b, kept in zip(self.blocks[max(c.first, upto) : c.last], self.kept[max(c.first, upto) : c.last]) if kept]
            upto = max(upto, c.last)
        return "\n\n".join(parts)

    def all_text(self) -> str:
        return "\n\n".join(b.text for b, kept in zip(self.blocks, self.kept) if kept)


def extract(html: str | None, winners: list[str] | None) -> tuple[str, str | None]:
    """The main text and the path it was found at; winners are the host's paths, best first."""
    page = Page(html or "")
    for path in winners or []:
        chosen = {id(k): k for c in page.containers if c.path == path and c.score > 0 for k in page.kin(c)}
        if text := page.text_of([*chosen.values()]):
            return text, path
    best = page.best()
    if best is None:
        return page.all_text(), None
    return page.text_of(page.kin(best)) or page.all_text(), best.path


def host_of(url: str = "url") -> Column:
    """The URL's host in lower case without user and port, '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """Per host its winning paths, best first: each page votes for its best container's path, with
    the weight of its score's square root, so that long pages don't decide alone."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], float] = {}
        for batch in batches:
            for host, html in zip(batch["host"], batch["html"]):
                best = Page(html.as_py() or "").best()
                if best is not None and best.score > 0:
                    key = host.as_py(), best.path
                    sums[key] = sums.get(key, 0) + int(1000 * best.score**0.5)
            if len(sums) > 50_000:
                yield ballots(sums)
                sums = {}
        yield ballots(sums)

    def ballots(sums: dict[tuple[str, str], float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["host", "path", "votes"]
        )

    votes = pages.select(host_of().alias("host"), "html").mapInArrow(lean(vote), "host string, path string, votes long")
    totals = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    by_host = Window.partitionBy("host")
    ranked = totals.select(
        "host", "path", "votes", F.row_number().over(by_host.orderBy(F.desc("votes"), "path")).alias("place"), F.sum("votes").over(by_host).alias("all")
    ).where((F.col("place") <= WINNERS) & ((F.col("place") == 1) | (F.col("votes") >= LEAST_SHARE * F.col("all"))))
    return ranked.groupBy("host").agg(F.expr("transform(array_sort(collect_list(struct(place, path))), x -> x.path)").alias("paths"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, path (where the text was found).

    A null or empty html, or one without text, gives ''. A null url counts as the host ''. Repeated rows are read
    each; an empty table gives no rows; further columns are ignored. The hosts' paths are
    written to the shared folder, so Spark knows their size: it broadcasts them if they are
    small and else shuffles the pages, splitting a host that holds too many.
    """
    winners = staged(host_paths(pages), "host-paths")
    joined = pages.select("page_id", "url", "html", host_of().alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "paths")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(html.as_py(), paths.as_py()) for html, paths in zip(batch["html"], batch["paths"])]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64)), pa.array([p for _, p in found], pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"],
            )

    return joined.mapInArrow(lean(read), "page_id long, url string, text string, n_chars long, path string")
