"""Main text of web pages by tree scoring.

Blocks of text pass points (for being there, for commas, for length) to the elements above them,
less with each level and less for text in links. The article is what encloses the best container (an
article or main element, or its parents up to where furniture or links stand beside them), whole,
with siblings that are no link lists; what its own tags or names mark as page furniture is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trovelens.llm.columns import needed, rows

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_NAME = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ID = re.compile(r"""(?:^|(?<=[\s"'/]))id\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form button select dialog menu head svg math object canvas audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var td th".split())
PARAGRAPHS = frozenset("p pre li dd dt blockquote h1 h2 h3 h4 h5 h6 tr td th caption figcaption summary address".split())
NAMED_ALIKE = frozenset("h1 h2 h3 h4 h5 h6 article main body html".split())
BONUS = {"article": 10.0, "main": 8.0, "section": 2.0, "div": 2.0, "blockquote": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": -1.0}
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th tbody thead tfoot".split())
#: Opening the key ends an open element of the values, not above the last ones.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words that name furniture, and of these such that name what is never the article, however long it is.
_WORDS = (
    "banner|promo[a-z]*|nav|navbar|navigation|navigator|menu|menus|breadcrumb[a-z]*|sidebar|footer|masthead|notice|notices|popup|modal|overlay|"
    "newsletter|subscribe|subscription|signup|login|sharing|social|pagination|pager|widget|widgets|toolbar|skip|copyright|disclaimer|complementary|contentinfo"
)
_NEVER = "ad|ads|adv|advert[a-z]*|adsense|adbox|sponsor[a-z]*|comment|comments|commentlist|disqus[a-z]*|reply|replies|respond|cookie|cookies|cookiebar|consent|gdpr"
#: What may follow a furniture word that is not the last one: parts and places of the thing itself.
_PART = "list|lists|wrap|wrapper|container|box|bar|area|section|block|item|items|group|inner|outer|content|body|main|holder|slot|unit|panel|link|links|form|row|col|column|left|right|top|bottom|primary|secondary|global|site|page|mobile|desktop|thread|text|title|header|footer|[0-9]+[a-z]?"
_FURNITURE_NAME = re.compile(
    rf"(?:[a-z0-9]+[_-]+)*(?:{_WORDS}|{_NEVER})(?:[_-]+(?:{_PART}))*|(?:site|page|global|top)?[_-]?header|related(?:[_-].*)?|share|alert|hidden|legal|recommend[a-z]*", re.I
)
_NEVER_NAME = re.compile(rf"(?:[a-z0-9]+[_-]+)*(?:{_NEVER})(?:[_-]+(?:{_PART}))*", re.I)
#: Names that say what stands beside or in an element, not what it is.
_ABOUT = re.compile(r"(?:has|have|having|with|without|no|not|is|hide|show)[_-].*", re.I)
#: An element that is furniture by its name only counts so much of its score against the best container outside it.
DEMOTED = 0.5
#: Headings of readers' comments: what they head is not the article.
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user)s?['’]?\s+)?(?:comments?|replies|responses|leave\s+a\s+(?:comment|reply)|join\s+the\s+(?:conversation|discussion)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _tokens(attributes: str) -> Iterator[str]:
    for found in _NAME.finditer(attributes):
        yield from (found[2] or found[3] or found[4] or "").split()


def named_furniture(attributes: str) -> bool:
    """Whether a class, id or role is a furniture word or ends in one, its own parts and places aside."""
    return any(_FURNITURE_NAME.fullmatch(token) and not _ABOUT.fullmatch(token) for token in _tokens(attributes))


def is_furniture(tag: str, attributes: str, within: bool = False) -> bool:
    """Whether an element is a menu, header, notice, advert or the like by its tag, names or state.

    The id of a section ``within`` an article is the anchor of its heading and says nothing, unless it names what is never the article.
    """
    if tag in FURNITURE:
        return True
    if not attributes or tag in NAMED_ALIKE:
        return False
    if within and tag == "section" and not any(_NEVER_NAME.fullmatch(token) for token in _tokens(attributes)):
        return named_furniture(_ID.sub(" ", attributes)) or bool(_HIDDEN.search(attributes))
    return named_furniture(attributes) or bool(_HIDDEN.search(attributes))


class Page:
    """Elements of a page as parallel lists (parents before children) and its blocks of text in order."""

    def __init__(self, html: str, spared: frozenset = frozenset()):
        #: Where elements begin that are no furniture whatever their names, and where those of this page do.
        self.spared, self.begins, self.begin = spared, [-1], -1
        self.wraps: dict[str, set[int]] = {"article": set(), "main": set()}
        self.article = False
        #: Open elements that are furniture by name only, and how many others are furniture.
        self.walls: list[int] = []
        self.hard = 0
        #: Where elements begin that are furniture by name only and have text; those of _NEVER aside.
        self.soft, self.never = set(), set()
        self.tag, self.parent, self.furniture = ["#"], [-1], [False]
        #: By name, the places of open elements in ``open``; the places of those that are no inline elements.
        self.at: dict[str, list[int]] = {}
        self.blocky: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []
        self.open = [0]
        self.parts: list[str] = []
        self.linked, self.dropped = 0, 0
        #: The open link, if any: how many elements are open where it begins, and the block that it begins in.
        self.link: tuple[int, int] | None = None
        at, end = 0, len(html)
        lower = None
        while at < end:
            found = _TAG.search(html, at)
            if found is None:
                self._text(html[at:])
                break
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, self.begin = name.lower(), found.start()
            if found[1] or found[4]:
                self._close(name)
            elif name in RAW:
                lower = html.lower() if lower is None else lower
                if len(lower) != end:  # letters whose lower case is longer: look in the text itself
                    close = re.compile("</" + name, re.I).search(html, at)
                    stop = close.start() if close else -1
                else:
                    stop = lower.find("</" + name, at)
                at = end if stop < 0 else (html.find(">", stop) + 1 or end)
            else:
                self._open(name, found[3] or found[6] or "")
        self._end_link()
        self._flush()

    def _end_link(self) -> None:
        """End a link that has no end tag: of its text only that of its first block is the link's."""
        if self.link:
            first = self.link[1]
            self.blocks[first + 1 :] = [(node, text, 0) for node, text, _ in self.blocks[first + 1 :]]
            if len(self.blocks) > first:
                self.linked = 0
            self.link = None

    def _text(self, text: str) -> None:
        if self.dropped and self.walls and not self.hard:
            for node in reversed(self.walls):
                if self.begins[node] in self.soft:
                    break
                self.soft.add(self.begins[node])
        elif not self.dropped:
            if "&" in text:
                text = unescape(text)
            self.parts.append(text)
            if self.link:
                self.linked += len(text)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.open[-1], text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def _open(self, name: str, attributes: str) -> None:
        if name in VOID or self.dropped and name in INLINE:
            if not self.dropped and name in ("br", "hr"):
                self.parts.append(" ")
                if name == "hr":
                    self._flush()
            return
        if name in INLINE and name not in ("td", "th"):
            if name == "a":
                self._end_link()
            if is_furniture(name, attributes):
                self._push(name, True, attributes)
            elif name == "a" and _HREF.search(attributes):
                self.link = len(self.open), len(self.blocks)
            return
        if not self.dropped:
            if name in ("td", "th"):
                self.parts.append(" ")
            else:
                self._flush()
        if name in ENDS_P:
            self._end({"p"}, ENDS_P - {"p"})
        if name in ENDS:
            self._end(*ENDS[name])
        if name in self.wraps:
            self._wrapped(name, attributes)
        within = bool(self.at.get("article") or self.at.get("main"))
        self._push(name, self.begin not in self.spared and is_furniture(name, attributes, within), attributes)

    def _wrapped(self, name: str, attributes: str) -> None:
        """Note an article or main, and the elements that are furniture by name only and hold it."""
        if not self.dropped:
            self.article = True
        elif not self.hard and not named_furniture(attributes):
            noted = self.wraps[name]
            for k in reversed(self.walls):
                if self.begins[k] in noted:
                    break
                noted.add(self.begins[k])

    def spare(self) -> frozenset:
        """Where the furniture by name begins that holds the page's main element, or its only articles."""
        return frozenset(self.wraps["main"] or (set() if self.article else self.wraps["article"]))

    def _push(self, name: str, furniture: bool, attributes: str) -> None:
        self.tag.append(name)
        self.parent.append(self.open[-1])
        self.furniture.append(furniture)
        self.begins.append(self.begin)
        self.at.setdefault(name, []).append(len(self.open))
        if name not in INLINE:
            self.blocky.append(len(self.open))
        self.open.append(len(self.tag) - 1)
        if furniture:
            if name in FURNITURE or _HIDDEN.search(attributes):
                self.hard += 1
            else:
                self.walls.append(self.open[-1])
                if any(_NEVER_NAME.fullmatch(token) for token in _tokens(attributes)):
                    self.never.add(self.begin)
        if self.dropped or furniture:
            self.dropped += 1

    def _last(self, names) -> int:
        """The place of the last open element of these names; 0 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def _end(self, names: set, bounds: set) -> None:
        k = self._last(names)
        if k > self._last(bounds):
            self._pop(k)

    def _pop(self, k: int) -> None:
        if not self.dropped and self.tag[self.open[k]] not in ("td", "th"):
            self._flush()
        self.dropped = max(0, self.dropped - (len(self.open) - k))
        for node in reversed(self.open[k:]):
            if self.walls and self.walls[-1] == node:
                self.walls.pop()
            elif self.furniture[node]:
                self.hard -= 1
            self.at[self.tag[node]].pop()
        while self.blocky and self.blocky[-1] >= k:
            self.blocky.pop()
        del self.open[k:]
        if self.link and k < self.link[0]:
            self._end_link()

    def _close(self, name: str) -> None:
        if name == "a" and not self.dropped:
            self.link = None
        if name == "br":
            if not self.dropped:
                self.parts.append(" ")
            return
        k = self._last((name,))
        if k and (name not in INLINE or name in ("td", "th") or not self.blocky or self.blocky[-1] < k):
            self._pop(k)

    def _points(self, of: list[int] | None = None) -> tuple[list, list, list]:
        """Score, characters and characters in links by element; with ``of``, the wall that each is in, no points leave a wall."""
        n = len(self.tag)
        score, chars, linked = [0.0] * n, [0] * n, [0] * n
        for node, text, link in self.blocks:
            chars[node] += len(text)
            linked[node] += link
            points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - link / len(text))
            above = self.parent[node] if self.tag[node] in PARAGRAPHS and (of is None or of[self.parent[node]] == of[node]) else node
            share = 1.0
            for level in range(5):
                if above < 0 or of is not None and of[above] != of[node]:
                    break
                score[above] += points * share
                above, share = self.parent[above], 1 / (2 + 3 * level)
        for k in range(n - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
            linked[self.parent[k]] += linked[k]
        for k in range(n):
            if score[k] > 0:
                score[k] = (score[k] + BONUS.get(self.tag[k], 0.0)) * (1 - linked[k] / max(chars[k], 1))
        return score, chars, linked

    def best_walls(self, walls: set[int]) -> set[int]:
        """Where those of ``walls`` (this page was read with all of them spared) begin that hold the best container in any of them, if it is still the best one demoted."""
        of = [-1] * len(self.tag)
        for k in range(1, len(self.tag)):
            of[k] = of[self.parent[k]] if of[self.parent[k]] >= 0 else self.begins[k] if self.begins[k] in walls else -1
        score, _, _ = self._points(of)
        outside, best, k = 0.0, 0.0, -1
        for at, v in enumerate(score):
            if of[at] < 0:
                outside = max(outside, v)
            elif v > best:
                best, k = v, at
        if DEMOTED * best <= outside:
            return set()
        chain = set()
        while k > 0:
            chain.add(self.begins[k])
            k = self.parent[k]
        return chain & walls

    def _comments(self) -> list[bool]:
        """By element, whether it is under a heading of readers' comments: all of the heading's section, or what follows it up to the next heading that is no lower."""
        n = len(self.tag)
        gone = [False] * n
        headed = {node for node, text, _ in self.blocks if self.tag[node] in HEADINGS and _COMMENTS.fullmatch(text)}
        if not headed:
            return gone
        first: dict[int, int] = {}
        below: dict[int, list[int]] = {}
        for node, _, _ in self.blocks:
            k = node
            while k > 0 and k not in first:
                first[k] = node
                k = self.parent[k]
        for k in range(1, n):
            below.setdefault(self.parent[k], []).append(k)
        for node in headed:
            above = self.parent[node]
            if first.get(above) == node and self.tag[above] not in ("body", "html", "main", "article", "#"):
                gone[above] = True
                continue
            level, after = self.tag[node], False
            for k in below[above]:
                if k == node:
                    after = gone[k] = True
                elif after and self.tag[k] in HEADINGS and self.tag[k] <= level:
                    break
                elif after:
                    gone[k] = True
        for k in range(1, n):
            gone[k] = gone[k] or gone[self.parent[k]]
        return gone

    def text(self) -> str:
        gone = self._comments()
        self.blocks = [b for b in self.blocks if not gone[b[0]]]
        n = len(self.tag)
        score, chars, linked = self._points()
        most = max(score)
        if most <= 0:  # all is links: what stands in paragraphs and headings, but no list of links
            return "\n".join(text for node, text, _ in self.blocks if self.tag[node] == "p" or self.tag[node] in HEADINGS)
        best = score.index(most)
        core, top, marked = self._article(best, chars, linked)
        path = set()
        k = self.parent[core]
        while k >= 0:
            path.add(k)
            k = self.parent[k]
        kept = [False] * n
        kept[0] = top == 0
        for k in range(1, n):
            above = self.parent[k]
            if k == core or k == top:
                kept[k] = True
            elif above >= 0 and kept[above]:
                kept[k] = k in path or above not in path or linked[k] <= 0.5 * chars[k]
            elif above == self.parent[top]:
                strict = marked and self.tag[self.parent[top]] in ("body", "html", "#")
                kept[k] = self._running(k, score, chars, linked, most) if strict else chars[k] > 0 and linked[k] <= 0.5 * chars[k]
        return "\n".join(text for node, text, _ in self.blocks if kept[node])

    def _article(self, best: int, chars: list, linked: list) -> tuple[int, int, bool]:
        """The innermost and the outermost element that is the article, and whether the page's tags mark it.

        That is what encloses the best container: article and main if there are any; else the
        parents up to where menus, headers and other furniture or link lists stand beside them.
        """
        marks, k = [], best
        while k > 0:
            if self.tag[k] in ("article", "main"):
                marks.append(k)
            k = self.parent[k]
        if marks:
            return marks[0], marks[-1], True
        bars = {self.parent[k] for k in range(1, len(self.tag)) if self.furniture[k] or chars[k] and linked[k] > 0.5 * chars[k]}
        top = best
        while top > 0 and self.parent[top] > 0 and self.tag[self.parent[top]] not in ("body", "html") and self.parent[top] not in bars:
            top = self.parent[top]
        return best, top, False

    def _running(self, k: int, score: list, chars: list, linked: list, most: float) -> bool:
        """Whether a sibling of the best container holds running text of its own."""
        if chars[k] == 0 or linked[k] > 0.25 * chars[k]:
            return False
        if self.tag[k] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return linked[k] == 0
        if self.tag[k] == "p":
            return chars[k] >= 80
        return self.tag[k] in ("div", "section", "article", "blockquote", "pre") and score[k] >= max(10.0, 0.2 * most)


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order, one line each; empty if there is none."""
    page = Page(html)
    spare = page.spare()
    walls = page.soft - page.never - spare
    while walls:  # what is spared at least doubles what others are measured against
        found = Page(html, spare | walls).best_walls(walls)
        if not found:
            break
        spare, walls = spare | found, walls - found
    return (Page(html, spare) if spare else page).text()


SCHEMA = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null or empty html has the empty text; null ids and urls are carried through; repeated rows give
    repeated results; other columns are ignored. Broken markup (unclosed, cut off, unknown) is read
    as browsers do as far as blocks are concerned; time and memory follow the page's own length.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, pages_ in rows(batches, "page_id", "url", "html"):
            texts = [main_text(h) if h else "" for h in pages_]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return needed(pages, "page_id", "url", "html").mapInArrow(extract, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
