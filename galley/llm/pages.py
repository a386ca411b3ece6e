"""Main text of web pages by tree scoring.

A page is parsed into a tree in one pass (unclosed paragraphs, list items and cells close
as browsers close them). Branches that can't hold the article are dropped: navigation,
footers, asides, forms, scripts, styles, and elements whose class, id or role names such a
part. A name drops no branch around the page's article, and inside an article it drops
headings and sections only if the whole name is of such a part. Captions, formulas and the
labels of drawings are text; what stands in for scripts or objects is not. Every paragraph earns points for its length and its commas and passes them on, whole
to its parent, a half to the next ancestor, then a third and so on; an ancestor's
points are discounted by the share of its text that lies in links. The best container is
kept with its siblings, unless they are menus or a page's header, and on the way up with
what scores enough or is prose; what is kept gives the text of its blocks in page order.

A null or empty page gives an empty text, as does one without any text. Pages that nest
deeply, are very long or never close their tags take time in proportion to their length:
nothing recurses and no text is cut. Repeated rows and null
ids are kept, other columns ignored, and an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Where markup begins: a comment, a declaration, or a tag with its name. And what follows a name up to the tag's end.
_OPENED = re.compile(r"<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile("[a-z]+|[0-9]+")

# Elements of HTML by what they do to the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes template select object audio video canvas xmp".split())
_DROPPED = frozenset("nav footer aside form button dialog menu head fieldset annotation annotation-xml desc metadata".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_SCORED = frozenset("p pre td blockquote li dd div section article main body center".split())
#: An opening tag that closes an open one of the same group.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words of a class, id or role that name a part beside the article.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside rail footer masthead comment comments disqus reply replies respond discussion share sharing social related recommended recommendations "
    "trending popular newsletter subscribe subscription signup login cookie cookies consent notice notices gdpr popup modal overlay toolbar widget widgets "
    "pagination pager search skip outbrain taboola paywall contentinfo complementary dialog alert".split()
)
#: Those of them that also name what an article is about, or how it is laid out.
_UNSURE = frozenset(
    "discussion search social popular notice notices alert dialog overlay toolbar widget widgets reply replies respond modal trending recommended "
    "recommendations banner promotion rail skip subscription subscribe login signup complementary sharing aside".split()
)
#: Words of a name that only say what kind of box it is; and that a box has, or lacks, the part that it names.
_BOXES = frozenset("section area box list block wrapper container posts articles links form buttons bar".split())
_HAVING = frozenset("has with without no".split())
_ARTICLES = ("article", "main")
#: Words that name a page's header, where no word of an article stands beside them.
_HEADERS = frozenset("header topbar logo branding".split())
#: Elements that are part of the text where they stand beside the article's container, however short.
_FLOW = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 hgroup ul ol dl table figure section details".split())
#: Parts that are kept whatever their other names say.
_CONTENT = frozenset("article main content body post entry story text prose".split())

#: Text with at least this share in links is a menu where it stands beside the container. Farther out a sibling
#: is kept from this share of the best score on, or as prose of so many characters with few links.
MENU, SIBLING_SHARE, SIBLING_PROSE = 0.5, 0.2, 80


def _beside(name: str, attributes: str, inside: bool) -> tuple[bool, int, bool]:
    """Whether the element is hidden, how surely its names are of a part beside the article (0, 1 or 2), and whether they are of a page's header. inside: it lies in an article."""
    words: set[str] = set()
    parts: list[set[str]] = []
    titled = name in _HEADINGS or name == "section"
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and m.start() and attributes[m.start() - 1].isspace() or key == "aria-hidden" and value == "true":
            return True, 0, False
        if key == "style":
            if "display:none" in value.replace(" ", ""):
                return True, 0, False
        elif key != "hidden":
            for one in value.split():
                own = set(_WORD.findall(one))
                titled = titled or own == {"section"}
                if own & _HAVING:
                    own -= _BESIDE
                words |= own
                if key != "id" or name not in _HEADINGS:  # a heading's id is its own words
                    parts.append(own)
    if inside and titled:
        return False, 2 * any(own <= _BESIDE | _BOXES and own & (_BESIDE - _UNSURE) for own in parts), False
    if not words & _BESIDE or words & _CONTENT and not words & {"comment", "comments", "ad", "ads", "sidebar", "nav", "menu", "footer", "related", "newsletter", "share"}:
        return False, 0, bool(words & _HEADERS) and not words & _CONTENT
    return False, 1 + bool(words & (_BESIDE - _UNSURE)), False


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """What stands in a page, in one pass: the bounds of a text, then the tag after it (whether it closes, its name, its attributes; "" for none).

    The contents of raw elements are passed over. A tag ends at the first > outside quotes;
    once a quote has no end, at the first > from there on. A < without any > after it is text.
    """
    at, seek, quotes, last, endless = 0, 0, True, page.rfind(">"), set()
    while m := _OPENED.search(page, seek):
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            yield at, m.start(), False, "", ""
            at = seek = len(page) if end < 0 else end + 3
            continue
        if m.end() > last:
            break
        if m[1]:
            yield at, m.start(), False, "", ""
            at = seek = page.find(">", m.end()) + 1
            continue
        inside = _INSIDE.match(page, m.end()) if quotes else None
        quotes = bool(inside)
        end = inside.end() if inside else page.find(">", m.end()) + 1
        name, attributes = m[3].lower(), page[m.end() : end - 1]
        yield at, m.start(), bool(m[2]), name, attributes
        at = seek = end
        if name in _RAW and not m[2] and not attributes.rstrip().endswith("/"):
            to = None if name in endless else re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            end = page.find(">", to.end()) + 1 if to else 0
            if end:
                at = seek = end
            elif name in ("script", "style", "textarea", "title", "xmp"):
                at = seek = len(page)
            else:
                endless.add(name)
    yield at, len(page), False, "", ""


class Tree:
    """Nodes in document order: parent, name, whether gone for good, how surely named as a part beside the article, whether named as a page's header, and whether dropped; and texts: node, block number, text."""

    def __init__(self, page: str):
        self.parent, self.name, self.gone, self.named, self.head, self.dropped = [-1], ["#"], [False], [0], [False], [False]
        self.texts: list[tuple[int, int, str]] = []
        self._parse(page)
        self.settle(frozenset())

    def settle(self, back: set[int] | frozenset[int]) -> None:
        """Drops what is gone, and the branches that names drop but for the nodes to bring back."""
        self.dropped = [False] * len(self.name)
        for i in range(1, len(self.name)):
            # an article or main element is no part beside itself
            beside = self.named[i] and i not in back and self.name[i] not in ("article", "main", "body", "html")
            self.dropped[i] = self.gone[i] or bool(beside) or self.dropped[self.parent[i]]

    def above(self, node: int) -> set[int]:
        """The nodes around this one."""
        out = set()
        while (node := self.parent[node]) > 0:
            out.add(node)
        return out

    def brought_back(self, points: list[float], size: list[int]) -> set[int]:
        """The named nodes around the article or, where there is none, around the best container. points, size: without them."""
        n = range(1, len(self.name))
        if any(size[i] and self.name[i] in _ARTICLES for i in n):
            return set()
        self.settle(set(n))
        more, sizes, _ = self.scores()
        if found := [i for i in n if self.name[i] in _ARTICLES and sizes[i] and not self.named[i]]:
            return self.above(max(found, key=lambda i: (more[i], -i)))
        if not size[0]:  # nothing else is there: what lies in an outermost named node
            under = [False] * len(self.name)
            for i in n:
                under[i] = under[self.parent[i]] or self.named[self.parent[i]] > 0
            self.settle({i for i in n if not under[i]})
            more, _, _ = self.scores()
            best = max(n, key=lambda i: (more[i], -i))
            return self.above(best) | ({best} if self.named[best] == 1 else set()) if self.named[best] < 2 else set()
        self.settle({i for i in n if self.named[i] == 1})
        more, _, _ = self.scores()
        best = max(n, key=lambda i: (more[i], -i))
        return self.above(best) | {best} if more[best] > max(points) else set()

    def _parse(self, page: str) -> None:
        parent, names, gone_for_good, named, texts = self.parent, self.name, self.gone, self.named, self.texts
        stack, block = [0], 0
        #: Depths in the stack of each name, and of blocks, and of blocks but paragraphs; each list ascends.
        depths: dict[str, list[int]] = {}
        blocks, boxes = [0], [0]

        def close(to: int) -> None:
            """Pops the stack down to this depth."""
            while len(stack) > to:
                name = names[stack.pop()]
                depths[name].pop()
                if name in _BLOCKS:
                    blocks.pop()
                    if name != "p":
                        boxes.pop()

        def deepest(some) -> int:
            """The depth of the innermost open element with one of these names; 0: none is open."""
            return max((depths[n][-1] for n in some if depths.get(n)), default=0)

        for at, end, closing, name, attributes in _tags(page):
            if end > at and not gone_for_good[stack[-1]]:
                texts.append((stack[-1], block, page[at:end]))
            if not name:
                continue
            if closing:
                depth = deepest((name,))
                if name in _BLOCKS:
                    block += 1
                    if depth:
                        close(depth)
                elif name == "br":
                    texts.append((stack[-1], block, " "))
                elif depth > blocks[-1]:
                    close(depth)
                continue
            if name in _RAW:
                if name not in ("script", "style"):
                    texts.append((stack[-1], block, " "))
                continue
            if name in _VOID:
                if name == "hr":
                    block += 1
                elif name == "br":
                    texts.append((stack[-1], block, " "))
                continue
            if name in _BLOCKS:
                block += 1
                depth = deepest(("p",))  # an open paragraph ends here
                if depth > boxes[-1]:
                    close(depth)
                if name in _HEADINGS and names[stack[-1]] in _HEADINGS:
                    close(len(stack) - 1)
            if name in _CLOSES:
                depth = deepest(_CLOSES[name])
                if depth > deepest(_LIMITS.get(name, ())):
                    close(depth)
            above = stack[-1]
            gone, beside, head = gone_for_good[above], 0, False
            if not gone:
                in_article = bool(depths.get("article") or depths.get("main"))
                if attributes:
                    gone, beside, head = _beside(name, attributes, in_article)
                gone = gone or name in _DROPPED
                if name == "header":  # the page's; an article's own keeps its headings
                    gone = gone or not in_article
                elif depths.get("header") and name not in _HEADINGS and name in _BLOCKS and name not in ("div", "section"):
                    gone = True
            parent.append(above)
            names.append(name)
            gone_for_good.append(gone)
            named.append(beside)
            self.head.append(head)
            if name in ("text", "tspan"):  # labels of a drawing
                texts.append((len(names) - 1, block, " "))
            if not attributes.rstrip().endswith("/") or name in _BLOCKS:
                depths.setdefault(name, []).append(len(stack))
                if name in _BLOCKS:
                    blocks.append(len(stack))
                    if name != "p":
                        boxes.append(len(stack))
                stack.append(len(names) - 1)

    def blocks(self, inside: list[bool]) -> list[str]:
        """The texts of the blocks that lie in nodes marked so."""
        out: list[str] = []
        last, parts = -1, []
        for node, block, text in self.texts:
            if inside[node]:
                if block != last and parts:
                    out.append("".join(parts))
                    parts = []
                last = block
                parts.append(text)
        out.append("".join(parts))
        joined = (" ".join(html.unescape(t).split()) for t in out)
        return [t for t in joined if t]

    def scores(self) -> tuple[list[float], list[int], list[int]]:
        """Points, length of text and length of text in links of each node (of its whole branch)."""
        n = len(self.name)
        size, linked = [0] * n, [0] * n
        direct, marks = [0] * n, [0] * n
        scored = [False] * n
        for i in range(n):
            scored[i] = self.name[i] in _SCORED and not self.dropped[i]
        box = list(range(n))  # the nearest element that can be a paragraph
        for i in range(1, n):
            if self.name[i] not in _BLOCKS:
                box[i] = box[self.parent[i]]
        for node, _, text in self.texts:
            length = 0 if text.isspace() else len(text)
            if not length or self.dropped[node]:
                continue
            count = text.count(",") + text.count("，") + text.count("、")
            size[node] += length
            direct[box[node]] += length
            marks[box[node]] += count
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.name[i] == "a" or in_link[self.parent[i]]
            if in_link[i]:
                linked[i] = size[i]
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        points = [0.0] * n
        for i in range(1, n):
            if not scored[i] or not direct[i]:
                continue
            earned = (1 + marks[i] + min(direct[i] / 100, 3.0)) * (1 - linked[i] / size[i])
            at, level = self.parent[i], 1
            if self.name[i] not in ("p", "pre", "td", "blockquote", "li", "dd"):
                at = i  # text right in a container
            while at >= 0 and level <= 5:
                points[at] += earned / level
                at, level = self.parent[at], level + 1
        for i in range(n):
            if size[i]:
                points[i] *= 1 - linked[i] / size[i]
        return points, size, linked


def _container(tree: Tree, best: int, points: list[float], size: list[int], linked: list[int]) -> set[int]:
    """The nodes that hold the article: the best container, or the article or main element around it, and what belongs to it on the way up to the page."""
    n, top = len(points), points[best]
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if size[i] and not tree.dropped[i]:
            children.setdefault(tree.parent[i], []).append(i)
    whole, at = best, best
    while at > 0:
        if tree.name[at] in _ARTICLES:
            whole = at
            break
        at = tree.parent[at]
    chosen, at, near = {whole}, whole, tree.name[whole] not in _ARTICLES
    while at > 0 and tree.name[at] not in ("body", "html"):
        above = tree.parent[at]
        framed = tree.name[above] in ("body", "html", "#")
        for i in children.get(above, []):
            if i == at or tree.head[i]:
                continue
            menu = linked[i] >= MENU * size[i]
            prose = tree.name[i] in ("p", "pre", "blockquote", "h1") and (size[i] >= SIBLING_PROSE or tree.name[i] == "h1") and linked[i] < 0.25 * size[i]
            if points[i] >= max(10.0, SIBLING_SHARE * top) or prose:
                chosen.add(i)
            elif near and not menu and (not framed or tree.name[i] in _FLOW):
                chosen.add(i)
        at, near = above, False
    return chosen


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by two line feeds."""
    if not page or page.isspace():
        return ""
    tree = Tree(page)
    points, size, linked = tree.scores()
    n = len(points)
    if any(tree.named):
        tree.settle(tree.brought_back(points, size))
        points, size, linked = tree.scores()
    best = max(range(n), key=lambda i: (points[i], -i))
    if points[best] > 0:
        chosen = _container(tree, best, points, size, linked)
    else:  # no paragraph: an article's headings, or whatever isn't dropped
        chosen = {i for i in range(n) if tree.name[i] in _ARTICLES and not tree.dropped[i]} or {0}
    inside = [False] * n
    for i in range(n):
        inside[i] = not tree.dropped[i] and (i in chosen or (i > 0 and inside[tree.parent[i]]))
    return "\n\n".join(tree.blocks(inside))


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    common.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield common.batch(_SCHEMA, [part.column("page_id"), part.column("url"), texts, [len(t) for t in texts]])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))
