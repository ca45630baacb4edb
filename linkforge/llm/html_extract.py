"""Main text of HTML pages by tree scoring.

The page is tokenised into a tree that follows HTML's rules for implied end tags. Paragraphs earn points for their
length and commas and pass them to their ancestors, less the further up; each container's points are discounted by its
share of link text. The best container and those of its siblings that score alike are kept, without the blocks that
their tag, role or class marks as something else than the article. All steps are linear in the page, whatever its depth,
its attributes' lengths and its errors.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import arrow_map

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that never hold article text.
DROP = frozenset("head script style noscript template iframe object embed svg math canvas audio video map nav footer aside button select input textarea label fieldset menu dialog title noembed noframes xmp".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption optgroup option".split())
#: Start tags that end an open p.
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr optgroup option".split())
#: Groups of elements that the start tags of ENDERS end, the topmost one up to the given boundary.
GROUPS = (
    (("p",), ("table", "td", "th", "button", "object", "caption", "template")), (("li",), ("ul", "ol", "menu", "dir")), (("dt", "dd"), ("dl",)), (("tr", "td", "th"), ("table",)), (("td", "th"), ("tr", "table")),
    (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), (("option",), ("select", "datalist")),
)
ENDERS = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "tbody": 5, "thead": 5, "tfoot": 5, "option": 6}
#: Elements that change which element of a group is open.
TELLING = frozenset(t for tags, stop in GROUPS for t in tags + stop)
SCOPE = frozenset("table td th caption button object template html".split())
#: Elements whose end tags reach beyond the innermost of SCOPE.
FAR = SCOPE | {"tr", "tbody", "thead", "tfoot", "body"}
#: Words of class, id or role that mark blocks beside the article.
BAD = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice alert nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar side aside rail widget footer foot copyright header masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion social share sharing related recommended recommendations newsletter subscribe subscription signup login search complementary contentinfo skip hidden tags toc".split())
#: Elements that their attributes never mark.
SPARED = frozenset("html body article main".split())
#: Words before a bad word that make a name tell of the page's layout: has-sidebar, no-sidebar, with-comments.
LAYOUT = frozenset("has have no not with without layout".split())
#: Words before "header" that make it the article's own: entry-header, post-header.
OWN = frozenset("article entry post content story blog text".split())
#: Text of an element, without its children's, from which on it counts as a paragraph, not as a caption.
PROSE_CHARS = 80
#: A name that only contains a bad word marks nodes with a smaller share of the page's text than this.
MOST_SHARE = 0.5
#: A result with a smaller share of the page's text is taken again without class, id and role.
LEAST_SHARE = 0.1
GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
#: Quotes count where a value begins, as in HTML. The last group is missing in a tag that never ends.
COMMENT, OTHER = r"!--(?:>|->|.*?(?:--!?>|\Z))", r"[!?/][^>]*+(?:>|\Z)"
TOKEN = re.compile(rf"<(?:{COMMENT}|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>)?+|{OTHER})", re.S)
LOOSE = re.compile(rf"<(?:{COMMENT}|(/?)([A-Za-z][^\s/>]*+)([^>]*+)(>)?+|{OTHER})", re.S)
ATTR = re.compile(r"([^\s/>=\"'][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
NAMING = re.compile("class|id|role|hidden|style", re.I)
COMMAS = re.compile("[,،、，]")


NONE = (False, False, False, False, False)


class Node:
    __slots__ = ("attrs", "base", "bulk", "kids", "link", "links", "marked", "marks", "open", "parent", "prose", "score", "size", "tag", "within")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.kids, self.attrs = tag, parent, [], attrs
        self.score, self.base, self.size, self.link, self.marked = 0.0, None, 0, 0, False
        self.bulk, self.prose, self.links, self.marks, self.within = 0, 0, 0, NONE, False


def marks(tag: str, raw: str) -> tuple[bool, bool, bool, bool, bool]:
    """(hidden, a whole name is bad, part of a name is, likely the article, the article's own header) by attributes."""
    hidden = whole = part = good = own = False
    for m in ATTR.finditer(raw) if NAMING.search(raw) else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value, re.I):
            hidden = True
        elif name in ("class", "id", "role"):
            for one in value.split():
                words = [w.rstrip("0123456789") for w in re.split(r"[_\-:]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", one).lower())]
                heads = [i for i, w in enumerate(words) if w == "header" and i and words[i - 1] in OWN]
                own |= bool(heads)
                at = next((i for i, w in enumerate(words) if w in BAD and i not in heads and not (w == tag == "header")), None)
                if at is not None and LAYOUT.isdisjoint(words[:at]):
                    whole |= len(words) == 1
                    part |= len(words) > 1
            good |= bool(GOOD.search(value))
    return hidden, whole, part, good, own


def tree(page: str) -> Node:
    """The element tree; text children are plain strings, with character references decoded.

    Each open element knows the one of every group that a start tag would end, and the open elements are counted by
    name, in all and up to the last boundary, so no tag looks through its ancestors in vain. Where a tag never ends
    by HTML's rule for quotes, it ends at the next ">", and the rest of the page is read without quotes.
    """
    root = Node("#root", None)
    root.open = (None,) * len(GROUPS)
    stack, inner, every = [root], [{}], {}
    at, end, token = 0, len(page), TOKEN

    def close(last: Node | None = None, tag: str = "") -> None:
        """Closes the innermost open elements up to the given one, or the innermost of that name."""
        while True:
            x = stack.pop()
            every[x.tag] -= 1
            if x.tag in SCOPE:
                inner.pop()
            else:
                inner[-1][x.tag] -= 1
            if x is last or last is None and x.tag == tag:
                return

    while at < end:
        m = token.search(page, at)
        if m is None:
            stack[-1].kids.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        if m[4] is None:
            if (stop := page.find(">", m.start())) < 0:
                break
            token, m = LOOSE, LOOSE.match(page, m.start())
            at = stop + 1
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            if (every if tag in FAR else inner[-1]).get(tag):
                close(tag=tag)
            continue
        if tag in ENDS_P and stack[-1].open[0]:
            close(stack[-1].open[0])
        if tag in ENDERS and stack[-1].open[ENDERS[tag]]:
            close(stack[-1].open[ENDERS[tag]])
        node = Node(tag, stack[-1], raw)
        stack[-1].kids.append(node)
        if tag in VOID or raw.endswith("/") and tag in ("svg", "path", "g", "use", "rect", "circle", "math"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            node.kids.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        node.open = stack[-1].open
        if tag in TELLING:
            node.open = tuple(None if tag in stop else was or (node if tag in tags else None) for was, (tags, stop) in zip(node.open, GROUPS, strict=True))
        every[tag] = every.get(tag, 0) + 1
        if tag in SCOPE:
            inner.append({})
        else:
            inner[-1][tag] = inner[-1].get(tag, 0) + 1
        stack.append(node)
    return root


def weigh(root: Node) -> set[Node]:
    """Attributes, sizes of text (bulk) and of paragraphs (prose) of all nodes, without what is hidden or never text.

    The nodes that hold, or are, an article or main of at least a quarter of the longest one's text are returned, and
    the forms and headers around half of the page's paragraphs.
    """
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.attrs:
            x.marks = marks(x.tag, x.attrs)
        if x.tag not in DROP and not (x.marks[0] and x.tag not in SPARED):
            order.append(x)
            todo += [k for k in x.kids if isinstance(k, Node)]
    for x in reversed(order):
        own = sum(len(" ".join(k.split())) for k in x.kids if isinstance(k, str))
        x.bulk += own
        x.prose += own if own >= PROSE_CHARS else 0
        if x.parent is not None:
            x.parent.bulk += x.bulk
            x.parent.prose += x.prose
    told = [x for x in order if x.tag in ("article", "main") and x.bulk and not (x.marks[1] or x.marks[2])]
    least = max((x.bulk for x in told), default=0) / 4
    out = {x for x in order if x.tag in ("form", "header") and x.prose and x.prose >= MOST_SHARE * root.prose}
    seen: set[Node] = set()
    for x in told:
        while x.bulk >= least and x not in seen:
            seen.add(x)
            if x.parent is None:
                break
            x = x.parent
    return out | seen


def beside(x: Node, root: Node, holders: set[Node]) -> bool:
    """Whether the names of a node put it beside the article.

    They don't where it holds the article. A name that is a bad word, but not beside one of the article, always counts;
    otherwise the node's text must be the smaller part of the page.
    """
    _, whole, part, good, _ = x.marks
    if not (whole or part) or x in holders or x.tag in SPARED:
        return False
    return whole and not good or x.bulk < MOST_SHARE * root.bulk


def gauge(root: Node, names: bool = True) -> list[Node]:
    """Text and link sizes of all nodes, marks, and points passed up; the nodes in page order. Without names, class, id
    and role mark nothing."""
    order, todo, holders = [], [root], weigh(root)
    while todo:
        x = todo.pop()
        order.append(x)
        if x.tag in DROP:
            x.marked = True
        elif x.attrs:
            x.marked = x.marks[0] and x.tag not in SPARED or names and beside(x, root, holders)
            x.base = 25.0 if x.marks[3] and not x.marked else None
        x.within = x.parent is not None and (x.parent.within or x.parent.tag in ("article", "main"))
        if x not in holders and (x.tag == "form" or x.tag == "header" and not x.within and not x.marks[4]):
            x.marked = True
        if not x.marked:
            todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    for x in reversed(order):
        x.links += x.tag == "a"
        if x.parent is not None:
            x.parent.links += x.links
        if x.marked:
            continue
        own = [k for k in x.kids if isinstance(k, str)]
        x.size += sum(len(" ".join(k.split())) for k in own)
        if x.tag == "a":
            x.link = x.size
        if x.parent is not None:
            x.parent.size += x.size
            x.parent.link += x.link
        if x.tag in ("p", "pre", "td", "blockquote", "dd", "li") or x.tag in BLOCK and any(k.strip() for k in own):
            if x.size >= 1:
                text = " ".join(own)
                points = 1 + len(COMMAS.findall(text)) + min(x.size / 100, 3.0)
                for depth, p in enumerate(up(x)):
                    p.score += points / (1, 2, 3 * depth)[min(depth, 2)]
                    if depth == 4:
                        break
    bonus = {"article": 30.0, "main": 25.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "th": -5.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "html": -10.0, "#root": -10.0}
    for x in order:
        if not x.marked and x.score:
            x.score = (x.score + bonus.get(x.tag, 0.0) + (x.base or 0.0)) * (1 - x.link / max(1, x.size))
    return order


def up(x: Node):
    while (x := x.parent) is not None:
        yield x


def linky(x: Node) -> bool:
    """A list or box made of links."""
    return x.size > 0 and x.links >= 2 and x.link > 0.6 * x.size


def walk(x: Node):
    todo = [x]
    while todo:
        n = todo.pop()
        yield n
        if not n.marked:
            todo += [k for k in n.kids if isinstance(k, Node)]


def blocks(tops: list[Node]) -> list[str]:
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(part).split()):
            out.append(text)
        part.clear()

    for top in tops:
        flush()
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                part.append(x)
            elif x.tag in ("br", "wbr", "img"):
                part.append(" " if x.tag == "br" else "")
            elif not x.marked and not (x.tag in ("ul", "ol", "div", "section", "table", "p") and x is not top and linky(x)):
                if x.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(x.kids)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by two line feeds; empty if there are none.

    White space within a block becomes one space. Null counts as empty. Plain text without tags is one block. Pages of
    any length and depth are read whole. Forms never hold article text, but for one around half of the page's paragraphs.
    """
    if not page or not page.strip():
        return ""
    text = best_text(root := tree(page))
    if len(text) < LEAST_SHARE * root.bulk and any(x.marked and (x.marks[1] or x.marks[2]) for x in walk(root)):
        text = max(text, best_text(tree(page), names=False), key=len)
    return text


def best_text(root: Node, names: bool = True) -> str:
    """The blocks of the best container and of its siblings that score alike."""
    order = gauge(root, names)
    scored = [x for x in order if x.score > 0 and not x.marked and x.tag in BLOCK | {"#root"}]
    if not scored:
        return "\n\n".join(blocks([root]))
    best = max(scored, key=lambda x: x.score)
    while best.parent is not None and best.parent.score >= best.score and best.parent.tag not in ("#root", "html", "body"):
        best = best.parent
    tops = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * best.score)
        tops = [k for k in best.parent.kids if isinstance(k, Node) and not k.marked and (k is best or k.score >= least or k.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and k.size > 80 and k.link < 0.25 * k.size)]
    return "\n\n".join(blocks(tops))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html): narrow, a row in and a row out.

    Null or empty html gives an empty text. Rows are independent, so repeated rows and ids give repeated results.
    Other columns aren't read; an empty table gives an empty result.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def rows(x: dict[str, list]) -> dict[str, list]:
        text = [main_text(h) for h in x["html"]]
        return {"page_id": x["page_id"], "url": x["url"], "text": text, "n_chars": [len(t) for t in text]}

    return arrow_map(pages.select("page_id", F.col("url").cast("string").alias("url"), "html"), rows, f"page_id {kind}, url string, text string, n_chars long")
