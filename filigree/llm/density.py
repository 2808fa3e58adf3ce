"""Main-text extraction by composite text density of the DOM."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .scratch import ship

#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text (fixed values).
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of an article's text (fixed values).
DROPPED = frozenset("script style noscript template head title nav footer aside label button select option textarea input iframe object embed applet svg canvas audio video map menu dialog noembed noframes".split())
#: Elements that start and end a block of text (fixed values).
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that end an open paragraph when they start (fixed values).
ENDS_P = BLOCK - frozenset("body caption html legend tbody tfoot thead tr summary figcaption".split())
#: Blocks of text that hold a part of an article, not a whole one, and headings (fixed values).
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl dir pre blockquote figure figcaption address caption legend summary header hgroup hr".split())
LISTS, HEADINGS = frozenset("ul ol dl dir".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that a start tag ends, up to a container (fixed values).
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())),
}
#: Words of a class or id that mark page furniture (fixed values).
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disqus disclaimer dropdown footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related replies respond search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola toolbar tooltip widget widgets".split()
)
#: Those of them that mark what readers wrote (fixed values).
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: First, last and wrapping parts of a name that tells what a node has or is set to, not what it is (fixed values).
FIRST, LAST, WRAPS = frozenset("has no with without".split()), frozenset("open opened closed enabled disabled layout".split()), frozenset("wrap wrapper container".split())
#: Last parts of a name that say how much or where of a thing a node is, and not what thing (fixed values).
PLAIN = WRAPS | frozenset("area bar block bottom box button buttons center col column form group holder icons inner item items left link links list main module outer panel posts primary right row secondary section slot stories top unit widget widgets zone".split())
#: What a header with a first part of its own belongs to if it is the page's (fixed values).
PAGE = frozenset("app blog global main nav page site top web".split())
#: Words of a class or id that mark an article (fixed values).
CONTENT = frozenset("article content entry main post story text".split())
#: Roles that mark page furniture (fixed values).
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())

#: How many times the text beside it a node that is named furniture must hold to be the page's text all the same.
REST = 12

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z)))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def furniture(name: str) -> set[str]:
    """The word by which one class or id, in lower case, calls its node furniture: the whole name, or the last part that says what the node is (site-nav, sidebar-left, cookie-banner, but not search-for-truth, card-header, has-sidebar, comments-open or content-sidebar-wrap)."""
    parts = [x for x in _SPLIT.split(name) if x]
    if not parts or (len(parts) > 1 and (parts[0] in FIRST or parts[-1] in LAST or (parts[-1] in WRAPS and not CONTENT.isdisjoint(parts)))):
        return set()
    whole = "".join(parts)
    if whole in FURNITURE:
        return {whole}
    while len(parts) > 1 and parts[-1] in PLAIN:
        parts.pop()
    said = parts[-1]
    if said not in FURNITURE or (said == "header" and len(parts) > 1 and parts[0] not in PAGE) or (said in ("widget", "widgets") and parts[0] == "elementor"):
        return set()
    return {said}


class Tree:
    """A document as parallel lists: tag, parent, dropped, furniture by its words (or a form); and text pieces (node, text) in page order, None for a block border."""

    __slots__ = ("tag", "parent", "gone", "said", "home", "named", "kind", "article", "pieces")

    def __init__(self):
        self.tag, self.parent, self.gone, self.said, self.home, self.article, self.pieces = ["#root"], [-1], [False], [None], [False], [False], []
        self.named, self.kind = [False], [""]  # whether a class or id names the node the content; its class

    def child(self, tag: str, parent: int, attributes: str) -> int:
        gone, marks = self.gone[parent] or tag in DROPPED, {"form"} if tag == "form" else None
        article, named, kind = tag in ("article", "main"), False, ""
        if len(attributes) > 1:
            words, said, role, label = set(), set(), "", ""
            for m in _ATTR.finditer(attributes):
                name = m[1].lower()
                value = m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    for x in value.lower().split():
                        parts = _SPLIT.split(x)
                        words.update(parts)
                        named = named or (contains(tag) and [y for y in parts if y and y not in PLAIN][-1:] == [y for y in parts if y in CONTENT][-1:] != [])
                        said |= furniture(x)
                    if name == "class":
                        kind = value
                elif name == "role":
                    role = value.lower().strip()
                elif name == "itemprop":
                    label = value.lower()
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                    gone = True
            article = article or role in ("article", "main") or label == "articlebody"
            if tag not in ("html", "body", "main"):
                if role in ROLES:
                    gone = True
                elif role == "form":
                    marks = {"form"}
                elif said and not (words & CONTENT and said <= {"header", "notice", "related", "share"}) and (tag != "article" or said & {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo"}):
                    marks = said
        if tag == "header" and not self.article[parent]:
            gone = True
        self.tag.append(tag)
        self.parent.append(parent)
        self.gone.append(gone)
        self.said.append(marks)
        self.home.append(article)
        self.named.append(named)
        self.kind.append(kind)
        self.article.append(article or self.article[parent])
        return len(self.tag) - 1


#: Elements that an open paragraph outside of them does not see ended (fixed values).
_HOLDS_P = ("button", "td", "th", "table", "caption", "object", "template")


def parse(html: str) -> Tree:
    """A tolerant reading of HTML: unclosed and misnested tags never lose text.

    For each name the depths of its open elements are at hand, so a tag looks at a few of them
    and never walks the open elements, but to end them: time is in proportion to the tags."""
    t = Tree()
    tags, pieces = t.tag, t.pieces
    stack, depths = [0], {"#root": [0]}  # open nodes; for each name the places of its nodes on the stack
    at, n = 0, len(html)

    def last(names) -> int:
        return max((d[-1] for x in names if (d := depths.get(x))), default=0)

    def end(depth: int) -> None:
        """End the node at a depth of the stack, and all inside it."""
        while len(stack) > depth:
            depths[tags[stack.pop()]].pop()

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            pieces.append((stack[-1], html[at:]))
            break
        if m.start() > at:
            pieces.append((stack[-1], html[at : m.start()]))
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                pieces.append((stack[-1], m[1].replace("&", "&amp;")))
            continue
        tag = name.lower()
        if m[2]:
            if tag not in ("html", "body") and (d := depths.get(tag)):  # what follows the end of body still belongs to it
                end(d[-1])
            if tag in BLOCK:
                pieces.append((stack[-1], None))
            elif tag in ("td", "th"):
                pieces.append((stack[-1], " "))
            continue
        if tag in ENDS_P and (p := last("p")) and p > last(_HOLDS_P):
            end(p)
        if tag in IMPLIED:
            closes, stop = IMPLIED[tag]
            bar = last(stop)
            # the outermost of those to be closed inside the nearest container
            inner = [d[i] for x in closes if (d := depths.get(x)) and (i := bisect_right(d, bar)) < len(d)]
            if inner:
                end(min(inner))
        if tag in BLOCK:
            pieces.append((stack[-1], None))
        elif tag == "br" or tag in ("td", "th"):
            pieces.append((stack[-1], " "))
        k = t.child(tag, stack[-1], m[4])
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?|</{tag}\Z", re.I).search(html, at)
            stop = close.start() if close else n
            pieces.append((k, html[at:stop]))
            at = close.end() if close else n
        elif tag not in VOID:
            depths.setdefault(tag, []).append(len(stack))
            stack.append(k)
    return t


def dropped(t: Tree) -> list[bool]:
    """Nodes that go: those of t.gone, and furniture by its words unless the text of the page is in it (see extract)."""
    marked = [k for k, x in enumerate(t.said) if x and not t.gone[k]]
    if not marked:
        return t.gone
    n, parent = len(t.tag), t.parent
    plain, clean = [0] * n, [0] * n  # text outside links: all but what readers wrote; all but furniture
    linked, by_readers, by_words = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        p, said = parent[k], t.said[k]
        linked[k] = linked[p] or t.tag[k] == "a"
        by_words[k] = by_words[p] or bool(said)
        by_readers[k] = by_readers[p] or bool(said and said & COMMENTS)
    for k, s in t.pieces:
        if s is not None and not t.gone[k] and not linked[k]:
            size = len("".join(s.split()))
            plain[k] += 0 if by_readers[k] else size
            clean[k] += 0 if by_words[k] else size
    for k in range(n - 1, 0, -1):
        plain[parent[k]] += plain[k]
        clean[parent[k]] += clean[k]
    # the article: the one that says most, or else what is named the content; one that is furniture, or lies in what readers wrote, is none
    able = [k for k in range(n) if (t.home[k] or t.named[k]) and not t.gone[k] and not t.said[k] and plain[k]]
    lead = max([k for k in able if t.home[k]] or able, key=lambda k: (plain[k], -k), default=None)
    holds, k = set(), lead
    while k is not None and k >= 0:
        holds.add(k)
        k = parent[k]
    inside = [False] * n
    stays = set()
    for k in range(1, n):
        inside[k] = k == lead or inside[parent[k]]
        if t.said[k] and not t.gone[k]:
            left = clean[0] - clean[k]
            if k in holds:
                keep = t.tag[lead] == "main" or 4 * plain[lead] >= left
            elif t.said[k] & COMMENTS:
                keep = not left and lead is None
            elif t.said[k] == {"form"}:
                keep = (lead is None or inside[k]) and plain[k] > left
            else:  # whatever its length, unless next to nothing stands beside it
                keep = (lead is None or inside[k]) and plain[k] > REST * left
            if keep:
                stays.add(k)
    gone = t.gone[:]
    for k in range(1, n):
        gone[k] = gone[k] or gone[parent[k]] or bool(t.said[k] and k not in stays)
    return gone


def measured(t: Tree, gone: list[bool]) -> tuple[list[int], list[int], list[int], list[int], list[int], list]:
    """For each node its characters, linked characters, tags and link tags (of its subtree, white space and what is gone left out) and the characters right inside it that are no link's; and the text pieces that stay, decoded."""
    n, parent = len(t.tag), t.parent
    chars, linked, tags, links, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = t.tag[k] == "a" or in_link[parent[k]]
        if not gone[k]:
            tags[parent[k]] += 1
            links[parent[k]] += t.tag[k] == "a"
    pieces = []
    for k, s in t.pieces:
        if gone[k]:
            continue
        if s is not None:
            s = unescape(s) if "&" in s else s
            size = len("".join(s.split()))
            chars[k] += size
            if in_link[k]:
                linked[k] += size
            else:
                own[k] += size
        pieces.append((k, s))
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if not gone[k]:
            chars[p] += chars[k]
            linked[p] += linked[k]
            tags[p] += tags[k]
            links[p] += links[k]
    return chars, linked, tags, links, own, pieces


def density(chars: int, linked: int, tags: int, links: int, body_chars: int, body_linked: int) -> float:
    """Composite text density: characters per tag, times the logarithm of (characters per linked character x tags per link tag) to a base that grows with the share of links; counts of 0 below a bar are 1."""
    if not chars:
        return 0.0
    base = log(chars / max(chars - linked, 1) * linked + body_linked / max(body_chars, 1) * chars + e)
    return chars / max(tags, 1) * max(log(chars / max(linked, 1) * max(tags, 1) / max(links, 1)), 0.0) / base


def chosen(t: Tree, gone: list[bool], chars: list[int], linked: list[int], tags: list[int], links: list[int], own: list[int]) -> tuple[int | None, list[float], list[float]]:
    """The container of the largest sum of child densities (the first of equal ones; None without text), the densities and the sums. Text right inside a node counts as a child of one tag."""
    n, parent = len(t.tag), t.parent
    body = body_of(t)
    c, lc = chars[body], linked[body]
    dense = [0.0 if gone[k] else density(chars[k], linked[k], tags[k], links[k], c, lc) for k in range(n)]
    total = [density(own[k], 0, 1, 0, c, lc) for k in range(n)]
    for k in range(1, n):
        total[parent[k]] += dense[k]
    some = [k for k in range(body, n) if not gone[k] and chars[k] and contains(t.tag[k])]
    return max(some, key=lambda k: (total[k], -k), default=None), dense, total


def body_of(t: Tree) -> int:
    return next((k for k in range(1, len(t.tag)) if t.tag[k] == "body"), 0)


def contains(tag: str) -> bool:
    """Whether an element can hold an article, and not just a paragraph of one."""
    return tag not in PARAGRAPH and (tag in BLOCK or tag in ("#root", "td", "th") or "-" in tag)


def main_text(html: str | None) -> str:
    """The text of the densest subtree and of what belongs to it (see extract)."""
    if not html:
        return ""
    t = parse(html)
    n, parent, gone = len(t.tag), t.parent, dropped(t)
    chars, linked, tags, links, own, pieces = measured(t, gone)
    best, dense, _ = chosen(t, gone, chars, linked, tags, links, own)
    if best is None:
        return ""
    body = body_of(t)
    path, k = {best}, best
    while k > 0 and k != body:
        k = parent[k]
        path.add(k)
    threshold = min(dense[k] for k in path)
    heads, first = [0] * n, [False] * n  # characters of headings in a node, and whether it has an h1
    for k in range(n - 1, 0, -1):
        if t.tag[k] in HEADINGS:
            heads[k], first[k] = chars[k], t.tag[k] == "h1"
        heads[parent[k]] += heads[k]
        first[parent[k]] |= first[k]
    # what holds the whole article: the innermost article or main on the path, or else the outermost node named the content
    steps = sorted(path)
    homes = [k for k in steps if t.home[k]][-1:] or [k for k in steps if t.named[k] and k > body][:1]
    whole = homes[0] if homes else n
    # of what stands beside the winner and the nodes it lies in, from the last to the first
    kept, after = set(), {}
    for k in range(n - 1, 0, -1):
        p, tag = parent[k], t.tag[k]
        if k in path:
            after[p] = True
        elif p in path and not gone[k] and chars[k] and (p != best or p == body):
            plain = 2 * linked[k] <= chars[k]
            if p == best:  # paragraphs stand in the body itself: all but lists of links between them
                ok = plain or links[k] < 3 or dense[k] >= threshold or not (contains(tag) or tag in LISTS)
            elif p >= whole and not (contains(tag) and not plain):  # all of the article but lists of links
                ok = plain
            elif dense[k] >= threshold and tag in BLOCK:
                ok = True
            elif p == parent[best] and p != body and contains(tag) and tag == t.tag[best] and (tag == "section" or (t.kind[k] and t.kind[k] == t.kind[best])):
                ok = plain  # parts of one kind
            elif 2 * heads[k] >= chars[k]:  # a heading needs what it is the heading of
                ok = plain and (first[k] or after.get(p, False))
            else:
                ok = plain and not contains(tag) and p != body
            after[p] = ok
            if ok:
                kept.add(k)
    inside = [False] * n
    for k in range(n):
        if k == best or k in kept:
            inside[k] = True
        elif k in path:  # text right inside a node above the winner is a paragraph of it
            inside[k] = k != body or density(own[k], 0, 1, 0, chars[body], linked[body]) >= threshold
        elif parent[k] not in path or (parent[k] == best and best != body):
            inside[k] = inside[parent[k]]
    blocks, line = [], []
    for k, s in pieces:
        if s is None:
            if line:
                blocks.append("".join(line))
                line = []
        elif inside[k]:
            line.append(s)
    blocks.append("".join(line))
    return "\n".join(x for b in blocks if (x := " ".join(b.split())))


def extract(spark, html: Column) -> Column:
    """Main text of a page's html, a string (empty for null, empty or textless pages).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments go first, by element, role, class and id. A name counts by what it calls the node:
    the whole of it or its last part, not by any word in it, nor by what the node has or
    wraps (has-sidebar, comments-open). What is named so goes whatever its length, unless the
    article lies in it or the rest of the page has next to no text; a form stays if it holds most of the text outside links.

    Every node gets its composite density: characters per tag, lowered by the share of
    linked characters and tags. The container (not a lone paragraph) with the largest sum
    of child densities is the main subtree, whatever its element; of equal sums the first
    in page order. The least density on the path from it to body is the threshold for the
    blocks beside that path. Paragraphs inside the nodes above the winner, headings of
    what is kept, and, inside the article or main element (or the node named the content) that
    the winner lies in, all parts whatever their length stay too if at most half of their characters are links; so do sections
    and nodes of the winner's class beside it. Where the
    body itself wins, its lists of links go unless they reach the threshold.

    Character references are decoded, white space in a block becomes one space, blocks are
    joined by a line feed. Pages are read whole whatever their length and depth, in time in proportion to both; unclosed tags and
    truncated pages lose no text. A row depends on its own html alone: repeated rows give
    equal texts, an empty table gives none, and other columns are not looked at.
    """
    ship(spark)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return text(html)
