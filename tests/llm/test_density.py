"""The main subtree against a recursive reading of composite text density, and pages whose article no element names."""

import random
import re
from html import unescape
from math import e, log

import pytest
from pyspark.sql import functions as F

from filigree.llm import density, queries

LINE = "The first sentence of the story goes on for a while and then it stops. " * 4
STORY = "".join(f"<p>{LINE}</p>" for _ in range(5))
TEXT = "\n".join([LINE.strip()] * 5)
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>short link {k}</a></li>" for k in range(20)) + "</ul>"


def grown(r, depth=0):
    """A random tree: (tag, children), a child being a tree or a text."""
    tag = r.choice(["div", "section", "article", "td-x", "p", "a", "span", "div"]) if depth else "body"
    if tag in ("p", "a", "span") or depth > 4:
        return tag, ["word " * r.randrange(0, 30)]
    return tag, [grown(r, depth + 1) if r.random() < 0.75 else "bit " * r.randrange(0, 9) for _ in range(r.randrange(1, 5))]


def written(tree):
    tag, children = tree
    return f"<{tag}>" + "".join(c if isinstance(c, str) else written(c) for c in children) + f"</{tag}>"


def sizes(tree, link=False):
    """(characters, linked characters, tags, link tags) of a subtree."""
    tag, children = tree
    link = link or tag == "a"
    out = [0, 0, 0, 0]
    for c in children:
        if isinstance(c, str):
            n = len(c.replace(" ", ""))
            out = [out[0] + n, out[1] + n * link, out[2], out[3]]
        else:
            x = sizes(c, link)
            out = [a + b for a, b in zip(out, [x[0], x[1], x[2] + 1, x[3] + (c[0] == "a")])]
    return out


def ctd(x, body):
    c, lc, t, lt = x
    if not c:
        return 0.0
    value = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    base = c / max(c - lc, 1) * lc + body[1] / max(body[0], 1) * c + e
    return c / max(t, 1) * max(log(value), 0) / log(base)


def sums(tree, body, link=False):
    """(density sum, tag) of every container with text, in page order."""
    tag, children = tree
    link = link or tag == "a"
    own = 0 if link else sum(len(c.replace(" ", "")) for c in children if isinstance(c, str))
    trees = [c for c in children if not isinstance(c, str)]
    total = ctd((own, 0, 1, 0), body) + sum(ctd(sizes(c, link), body) for c in trees)
    here = [(total, tag)] if tag not in ("p", "a", "span") and sizes(tree)[0] else []
    return here + [x for c in trees for x in sums(c, body, link)]


def test_sums_as_by_definition():
    r, winners = random.Random(11), set()
    for _ in range(400):
        tree = grown(r)
        want = sums(tree, sizes(tree))
        t = density.parse(f"<html>{written(tree)}</html>")
        gone = density.dropped(t)
        best, _, total = density.chosen(t, gone, *density.measured(t, gone)[:5])
        if not want:
            assert best is None or t.tag[best] == "#root"
            continue
        top = max(want, key=lambda x: x[0])
        assert total[best] == pytest.approx(top[0])
        firsts = [tag for s, tag in want if s == pytest.approx(top[0])]
        assert t.tag[best] in firsts
        winners.add(t.tag[best])
    assert len(winners) >= 4  # the densest container is of many kinds


def first_article(html):
    m = re.search(r"(?s)<article\b.*?</article>", html)
    blocks = re.split(r"</?(?:p|h1|article|div)\b[^>]*>", m[0]) if m else []
    return "\n".join(x for b in blocks if (x := " ".join(unescape(re.sub("<[^>]+>", "", b)).split())))


PAGES = {
    "no article element": f"<body><div>{LINKS}</div><div class=x>{STORY}</div></body>",
    "a teaser comes first": f"<body><div><article><p><a href=/1>Another story</a></p></article></div><div><article>{STORY}</article></div></body>",
    "teasers behind": f"<body><article>{STORY}</article><div><article><p><a href=/2>next</a></p></article><article><p><a href=/3>more</a></p></article></div></body>",
    "an article element around links": f"<body><article>{LINKS}</article><section>{STORY}</section></body>",
    "paragraphs in the body": f"<body>{LINKS}{STORY}</body>",
    "a table layout": f"<body><table><tr><td>{LINKS}<td>{STORY}</table></body>",
    "a form around the page": f"<body><form action=x><input name=v><div>{LINKS}</div><div>{STORY}<select><option>one</select></div></form></body>",
    "wrapper has-sidebar": f"<body><div class='layout has-sidebar'><article>{STORY}</article></div></body>",
    "wrapper with-header": f"<body><div class='page with-header'><div>{STORY}</div></div></body>",
    "wrapper no-ads": f"<body><div id='no-ads'><div>{LINKS}</div><div>{STORY}</div></div></body>",
    "wrapper widget": f"<body><div class='elementor-widget-container'>{STORY}</div></body>",
    "text after the end of body": f"<html><body><div><p>{LINE}</p></div></body>{''.join(f'<p>{LINE}</p>' for _ in range(4))}</html>",
}


@pytest.mark.parametrize("name", PAGES)
def test_the_density_chooses(name):
    assert density.main_text(PAGES[name]) == TEXT


def test_the_first_article_would_not_do():
    assert sum(first_article(p) == TEXT for p in PAGES.values()) < len(PAGES) / 2
    wrong = sum(first_article(p) != density.main_text(p) for p in PAGES.values())
    assert wrong > len(PAGES) / 2


def test_small_parts_beside_the_winner_stay():
    page = f"<body><div class=top><h1><a href=/>Site</a></h1></div><div><div class=title><h1>Head</h1></div><p>In.</p><div>{STORY}</div><p>End.</p><p><a href=x>all links here</a></p></div></body>"
    assert density.main_text(page) == f"Head\nIn.\n{TEXT}\nEnd."


def test_equal_sums_take_the_first():
    half = f"<div><p>{LINE}</p><p>{LINE}</p></div>"
    t = density.parse(f"<body><section>{half}</section><section>{half}</section></body>")
    gone = density.dropped(t)
    best, _, total = density.chosen(t, gone, *density.measured(t, gone)[:5])
    same = [k for k in range(len(t.tag)) if total[k] == total[best] and density.contains(t.tag[k])]
    assert best == min(same)


def test_the_column(spark, tmp_path):
    rows = [(1, None, "own"), (1, None, "own"), (2, PAGES["a table layout"], "own"), (2, PAGES["a table layout"], "own"), (3, "", "own"), (4, "<nav>menu</nav>", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    out = sorted((r.page_id, r.t) for r in pages.select("page_id", density.extract(spark, F.col("html")).alias("t")).collect())
    assert out == [(1, ""), (1, ""), (2, TEXT), (2, TEXT), (3, ""), (4, "")]
    spark.createDataFrame([], "page_id bigint, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.op3_text_density(spark, str(tmp_path))
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.collect() == []


def sentences(n, word):
    return "".join(f"<p>{word} {k} is a sentence of this part, long enough to be read as prose, with its comma and its end.</p>" for k in range(n)), [f"{word} {k} is a sentence of this part, long enough to be read as prose, with its comma and its end." for k in range(n)]


@pytest.mark.parametrize("home", ["main", "article", "div class='content'", "div class=post-content", "div role=main"])
@pytest.mark.parametrize("part", ["section", "div", "div class=part"])
@pytest.mark.parametrize("outer", [1, 2, 3, 5, 9])
def test_sections_of_unequal_size(home, part, outer):
    """Every section of an article stays, headings included, however large another one is."""
    want, body = [], ""
    for name, n in (("First", outer), ("Middle", 18), ("Last", outer)):
        html, lines = sentences(n, name)
        body += f"<{part}><h2>{name} part</h2>{html}</{part.split()[0]}>"
        want += [f"{name} part", *lines]
    page = f"<body><nav>{LINKS}</nav><{home}>{body}</{home.split()[0]}><footer>Foot</footer></body>"
    assert density.main_text(page).split("\n") == want


def test_sections_without_an_article():
    want, body = [], ""
    for name, n in (("First", 2), ("Middle", 18), ("Last", 1)):
        html, lines = sentences(n, name)
        body += f"<section><h2>{name} part</h2>{html}</section>"
        want += [f"{name} part", *lines]
    assert density.main_text(f"<body><div>{LINKS}</div><div id=x>{body}</div></body>").split("\n") == want


@pytest.mark.parametrize("name", ["related-work", "social-history", "share-price", "search-for-truth", "ad-hoc", "skip-intro", "promotion-history", "sub-header", "card-header", "section-header", "menu-of-the-day", "widgetry", "notice-period"])
@pytest.mark.parametrize("tag", ["p", "div", "h2"])
def test_compound_names_of_content(name, tag):
    html, lines = sentences(6, "Line")
    page = f"<body><article>{html}<{tag} class='{name}'>What this part says.</{tag}>{html}</article></body>"
    assert density.main_text(page).split("\n") == [*lines, "What this part says.", *lines]


@pytest.mark.parametrize("name", ["sidebar", "side-bar", "sidebar-left", "right-sidebar", "ad", "ads-box", "cookie-banner", "newsletter-signup", "site-header", "top-nav", "nav-bar", "share-buttons", "related-posts", "comments", "comment-list", "footer-links", "social-links", "promo_box", "search-form"])
@pytest.mark.parametrize("size", [1, 6, 40])
def test_furniture_goes_whatever_its_length(name, size):
    html, lines = sentences(5, "Line")
    other, _ = sentences(size, "Aside")
    for home in ("div class=content", "article"):
        tag = home.split()[0]
        assert density.main_text(f"<body><{home}>{html}</{tag}><div class='{name}'>{other}</div></body>").split("\n") == lines
        assert density.main_text(f"<body><div class='{name}'>{other}</div><{home}>{html}</{tag}></body>").split("\n") == lines


def test_time_in_proportion_to_depth():
    import time

    def took(html):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            density.main_text(html)
            best = min(best, time.perf_counter() - began)
        return best

    for unit in ("<div>", "<div></b>", "<div><p>x", "<ul><li>a", "<table><tr><td>b", "<dl><dt>c"):
        short, long = (took(unit * n + "text") for n in (8000, 16000))
        assert short < 0.4 and long < 2.6 * short + 0.02, unit


def test_implied_ends_as_before():
    """Items and cells end their like inside the nearest container, and no further."""
    t = density.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g<table><tr><td>h</table>i</table><p>j<div>k</div>l<button><p>m<p>n</button>o")
    at = [(s, [t.tag[k] for k in line(t, n)]) for n, s in t.pieces if s and s.strip()]
    assert at == [
        ("a", ["ul", "li"]), ("b", ["ul", "li", "ul", "li"]), ("c", ["ul", "li", "ul", "li"]), ("d", ["ul", "li"]), ("e", ["table", "tr", "td"]), ("f", ["table", "tr", "td"]), ("g", ["table", "tr", "td"]),
        ("h", ["table", "tr", "td", "table", "tr", "td"]), ("i", ["table", "tr", "td"]), ("j", ["p"]), ("k", ["div"]), ("l", []), ("m", ["button", "p"]), ("n", ["button", "p"]), ("o", []),
    ]


def line(t, k):
    out = []
    while k > 0:
        out.append(k)
        k = t.parent[k]
    return out[::-1]
