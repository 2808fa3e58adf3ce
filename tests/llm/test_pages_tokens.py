import random

import numpy as np
import pytest
from brute import LOWER, WORD
from pyspark.sql import functions as F

from filigree.llm import density, queries, separators, simwindows, urlalias


def test_rules_and_urls(spark):
    urls = [(1, "HTTP://WWW.Example.COM/en/x?y#z"), (2, "https://a.example.com/en/"), (3, "https://net/es/1"), (4, "http://x.net/fr/"), (5, "http://other.org/en"), (6, None), (7, "nonsense"), (8, "http://com"), (9, "https://notexample.com/en/"), (10, "a://b://c/d"), (11, "")]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in urls], "page_id bigint, url string, html string, host string")
    got = {r.id: r for r in urlalias.judge(pages, queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 12)] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/", "example.com/en/", "block"),
        ("net", "/es/1", "net/es/", "block"),
        ("x.net", "/fr/", "net/fr/", "block"),
        ("other.org", "/en", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("com", "", None, "allow"),
        ("notexample.com", "/en/", "com/", "allow"),
        ("b:", "//c/d", None, "allow"),
        ("", "", None, "allow"),
    ]


def test_blocks_reach_aliases_and_allow_wins(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.org/1", link.format("http://bad.net/es/1")),  # canonical address is blocked
        (2, "http://a.org/2", '<META HTTP-EQUIV="refresh" content="0; url=/1">'),  # refreshes to the first
        (3, "http://a.org/3", "<!-- " + link.format("http://bad.net/es/1") + " -->"),  # a comment is no link
        (4, "http://b.org/4", link.format("http://bad.net/es/4")),
        (5, "http://good.com/5", link.format("http://bad.net/es/4")),  # an allowed alias in the same chain
        (6, "http://bad.net/es/4", None),  # its own rule decides
        (7, "http://c.org/7", None),
        (7, "http://c.org/7#top", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    moved = spark.createDataFrame([("http://c.org/7", "http://a.org/2"), (None, "x")], "src string, dst string")
    got = sorted((r.id, r.verdict) for r in urlalias.judge(df, queries.URL_RULES, redirects=moved).collect())
    assert got == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "block"), (7, "block"), (7, "block")]
    assert urlalias.judge(df.limit(0), []).collect() == []


def test_many_rules_as_few(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 5}.x{k % 3}.com/p{k % 4}/q", "") for k in range(60)], "page_id bigint, url string, html string")
    rules = [("com/", "allow"), ("x1.com/p1", "block"), ("h2.x1.com/", "block"), ("h2.x1.com/p1/", "allow"), ("x2.com/p3", "block")]
    few = sorted(map(tuple, urlalias.judge(pages, rules).collect()))
    monkeypatch.setattr(urlalias, "INLINE", 0)
    assert sorted(map(tuple, urlalias.judge(pages, rules).collect())) == few


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav>menu</nav></header>
<div id="cookie-notice">We use cookies, accept them all now please</div><div class="wrap"><article><h1>Head &amp; &#233;</h1><p>First  <a href=x>linked</a>
 para<p><b>Second<br>line<ul><li>one<li>two</ul><script>if (a < b) document.write("</p>")</script><div class="ad">Buy</div><form><input>send</form>
<section class="comments"><p>reader says</p></section><pre> kept
 text </pre></article><aside>aside text</aside></div><footer>&copy; foot</footer></body>"""


def test_article_text():
    assert density.main_text(PAGE) == "Head & é\nFirst linked para\nSecond line\none\ntwo\nkept text"
    assert density.main_text(None) == density.main_text("") == density.main_text("<p></p><!-- x") == ""
    assert density.main_text("plain text < 3 &lt;b&gt;") == "plain text < 3 <b>"
    assert density.main_text("<div><p>cut off in the mid") == "cut off in the mid"


def test_densest_part_without_an_article_element():
    links = "".join(f"<li><a href='/{k}'>short link {k}</a></li>" for k in range(30))
    body = "".join(f"<p>{'many words of a long paragraph ' * 8}</p>" for _ in range(6))
    text = density.main_text(f"<body><div><ul>{links}</ul></div><div>{body}</div><div><p>tiny</p><a href=x>more</a></div></body>")
    assert "short link" not in text and text.count("\n") == 5


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "core " * 50 + "</div>" * 3000
    assert density.main_text(f"<body>{deep}</body>") == ("core " * 50).strip()
    assert len(density.main_text("<body><article>" + "<p>word</p>" * 20000 + "</article>")) == 5 * 20000 - 1
    assert density.main_text("<p a='" + "x" * 100_000) != "never ends"


def test_extract_column(spark, small):
    pages = spark.createDataFrame([(1, None), (2, PAGE)], "page_id bigint, html string")
    assert [r.t for r in pages.select("page_id", density.extract(spark, F.col("html")).alias("t")).orderBy("page_id").collect()] == ["", density.main_text(PAGE)]
    assert all(r.n_chars == len(r.text) for r in queries.op3_text_density(spark, small).collect())


@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(separators, "FAN", 3)  # three blocks to an upper sum
    r, kind = random.Random(width), {2: np.uint16, 4: np.uint32}[width]
    files, want = [], []
    for k, tokens in enumerate([[], [9], [9, 9, 9], [1, 2, 3], [9, 1], *[[r.choice([1, 2, 3, 9, 4, 5, 6]) for _ in range(r.randrange(1, 400))] for _ in range(5)], [1] * 300]):
        p = tmp_path / f"{k}.bin"
        np.array(tokens, kind).tofile(p)
        files.append((p.as_uri(),))
        start = n = 0
        for i, t in enumerate([*tokens, None]):
            if t == 9 or (t is None and i > start):
                want.append((p.as_uri(), n, start, i - start, t == 9))
                start, n = i + 1, n + 1
    sized = separators.sizes(spark, spark.createDataFrame(files, "path string"))
    got = separators.scan(sized, 9, width, block_bytes=16)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert separators.scan(sized.limit(0), 9, width).collect() == []


def test_broken_token_file(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    sized = separators.sizes(spark, spark.createDataFrame([((tmp_path / "odd.bin").as_uri(),)], "path string"))
    with pytest.raises(Exception, match="whole number of tokens"):
        separators.scan(sized, 1).collect()


def test_token_counts(spark, small):
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op2_separator_scan(spark, small).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(enc.encode_ordinary(t)) for i, t in texts.items()} and len(got) == len(texts)


def test_token_counts_of_hard_rows(spark, tmp_path):
    rows = [(1, None), (1, "two words"), (1, "two words"), (None, "x"), (2, ""), (3, "word " * 200_000)]
    docs = spark.createDataFrame([(i, t, 5, "own") for i, t in rows], "doc_id bigint, text string, n_tokens int, path string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(queries.op2_separator_scan(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert [(r.doc_id, r.n_tokens) for r in got[:5]] == [(None, 1), (1, 0), (1, 2), (1, 2), (2, 0)] and got[5].doc_id == 3 and got[5].n_tokens >= 200_000
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert queries.op2_separator_scan(spark, str(tmp_path)).collect() == []


def test_stores_by_their_names():
    with pytest.raises(ValueError, match="wasbs://"):
        separators._open("wasbs://box@host/a.bin")
    assert separators._open("file:///a/b.bin")[1] == separators._open("/a/b.bin")[1] == "/a/b.bin"


def similar(text, items, width=5):
    """Best weighted similarity of every item over all windows of its length."""
    from math import log

    split = lambda t: WORD.findall((t or "").translate(LOWER))
    cut = lambda w: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    words = [(i, split(t)) for i, t in dict.fromkeys(items) if split(t)]  # an id may have several texts
    df, n = {}, len(words)
    for _, w in words:
        for s in cut(w):
            df[s] = df.get(s, 0) + 1
    weigh = lambda ss: sum(1 + log((n + 1) / df[s]) if s in df else 1 + log(n + 1) for s in ss)
    doc, out = split(text), {}
    for i, w in words:
        own = cut(w)
        for s in range(max(1, len(doc) - len(w) + 1)) if doc else ():
            win = cut(doc[s : s + len(w)])
            both = weigh(win & own)
            out[i] = max(out.get(i, 0), both / (weigh(own) + weigh(win) - both))
    return {i: v for i, v in out.items() if v >= 0.8 - 1e-12}


def test_contamination_as_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randrange(8, 60)))) for k in range(25)] + [(90, None), (91, " "), (92, "Short Item"), (93, "v1"), (3, "an item that repeats an id but not its text at all")]
    docs = [(0, None), (1, ""), (2, "short item"), (3, "no such thing")]
    for k, (i, t) in enumerate(items[:25]):
        w = t.split()
        noise = r.choices(vocabulary, k=40)
        docs += [(100 + k, " ".join([*noise, *w, *noise])), (200 + k, "\n".join([*noise, *[x.upper() for x in w], *noise])), (300 + k, " ".join([*noise[:9], *w[: len(w) // 2]])), (400 + k, " ".join(["edge", *w[1:], *noise]))]
    df = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id bigint, text string, items string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    missed = 0
    for row in simwindows.contamination(df, bench).collect():
        want = similar(row.text, items)
        got = {x["item"]: x["similarity"] for x in row["items"]}
        assert all(v == pytest.approx(want.get(i, -1)) for i, v in got.items()), (row.doc_id, got, want)
        missed += len(set(want) - set(got))
        if 100 <= row.doc_id < 300:
            assert row.doc_id % 100 in got  # copies are always found
    assert missed == 0
    none = simwindows.contamination(df, bench.limit(0))
    assert none.where(F.size("items") > 0).count() == 0


def test_fingerprints_and_blocks():
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    for length in (1, 2, 7, 33, 64, 200):
        want = [np.packbits(bits[p : p + length].sum(0) > length // 2).view(np.uint64)[0] for p in range(400 - length + 1)]
        assert (simwindows.Windows(h).of(length) == np.array(want)).all()
        assert (simwindows.Windows(h).of(length, 3) == np.array(want)[::3]).all()
    # every fingerprint within the radius is found
    index = simwindows.Index([(k, " ".join(f"a{k}x{j}" for j in range(20))) for k in range(10)])
    size = next(iter(index.classes))
    prints = index.classes[size][0]
    for p in range(len(prints)):
        flipped = prints[p]
        for b in r.choice(64, simwindows.RADIUS, replace=False):
            flipped ^= np.uint64(1) << np.uint64(b)
        w, q = index._near(np.array([flipped], np.uint64), size)
        assert p in q


def test_several_passes_as_one(spark, monkeypatch):
    """Passes share the weights of the whole benchmark."""
    r = random.Random(12)
    vocabulary = [f"v{k}" for k in range(60)]  # shingles that several items have
    stock = [" ".join(r.choices(vocabulary, k=9)) for _ in range(6)]
    items = [(k, " ".join([r.choice(stock), *r.choices(vocabulary, k=r.randrange(4, 40)), r.choice(stock)])) for k in range(60)] + [(3, "short one"), (3, items_text := "two texts under one id"), (77, items_text), (78, None)]
    docs = [(0, None), (1, ""), (2, "a short one here")]
    for k, (i, t) in enumerate(items[:60]):
        w = t.split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "changed"
        docs += [(10 + k, " ".join([*r.choices(vocabulary, k=30), *w, *r.choices(vocabulary, k=30)]))] * (1 + k % 2)
    df = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id bigint, text string, _row string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    said = lambda out: sorted((x.doc_id, x._row, [(i["item"], round(i["similarity"], 9)) for i in x["items"]]) for x in out.collect())
    one = said(simwindows.contamination(df, bench))
    assert sum(bool(x[2]) for x in one) > 40
    monkeypatch.setattr(simwindows, "ITEMS", 13)
    assert said(simwindows.contamination(df.repartition(3), bench)) == one


def test_a_pass_builds_one_index_in_a_worker(monkeypatch):
    class Sent:
        value = ([(1, "some words of an item")], None)

    built = []
    monkeypatch.setattr(simwindows, "Index", lambda *a: built.append(a) or a)
    monkeypatch.setattr(simwindows, "_BUILT", {})
    for batch in ["first"] * 5 + ["second"] * 5:  # passes run one after the other
        simwindows._index(Sent, batch)
    assert len(built) == 2


def test_recall_with_edits(spark):
    """Of passages changed up to the limit of similarity, all but one in a hundred are found."""
    r, held, found = random.Random(5), 0, 0
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(100 * n + k, " ".join(r.choices(vocabulary, k=n))) for n in (14, 20, 30, 45, 70, 120) for k in range(60)]
    docs = []
    for i, t in items:
        w = t.split()
        cut = r.randrange((len(w) - 4) // 9 + 1)  # at most what the similarity allows
        edits = r.randrange(1, 1 + len(w) // 45) if cut == 0 and len(w) > 45 else 0
        for _ in range(edits):
            at = r.randrange(len(w))
            how = r.choice("xid")
            w[at : at + 1] = ["changed"] if how == "x" else ["added", w[at]] if how == "i" else []
        w = w[cut:] if r.random() < 0.5 else w[: len(w) - cut]
        docs.append((i, " ".join([*r.choices(vocabulary, k=25), *w, *r.choices(vocabulary, k=25)])))
    out = simwindows.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {x.doc_id: {i["item"] for i in x["items"]} for x in out.collect()}
    texts = dict(items)
    for i, t in docs:
        want = set(similar(t, [(i, texts[i])]))  # no shingle is in two items, so weights are alike
        held, found = held + len(want), found + len(want & got[i])
    assert held > 300 and found >= 0.99 * held, (found, held)
