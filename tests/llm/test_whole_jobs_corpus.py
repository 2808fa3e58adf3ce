"""Jobs of the corpus operators that a review found cut short."""

import pytest
from pyspark.sql import functions as F

from filigree.llm import chosenpath, density, langkernel, urlalias

LINE = "The first sentence of the story goes on for a while and then it stops. " * 6
STORY = f"<h1>Head</h1><p>{LINE}</p><p>{LINE}</p>"
TEXT = f"Head\n{LINE.strip()}\n{LINE.strip()}"
SIDE = "<div class='sidebar'><p>Side words here.</p></div>"
READERS = f"<div id='comments' class='comments-area'><article class='comment-body'><p>Reader says. {LINE * 9}</p></article></div>"
BOX = "<div class='elementor-element elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'>{}</div></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='page has-sidebar'><article>{STORY}</article>{SIDE}</div>",
        f"<div class='layout no-sidebar'><div>{STORY}</div>{SIDE}</div>",
        f"<div class='content-sidebar-wrap'><main>{STORY}</main>{SIDE}</div>",
        f"<div class='widget-area'><div class='sidebar-wrap'><div>{STORY}</div></div>{SIDE}</div><p>tiny <a href=x>foot</a></p>",
        f"<article class='post comments-open'>{STORY}{READERS}</article>",
        f"<article>{STORY}<div class='related'><article><p>teaser</p></article></div></article><div class='sidebar'><article>more</article></div>",
        f"<div class='story'>{STORY}</div>{READERS}",
        BOX.format("<h1>Head</h1>" + f"<p>{LINE}</p>") + BOX.format(f"<p>{LINE}</p>") + SIDE,
    ],
)
def test_words_of_wrappers_drop_no_article(page):
    got = density.main_text(f"<body>{page}</body>")
    assert got.endswith(TEXT.partition("\n")[2]) and "Side" not in got and "teaser" not in got and "Reader" not in got


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langkernel, "TEXTS", 100)  # fewer than the languages
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[(k * p + q) % 26] for p, q in ((1, 3), (7, 1), (3, k // 26), (11, k // 13)))
    rows = [(4 * k + j, " ".join([word(k)] * 30), f"l{k:03d}") for k in range(300) for j in range(1 if k > 290 else 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langkernel.fit(docs)
    assert model.languages == [f"l{k:03d}" for k in range(300)]
    got = docs.select("lang", model.predict(spark, F.col("text"))["lang"].alias("p")).where("lang >= 'l256'").collect()
    assert sum(r.lang == r.p for r in got) >= 0.9 * len(got)


def test_pipeline_without_labels_keeps_texts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None)], "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]


def test_near_copies_without_ids_and_texts_under_one_id(spark):
    words = [f"w{k}" for k in range(80)]
    a, b, c = " ".join(words[:60]), " ".join(words[2:62]), " ".join(words[5:65])  # a near b near c, but not a near c
    other, blank = "quite another text that shares no shingle with them", " "
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    got = chosenpath.similarity_components(frame([(3, a), (None, b), (9, c), (None, f"{other} x"), (None, other)]), width=3, hundredths=90)
    assert sorted((r.id or 0, r.component_id or 0, r.kept) for r in got.collect()) == [(0, 0, True), (0, 0, True), (0, 3, False), (3, 3, True), (9, 3, False)]
    docs = [(5, other), (5, b), (3, a), (6, a), (7, other + " one"), (7, "nothing is like this text at all"), (8, blank), (8, "a sole text of its own"), (8, "a sole text of its own"), (2, " ".join(map(str, range(60)))), (2, " ".join(map(str, range(1, 61))))]
    out = sorted((r.doc_id, r.text) for r in chosenpath.deduplicate(frame(docs), width=3, hundredths=90).collect())
    assert [i for i, _ in out].count(2) == 1
    assert [x for x in out if x[0] != 2] == sorted([(5, other), (3, a), (7, other + " one"), (7, "nothing is like this text at all"), (8, blank), (8, "a sole text of its own")])


def test_tied_rules_past_the_inline_limit(spark, monkeypatch):
    urls = ["http://b.org/x", "http://a.b/x/yy", "http://q.a.b/x/yy/z", "http://c.net/p"]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id bigint, url string, html string")
    rules = [("b.org/x", "block"), ("b.org/x", "allow"), ("a.b/x/", "block"), ("b/x/yy", "allow"), ("c.net/p", "allow"), ("c.net/p", "block")]
    few = sorted(map(tuple, urlalias.judge(pages, rules).collect()))
    assert [(r[3], r[4]) for r in few] == [("b.org/x", "allow"), ("a.b/x/", "block"), ("a.b/x/", "block"), ("c.net/p", "allow")]
    monkeypatch.setattr(urlalias, "INLINE", 0)
    assert sorted(map(tuple, urlalias.judge(pages, rules).collect())) == few
