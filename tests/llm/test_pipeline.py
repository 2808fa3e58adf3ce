import random
import re

import pytest
from brute import base_spans, components

pytest.importorskip("public_tokenizers")


def test_stages(spark, small, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "benchmark_items", "secrets", "pieces"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(9001, "123 456 !!", "en", "src1", 10), (9002, None, None, None, None)], docs.schema)
    docs, kept = docs.union(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "pieces":
            assert out.columns == docs.columns
        p = str(tmp_path / name)
        out.write.parquet(p)
        kept[name] = [r for r in spark.read.parquet(p).collect()]
        docs = spark.read.parquet(p)
    ids = lambda n: {r.doc_id for r in kept[n]}
    assert 9001 not in ids("language") and 9002 not in ids("language") and len(kept["language"]) == 200
    near = components([(r.doc_id, r.text) for r in kept["language"]], 5, 80)
    assert ids("near_copies") == {i for i, (_, c) in near.items() if i == c}
    items = [re.sub(r"\s+", " ", r.text.lower()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = {r.doc_id for r in kept["near_copies"] if any(t in re.sub(r"\s+", " ", r.text.lower()) for t in items)}
    assert not held & ids("benchmark_items") and len(ids("near_copies") - ids("benchmark_items") - held) <= 1
    assert all(base_spans(r.text) == "" and r.n_chars == len(r.text) for r in kept["secrets"])
    assert [r.text for r in sorted(kept["pieces"])] == [r.text for r in sorted(kept["secrets"])]


WORDS = {"en": "the house and the tree with water", "de": "der baum und das haus mit wasser", "it": "il gatto mangia la pizza sotto il tavolo", "fr": "la maison et un arbre avec eau", "es": "el perro corre por la calle del pueblo"}


def test_other_languages_go_and_the_found_one_is_written(spark):
    import corpus_pipeline

    r, rows = random.Random(3), []
    for k in range(250):
        lang = list(WORDS)[k % 5]
        rows.append((k, " ".join(r.choices(WORDS[lang].split(), k=r.randrange(6, 25))), lang, "own"))
    wrong = [(900, "the house and the tree with the water and the house", "it", "own"), (901, "il gatto mangia la pizza il gatto sotto il tavolo", "en", "own"), (902, "12 34", "en", "own"), (903, None, "en", "own"), (904, "der baum und das haus mit wasser", None, "own")]
    docs = spark.createDataFrame(rows + wrong + wrong[:1], "doc_id bigint, text string, lang string, said string")
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((x.doc_id, x.lang, x.said) for x in out.collect())
    assert got == sorted([(k, lang, "own") for k, _, lang, _ in rows if lang != "it"] + [(900, "en", "own"), (900, "en", "own"), (904, "de", "own")])


def test_a_text_that_no_classifier_claims_goes(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"{WORDS['en']} {k}", "en") for k in range(9)] + [(k, f"{WORDS['de']} {k}", "de") for k in range(9, 18)], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert corpus_pipeline.language(spark, docs, "").count() == 0
    assert corpus_pipeline.language(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("rows", [0, 4])
def test_stages_with_extra_columns_and_hard_rows(spark, tmp_path, rows):
    """Columns named as those that operators use inside, nulls in every column, repeated rows, an empty table."""
    import corpus_pipeline

    hard = [(1, "some words of a text with token=abcdefgh1 in it", "en", "s", 9, "own", "own", 1, "own"), (None,) * 9, (2, "", "en", None, 0, "own", "own", 1, "own"), (2, "", "en", None, 0, "own", "own", 1, "own")][:rows]
    docs = spark.createDataFrame(hard, "doc_id bigint, text string, lang string, source string, n_chars bigint, items string, spans string, ids int, d string")
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        want = docs.count() - (1 if name == "near_copies" and rows else 0)  # one of two equal rows
        assert len(got) == want, name
        if name == "pieces":
            assert {"items", "spans", "d", "n_chars"} <= set(out.columns)
        else:
            assert out.columns == docs.columns and all(x["items"] == x.spans == x.d for x in got)


def test_run(spark, small):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, small).count() > 100
