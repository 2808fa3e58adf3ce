"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import importance, oracles, prefixtrie
from .scratch import Scratch

#: Rules of op1 (fixed values).
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Share of label-1 votes from which op7 predicts 1 (fixed value).
GOOD = 0.3
#: Least cosine of linked vectors in op11 (fixed value).
COSINE = 0.9


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _fold(of: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def op1_url_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlalias import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op2_separator_scan(spark: SparkSession, sf_dir: str, ranks: str | None = None, separator: int = 50256) -> DataFrame:
    """Token counts of every document: texts go to flat token files, whose separators are then searched."""
    from .separators import document_tokens, write_tokens

    scratch = Scratch(spark, "tokens")
    folder = scratch.path("flat")
    ranks = ranks or _vocabulary("byte_bpe_multi_50k.tiktoken")
    manifest = scratch.keep(write_tokens(_table(spark, sf_dir, "documents"), folder, ranks, separator), "manifest")
    counts = scratch.keep(document_tokens(manifest, separator, scratch).withColumnRenamed("id", "doc_id"), "counts")
    scratch.remove(folder)
    return counts


def op3_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .density import extract

    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract(spark, F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosenpath import similarity_components

    found = similarity_components(_table(spark, sf_dir, "documents"), width=3, hundredths=85)
    return found.withColumnRenamed("id", "doc_id")


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decisionlist import fit, statistics, verdict

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, _table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return statistics(docs).select(*base, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op6_credential_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import credentials as c

    s = F.col("spans")
    return c.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[c.count(s, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(c.joined(c.base_only(s)), 256).alias("base_sha256"),
        c.joined(s).alias("spans"),
    )


def op7_lsa_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lsavotes import fit

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels"), where=_fold(5, "id") != 0)
    scored = docs.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), model.score(spark, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simwindows import contamination

    found = contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("items", lambda x: x["similarity"]))
    return found.select("doc_id", F.transform("items", lambda x: x["item"]).alias("item_ids"), F.coalesce(best, F.lit(0.0)).alias("similarity"), (F.size("items") > 0).alias("contaminated"))


def op9_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langkernel import fit

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, where=_fold(4) != 2)
    out = docs.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), model.predict(spark, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_piece_fst(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids of every text, their number, and whether decoding gives the text back."""
    from .piecefst import codec

    coded = codec(spark, model or _vocabulary("piece_bpe_32k.model"))
    out = _table(spark, sf_dir, "documents").select("doc_id", "text", coded(F.col("text")).alias("p"))
    return out.select("doc_id", F.size("p.ids").cast("bigint").alias("n_pieces"), F.col("p.ids").alias("ids"), (F.col("p.text") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rpforest import cosine_components

    return cosine_components(_table(spark, sf_dir, "embeddings"), cosine=COSINE).withColumnRenamed("id", "vec_id")


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_url_alias": op1_url_alias,
    "op2_separator_scan": op2_separator_scan,
    "op3_text_density": op3_text_density,
    "op4_chosen_path": op4_chosen_path,
    "op5_decision_list": op5_decision_list,
    "op6_credential_link": op6_credential_link,
    "op7_lsa_votes": op7_lsa_votes,
    "op8_simhash_windows": op8_simhash_windows,
    "op9_language_kernel": op9_language_kernel,
    "op10_piece_fst": op10_piece_fst,
    "op11_projection_forest": op11_projection_forest,
    "op12_importance_resample": op12_importance_resample,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_url_alias": oracles.url_alias(URL_RULES),
    "op4_chosen_path": oracles.shingle_components(3, 85),
    "op11_projection_forest": oracles.cosine_components(COSINE),
    "op12_importance_resample": oracles.resampling(importance.PERCENT, importance.LEAST_WORDS, importance.SEED, importance.BUCKETS),
    "op13_prefix_trie": oracles.prefix_trie(prefixtrie.FAMILY, prefixtrie.HEADS),
}
