"""Raw documents to encoded training text: language, near copies, benchmark items, secrets, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filigree.llm import chosenpath, credentials, langkernel, piecefst, simwindows
from filigree.llm.scratch import Scratch


def free(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    while name in columns:
        name += "_"
    return name


#: Languages that the corpus is for, and the least score of one (a one-versus-rest value of -0.5).
LANGUAGES, LEAST_SCORE = ("de", "en", "es", "fr"), 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the kernel classifier, learned from docs, finds to be in one of LANGUAGES with a score of LEAST_SCORE or more; lang becomes what it finds.

    Texts that are null or have no letter (`und`) go, as do those of other languages that docs
    has labels of. Without labels nothing is learned: texts with a letter stay as they are.
    Rows are judged each by its text, so repeated rows stay or go together; extra columns
    stay as they are; an empty table stays empty."""
    model = langkernel.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = docs.columns
    said = free("said", own)
    good = docs.withColumn(said, model.predict(spark, F.col("text"))).where(F.col(said)["lang"].isin(*LANGUAGES) & (F.col(said)["score"] >= LEAST_SCORE))
    return good.select(*[F.col(said)["lang"].alias("lang") if c == "lang" else F.col(c) for c in own])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Null, empty and blank texts are copies of nothing and stay; rows with a null id stay; of
    rows that repeat an id and a text one stays; extra columns stay as they are."""
    return chosenpath.deduplicate(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item. Null and empty texts and items hold nothing; equal rows stay or go together; extra columns stay, one named `items` too."""
    other = free("items", docs.columns)
    held = simwindows.contamination(docs.withColumnRenamed("items", other), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return held.where(F.size("items") == 0).drop("items").withColumnRenamed(other, "items")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace credentials in texts by a mark; n_chars follows. Every row stays, null and empty texts as they are (0 characters); extra columns stay, one named `spans` too."""
    own, other = docs.columns, free("spans", docs.columns)
    found = credentials.scan(docs.withColumnRenamed("spans", other))
    clean = found.withColumn("text", credentials.redact(F.col("text"), F.col("spans"))).drop("spans").withColumnRenamed(other, "spans")
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*own)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and the text that decoding gives back, beside the other columns (those named ids or n_pieces are replaced). Null and empty texts have no ids and an empty text."""
    import public_tokenizers

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    own = [c for c in docs.columns if c not in ("text", "n_pieces", "ids")]
    p = free("p", own)
    out = docs.select(*own, piecefst.codec(spark, model)(F.col("text")).alias(p))
    return out.select(*own, F.size(f"{p}.ids").cast("bigint").alias("n_pieces"), F.col(f"{p}.ids").alias("ids"), F.col(f"{p}.text").alias("text"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_items", benchmark_items),
    ("secrets", secrets),
    ("pieces", pieces),
]
#: Learned models and iterated components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
