"""Labels of excerpts, prompt blocks, and citations checked against what was retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Patterns of chunk ids and labels (fixed values).
CHUNK_ID = r"[A-Z][A-Z.]{0,5}-10-[KQ]-\d{4}-(?:FY|Q[1-4])-[a-z_]+-\d+"
LABEL = r"[A-Z][A-Z.]{0,5}-\d+"
BRACKET = r"\[([^\[\]]+)\]"


def labels(hits: DataFrame, by: tuple[str, ...] = ("ticker",), order: tuple[str, ...] = ("fiscal_year", "place")) -> DataFrame:
    """hits with `label`: ticker and 1-based number in the order of the hits."""
    w = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("label", F.concat_ws("-", "ticker", F.row_number().over(w)))


def prompt_block(rows: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(by, block): labelled excerpts of each group as prompt text. rows need label, company, form, fiscal_label, period_end, section, text."""
    head = F.format_string("[%s] (%s, %s %s, period ending %s, section %s)\n%s", "label", "company", "form", "fiscal_label", F.col("period_end").cast("string"), "section", "text")
    n = F.regexp_extract("label", r"-(\d+)$", 1).cast("int")
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), head.alias("t")))), lambda x: x["t"]), "\n\n").alias("block"))


def resolve(text: Column, known: Column) -> Column:
    """text with each bracket of labels alone, such as [AA-1, AA-2], by the ids that map `known` gives; labels it lacks stay, other brackets are untouched."""
    pieces = F.split(text, r"(?=\[[^\[\]]+\])|(?<=\])")

    def one(p):
        inner = F.regexp_extract(p, rf"^{BRACKET}$", 1)
        parts = F.transform(F.split(inner, "[,;]"), lambda x: F.trim(x))
        cites = (inner != "") & F.forall(parts, lambda x: x.rlike(rf"^{LABEL}$"))
        return F.when(cites, F.concat(F.lit("["), F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), x)), ", "), F.lit("]"))).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def cited_labels(text: Column) -> Column:
    """Labels in brackets of labels alone, in order, repeats kept."""
    inner = F.regexp_extract_all(text, F.lit(BRACKET), F.lit(1))
    parts = F.transform(inner, lambda b: F.transform(F.split(b, "[,;]"), lambda x: F.trim(x)))
    return F.flatten(F.filter(parts, lambda ps: F.forall(ps, lambda x: x.rlike(rf"^{LABEL}$"))))


def unknown_labels(text: Column, known: Column) -> Column:
    """Cited labels that map `known` lacks."""
    return F.filter(cited_labels(text), lambda x: F.try_element_at(known, x).isNull())


def citations(text: Column) -> Column:
    """Distinct chunk ids in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CHUNK_ID), F.lit(0)))


def validated(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """answers (aid, text) with `valid` and `invalid` citations against retrieved (aid, id)."""
    cited = answers.select("aid", F.posexplode(citations(F.col("text"))).alias("k", "id"))
    marked = cited.join(retrieved.select("aid", "id", F.lit(True).alias("there")).distinct(), ["aid", "id"], "left")
    own = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("k", "id")))), lambda x: x["id"])
    by = marked.groupBy("aid").agg(own(F.col("there").isNotNull()).alias("valid"), own(F.col("there").isNull()).alias("invalid"))
    none = F.array().cast("array<string>")
    return answers.join(by, "aid", "left").select("aid", "text", F.coalesce("valid", none).alias("valid"), F.coalesce("invalid", none).alias("invalid"))
