"""Quality rules: text statistics in Spark expressions, and decision lists learned from labelled statistics.

Everything that touches the corpus is a DataFrame expression. Learning works on a bounded
number of labelled rows of statistics on the driver, and emits a `CASE WHEN` column.
"""

from __future__ import annotations

from bisect import bisect_left
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Bounds of the fit: labelled rows (in expectation), rules, conditions of a rule, thresholds tried per statistic and step.
LABELLED, RULES, CONDITIONS, CUTS = 8000, 12, 4, 64
#: A rule stays in the list if, on rows it was not grown on, this share of what it covers is of low quality, and it covers this many.
PRECISION, COVER = 0.8, 8
FEATURES = ("n_words", "mean_word", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "distinct_share", "mark_share")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the statistics in FEATURES.

    Names of these columns are replaced if docs has them. A null text counts as empty;
    shares of an empty text are 0. Texts are read whole, as they are (no case folding).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in docs.columns if c not in ("_words", "_win", "_sorted", "_lines", *FEATURES, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    d = docs.select(*own, F.array_remove(F.split(t, SPACES), "").alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    n = F.size("_words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.expr("cast(array() as array<bigint>)"))
    d = d.withColumn("_win", windows)
    # only a text with a repeated window needs the positions of its windows in order of their hashes
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = F.filter("_sorted", lambda e, k: (F.get(F.col("_sorted"), k - 1)["h"] == e["h"]) | F.coalesce(F.get(F.col("_sorted"), k + 1)["h"] == e["h"], F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda e: e["i"])),
        F.struct(F.lit(-9).alias("at"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    count = lambda keep: F.length(F.regexp_replace(t, keep, "")).cast("bigint")
    per = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    d = d.select(
        *own,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").alias("_lines"),
        count(r"[^A-Z]+").alias("_upper"),
        count(r"[^!?]+").alias("_marks"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
    )
    w = F.col("n_words")
    return d.select(
        *[c for c in d.columns if c not in ("_lines", "_upper", "_marks", "_distinct")],
        per(F.col("word_chars"), w).alias("mean_word"),
        per(F.col("n_symbols"), w).alias("symbol_share"),
        per(F.col("n_repeat_words"), w).alias("repeat_share"),
        per(F.col("n_dup_lines"), F.col("_lines")).alias("dup_line_share"),
        per(F.col("_upper"), F.col("word_chars")).alias("upper_share"),
        per(F.col("_distinct"), w).alias("distinct_share"),
        per(F.col("_marks"), w).alias("mark_share"),
    )


Rule = list[tuple[int, str, float]]


def _covers(rule: Rule, x: tuple) -> bool:
    return all(x[f] >= v if op == ">=" else x[f] < v for f, op, v in rule)


def _best_condition(rows: list[tuple[tuple, bool]]) -> tuple[float, tuple | None]:
    """The threshold condition of the largest information gain for the low label (FOIL's measure)."""
    p0 = sum(y for _, y in rows)
    n0 = len(rows) - p0
    base = log2(p0 / (p0 + n0))
    found: tuple[float, tuple | None] = (0.0, None)
    for f in range(len(rows[0][0])):
        order = sorted((x[f], y) for x, y in rows)
        keys = [k for k, _ in order]
        below = [0]
        for _, y in order:
            below.append(below[-1] + y)
        distinct = sorted(set(keys))
        step = max(1, len(distinct) // CUTS)
        for v in distinct[step::step] if len(distinct) > 1 else ():
            i = bisect_left(keys, v)
            for op, p, n in (("<", below[i], i - below[i]), (">=", p0 - below[i], len(order) - i - p0 + below[i])):
                if p and (gain := p * (log2(p / (p + n)) - base)) > found[0] + 1e-9:
                    found = gain, (f, op, v)
    return found


def learn(rows: list[tuple[tuple, bool]]) -> list[Rule]:
    """Sequential covering: ordered conjunctions that mark low quality.

    rows are (statistics, is_low). Two thirds grow a rule by conditions of the largest
    gain; the other third prunes its last conditions while that raises the share of low
    rows it covers, and decides if it stays. What a rule covers leaves both parts.
    """
    grow, prune = [r for k, r in enumerate(rows) if k % 3], [r for k, r in enumerate(rows) if not k % 3]
    rules: list[Rule] = []
    while len(rules) < RULES and any(y for _, y in grow) and not all(y for _, y in grow):
        rule: Rule = []
        left = grow
        while len(rule) < CONDITIONS and any(not y for _, y in left):
            _, condition = _best_condition(left)
            if condition is None:
                break
            rule.append(condition)
            left = [r for r in left if _covers(rule, r[0])]
        worth = lambda r: (sum(y for x, y in prune if _covers(r, x)) + 1) / (sum(1 for x, _ in prune if _covers(r, x)) + 2)
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = [y for x, y in prune if rule and _covers(rule, x)]
        if len(hit) < COVER or sum(hit) < PRECISION * len(hit):
            break
        rules.append(rule)
        grow = [r for r in grow if not _covers(rule, r[0])]
        prune = [r for r in prune if not _covers(rule, r[0])]
    return rules


def verdict(rules: list[Rule], features: tuple[str, ...] = FEATURES) -> Column:
    """The decision list as one ordered conditional: False at the first rule that fits, else True."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for f, op, v in rule:
            fits = fits & (F.col(features[f]) >= v if op == ">=" else F.col(features[f]) < v)
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def describe(rules: list[Rule], features: tuple[str, ...] = FEATURES) -> list[str]:
    """The list in words, first rule first."""
    return [" and ".join(f"{features[f]} {op} {v:.6g}" for f, op, v in rule) + " -> drop" for rule in rules] + ["else -> keep"]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Learn from about LABELLED labelled texts, chosen by a hash of the id.

    Null ids, texts and labels teach nothing; no labels, or an empty table, give an empty
    list, which keeps everything. An id counts once however often it is repeated: with the
    least of its texts and, of several labels, the least. Of equal gains the first statistic in
    FEATURES and the least threshold win. Other columns are ignored."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    n = marked.count()
    if not n:
        return []
    few = marked.where(F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(5)), F.lit(1 << 30)) < min(1 << 30, LABELLED * (1 << 30) // n))
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(few.groupBy("_id").agg(F.min("_y").alias("_y"))), "_id")
    chosen = chosen.groupBy("_id", "_y").agg(F.min("text").alias("text"))
    rows = statistics(chosen).select(F.xxhash64(F.col("_id").cast("string")), "_y", *FEATURES).collect()
    return learn([(tuple(float(v) for v in r[2:]), r[1] == 0) for r in sorted(rows)])
