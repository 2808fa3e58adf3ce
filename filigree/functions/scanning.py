"""Matches of a pattern with their places in a text, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once however often f names it."""
    return F.transform(F.array(x), f)[0]


def running_sums(xs: Column) -> Column:
    """The sum up to each element of an array of numbers: every step doubles how far back an element has seen, so n elements take n log n additions."""

    def run(xs):
        reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(xs), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(reach, xs, lambda sums, d: F.transform(sums, lambda x, i: F.when(i >= d, x + F.get(sums, i - d)).otherwise(x)))

    return bind(xs, run)


#: Characters of the text that a place carries from before and behind it, and the fewest that a match of any pattern here has.
BEFORE, BEHIND, LEAST = 30, 300, 5


def places(text: Column, pattern: str, group: int = 0, part: str = "", clue: Column | None = None) -> Column:
    """The leftmost non-overlapping matches of a pattern as array<struct<pos, end, said, before, after>>; empty where there is none, null for a null text.

    pos counts characters from 0 and end is behind the match; said is the match, one of its
    groups, or what the pattern `part` finds in the match alone, which spares a reading of the text; before and after are the BEFORE characters in front of it and the BEHIND ones behind it. The pattern takes at
    least LEAST characters. Gaps (a split by the pattern) and matches take turns, so running sums of their
    lengths are the places, and the surroundings are put together from the pieces nearby:
    a text is read a fixed number of times, however many matches it has, and not at all where a clue, true for all texts with a match, is false."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.transform(matches, lambda m: F.regexp_extract(m, part, 0)) if part else matches
    ahead, back = 2 * -(-BEHIND // LEAST) + 1, 2 * -(-BEFORE // LEAST) + 1

    def near(p):
        n = F.size(p["m"])
        in_turn = lambda gaps, cut: F.flatten(F.zip_with(F.transform(gaps, cut), p["m"], lambda g, m: F.array(g, m)))
        return F.struct(
            running_sums(F.zip_with(F.slice(p["g"], 1, n), p["m"], lambda g, m: F.length(g) + F.length(m))).alias("ends"),
            F.flatten(F.zip_with(F.transform(F.slice(p["g"], 2, n), lambda g: F.substring(g, 1, BEHIND)), F.transform(p["m"], lambda m, i: F.coalesce(F.get(p["m"], i + 1), F.lit(""))), lambda g, m: F.array(g, m))).alias("behind"),
            in_turn(F.slice(p["g"], 1, n), lambda g: F.right(g, F.lit(BEFORE))).alias("front"),
            p["m"].alias("m"),
            p["v"].alias("v"),
        )

    def placed(q):
        def one(m, i):
            to = 2 * i + 1
            return F.struct(
                (F.get(q["ends"], i) - F.length(m)).alias("pos"),
                F.get(q["ends"], i).alias("end"),
                F.get(q["v"], i).alias("said"),
                F.right(F.array_join(F.slice(q["front"], F.greatest(F.lit(1), to - back + 1), F.least(F.lit(back), to)), ""), F.lit(BEFORE)).alias("before"),
                F.substring(F.array_join(F.slice(q["behind"], to, F.lit(ahead)), ""), 1, BEHIND).alias("after"),
            )

        return F.transform(q["m"], one)

    none = F.array().cast("array<struct<pos:int,end:int,said:string,before:string,after:string>>")
    pieces = F.struct(F.split(text, pattern, -1).alias("g"), matches.alias("m"), said.alias("v"))
    some = text.rlike(pattern) if clue is None else clue & text.rlike(pattern)
    return F.when(some, bind(bind(pieces, near), placed)).when(text.isNotNull(), none)
