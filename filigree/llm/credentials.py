"""Secret scans with multipart credential linking, in Spark expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Patterns that count by themselves (fixed values): kind, pattern, group whose length is tested, least length.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Patterns too weak to count alone: kind, pattern.
WEAK = (
    ("weak_id", r"""(?<![A-Za-z0-9_])(?:[cC]lient_?[iI]d|[kK]ey_?[iI]d|[aA]ccount|[uU]ser(?:name)?|[lL]ogin|USER(?:NAME)?|CLIENT_ID)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""),
    ("weak_secret", r"""(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])|(?<![A-Za-z0-9_])(?:[pP]wd|PWD|[aA]uth|[cC]redentials?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    ("weak_endpoint", r"""(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!&=+%-]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])"""),
)
#: What every match of a kind contains, where that spares most texts a search.
LITERAL = {"access": "AKIA"}
#: Parts belong together if at most this many characters lie between their starts.
SCOPE = 200
ROLE = {"access": "id", "assign": "secret", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "weak_endpoint": "endpoint"}
#: Spans at one start are in this order.
ORDER = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
KINDS_AT = {k: n for n, k in enumerate(ORDER)}
#: A span: its characters, and its bytes of UTF-8 (ends exclusive).
SPANS = "array<struct<start:int,k:int,end:int,at:int,to:int>>"
FAR = 1 << 29


def _with(value: Column, body) -> Column:
    """body of a value that is computed once: inside a lambda a column expression is computed anew for every element, a lambda's variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scanned(parts: Column, join) -> Column:
    """Running totals of an array under an associative `join` of an earlier and a later element.

    In step k every element takes in the one 2^k places before it, so n elements need n log n
    joins: an accumulator that carries the array built so far would copy n elements n times."""

    def run(p):
        steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(p), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(steps, p, lambda a, d: F.transform(a, lambda x, i: F.when(i >= d, join(F.get(a, i - d), x)).otherwise(x)))

    return _with(parts, run)


def _found(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches.

    Matches and the gaps between them (a split by the same pattern) take turns, so running
    sums of their lengths are the positions. Texts without a match cost one search."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # a pattern with a group looks at nothing outside its match, so the group is found in the match again
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    parts = F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda p: p["m"].isNotNull())
    sizes = F.transform(
        parts,
        lambda p: F.struct(
            (F.length(p["g"]) + F.length(p["m"])).alias("end"), (F.octet_length(p["g"]) + F.octet_length(p["m"])).alias("to"), F.length(p["m"]).alias("n"), F.octet_length(p["m"]).alias("b"), F.length(value(p["m"])).alias("size")
        ),
    )
    later = lambda x, y: F.struct((x["end"] + y["end"]).alias("end"), (x["to"] + y["to"]).alias("to"), y["n"].alias("n"), y["b"].alias("b"), y["size"].alias("size"))
    kept = F.filter(_scanned(sizes, later), lambda s: s["size"] >= least)
    named = F.transform(kept, lambda s: F.struct((s["end"] - s["n"]).alias("start"), F.lit(KINDS_AT[kind]).alias("k"), s["end"].alias("end"), (s["to"] - s["b"]).alias("at"), s["to"].alias("to")))
    mark = LITERAL.get(kind)
    there = text.rlike(pattern) if mark is None else F.contains(text, F.lit(mark)) & text.rlike(pattern)
    return F.when(there, named).otherwise(F.array().cast(SPANS))


def _is(s: Column, role: str) -> Column:
    return s["k"].isin([KINDS_AT[k] for k, r in ROLE.items() if r == role])


def _passed(parts: Column, far: int) -> Column:
    """For each part in turn, the last start so far of each role (far if there was none); parts run up if far is negative, else down."""
    last = F.greatest if far < 0 else F.least
    own = F.transform(parts, lambda p: F.struct(*[F.when(_is(p, r), p["start"]).otherwise(F.lit(far)).alias(f) for r, f in (("id", "i"), ("secret", "s"), ("endpoint", "e"))]))
    return _scanned(own, lambda x, y: F.struct(*[last(x[f], y[f]).alias(f) for f in ("i", "s", "e")]))


def _linked(parts: Column) -> Column:
    """Weak parts of a sorted array whose scope holds their complement: an interval join by one pass from each end."""
    zipped = F.arrays_zip(parts.alias("p"), _passed(parts, -FAR).alias("b"), F.reverse(_passed(F.reverse(parts), FAR)).alias("a"))

    def near(z, f):
        return (z["p"]["start"] - z["b"][f] <= SCOPE) | (z["a"][f] - z["p"]["start"] <= SCOPE)

    def counts(z):
        k = z["p"]["k"]
        return (
            ((k == KINDS_AT["weak_id"]) & near(z, "s"))
            | ((k == KINDS_AT["weak_secret"]) & (near(z, "i") | near(z, "e")))
            | ((k == KINDS_AT["weak_endpoint"]) & near(z, "i") & near(z, "s"))
        )

    return F.transform(F.filter(zipped, counts), lambda z: z["p"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`: array<struct<start, k, end, at, to>> in order of start and kind (ORDER): k the place in ORDER, start and end in characters, at and to in bytes.

    Base kinds always count. A weak part counts only if its complement starts within SCOPE
    characters of it in the same text: a secret needs an identifier or an endpoint, an
    identifier needs a secret, an endpoint needs both. The interval join of the parts runs
    inside the row: no shuffle, and a text is never split from its parts; n matches take
    n log n steps, so a very long text full of them is no special case. Null and empty
    texts have no spans, an empty table no rows; repeated rows are scanned each on its own;
    parts at one start both count, in the order of ORDER; other columns stay, and one named
    `spans` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[_found(t, *b) for b in BASE])
    own = [c for c in docs.columns if c != "spans"]
    mark = "_"
    while any(c.startswith(mark) for c in own):  # columns of the scan have names that no other has
        mark += "_"
    x, b, w, a, m = (mark + c for c in ("text", "base", "weak", "all", "more"))
    d = docs.select(*own, t.alias(x), base.alias(b), _found(t, *WEAK[1]).alias(w))
    # without a secret, strong or weak, no weak part counts: most texts are not searched for the others
    secret = (F.size(w) > 0) | F.exists(b, lambda s: _is(s, "secret"))
    d = d.select(*own, b, F.when(secret, F.concat(F.col(w), *[_found(F.col(x), *k) for k in (WEAK[0], WEAK[2])])).alias(w))
    d = d.select(*own, b, F.when(F.size(w) > 0, F.sort_array(F.concat(b, w))).alias(a))
    d = d.select(*own, b, F.when(F.exists(a, lambda s: _is(s, "secret")), _linked(F.col(a))).alias(m))
    return d.select(*own, F.sort_array(F.concat(F.col(b), F.coalesce(m, F.array().cast(SPANS)))).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["k"] < len(BASE))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == KINDS_AT[kind])).cast("bigint")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span (overlapping ones as one) replaced by mark; spans sorted by start.

    Pieces are cut by bytes, for a place among characters is found only by counting from the start."""
    ends = _scanned(F.transform(spans, lambda s: s["to"]), lambda x, y: F.greatest(x, y))

    def cut(b):
        between = F.transform(
            F.arrays_zip(spans.alias("s"), F.concat(F.array(F.lit(0)), b["ends"]).alias("e")),
            lambda z: F.when(z["s"].isNull(), F.substring(b["raw"], z["e"] + 1, F.octet_length(b["raw"])).cast("string"))
            .when(z["s"]["at"] >= z["e"], F.concat(F.substring(b["raw"], z["e"] + 1, z["s"]["at"] - z["e"]).cast("string"), F.lit(mark)))
            .otherwise(F.lit("")),
        )
        return F.array_join(between, "")

    return F.when(F.size(spans) > 0, _with(F.struct(F.encode(text, "UTF-8").alias("raw"), ends.alias("ends")), cut)).otherwise(text)
