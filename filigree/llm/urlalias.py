"""URL filters: rules on host and path, carried over redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .scratch import Scratch

#: Most rules that become one expression; more are joined by host.
INLINE = 200


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without it or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The name of a page in the alias graph: scheme and host in lower case, no fragment, / for no path, no . and .. in the path; null without a host."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.concat(scheme, F.lit("://"), host(url), plain_path(path(url)), query))


def plain_path(p: Column) -> Column:
    """A path without . and .. segments, / for an empty one."""
    up = lambda a: F.regexp_replace(a, r"/[^/]*$", "")
    walked = F.aggregate(F.split(F.substr(p, F.lit(2)), "/"), F.lit(""), lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.lit("/"), x)))
    done = F.when(p.rlike(r"/\.\.?$"), F.concat(walked, F.lit("/"))).otherwise(walked)
    return F.when(p == "", "/").when(p.rlike(r"/\.\.?(/|$)"), done).otherwise(p)


#: Character references that addresses in attributes use, the ampersand last (fixed values).
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#x26;", "&"), ("&#38;", "&"), ("&amp;", "&"))
#: What is no markup of the page: comments and scripts (fixed value).
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>"
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _href(tag: Column) -> Column:
    return F.concat(*[F.regexp_extract(tag, rf"(?i)\bhref\s*=\s*{_VALUE}", k) for k in (1, 2, 3)])


def _decoded(x: Column) -> Column:
    """An attribute's value without white space around it, with its character references read."""
    out = F.regexp_replace(x, r"^\s+|\s+$", "")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def resolved(x: Column, base: Column) -> Column:
    """An address as seen from a page at base (. and .. stay, node reads them)."""
    origin = F.regexp_extract(base, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(x.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), x)
        .when(x.startswith("//"), F.concat(F.regexp_extract(base, r"^(.*?:)//", 1), x))
        .when(x.startswith("/"), F.concat(origin, x))
        .when(folder.endswith("/"), F.concat(folder, x))
        .otherwise(F.concat(folder, F.lit("/"), x))
    )


def targets(html: Column, url: Column) -> Column:
    """Absolute urls that a page names as its canonical address or refreshes to (array, empty if none), seen from its base element where it has one; comments and scripts do not count."""
    h = F.regexp_replace(html, HIDDEN, "")
    links = F.filter(F.regexp_extract_all(h, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    metas = F.filter(F.regexp_extract_all(h, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    moves = F.transform(metas, lambda t: F.regexp_extract(t, r"""(?i)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*['"]?([^"'>\s]+)""", 1))
    raw = F.filter(F.transform(F.concat(F.transform(links, _href), moves), _decoded), lambda x: x != "")
    named = _decoded(_href(F.regexp_extract(h, r"(?is)<base\b[^>]*>", 0)))
    base = F.when(named != "", resolved(named, url)).otherwise(url)
    # a lambda's variable is computed once
    absolute = F.get(F.transform(F.array(base), lambda b: F.transform(raw, lambda x: resolved(x, b))), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(html.rlike(r"(?i)\bcanonical\b|\bhttp-equiv\s*=\s*[\"']?refresh"), absolute).otherwise(none)


def _fits(h: Column, p: Column, rule: str) -> Column:
    name, _, rest = rule.partition("/")
    return ((h == name) | h.endswith("." + name)) & p.startswith("/" + rest)


def ruled(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rows (with host and path) with `rule` and `said` (allow or block) of the longest rule that fits (allow before block, then the rule's order, among equally long ones); null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Few rules
    are one conditional expression; many are joined by each suffix of the host.
    """
    order = sorted(set(rules), key=lambda r: (-len(r[0]), r[0], r[1]))
    if len(order) <= INLINE:
        rule = said = None
        for r, v in order:
            fits = _fits(F.col("host"), F.col("path"), r)
            rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
            said = F.when(fits, F.lit(v)) if said is None else said.when(fits, F.lit(v))
        none = F.lit(None).cast("string")
        return rows.withColumn("rule", none if rule is None else rule).withColumn("said", none if said is None else said)
    table = rows.sparkSession.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], k, r, v) for k, (r, v) in enumerate(order)], "suffix string, start string, n int, rule string, said string")
    by = table.groupBy("suffix").agg(F.array_sort(F.collect_list(F.struct("n", "start", "rule", "said"))).alias("own"))
    hosts = rows.select("host", "path").distinct()  # a common host is looked up once per path
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hit = hosts.withColumn("suffix", F.explode(suffixes)).join(by, "suffix").select("host", "path", F.get(F.filter("own", lambda r: F.col("path").startswith(r["start"])), F.lit(0)).alias("r")).where("r is not null")
    best = hit.groupBy("host", "path").agg(F.min("r").alias("r")).select("host", "path", F.col("r.rule").alias("rule"), F.col("r.said").alias("said"))
    return rows.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Verdict of every page: (id, host, path, rule, verdict, alias_of).

    rules are (host/path, allow or block). The page's own rule decides where there is one.
    Else its aliases decide: pages and addresses tied to it by any chain of canonical
    links, refreshes (from `html`) and `redirects` (src, dst). An allow rule on any alias
    takes precedence over block rules on others; a block rule alone blocks; no rule
    allows. alias_of is the smallest address of the chain, null for a page without edges.

    Null and malformed urls have empty host and path, no aliases and are allowed; null html
    has no links; relative links are resolved, from the base element where there is one;
    self-links and repeated edges change nothing; repeated rows are judged alike, rows with a
    null id too; an empty table has no verdicts. Among equally long rules that fit, allow
    comes before block. Urls and html of any length are read whole. Other columns of pages
    are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urlalias")
    none = F.array().cast("array<string>")
    link = F.coalesce(targets(F.col("h"), F.col("u")), none) if html else none
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("u"), *([F.col(html).alias("h")] if html else []))
    rows = rows.select("id", "u", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"), node(F.col("u")).alias("node"), link.alias("links"))
    rows = scratch.keep(ruled(rows, rules), "pages")
    edges = rows.where("node is not null").select("node", F.explode("links").alias("t")).select(F.col("node").alias("a"), node(F.col("t")).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")))
    labels = scratch.keep(connected_components(edges, scratch), "aliases")
    places = ruled(labels.select("node", "component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), rules)
    decided = places.groupBy("component").agg(F.max(F.when(F.col("said") == "allow", 1)).alias("allows"), F.max(F.when(F.col("said") == "block", 1)).alias("blocks"))
    carried = labels.join(decided, "component").select("node", "component", F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").otherwise("allow").alias("carried"))
    out = rows.drop("links").join(carried, "node", "left")
    return out.select("id", "host", "path", "rule", F.coalesce("said", "carried", F.lit("allow")).alias("verdict"), F.col("component").alias("alias_of"))
