"""A plain Python reading of the section rules, one object per text, to hold the expressions against."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby, pairwise

import numpy as np

from filigree.operators.sections import ANNUAL, ANY, AUDITOR, FALLBACKS, FINANCIAL_SECTION, ITEM, QUARTER_ONE, QUARTER_TITLES, QUARTER_TWO, TITLES, Fallback, title

#: What is left of a contents row behind its heading: a page number at the end of the line or, where only bars are left, of the next (fixed value).
_PAGE = r"[^\n]*\|[^\S\n]*(?:\d{1,3}|N/A)[^\S\n]*(?:\n|\Z)"
CONTENTS = re.compile(rf"{_PAGE}|(?:[^\S\n]|[|.])*\n{_PAGE}")
#: What stands before a heading, nearest rule first: a pattern of the last 30 characters, and whether the place is a mention inside a sentence (fixed values).
BEFORE = (
    (re.compile(r"[\"“(,][ \t]*\Z"), True),
    (re.compile(r"(?:\A[ \t]*|[^ \t]|[.;:|)\]\d\n”][ \t]+)\Z"), False),
    (re.compile(r"(?:\b[A-Z]{2,}|PART\s+[IV]+|Reserved|None|Form 10-[KQ])[ \t]+\Z"), False),
)
_CONDENSED = r"(?:(?:Condensed|CONDENSED)\s*)?"
#: Kinds of places that the scan looks for.
KINDS = {k: re.compile((_CONDENSED if k == "statements" else "") + title(t)) for k, t in TITLES.items()} | {
    "item": re.compile(ITEM),
    "section": re.compile(FINANCIAL_SECTION),
    "auditor": re.compile(AUDITOR),
    "tail": re.compile(title(TITLES["index"]) + "|" + title(TITLES["audit"])),
}


class Places:
    """Columns over the places of a text where a kind of heading may be."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)
        self._of: dict[str, list[re.Match]] = {}

    def of(self, kind: str) -> list[re.Match]:
        if kind not in self._of:
            # titles at the very top are the report's own
            self._of[kind] = list(KINDS[kind].finditer(self.text, self.size // 50 if kind in TITLES else 0))
        return self._of[kind]

    def listed(self, m: re.Match) -> bool:
        """A row of a table of contents, as far as 300 characters tell."""
        return CONTENTS.match(self.text, m.end(), m.end() + 300) is not None

    def mentioned(self, m: re.Match) -> bool:
        """Named in a sentence, and no heading."""
        before = self.text[max(0, m.start() - 30) : m.start()]
        return next((said for pattern, said in BEFORE if pattern.search(before)), True)

    def stands(self, m: re.Match) -> bool:
        return not self.listed(m) and not self.mentioned(m)

    def titled(self, m: re.Match) -> bool:
        """What follows a title starts anew: a capital, a bracket, a bar, a line or nothing."""
        after = self.text[m.end() : m.end() + 5].lstrip(" ")[:1]
        return not after or after.isupper() or after in "\n(|"


class Outline:
    """Real section starts of one document, as a sorted table (place, label, item)."""

    def __init__(self, text: str, form: str):
        self.places, self.form, self.size = Places(text), form, len(text)
        items = self.places.of("item")
        #: Where the body begins: behind the last contents row near the top.
        self.body = max((m.end() for m in items if m.start() < self.size / 10 and self.places.listed(m)), default=0)
        real = [m for m in items if m.start() > self.body and self.places.stands(m)]
        self.table = [(m.start(), label, m[1].upper()) for m, label in zip(real, self.numbered(real))]

    def numbered(self, items: list[re.Match]) -> list[str]:
        """Labels of item headings by number; a quarterly report numbers anew in its second part, and its titles come first."""
        names = [m[1].upper() for m in items]
        if self.form == "10-K":
            return [ANNUAL.get(n, "other") for n in names]
        rank = [(int(n.rstrip("ABC")), n) for n in names]
        restarts = np.array([n in ("5", "6") or (k > 0 and rank[k] < rank[k - 1]) for k, n in enumerate(names)], bool)
        second = np.logical_or.accumulate(restarts) if len(restarts) else restarts
        by_number = [(QUARTER_TWO if late else QUARTER_ONE).get(n, "other") for n, late in zip(names, second)]
        heads = [self.places.text[m.start() : m.start() + 80].upper() if n in ("1", "1A", "2", "3", "4") else "" for m, n in zip(items, names)]
        return [next((label for t, label in QUARTER_TITLES if t in head), label) for head, label in zip(heads, by_number)]

    def extents(self, label: str) -> list[tuple[int, int]]:
        at = [p for p, _, _ in self.table] + [self.size]
        return [(p, e) for (p, x, _), e in zip(self.table, at[1:]) if x == label]

    def annual_tail(self):
        """What stands behind the items of an annual report: a FINANCIAL SECTION, or else statements behind item 16."""
        sections = [m.start() for m in self.places.of("section")]
        last = max((p for p, _, item in self.table if item == "16"), default=None)
        if not sections and last is not None and self.size - last > self.size / 20:
            yield from [(m.start(), "financials") for m in self.places.of("tail") if m.start() >= last and self.places.stands(m)][:1]
        late = [p for p in sections if p > self.size / 20][:1]
        yield from ((p, "mdna") for p in late)
        yield from [(m.start(), "financials") for m in self.places.of("auditor") if late and m.start() >= late[0]][:1]

    def by_title(self, rule: Fallback, spans: list[tuple[int, int]], heads: list[int]) -> int | None:
        """The first title, in order of preference, outside the section's stubs that no other heading follows closely."""
        for kind in rule.quarterly if self.form == "10-Q" else rule.annual:
            for m in self.places.of(kind):
                p = m.start()
                near = bisect_right(heads, p)
                alone = near == len(heads) or heads[near] - p >= 1500
                if alone and not any(a - 50 <= p < b for a, b in spans) and self.places.titled(m) and self.places.stands(m):
                    return p
        return None

    def missing(self):
        """Sections without a heading, or with one over a stub, by their titles. Extents are those before this step."""
        spans = {r.label: self.extents(r.label) for r in FALLBACKS}
        heads = sorted(p for p, _, _ in self.table)
        least = max(1500, self.size / 100)
        for rule in FALLBACKS:
            had = spans[rule.label]
            whole = had and not ((rule.stubs == ANY or self.form in rule.stubs) and sum(b - a for a, b in had) < least)
            if whole or (not had and self.form in rule.optional):
                continue
            p = self.by_title(rule, had, heads)
            if p is not None:
                heads.insert(bisect_left(heads, p), p)
                yield p, rule.label

    def lead(self):
        """A quarterly report may open with a discussion that has no heading."""
        first = min((p for p, _, _ in self.table if p > self.body), default=self.size)
        if sum(b - a for a, b in self.extents("mdna")) < self.size / 20 and first - self.body > self.size / 5:
            yield self.body, "mdna"

    #: What is added to the numbered items, in turn, by form.
    STEPS = {"10-K": (annual_tail, missing), "10-Q": (missing, lead)}

    def headings(self) -> list[tuple[int, str]]:
        for step in self.STEPS.get(self.form, (type(self).missing,)):
            self.table = sorted([*self.table, *((p, label, "") for p, label in step(self))])
        return sorted((p, label) for p, label, _ in self.table)


def parts(text: str, form: str) -> list[tuple[str, str]]:
    """(label, text) of the sections that cover a document: islands of one label among the stretches between headings."""
    cuts = [(0, "other"), *Outline(text, form).headings(), (len(text), "")]
    stretches = [(label, text[a:b]) for (a, label), (b, _) in pairwise(cuts)]
    solid = [bool(t.strip()) for _, t in stretches]
    # the label that was last in force before each stretch
    force = accumulate((label if full else None for (label, _), full in zip(stretches, solid)), lambda had, now: now or had, initial=None)
    shown = [s for s, full, had in zip(stretches, solid, force) if full or s[0] == had]
    return [(label, "\n".join(t for _, t in island)) for label, island in groupby(shown, lambda s: s[0])]
