"""Plain Python readings of the contracts, to hold the operators against."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(rows, width, hundredths):
    """{id: (set size, component)} of (id, text) rows by comparing all sets that share a shingle."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(o for s in sets[i] for o in seen[s])
        for s in sets[i]:
            seen[s].append(i)
        for o, n in shared.items():
            if 100 * n >= hundredths * (len(sets[i]) + len(sets[o]) - n):
                a, b = find(i), find(o)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def statistics(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def linked_spans(text, patterns, role, scope):
    """All spans (kind:start:end) by comparing every weak part with every other part. patterns: {kind: regex}, base kinds by base_spans."""
    t = text or ""
    base = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in base_spans(t).split(",") if x)]
    weak = [(m.start(), k, m.end()) for k, p in patterns for m in re.finditer(p, t, re.A)]
    near = lambda a, r: any(role[k] == r and abs(b - a) <= scope for b, k, _ in base + weak)
    needs = {"weak_id": lambda a: near(a, "secret"), "weak_secret": lambda a: near(a, "id") or near(a, "endpoint"), "weak_endpoint": lambda a: near(a, "id") and near(a, "secret")}
    return sorted(f"{k}:{a}:{b}" for a, k, b in base + [w for w in weak if needs[w[1]](w[0])])
