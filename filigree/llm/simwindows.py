"""Benchmark decontamination by SimHash fingerprints of item-sized word windows."""

from __future__ import annotations

from functools import reduce
from math import log
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, ship
from .textkit import chunks, mix, relax, utf8, words

_U = np.uint64
#: Words of a shingle, least similarity, Hamming radius, blocks of a fingerprint (16 bits each).
WIDTH, LEAST, RADIUS, BLOCKS = 5, 0.8, 7, 4
#: Ladder of window lengths grows by this factor; items that one pass holds in memory, and their characters.
STEP, ITEMS, CHARS = 1.2, 20_000, 32_000_000


def window_length(words_of_item: int, step: float = STEP) -> int:
    """The window for an item: the largest length of a fixed ladder that is at most 9 tenths of the item (one word at least)."""
    out = 1
    while (up := max(out + 1, int(out * step))) <= 0.9 * words_of_item:
        out = up
    return out


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of bit-sliced counters: element k of a counter has bit k of 64 counts."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        terms = [x[k] for x in (a, b) if k < len(x)] + ([carry] if carry is not None else [])
        if len(terms) == 1:
            out.append(terms[0])
            carry = None
        elif len(terms) == 2:
            out.append(terms[0] ^ terms[1])
            carry = terms[0] & terms[1]
        else:
            half = terms[0] ^ terms[1]
            out.append(half ^ terms[2])
            carry = (terms[0] & terms[1]) | (half & terms[2])
    return out + ([carry] if carry is not None else [])


class Windows:
    """SimHash fingerprints of all windows of a row of word hashes, from sums of 1, 2, 4, ... words."""

    def __init__(self, h: np.ndarray):
        self.n, self.sums = len(h), [[h]]

    def of(self, length: int, stride: int = 1) -> np.ndarray:
        """64-bit fingerprints of the windows of `length` words at every stride-th place: a bit is set if more than half of the words have it."""
        while len(self.sums) < length.bit_length():
            last, d = self.sums[-1], 1 << (len(self.sums) - 1)
            self.sums.append(_add([x[:-d] for x in last], [x[d:] for x in last]))
        count, at = None, 0
        stop = self.n - length + 1
        for k in range(length.bit_length()):
            if length >> k & 1:
                part = [x[at : at + stop : stride] for x in self.sums[k]]
                count = part if count is None else _add(count, part)
                at += 1 << k
        least = length // 2 + 1
        more, same = np.zeros(len(count[0]), np.uint64), np.full(len(count[0]), ~_U(0))
        for k in range(max(len(count), least.bit_length()) - 1, -1, -1):
            plane = count[k] if k < len(count) else np.zeros(1, np.uint64)
            if least >> k & 1:
                same = same & plane
            else:
                more |= same & plane
                same = same & ~plane
        return more | same


def fingerprints(h: np.ndarray, length: int) -> np.ndarray:
    """64-bit SimHash of every window of `length` word hashes."""
    return Windows(h).of(length)


def _shingle_ids(h: np.ndarray) -> np.ndarray:
    k = min(WIDTH, len(h))
    x = np.zeros(len(h) - k + 1, np.uint64)
    for d in range(k):
        x = mix(x * _U(0x9E3779B97F4A7C15) + h[d : len(h) - k + 1 + d] + _U(d + 1))
    return x


def _items(rows: list[tuple]) -> list[tuple]:
    """(id, word hashes) of the texts that have words."""
    rows = [(i, t) for i, t in rows if t]
    data, ends = utf8(pa.array([t for _, t in rows], pa.string()))
    if not rows:
        return []
    h, _, _, at = words(data, ends, 0, len(rows))
    return [(rows[k][0], h[at[k] : at[k + 1]]) for k in range(len(rows)) if at[k + 1] > at[k]]


class Index:
    """Items of one pass: per window length a multi-index of their fingerprints; shingle weights.

    Where there are other passes, `several` has the number of items of all and, for each shingle
    of this pass that more than one of them has, how many do."""

    def __init__(self, items: list[tuple], several: tuple[int, dict[int, int]] | None = None):
        self.items, self.last_pass = _items(items), several is None
        sets = [np.unique(_shingle_ids(w)) for _, w in self.items]
        if several is None:
            n, df = len(self.items), {}
            for s in sets:
                for x in s.tolist():
                    df[x] = df.get(x, 0) + 1
        else:
            n, more = several
            df = {x: more.get(x, 1) for s in sets for x in s.tolist()}
        self.unseen = 1 + log(n + 1)
        self.weight = {x: 1 + log((n + 1) / d) for x, d in df.items()}
        self.sets = [set(s.tolist()) for s in sets]
        self.total = [sum(self.weight[x] for x in s) for s in self.sets]
        lengths = np.array([len(w) for _, w in self.items], int)
        self.classes = {}
        sizes = np.array([window_length(int(x)) for x in lengths], int)
        for size in np.unique(sizes).tolist():
            prints, owner = [], []
            for k in np.flatnonzero(sizes == size).tolist():
                p = np.unique(fingerprints(self.items[k][1], size))
                prints.append(p)
                owner.append(np.full(len(p), k))
            prints, owner = np.concatenate(prints), np.concatenate(owner)
            # block tables: every value within RADIUS // BLOCKS bits of a fingerprint's block leads to it
            near = np.concatenate(([0], 1 << np.arange(16))).astype(np.uint16)
            tables = []
            for b in range(BLOCKS):
                block = prints.view(np.uint16).reshape(-1, 4)[:, b]
                value = (block[:, None] ^ near[None, :]).ravel()
                entry = np.repeat(np.arange(len(prints)), len(near))
                order = np.argsort(value, kind="stable")
                ptr = np.searchsorted(value[order], np.arange(65537))
                tables.append((ptr.astype(np.int64), entry[order]))
            # an item has windows at 2 * stride places in a row, so at least two of them meet every stride-th window of a copy
            stride = max(1, (int((lengths[sizes == size] - size).min()) + 1) // 2)
            self.classes[size] = prints, owner, tables, stride

    def _near(self, f: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) pairs within RADIUS: by pigeonhole one of four blocks is within one bit."""
        prints, _, tables, _ = self.classes[size]
        out_w, out_p = [], []
        blocks = f.view(np.uint16).reshape(-1, 4)
        for b, (ptr, entry) in enumerate(tables):
            v = blocks[:, b].astype(np.int64)
            lo = ptr[v]
            n = ptr[v + 1] - lo
            w = np.flatnonzero(n)
            if not len(w):
                continue
            n = n[w]
            e = entry[np.repeat(lo[w] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            w = np.repeat(w, n)
            good = np.bitwise_count(f[w] ^ prints[e]) <= RADIUS
            out_w.append(w[good])
            out_p.append(e[good])
        if not out_w:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(out_w), np.concatenate(out_p)

    def _stretch(self, h: np.ndarray, ids: list[int], lo: int, hi: int, pos: int, k: int, size: int) -> tuple[list[int], int]:
        """Shingles of the windows of item k's length in words lo..hi near a matching fingerprint at pos, and how many a window has: windows are the runs of so many."""
        length = len(self.items[k][1])
        first, last = max(lo, pos - (length - size) - WIDTH), min(pos + WIDTH, max(lo, hi - length))
        if length < WIDTH or hi - lo < WIDTH:
            return [int(_shingle_ids(h[s : min(hi, s + length)])[0]) for s in range(first, last + 1)], 1
        stop = min(hi, last + length)
        return ids[first : stop - WIDTH + 1], min(length, hi - lo) - WIDTH + 1

    def _hopeless(self, k: int, seen: list[int]) -> bool:
        """No window can have more of an item than all of them together."""
        own = self.sets[k]
        return sum(self.weight[x] for x in own.intersection(seen)) < (LEAST - 1e-9) * self.total[k]

    def search(self, h: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], float | list]:
        """{(row, item): similarity} of at least LEAST for rows of word hashes; with other passes {(row, item): stretches}, which only all weights can judge."""
        found: dict = {}
        if not len(h):
            return found
        windows = Windows(h)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        ids = None
        for size, (_, owner, _, stride) in self.classes.items():
            cand = []
            if len(h) >= size:
                w, p = self._near(windows.of(size, stride), size)
                w = w * stride
                inside = row[w] == row[w + size - 1]
                cand.append((w[inside], owner[p[inside]]))
            # a text a little shorter than the window is a window itself
            n = np.diff(at)
            short = np.flatnonzero((n < size) & (n >= LEAST * size))
            if len(short):
                f = np.concatenate([fingerprints(h[at[r] : at[r + 1]], int(n[r])) for r in short])
                w, p = self._near(f, size)
                cand.append((at[short[w]], owner[p]))
            for w, k in cand:
                for pos, item in sorted(set(zip(w.tolist(), k.tolist()))):
                    r = int(row[pos])
                    if self.last_pass and found.get((r, item), 0) >= 1:
                        continue
                    if ids is None:
                        ids = _shingle_ids(h).tolist()
                    seen, width = self._stretch(h, ids, int(at[r]), int(at[r + 1]), pos, item, size)
                    if self._hopeless(item, seen):
                        continue
                    if not self.last_pass:
                        if (seen, width) not in (had := found.setdefault((r, item), [])):
                            had.append((seen, width))
                        continue
                    best = most_similar(seen, width, self.sets[item], self.weight, self.unseen)
                    if best >= max(LEAST - 1e-12, found.get((r, item), 0)):
                        found[r, item] = best
        return found


def most_similar(seen: list[int], width: int, own: set[int], weight: dict[int, float], unseen: float) -> float:
    """Largest weighted Jaccard similarity of a set and a run of `width` shingles."""
    total, best = sum(weight.get(x, unseen) for x in own), 0.0
    for s in range(len(seen) - width, -1, -1):
        window = set(seen[s : s + width])
        both = sum(weight.get(x, unseen) for x in window & own)
        if both > best * total:
            best = max(best, both / (total + sum(weight.get(x, unseen) for x in window) - both))
            if best >= 1:
                break
    return best


def _number(rows: DataFrame) -> int:
    """Passes of at most ITEMS items and CHARS characters (in expectation)."""
    n, size = rows.agg(F.count("*"), F.sum(F.length("t"))).first()
    return max(1, -(-n // ITEMS), -(-(size or 0) // CHARS))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `items`: array<struct<item, similarity>> of the benchmark items that the text holds.

    An item is held if some window of as many words as it has (words lower-cased in A-Z)
    has weighted 5-word-shingle similarity LEAST or more with it; a shingle weighs
    1 + ln((N + 1) / items that have it), N and these counts being of the whole benchmark.
    Candidates are windows whose 64-bit SimHash is within RADIUS bits of a fingerprint of the
    item; four 16-bit blocks looked up with one bit of tolerance miss none of them. Of the
    windows of a text enough are fingerprinted that every whole copy has two of them; a
    passage changed up to the limit of similarity may have none (tests measure the share).

    Texts are searched whole, whatever their length; null or blank texts and items hold
    nothing; an item of fewer than five words is one shingle. Equal rows get equal items;
    items repeated under one id count once, under several ids each; similarity of exactly
    LEAST counts. A column of docs named `items` is replaced, others stay. The order of
    items is by id. An empty benchmark leaves every array empty.

    A benchmark beyond ITEMS items is taken in passes, one written after the other, each
    with an index of bounded memory on the driver and in a worker; what they find near is judged
    at the end by joining the weights of all.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"array<struct<item:{kind},similarity:double>>"
    out = docs.drop("items")
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    passes = _number(rows)
    if passes == 1:
        sent = spark.sparkContext.broadcast((sorted({(r.i, r.t) for r in rows.collect()}), None))
        return out.withColumn("items", _search(sent, schema)(F.coalesce(F.col(text), F.lit(""))))
    return _in_passes(out, rows.distinct(), text, kind, passes)


def _in_passes(docs: DataFrame, rows: DataFrame, text: str, kind: str, passes: int) -> DataFrame:
    """contamination over a benchmark (i, t) of several passes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simwindows")

    def shingled(batches):
        for b in batches:
            found = [(i, np.unique(_shingle_ids(w)).view(np.int64)) for i, w in _items(list(zip(range(b.num_rows), b.column(0).to_pylist())))]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array([i for i, _ in found], pa.int64())), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["part", "s"])

    part = F.pmod(F.xxhash64("i"), F.lit(passes))
    sets = scratch.keep(rows.select("t", part.cast("bigint").alias("part")).mapInArrow(shingled, "part bigint, s array<bigint>"), "shingles")
    n = sets.count()
    shared = scratch.keep(sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    # the rows are written with a number, for no id need be one
    own = scratch.keep(docs.select(F.struct(*docs.columns).alias("d"), F.monotonically_increasing_id().alias("_row")), "rows")
    pairs = f"array<struct<item:{kind},own:array<bigint>,seen:array<bigint>,width:int>>"
    hits = []
    for k in range(passes):
        items = sorted({(r.i, r.t) for r in rows.where(part == k).collect()})
        more = dict(map(tuple, sets.where(F.col("part") == k).select(F.explode("s").alias("s")).distinct().join(shared, "s").collect()))
        sent = spark.sparkContext.broadcast((items, (n, {x % (1 << 64): d for x, d in more.items()})))
        near = own.select("_row", F.explode(_search(sent, pairs)(F.coalesce(F.col("d")[text], F.lit("")))).alias("p"))
        hits.append(scratch.keep(near.select("_row", F.col("p.*")), f"near{k}"))
        sent.destroy()
    every = scratch.keep(reduce(DataFrame.union, hits).withColumn("_pair", F.monotonically_increasing_id()), "near")
    weighed = every.select("_pair", F.explode(F.array_distinct(F.concat("own", "seen"))).alias("s")).join(shared, "s")
    weighed = weighed.groupBy("_pair").agg(F.collect_list(F.struct("s", "df")).alias("df"))
    judged = every.join(weighed, "_pair", "left").select("_row", "item", _judged(n)("own", "seen", "width", F.col("df.s"), F.col("df.df")).alias("similarity")).where(F.col("similarity") >= LEAST - 1e-12)
    best = judged.groupBy("_row", "item").agg(F.max("similarity").alias("similarity")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("item", "similarity"))).alias("items"))
    none = F.array().cast(f"array<struct<item:{kind},similarity:double>>")
    return own.join(best, "_row", "left").select("d.*", F.coalesce("items", none).alias("items"))


def _judged(n: int):
    @F.arrow_udf("double")
    def similarity(own: pa.Array, seen: pa.Array, width: pa.Array, shingle: pa.Array, df: pa.Array) -> pa.Array:
        out = []
        for o, s, w, x, d in zip(*[c.to_pylist() for c in (own, seen, width, shingle, df)]):
            weight = {a: 1 + log((n + 1) / b) for a, b in zip(x or (), d or ())}
            out.append(most_similar(s, w, set(o), weight, 1 + log(n + 1)))
        return pa.array(out, pa.float64())

    return similarity


_BUILT: dict[str, Index] = {}


def _index(sent, token: str) -> Index:
    """The index of a broadcast pass, built once by a worker, which lets go of the one before; token names the pass."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Index(*sent.value)
    return _BUILT[token]


def _signed(ids) -> list[int]:
    return np.array(ids, np.uint64).view(np.int64).tolist()


def _search(sent, schema: str):
    """A function of a text column to its items with their similarity or, of one pass among others, with the stretches that may hold them."""
    token = uuid4().hex

    @F.arrow_udf(schema)
    def search(column: pa.Array) -> pa.Array:
        index = _index(sent, token)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        data, ends = utf8(column)
        for i, j in chunks(ends, 1 << 18):
            h, _, _, at = words(data, ends, i, j)
            for (r, k), s in index.search(h, at).items():
                if index.last_pass:
                    out[i + r].append({"item": index.items[k][0], "similarity": s})
                else:
                    out[i + r] += [{"item": index.items[k][0], "own": _signed(sorted(index.sets[k])), "seen": _signed(ids), "width": w} for ids, w in s]
        for x in out:
            x.sort(key=lambda d: d["item"])
        relax()
        item = pa.int64() if "item:bigint" in schema else pa.int32() if "item:int" in schema else pa.string()
        rest = [("similarity", pa.float64())] if index.last_pass else [("own", pa.list_(pa.int64())), ("seen", pa.list_(pa.int64())), ("width", pa.int32())]
        return pa.array(out, pa.list_(pa.struct([("item", item), *rest])))

    return search
