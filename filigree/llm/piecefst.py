"""SentencePiece encoding and decoding as shortest paths through a weighted transducer."""

from __future__ import annotations

import heapq
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import functions as F

from .scratch import ship
from .textkit import chunks, relax, utf8

SPACE = "▁"
#: Words, and pairs of pieces, that a worker remembers; the memory starts anew beyond it.
REMEMBERED = 250_000
#: Bytes of text whose words are composed together.
TOGETHER = 4 << 20


def _fields(b: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        v = s = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, b[i : i + n]
            i += n


def character_map(blob: bytes) -> dict[str, str]:
    """Rules (what is read, what is written) of a normaliser's compiled map: its length, a double-array trie of what is read, and texts that the trie's values point into."""
    size = int.from_bytes(blob[:4], "little")
    trie, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    labels = np.arange(1, 256)
    out: dict[str, str] = {}
    todo = [(0, b"")]
    while todo:
        at, read = todo.pop()
        unit = int(trie[at])
        base = at ^ (unit >> 10 << ((unit & 0x200) >> 6))
        if read and unit >> 8 & 1:
            value = int(trie[base]) & 0x7FFFFFFF
            out[read.decode()] = texts[value : texts.index(b"\0", value)].decode()
        child = base ^ labels
        some = child < len(trie)
        good = labels[some][trie[child[some]] & 0x800000FF == labels[some]]
        todo += [(base ^ c, read + bytes([c])) for c in good.tolist()]
    return out


class PieceTransducer:
    """The composed machine of a model file: normaliser, pieces and byte fallback.

    The normaliser's arcs read the longest stretch that its character map knows and write what
    it stands for, any other character as it is; they turn a space into the space mark and put one
    mark before a text. Piece arcs
    read the characters of one piece and write its id. A character that no piece holds has
    a chain of byte arcs instead, or the unknown id where the model has no byte pieces.

    States are (place in the text, last piece). For a unigram model an arc weighs the
    negative score of its piece. For a merge (BPE) model an arc weighs 0 if merging its
    piece and the piece before it, alone, gives just these two, else infinity: the merge
    segmentation of a text is the one whose neighbours all stand this test, so it is the
    one path of finite weight. Weights add along a path and the least is taken at a state,
    the tropical semiring, so the shortest path is found in one pass over the text.
    """

    def __init__(self, model: bytes):
        pieces, kinds, scores = [], [], []
        self.kind, self.dummy, self.trim = 1, True, True
        charsmap = b""
        for f, v in _fields(model):
            if f == 1:
                p = dict(_fields(v))
                pieces.append(p.get(1, b"").decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, 1))
            elif f == 2:
                self.kind = dict(_fields(v)).get(3, 1)
            elif f == 3:
                spec = dict(_fields(v))
                charsmap, self.dummy, self.trim = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        by_first: dict[str, list[tuple[str, str]]] = {}
        for read, write in character_map(charsmap).items() if charsmap else ():
            by_first.setdefault(read[0], []).append((read, write))
        self._rules = {c: sorted(x, key=lambda r: -len(r[0])) for c, x in by_first.items()}
        self._mapped = re.compile("[" + "".join(map(re.escape, by_first)) + "]") if by_first else None
        if self.kind not in (1, 2):
            raise ValueError("only unigram and merge models are supported")
        self.pieces, self.kinds = pieces, kinds
        self.id = {p: i for i, p in enumerate(pieces) if kinds[i] in (1, 4)}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.unknown = kinds.index(2)
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == 6}
        self.longest = max(map(len, self.id), default=1)
        self.letters = {c for p in self.id for c in p}
        # a mark inside a piece would make pieces run over the border of two words
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        # arcs by what they read: the id of a piece that stands alone, or -1 for the end of a longer one
        self.arcs: dict[str, int] = {}
        if self.kind == 2:
            self.arcs = {p[k:]: -1 for p in self.id for k in range(len(p))}
            self.arcs |= {p: i for p, i in self.id.items() if len(p) == 1 or self._merged(p) == [p]}
        self._fits: dict[int, bool] = {}
        # what decoding writes for an id: pieces and bytes as they are, nothing for control pieces
        self.says = [p.encode() if k in (1, 4) else bytes([int(p[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" for p, k in zip(pieces, kinds)]
        self._words: dict[str, bytes] = {}
        self._starts: dict[str, bytes] = {}

    def _merged(self, s: str) -> list[str]:
        """Merge neighbours of s, best score first, leftmost among equals (short strings: two pieces at most)."""
        parts: list[str | None] = list(s)
        left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap = [(-self.score[s[i : i + 2]], i, s[i], s[i + 1]) for i in range(len(s) - 1) if s[i : i + 2] in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < len(parts) and (p := parts[x] + parts[y]) in self.score:
                    heapq.heappush(heap, (-self.score[p], x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging two pieces as one text gives them back."""
        p, q = self.pieces[a], self.pieces[b]
        return self._merged(p + q) == [p, q]

    def path(self, s: str) -> tuple[int, ...]:
        """Ids on the shortest path over a normalised string."""
        out: list[int] = []
        i = 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] in self.letters:
                j += 1
            if j > i:
                out += self._run(s[i:j])
            if j < len(s):
                raw = s[j].encode("utf-8", "surrogatepass")
                out += [self.byte[b] for b in raw] if len(self.byte) == 256 else [self.unknown]
            i = j + 1
        if len(self.byte) == 256:
            return tuple(out)
        return tuple(x for x, before in zip(out, [None, *out]) if x != self.unknown or x != before)  # a run of unknown characters is one

    def _run(self, s: str, last: list[int] | None = None, from_: list[int] | None = None, done: int = 0) -> list[int]:
        """Path over letters that pieces hold; last and from_ may bring the states of its first `done` letters."""
        n = len(s)
        if self.kind == 1:
            return self._lightest(s)
        if n > 1 and s.count(SPACE) == n:
            return [self.id[p] for p in self._merged(s)]  # runs of marks have pieces of equal score
        if last is None or from_ is None:
            last, from_ = [0] * (n + 1), [0] * (n + 1)
        from_[done + 1 :] = [-1] * (n - done)
        last[done + 1 :] = [0] * (n - done)
        arcs, fits = self.arcs.get, self._fits
        for end in range(done + 1, n + 1):
            start = end - 1
            while start >= 0:
                piece = arcs(s[start:end])
                if piece is None:
                    break  # no piece ends with this
                if piece >= 0 and from_[start] >= 0:
                    if not start:
                        break
                    key = last[start] << 20 | piece
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) > REMEMBERED:
                            fits.clear()
                        ok = fits[key] = self._fit(last[start], piece)
                    if ok:
                        break
                start -= 1
            if start >= 0 and piece is not None:
                last[end], from_[end] = piece, start
        if from_[n] < 0:  # equal scores can leave no path: merge directly
            return [self.id.get(p, self.unknown) for p in self._merged(s)]
        out = []
        while n:
            out.append(last[n])
            n = from_[n]
        return out[::-1]

    def _lightest(self, s: str) -> list[int]:
        n, known, score = len(s), self.id, self.score
        back, cost = [0] * (n + 1), [0.0] + [float("inf")] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                p = s[start:end]
                if p in known and (w := cost[start] - score[p]) < cost[end]:
                    back[end], cost[end] = start, w
            if cost[end] == float("inf"):  # a letter that only longer pieces hold
                back[end], cost[end] = end - 1, cost[end - 1] + 1e6
        out = []
        while n:
            out.append(known.get(s[back[n] : n], self.unknown))
            n = back[n]
        return out[::-1]

    def normal(self, text: str) -> str:
        """What the normaliser's character map makes of a text."""
        if self._mapped is None:
            return text
        out, at = [], 0
        while (m := self._mapped.search(text, at)) is not None:
            out.append(text[at : m.start()])
            read, write = next((r for r in self._rules[m[0]] if text.startswith(r[0], m.start())), (m[0], m[0]))
            out.append(write)
            at = m.start() + len(read)
        return "".join(out) + text[at:]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        text = self.normal(text).replace(SPACE, " ")
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
            if not text:
                return []
        return list(self.path((SPACE if self.dummy else "") + text.replace(" ", SPACE)))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after the other, and their borders.

        Where no piece crosses the border of two words, each distinct word is composed
        once; words are taken in order, so that a word shares the states of the letters it
        has in common with the one before.
        """
        if not (self.by_word and self.dummy and not self.trim and "\n" not in self.letters and len(self.byte) == 256):
            rows = [self.encode(t) for t in texts]
            return np.array([i for r in rows for i in r], np.int32), np.cumsum([0] + [len(r) for r in rows])
        if len(self._words) > REMEMBERED:
            self._words.clear()
        if len(self._starts) > REMEMBERED:
            self._starts.clear()
        rows = [[line.split(" ") for line in self.normal(t).replace(SPACE, " ").split("\n")] if t else [] for t in texts]
        inner: set[str] = set()
        first: set[str] = set()
        for lines in rows:
            if lines:
                inner.update(lines[0])
                for ws in lines[1:]:
                    first.add(ws[0])
                    inner.update(ws[1:])
        self._learn(inner.difference(self._words), SPACE, self._words)
        self._learn(first.difference(self._starts), "", self._starts)
        word, start, feed = self._words.__getitem__, self._starts.__getitem__, _packed(self.path("\n"))
        parts: list[bytes] = []
        ends = [0]
        for lines in rows:
            at = len(parts)
            for k, ws in enumerate(lines):
                if k:
                    parts.append(feed)
                if "" in ws[1 if k else 0 :]:  # more than one space in a row
                    parts.append(_packed(self.path((SPACE if not k else "") + SPACE.join(ws))))
                elif k:
                    parts.append(start(ws[0]))
                    parts.extend(map(word, ws[1:]))
                else:
                    parts.extend(map(word, ws))
            ends.append(ends[-1] + sum(map(len, parts[at:])) // 4)
        return np.frombuffer(b"".join(parts), np.int32), np.array(ends, np.int64)

    def _learn(self, new: set[str], head: str, into: dict[str, bytes]) -> None:
        """Paths of new words, each behind head, packed: a word takes a third of what a tuple of numbers would."""
        before, last, from_ = "", [0], [0]
        letters = self.letters
        for w in sorted(new):
            s = head + w
            if not letters.issuperset(w) or self.kind == 1 or not w:
                into[w] = _packed(self.path(s))
                continue
            common = 0
            for a, b in zip(before, s):
                if a != b:
                    break
                common += 1
            into[w] = _packed(self._run(s, last, from_, common))
            before = s

    def decode(self, ids) -> str:
        """The text of a sequence of ids: pieces joined, byte runs read as UTF-8, marks as spaces, one leading space dropped."""
        s = b"".join(map(self.says.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return s[1:] if self.dummy and s[:1] == " " else s


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


_LOADED: dict[str, PieceTransducer] = {}


def _machine(name: str) -> PieceTransducer:
    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = PieceTransducer(f.read())
    return _LOADED[name]


def _sent(spark, model: str) -> str:
    """Send the model file to every executor once; returns its name there."""
    ship(spark)
    sc = spark.sparkContext
    done = getattr(sc, "_filigree_files", None)
    if done is None:
        done = sc._filigree_files = set()
    if model not in done:
        sc.addFile(model)
        done.add(model)
    return model.rsplit("/", 1)[-1]


def _encoded(machine: PieceTransducer, column: pa.Array) -> pa.ListArray:
    ids, offsets = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    texts = column.to_pylist()
    _, ends = utf8(column)
    for i, j in chunks(ends, TOGETHER):
        flat, at = machine.encode_all(texts[i:j])
        offsets.append(at[1:] + offsets[-1][-1])
        ids.append(flat)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(ids)))


def _decoded(machine: PieceTransducer, column: pa.ListArray) -> pa.Array:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    flat = column.values.to_numpy(zero_copy_only=False)
    some = column.is_valid().to_pylist()
    return pa.array([machine.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(at.tolist(), at.tolist()[1:], some)], pa.string())


def encoder(spark, model: str):
    """A function of a text column to its ids (array<int>); null and empty texts have none. model is a path that the driver can read."""
    name = _sent(spark, model)

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        return _encoded(_machine(name), column)

    return encode


def decoder(spark, model: str):
    """A function of an ids column to its text; null ids give null."""
    name = _sent(spark, model)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return _decoded(_machine(name), column)

    return decode


def codec(spark, model: str):
    """A function of a text column to struct(ids, text): its ids and what decoding them gives back, in one pass.

    Null and empty texts have no ids and an empty text. Texts of any length are encoded whole, equal
    ones alike. A text comes back as it was but for what the normaliser changes: the space
    mark (U+2581) in a text is read as a space, models that trim spaces do so, and a
    character map writes what it stands for.

    Two functions one on the other would be planned as one node that encodes twice."""
    name = _sent(spark, model)

    @F.arrow_udf("struct<ids:array<int>,text:string>")
    def both(column: pa.Array) -> pa.Array:
        ids = _encoded(_machine(name), column)
        out = pa.StructArray.from_arrays([ids, _decoded(_machine(name), ids)], names=["ids", "text"])
        relax()
        return out

    return both.asNondeterministic()
