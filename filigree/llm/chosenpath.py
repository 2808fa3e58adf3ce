"""Set similarity self-join of texts by chosen-path branching on minwise tokens."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .scratch import Scratch, ship
from .textkit import _U, chunks, mix, relax, shingles, utf8, words

#: Independent trees, tokens that choose a root branch, tokens chosen on the deepest path, most documents of a leaf.
TREES, ROOT, DEPTH, LEAF = 16, 2, 4, 64
#: Minwise values of a set, and how many of them two sets of a leaf must share to be candidates.
#: At similarity 0.85 the count is binomial(64, 0.85); fewer than 37 agree with chance 1e-7.
SKETCH, AGREE = TREES * DEPTH, 37
#: Most documents whose full sets one task compares as a whole, most shingles that these have together (but for the hubs and a single set), and documents shared by all blocks of a larger group.
BLOCK, LOAD, HUBS = 256, 1 << 22, 8
#: Most bits, as a power of two, of the filters that spare rows without a partner the shuffle.
FILTER, SHIFTS = 26, (0, 32)
#: A node with more than one in HOT of all rows is dealt to SALTS places.
HOT, SALTS = 1024, 64
#: Places, as a power of two, among which occurrences of shingles are counted to put the rare ones first.
TALLY = 20

_SEEDS = np.random.default_rng(85).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * _U(2) + _U(1)


def _sets(column: pa.Array, width: int):
    """For each row the sorted distinct shingle hashes of its text."""
    data, ends = utf8(column)
    for i, j in chunks(ends):
        h, _, _, at = words(data, ends, i, j)
        s, ptr = shingles(h, at, width)
        for r in range(j - i):
            yield np.unique(s[ptr[r] : ptr[r + 1]])


def _print(u: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return np.array([mix(u).sum(dtype=np.uint64), mix(u ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(u))], np.uint64).tobytes()


def _sketch(u: np.ndarray) -> np.ndarray:
    best = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(u), 4096):
        best = np.minimum(best, ((u[k : k + 4096, None] * _SEEDS) >> _U(32)).astype(np.uint32).min(0))
    return best


def sketches(docs: DataFrame, text: str, id_col: str, width: int) -> DataFrame:
    """(id, n_shingles, fp, sig) per row: set size, name of the set, and minwise values (null where the set is empty)."""
    kind = docs.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, n_shingles bigint, fp binary, sig binary"

    def run(batches):
        for b in batches:
            n, fp, sig = [], [], []
            for u in _sets(b.column(1), width):
                n.append(len(u))
                fp.append(_print(u) if len(u) else None)
                sig.append(_sketch(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n_shingles", "fp", "sig"])
            relax()

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _rooted(reps: DataFrame, trees: int, shared=None) -> DataFrame:
    """A row for each tree of each set: node key of the root branch, tokens chosen deeper, and the sketch of 8-bit minwise values. `shared`, a broadcast Filter of keys, leaves out most rows whose node has no other set."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(n, SKETCH)
            low = mix(sig.astype(np.uint64)).astype(np.uint8)
            sk = pa.array([x.tobytes() for x in low], pa.binary())
            for t in range(trees):
                chosen = sig[:, DEPTH * t : DEPTH * (t + 1)].astype(np.uint64)
                key = np.full(n, t + 1, np.uint64)
                for d in range(ROOT):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + chosen[:, d])
                path = pa.array([x.tobytes() for x in chosen[:, ROOT:].astype(np.uint32)], pa.binary())
                out = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), path, sk], names=["key", "fp", "path", "sk"])
                yield out if shared is None else out.filter(pa.array(_holds(shared.value, key)))
            relax()

    return reps.select("fp", "sig").mapInArrow(run, "key bigint, fp binary, path binary, sk binary")


def _matched(rows: DataFrame, table: DataFrame, n: str) -> DataFrame:
    """rows (key, fp, ...) with the columns of table (one row per key; n says how many rows have the key), by key.

    A key with more than one in HOT of all rows is dealt to SALTS places, so that no task gets
    a large node whole; fewer than HOT keys are that large, and only they are broadcast."""
    total = table.agg(F.sum(n)).first()[0] or 0
    large = F.col(n) * HOT > total
    hot = table.where(large).select("key", F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))).drop("_hot")
    places = F.explode(F.when(large, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))).alias("_salt")
    return dealt.join(table.select("*", places).hint("merge"), ["key", "_salt"]).drop("_salt")


def _deeper(rows: DataFrame, level: int) -> DataFrame:
    """Branch on the next chosen token."""
    token = F.substring("path", 4 * (level - 1) + 1, 4)
    return rows.withColumn("key", F.xxhash64("key", token))


def _grouped(batches, key: str):
    """Runs of equal keys of sorted batches, across batch borders, as lists of tables."""
    held, name = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:]):
            if held and k[i] != name:
                yield held
                held = []
            held.append(b.slice(i, j - i))
            name = k[i]
    if held:
        yield held


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _leaf(batches):
    """Compare the sketches of each small node exhaustively; emit a star per connected group."""
    for b in _whole(batches):
        key = b.column(0).to_numpy()
        fp = b.column(1).to_pylist()
        sk = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(fp), SKETCH)
        parent = list(range(len(fp)))
        d = 1
        while True:
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            for lo in range(0, len(i), 65536):
                x = i[lo : lo + 65536]
                for p in x[(sk[x] == sk[x + d]).sum(1) >= AGREE].tolist():
                    a, c = _find(parent, p), _find(parent, p + d)
                    if a != c:
                        parent[max(a, c)] = min(a, c)
            d += 1
        out = [(fp[i], fp[r]) for i in range(len(fp)) if (r := _find(parent, i)) != i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])


def _once(batches):
    """Sorted batches without the rows that repeat the (task, fp) of the one before."""
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        task, fp = b.column(b.schema.get_field_index("task")), b.column(b.schema.get_field_index("fp"))
        new = np.ones(n, bool)
        new[1:] = ~pc.and_(pc.equal(task.slice(1), task.slice(0, n - 1)), pc.equal(fp.slice(1), fp.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        new[0] = (task[0].as_py(), fp[0].as_py()) != last
        last = (task[n - 1].as_py(), fp[n - 1].as_py())
        yield b if new.all() else b.filter(pa.array(new))


def _whole(batches, most: int = 20000):
    """Regroup sorted batches so that no run of one key is cut."""
    held, n = [], 0
    for g in _grouped(batches, "key"):
        held += g
        n += sum(x.num_rows for x in g)
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _exact(hundredths: int):
    """Connected groups of full sets inside each task key, found exactly; a star per group.

    A pivot is compared with every set that no group holds yet. What it links joins its
    group and becomes a pivot in turn, so every link between two sets of the task is
    either found or lies inside one group already.
    """

    def run(batches):
        for g in _grouped(_once(batches), "task"):
            t = pa.Table.from_batches(g)
            fp = t.column("fp").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            if len(fp) < 2:
                continue
            n = np.array([len(x) for x in sets])
            dense, ids = np.unique(np.concatenate(sets), return_inverse=True)
            ptr = np.concatenate(([0], np.cumsum(n)))
            mark = np.zeros(len(dense), bool)
            left = np.arange(len(fp))
            out = []
            while len(left):
                root, queue, left = left[0], [left[0]], left[1:]
                while queue and len(left):
                    p = queue.pop()
                    mark[ids[ptr[p] : ptr[p + 1]]] = True
                    fit = (100 * np.minimum(n[left], n[p]) >= hundredths * np.maximum(n[left], n[p]))
                    some = left[fit]
                    if len(some):
                        at = np.concatenate([np.arange(ptr[x], ptr[x + 1]) for x in some]) if len(some) < len(fp) - 1 else None
                        hit = mark[ids[at]] if at is not None else mark[ids][np.concatenate([np.arange(ptr[x], ptr[x + 1]) for x in some])]
                        both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(n[some])[:-1])))
                        linked = some[100 * both >= hundredths * (n[some] + n[p] - both)]
                        if len(linked):
                            out += [(fp[x], fp[root]) for x in linked]
                            queue += linked.tolist()
                            left = left[~np.isin(left, linked)]
                    mark[ids[ptr[p] : ptr[p + 1]]] = False
            if out:
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary()), pa.array([t.column("task")[0].as_py()] * n, pa.int64()), pa.array([t.column("big")[0].as_py()] * n)], names=["a", "b", "task", "big"])

    return run


def _with_sets(docs: DataFrame, members: DataFrame, text: str, id_col: str, width: int) -> DataFrame:
    """members (rep, fp, task, component, blocks, block) with the full set of each representative text."""

    def run(batches):
        # rows that repeat an id and a text lie in one task, or in as many as a hot id is split to: one of each task goes on
        had: set = set()
        for b in batches:
            keep, sets = [], []
            fp, task = b.column(1).to_pylist(), b.column(2).to_pylist()
            for r, u in enumerate(_sets(b.column(0), width)):
                if len(u) and _print(u) == fp[r] and (fp[r], task[r]) not in had:  # another row may bear the same id, or the same text too
                    keep.append(r)
                    sets.append(u.tobytes())
                    had.add((fp[r], task[r]))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(1, 6)], pa.array(sets, pa.binary())], names=["fp", "task", "component", "blocks", "block", "set"])
            relax()

    def named(batches):
        for b in batches:
            sets = [(_print(u), u.tobytes()) for u in _sets(b.column(0), width) if len(u)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sets], pa.binary()) for k in (0, 1)], names=["fp", "set"])
            relax()

    there = docs.select(F.col(id_col).alias("rep"), F.col(text).alias("text"))
    named_by_id = there.where("rep is not null").where(_maybe(members, "rep"))
    found = named_by_id.join(members.hint("shuffle_hash"), "rep").select("text", "fp", "task", "component", "blocks", "block").mapInArrow(run, "fp binary, task bigint, component binary, blocks bigint, block bigint, set binary")
    nameless = members.where("rep is null")
    if nameless.isEmpty():
        return found
    # no id leads to these sets, so their rows are found by the fingerprint
    own = there.where("rep is null").select("text").mapInArrow(named, "fp binary, set binary").groupBy("fp").agg(F.first("set").alias("set"))
    return found.unionByName(own.join(nameless, "fp").select("fp", "task", "component", "blocks", "block", "set"))


def _filter(members: DataFrame, key) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes: two places each among at most 2^FILTER bits, as 64-bit words.

    Its size is bounded, so with very many members it only lets more rows through.
    """
    bits = 1 << min(FILTER, max(16, (16 * members.count()).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned(key, s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS]))
    words = members.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return table


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and false for most others."""
    ok, mask = np.ones(len(keys), bool), _U(64 * len(table) - 1)
    for s in SHIFTS:
        at = (keys >> _U(s)) & mask
        ok &= (table[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)
    return ok


def _maybe(members: DataFrame, key: str, tested: str | None = None):
    """A column that is true where column `tested` (or of the same name) has a value of members' key, and false for most other values."""
    sent = members.sparkSession.sparkContext.broadcast(_filter(members, F.xxhash64(key)))

    @F.arrow_udf("boolean")
    def maybe(keys: pa.Array) -> pa.Array:
        return pa.array(_holds(sent.value, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return maybe(F.xxhash64(tested or key))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur among sets, counted by hash in at most 2^TALLY places."""

    def tally(batches):
        for b in batches:
            at = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist())]) >> _U(64 - TALLY)
            place, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(n, pa.int64())], names=["at", "n"])

    found = sets.select("set").mapInArrow(tally, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << TALLY, np.uint32)
    table[found.column("at").to_numpy()] = np.minimum(found.column("n").to_numpy(), 0xFFFFFFFF)
    return table


def _first_shingles(sets: DataFrame, hundredths: int) -> DataFrame:
    """(key, fp, n, at, rest): the rarest shingles of each set, as many as it takes for two linked sets to share one, with their place in the order."""
    sent = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def run(batches):
        for b in batches:
            key, n, at, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r, (x, c) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                u = np.frombuffer(x, np.uint64)
                some = len(u) - -(-hundredths * len(u) // 100) + 1
                first = u[np.lexsort((u, sent.value[u >> _U(64 - TALLY)]))[:some]]
                key.append(mix(first ^ np.frombuffer(c[:8], np.uint64)[0]))
                n.append(np.full(some, len(u)))
                at.append(np.arange(some))
                row.append(np.full(some, r))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), b.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(n)), pa.array(np.concatenate(at)), b.column(3).take(pa.array(np.concatenate(row)))], names=["key", "fp", "n", "at", "rest"])
            relax()

    return sets.select("fp", "set", "component", "rest").mapInArrow(run, "key bigint, fp binary, n bigint, at bigint, rest boolean")


def _second(large: DataFrame, rest: DataFrame, hundredths: int, scratch: Scratch) -> DataFrame:
    """Tasks (task, fp, set, big) in which every set of rest meets every set of its group that it may be linked with.

    Two linked sets share one of their rarest shingles (prefix filter), and what follows the
    first shared one in either is long enough for the overlap (position filter), so sets
    that no such shingle ties are not linked, and groups fall into tighter ones. In those the sets
    of rest, in chunks of as many as a block has, meet every block."""
    loose = large.join(rest.select("component").distinct(), "component", "left_semi")
    marked = scratch.keep(loose.join(rest.select(F.col("fp").alias("f"), F.lit(True).alias("rest")), F.col("fp") == F.col("f"), "left").select("fp", "set", "component", F.coalesce("rest", F.lit(False)).alias("rest")), "loose")
    shingle = scratch.keep(_first_shingles(marked, hundredths), "prefixes")
    shared = scratch.keep(shingle.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max(F.col("n") - F.col("at")).alias("left"), F.max("rest").alias("r")).where("c > 1 and r").drop("r"), "shared")
    # the smallest partner of n shingles has h n of them; both must have the overlap left from the shared one on
    enough = F.least(F.col("n") - F.col("at"), F.col("left")) * (100 + hundredths) >= hundredths * (F.col("n") + F.greatest(F.col("lo"), F.ceil(hundredths * F.col("n") / 100)))
    tied = scratch.keep(_matched(shingle, shared, "c").where(enough).select("key", "fp", "rest"), "tied")
    low = scratch.keep(tied.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("c"), F.max("rest").alias("r")).where("c > 1 and r").drop("r"), "lowest")
    tight = scratch.keep(connected_components(_matched(tied, low, "c").where("fp <> b").select(F.col("fp").alias("a"), "b"), scratch), "tight").select(F.col("node").alias("fp"), F.col("component").alias("group"))
    sets = marked.join(tight, "fp")
    size = tight.join(marked.select("fp", "rest", F.ceil(F.octet_length("set") / 8).alias("n")), "fp").groupBy("group").agg(_n_blocks(F.count("*"), F.sum("n")).alias("blocks"), _n_blocks(F.sum(F.col("rest").cast("int")), F.sum(F.when(F.col("rest"), F.col("n")))).alias("chunks")).where("chunks > 0")
    placed = scratch.keep(
        sets.join(size, "group")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .withColumn("chunk", F.when(F.col("rest"), F.pmod(F.xxhash64("fp", F.lit(2)), F.col("chunks"))))
        .select("fp", "set", "group", "blocks", "chunks", "block", "chunk"),
        "placed",
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    task = F.xxhash64("group", "b", "c").alias("task")
    here = placed.where("chunk is not null").select("fp", "set", "group", every("blocks").alias("b"), F.col("chunk").alias("c"))
    # a block's own sets, without those that come with the chunk
    there = placed.select("fp", "set", "group", F.col("block").alias("b"), every("chunks").alias("c"), "chunk").where("chunk is null or chunk <> c").drop("chunk")
    return here.unionByName(there).select(task, "fp", "set", F.lit(True).alias("big"))


def _n_blocks(sets, shingles):
    """How many blocks a group is dealt to, by its sets and by all their shingles."""
    return F.greatest(F.ceil(sets / BLOCK), F.ceil(shingles / LOAD))


def _compared(rows: DataFrame, hundredths: int, parts: int) -> DataFrame:
    return rows.repartition(parts, "task").sortWithinPartitions("task", "fp").mapInArrow(_exact(hundredths), "a binary, b binary, task bigint, big boolean")


def similarity_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = 5,
    hundredths: int = 80,
    trees: int = TREES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Components of the graph that links texts whose shingle sets have Jaccard similarity hundredths/100 or more.

    A text's set holds its distinct `width`-word shingles (words lower-cased in A-Z); with
    fewer words the whole sequence is one shingle; a null, empty or blank text has none and
    is linked with nothing. Returns one row per input row: id, n_shingles, component_id
    (smallest id of a row it reaches, its own id if none is smaller) and `kept`
    (id = component_id). Rows that repeat an id share its component; those that repeat a text too bring one set to be compared, whatever their number. Other columns of docs
    are ignored, so clashing names do no harm. A null id counts as larger than every other:
    such a row is kept only where its component has null ids alone.

    Method: equal sets are one node from the start, whatever their number. `trees`
    independent trees branch the sets by ROOT tokens that minwise hashes choose; a node of
    more than LEAF sets is branched by the next token, DEPTH tokens deep. Leaves compare
    sketches of minwise values exhaustively, which yields groups that hold every pair seen
    as near; full sets then decide inside the groups. A pair at similarity 0.85 is in one
    leaf of a tree with chance 0.72 (two tokens) to 0.52 (four), so sixteen trees miss it
    with chance 1e-9 to 8e-6; at 0.80 with 8e-8 to 2e-4. A node still too large at the deepest level is a group as it is. A group
    of more than BLOCK sets, or of more than LOAD shingles, is dealt into blocks that share HUBS sets. Sets that no block
    joins to the largest part are tied in a second step to the sets of the group that share
    one of their rarest shingles at a place that leaves room for the overlap, which every
    linked pair does; full sets are compared inside what is tied, so no link is lost, and a
    group that is alike but not linked costs no more than its rare shingles.
    """
    return _linked(docs, id_col, text, width, hundredths, trees, scratch).select("id", "n_shingles", "component_id", "kept")


def _linked(docs: DataFrame, id_col: str, text: str, width: int, hundredths: int, trees: int, scratch: Scratch | None) -> DataFrame:
    """The rows of similarity_components with the fingerprint of their set (fp) and of their group (its own if alone); null without words."""
    spark = docs.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "chosenpath")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_rows = scratch.keep(sketches(docs, text, id_col, width), "sketches")
    reps = scratch.keep(all_rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n")), "sets")

    rows, leaves, near = _rooted(reps, trees), [], None
    levels = DEPTH - ROOT + 1
    for level in range(1, levels + 1):
        # written, so that the join has exchanges of its own, whose large partitions can be split
        sizes = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), f"sizes{level}")
        if level == 1:
            rows = _rooted(reps, trees, spark.sparkContext.broadcast(_filter(sizes, F.col("key"))))
        rows = scratch.keep(_matched(rows, sizes, "size"), f"level{level}")
        leaves.append(rows.where(F.col("size") <= LEAF).select("key", "fp", "sk"))
        rows = rows.where(F.col("size") > LEAF).drop("size")
        if level < levels:
            if rows.isEmpty():
                break
            rows = _deeper(rows, level)
        else:
            low = scratch.keep(rows.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("c")), "lowest")
            near = _matched(rows, low, "c").where("fp <> b").select(F.col("fp").alias("a"), "b")
    every = reduce(DataFrame.union, leaves).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_leaf, "a binary, b binary")
    near = every if near is None else every.union(near)
    cand = scratch.keep(connected_components(near, scratch), "candidates")
    named = cand.join(reps.select("fp", "rep", "n"), F.col("node") == F.col("fp"))
    size = named.groupBy("component").agg(_n_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    members = scratch.keep(
        named.select("rep", "fp", "component")
        .join(size, "component")
        .select("rep", "fp", "component", "blocks")
        .withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks"))).otherwise(F.lit(0)))
        .withColumn("task", F.xxhash64("component", "block")),
        "members",
    )
    sets = scratch.keep(_with_sets(docs, members, text, id_col, width), "fullsets")
    large = sets.where("blocks > 1")
    n_large = members.where("blocks > 1").count()
    own = sets.select("task", "fp", "set", (F.col("blocks") > 1).alias("big"))
    split = n_large > 0
    if split:
        blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("to")
        # the hubs of a large group, one of each of HUBS slots, stand in all its blocks
        slot = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(HUBS))
        hubs = scratch.keep(large.groupBy("component", slot.alias("slot")).agg(F.min("fp").alias("fp")).select("fp"), "hubs", rows=n_large)
        spread = large.join(hubs, "fp").select("fp", "set", "component", "block", blocks)
        places = spread.select("fp", "component", F.xxhash64("component", F.col("to").alias("block")).alias("task"))
        own = own.union(spread.where("to <> block").select(F.xxhash64("component", F.col("to").alias("block")).alias("task"), "fp", "set", F.lit(True)))
    first = scratch.keep(_compared(own, hundredths, parts), "links")
    links = first.select("a", "b")
    if split:
        # of each large group, the hub whose parts of all blocks are the largest together leads the main part
        stars = first.where("big").select("task", F.col("a").alias("fp"), F.col("b").alias("root"))
        stars = stars.union(stars.select("task", F.col("root").alias("fp"), "root").distinct())
        size = stars.groupBy("task", "root").agg(F.count("*").alias("n"))
        held = places.join(stars, ["task", "fp"]).join(size, ["task", "root"])
        lead = held.groupBy("component", "fp").agg(F.sum("n").alias("n")).groupBy("component").agg(F.max_by("fp", F.struct("n", "fp")).alias("fp"))
        main = held.join(lead, ["component", "fp"]).select("task", "root")
        # a set outside the main part may still be linked with any other set of its group
        rest = scratch.keep(large.join(stars.join(main, ["task", "root"], "left_semi").select("task", "fp"), ["task", "fp"], "left_anti").select("fp", "component"), "rest")
        second = None if rest.isEmpty() else _compared(_second(large, rest, hundredths, scratch), hundredths, parts).select("a", "b")
        every = first.where("big").select("a", "b")
        across = connected_components(every if second is None else every.union(second), scratch)
        links = first.where("not big").select("a", "b")
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = labels.union(labels.select(F.col("component").alias("node"), "component")).distinct()
    labels = labels.union(across) if split else labels
    labels = scratch.keep(labels, "labels")

    least = reps.select("fp", "rep").join(labels, F.col("fp") == F.col("node"))
    low = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    alone = reps.join(labels, F.col("fp") == F.col("node"), "left_anti")
    by_set = least.join(low, "component").select("fp", "component_id", F.col("component").alias("group")).union(alone.select("fp", F.col("rep").alias("component_id"), F.col("fp").alias("group")))
    done = all_rows.select("id", "n_shingles", "fp").join(by_set, "fp", "left")
    root = F.coalesce("component_id", "id")
    return done.select("id", "n_shingles", root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"), "fp", "group")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 5, hundredths: int = 80) -> DataFrame:
    """docs with one row of each group of near copies: the one of the smallest id.

    Rows that repeat an id and a text count as one document, of which one row stays. Other
    texts under an id are judged each for itself; of near copies under one id one stays.
    Texts without words are copies of nothing. Rows without an id cannot be named and stay. Rows
    that a filter of bounded size rules out as dropped pass without a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    found = _linked(docs, id_col, text, width, hundredths, TREES, scratch).where("id is not null")
    several = (F.min("fp") != F.max("fp")) | ((F.count("fp") > 0) & (F.count("fp") < F.count("*")))
    by_id = found.groupBy("id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"), F.coalesce(several, F.lit(False)).alias("several"))
    marked = scratch.keep(by_id.where("n > 1 or not kept").withColumnsRenamed({"id": "_id", "kept": "_kept", "several": "_several"}).drop("n"), "marked")
    own = docs.columns
    # a row whose id is null is never marked
    maybe = F.col(id_col).isNotNull() & _maybe(marked, "_id", id_col)
    rest = docs.where(maybe).join(marked.hint("shuffle_hash"), F.col(id_col) == F.col("_id"), "left")
    alone = rest.where("_id is null").select(*own)
    first = rest.where("_kept and not _several").select(*own).dropDuplicates([id_col])
    out = docs.where(~maybe).unionByName(alone).unionByName(first)
    if marked.where("_several").isEmpty():
        return out

    @F.arrow_udf("binary")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array([_print(u) if len(u) else None for u in _sets(column, width)], pa.binary())

    # ids of several texts: one row of each group of near copies that the id is the smallest of
    ids = marked.where("_several").select(F.col("_id").alias("id"))
    stay = found.where("kept").join(ids, "id").groupBy("id", "group").agg(F.min("fp").alias("_stays")).select(F.col("id").alias("_named"), "_stays")
    each = rest.where("_several").select(*own, prints(F.col(text)).alias("_fp"))
    each = each.join(stay, (F.col(id_col) == F.col("_named")) & F.col("_fp").eqNullSafe(F.col("_stays")))
    return out.unionByName(each.dropDuplicates([id_col, "_fp"]).select(*own))
