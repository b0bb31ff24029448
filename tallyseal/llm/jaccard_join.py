"""N-gram Jaccard join by signature trees.

Sets that can be similar share a token among the rarest tokens of each (prefix
filter; rarity comes from counters over all documents, of fixed size). The sets that
share a token, once for all tokens that the same sets share, go through a signature tree: nodes hold the OR of token bitmaps, the
size range, the collision slack of their bitmaps and, once all members are connected,
their component; a dual traversal drops node pairs whose greatest possible overlap is
too small or whose members are connected already. Here bitmaps alone decide, and a
spanning forest of what they let pass is written, not all pairs. Distributed connected
components over these edges give coarse groups that no link leaves; every distinct set
then goes with its tokens to the one task of its coarse group, where the same tree
with exact intersections at the end finds the links. A token counts only if for one of
its sets it is among the even rarer tokens of which one must be shared with a set at
least as large; so sets that have much in common, but not enough, don't meet. Tokens with
more than `hot_sets` sets are split by size ranges that overlap, and sets of one size
into blocks that meet in pairs, so that no linked pair is parted and no task has more.

A coarse group with more than `group_tokens` tokens or `group_sets` sets is cut into
blocks by size. Each block is joined by itself, together with a few hubs, sets of all
sizes that go to every block of their range; what the blocks and hubs link is one main
component in a family of near copies. Two sets of it need not meet any more, so only
block pairs with a block of other sets are joined, in tasks of their own.

Sets are told apart by 128 bits of a digest. Tables carry a 64-bit name of each, and sets
with other digests that had one name by chance get others before anything is joined.

Edge cases: exact copies are one set with many documents; null or empty texts have
an empty set, are linked with nothing and stand alone; a null id takes no part in
linking and gets a null component; repeated rows give repeated result rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyseal.llm.common import Scratch, arrow_map, pages_sum, signed, span_hashes, text_slices, window_hashes, word_hashes

COUNTERS = 1 << 18
PAGE = 1 << 12
BITS = 2048
HOT_SETS = 20_000
#: Ids up to so many are sent to all executors to pick rows by; with more, the rows are shuffled.
FEW_IDS = 2_000_000
#: Sets of each size range that meet all sets of a large group near their size.
HUBS = 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a shorter text is one shingle."""
    hashes, first = word_hashes(data, offsets, lower=True)
    n = np.diff(first)
    grams = window_hashes(hashes, words)
    out = []
    for i, k in enumerate(n):
        a = first[i]
        if k >= words:
            out.append(np.unique(grams[a : a + k - words + 1]))
        elif k:
            out.append(span_hashes(hashes[a : a + k], np.array([0]), np.array([k])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set of sorted hashes."""
    return struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest())


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for i, _, data, offs in text_slices(batch):
            yield batch, i, shingle_sets(data, offs, words)


def token_counters(docs: DataFrame, words: int) -> np.ndarray:
    """Documents that hold a token of each counter, over all documents; the array has a fixed size."""

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(COUNTERS, np.uint32)
        for _, _, sets in _sets(batches, words):
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTERS // PAGE, dtype=np.int32)), pa.array(np.full(COUNTERS // PAGE, part, np.int32)), pa.array([total[k : k + PAGE].tobytes() for k in range(0, COUNTERS, PAGE)], pa.binary())], names=["page", "part", "data"])

    made = arrow_map(docs.select("text"), count, "page int, part int, data binary")
    pages = pages_sum(made, docs.rdd.getNumPartitions()).collect()  # COUNTERS / PAGE rows
    total = np.zeros(COUNTERS, np.uint32)
    for r in pages:
        total[r["page"] * PAGE : (r["page"] + 1) * PAGE] = np.frombuffer(r["data"], np.uint32)
    return total


def signature(s: np.ndarray) -> bytes:
    """Bitmap of a set, of the power of two from 256 to 65536 bits at or above its size; a wider one folds onto a narrower."""
    bits = min(max(256, 1 << int(len(s) - 1).bit_length()), 1 << 16)
    one = np.zeros(bits, np.uint8)
    one[((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(one).tobytes()


def _fold(sig: bytes, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(sig, np.uint8).reshape(-1, width), 0)


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens of a set of n in any one order of which a set with Jaccard similarity num/den must share one."""
    return n - -(-n * num // den) + 1


def index_length(n: int, num: int, den: int) -> int:
    """As prefix_length, where the other set is at least as large: the first common token then lies in this shorter prefix."""
    return n - -(-2 * n * num // (num + den)) + 1


def _prefixes(batches, words: int, num: int, den: int, counters) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, k1, k2, n, tokens, lead, sig) a document, `lead` of the tokens being its index prefix; tokens and signature only the first time that this task meets the set."""
    rank, seen = counters.value, set()
    for batch, i, sets in _sets(batches, words):
        ids = batch.column(batch.schema.get_field_index("doc_id")).slice(i, len(sets))
        keys, sizes, tokens, leads, sigs = [], [], [], [], []
        for s, known in zip(sets, ids.is_valid().to_pylist(), strict=True):
            n = len(s)
            key = set_key(s) if n else (None, None)
            keys.append(key)
            sizes.append(n)
            leads.append(index_length(n, num, den) if n else 0)
            if not known or not n or key in seen:
                tokens.append(None)
                sigs.append(None)
                continue
            if len(seen) < 1_000_000:
                seen.add(key)
            p = prefix_length(n, num, den)
            order = np.lexsort((s, rank[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:p]
            tokens.append(signed(s[order]))
            sigs.append(signature(s))
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), *(pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(leads, pa.int32()), pa.array(sigs, pa.binary())],
            names=["doc_id", "k1", "k2", "n", "tokens", "lead", "sig"],
        )


def named(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of sets(doc_id, k1, k2, n, ...) with a 64-bit name `sid` of their key (null without a key), and each name's (sid, k1, k2, n, smallest doc_id).

    A name is k1; keys that share one get hashes of the whole key instead, and again until every key has a name of its own.
    """
    rows, turn = sets.withColumn("sid", F.col("k1")), 0
    while True:
        ends = [f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]
        who = scratch.keep(rows.where("sid is not null").groupBy("sid").agg(*ends, F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "names")
        shared = who.where("min_k1 != max_k1 or min_k2 != max_k2").select("sid", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return rows, who.selectExpr("sid", "min_k1 as k1", "min_k2 as k2", "n", "doc_id")
        turn += 1
        name = F.when(F.col("shared"), F.xxhash64("k1", "k2", F.lit(turn))).otherwise(F.col("sid"))
        rows = scratch.keep(rows.join(shared, "sid", "left").withColumn("sid", name).drop("shared"), "renamed")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) with the smallest reachable node as label: large-star and small-star rounds over written tables, until nothing changes."""
    now = scratch.keep(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u != v").distinct(), "edges")
    last = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("if(v = m, u, v) as u", "m as v").where("u != v").distinct()
        new = scratch.keep(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            scratch.drop(now)
            break
        scratch.drop(now)
        now, last = new, tuple(state)
    return new.selectExpr("u as node", "v as label").union(new.selectExpr("v as node", "v as label").distinct())


def are_few(ids: DataFrame) -> bool:
    return ids.limit(FEW_IDS + 1).count() <= FEW_IDS


def picked(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows whose id is one of ids(id) (left_semi), or isn't (left_anti). Rows hold texts, so they stay where they are while the ids, counted before, are few."""
    return rows.join(F.broadcast(ids) if are_few(ids) else ids.hint("shuffle_hash"), ids.columns, how)


class _Tree:
    """Signature tree over sets in the order given: node k covers [lo, hi)."""

    LEAF = 32

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, np.ascontiguousarray(bits).view(np.uint64)
        self.slack = sizes - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.nodes: list[tuple[int, int, int, int, int, np.ndarray, int, int]] = []
        self.root = self._build(0, len(sizes))

    def _build(self, lo: int, hi: int) -> int:
        if hi - lo <= self.LEAF:
            left = right = -1
            bits = np.bitwise_or.reduce(self.bits[lo:hi], 0)
        else:
            mid = (lo + hi) // 2
            left, right = self._build(lo, mid), self._build(mid, hi)
            bits = self.nodes[left][5] | self.nodes[right][5]
        self.nodes.append((lo, hi, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), int(self.slack[lo:hi].max()), bits, left, right))
        return len(self.nodes) - 1


def link_sets(sets: list[np.ndarray] | None, num: int, den: int, cut: int | None = None, sizes: np.ndarray | None = None, bits: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Component of every set (index of its smallest member) under Jaccard >= num/den, and the exact comparisons made.

    With cut, only links between the sets before and from cut on are looked for. Without sets, pairs that sizes and bitmaps let pass count as linked.
    """
    exact = sets is not None
    if exact:
        sizes = np.array([len(s) for s in sets], np.int64)
    m = len(sizes)
    up = np.arange(m)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def linked(inter, total):  # total: sum of the two sizes
        return den * inter >= num * (total - inter)

    made = 0
    flat = np.concatenate(sets) if exact and m else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if exact and m == 2:
        if linked(len(np.intersect1d(sets[0], sets[1], assume_unique=True)), sizes.sum()):
            up[1] = 0
        return up, 1

    def overlaps(i: int, js: np.ndarray) -> np.ndarray:
        lens = sizes[js]
        at = np.repeat(starts[js] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        x, s = flat[at], sets[i]
        k = np.searchsorted(s, x)
        k[k == len(s)] = 0
        return np.add.reduceat((s[k] == x).astype(np.int64), np.concatenate([[0], np.cumsum(lens)[:-1]]))

    def compare(i: int, js: np.ndarray) -> None:
        nonlocal made
        js = js[(sizes[js] * den >= sizes[i] * num) & (sizes[i] * den >= sizes[js] * num)]
        if len(js):
            made += len(js)
            for j in js[linked(overlaps(i, js), sizes[i] + sizes[js])] if exact else js:
                a, b = root(i), root(int(j))
                up[max(a, b)] = min(a, b)

    if exact and cut is None:  # first a few hubs, which connect most of a family in one pass each
        for _ in range(8):
            roots = np.array([root(i) for i in range(m)])
            names, counts = np.unique(roots, return_counts=True)
            alone = names[counts == 1]
            if len(alone) < 2:
                break
            hub = int(alone[len(alone) // 2])
            compare(hub, alone[alone != hub])
    if exact:
        bits = np.zeros((m, BITS // 8), np.uint8)
        for i, s in enumerate(sets):
            one = np.zeros(BITS, np.uint8)
            one[((s >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
            bits[i] = np.packbits(one)
    tree = _Tree(sizes, bits)
    nodes = tree.nodes
    same = {}

    def whole(k: int, roots: np.ndarray) -> int:
        lo, hi = nodes[k][:2]
        r = roots[lo]
        return int(r) if (roots[lo:hi] == r).all() else -1

    roots = np.array([root(i) for i in range(m)])
    for k in range(len(nodes)):
        same[k] = whole(k, roots)
    stack = [(tree.root, tree.root)]
    while stack:
        x, y = stack.pop()
        xl, xh, xa, xb, xs, xbits, x1, x2 = nodes[x]
        yl, yh, ya, yb, ys, ybits, y1, y2 = nodes[y]
        if cut is not None and (yh <= cut or xl >= cut):
            continue
        if same[x] >= 0 and same[y] >= 0 and root(same[x]) == root(same[y]):
            continue
        if x != y:
            most = min(xb, yb, int(np.bitwise_count(xbits & ybits).sum(dtype=np.int64)) + min(xs, ys))
            if xb * den < ya * num or yb * den < xa * num or (num + den) * most < num * (xa + ya):
                continue
        if x1 < 0 and y1 < 0:
            left, right = np.arange(xl, xh), np.arange(yl, yh)
            near = np.array([root(i) for i in range(xl, xh)])[:, None] != np.array([root(j) for j in range(yl, yh)])
            near &= left[:, None] < right
            if cut is not None:
                near &= (left[:, None] < cut) & (right >= cut)
            if near.any():
                most = np.bitwise_count(tree.bits[left][:, None] & tree.bits[right]).sum(2, dtype=np.int64) + np.minimum(tree.slack[left][:, None], tree.slack[right])
                near &= (num + den) * most >= num * (sizes[left][:, None] + sizes[right])
            for i in np.flatnonzero(near.any(1)).tolist():
                js, r = right[near[i]], root(xl + i)
                js = js[[root(int(j)) != r for j in js]]
                if len(js):
                    compare(xl + i, js)
            for k in {x, y}:
                ends = {root(i) for i in range(nodes[k][0], nodes[k][1])}
                same[k] = ends.pop() if len(ends) == 1 else -1
        elif x == y:
            stack += [(x1, x2), (x2, x2), (x1, x1)]
        elif y1 < 0 or (x1 >= 0 and xh - xl >= yh - yl):
            stack += [(x2, y), (x1, y)]
        else:
            stack += [(x, y2), (x, y1)]
    return np.array([root(i) for i in range(m)]), made


def _candidates(batches, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (held, part, n, sid, sig) sorted by them to a spanning forest (a, b) of the pairs that may be linked in each group."""

    def groups():
        held: list = []
        now = None
        for batch in batches:
            for group, part, n, sid, sig in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                # sorted by size: where two neighbours are too far apart no pair reaches across
                if held and ((group, part) != now or held[-1][0] * den < n * num):
                    yield held
                    held = []
                now = (group, part)
                if not held or held[-1][1] != sid:
                    held.append((n, sid, sig))
        if held:
            yield held

    edges: dict[tuple[int, int], None] = {}
    for held in groups():
        if len(held) < 2:
            continue
        width = min(len(h[2]) for h in held)
        if len(held) == 2:
            x, y = (int.from_bytes(_fold(h[2], width).tobytes()) for h in held)
            a, b = held[0][0], held[1][0]
            if (num + den) * ((x & y).bit_count() + min(a - x.bit_count(), b - y.bit_count())) >= num * (a + b):
                edges[held[1][1], held[0][1]] = None
        else:
            held.sort(key=lambda h: (h[2][:4], h[0], h[1]))
            label, _ = link_sets(None, num, den, None, np.array([h[0] for h in held], np.int64), np.stack([_fold(h[2], width) for h in held]))
            for i in np.flatnonzero(label != np.arange(len(held))):
                edges[held[i][1], held[label[i]][1]] = None
        if len(edges) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])
            edges = {}
    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])


def _link_groups(batches, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, side, n, sid) to star edges (a, b) of each group's links; side 0 and 1: only links across."""

    def groups():
        held: list = []
        now = None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            for grp, side, sid, data in zip(*cols, strict=True):
                if held and grp != now:
                    yield held
                    held = []
                now = grp
                held.append((side, sid, np.frombuffer(data, np.uint64)))
        if held:
            yield held

    a, b = [], []
    for held in groups():
        if len(held) < 2:
            continue
        sides = [h[0] for h in held]
        cut = sides.index(1) if 1 in sides else None
        if cut is None:  # similar sets come close together by their smallest tokens
            held.sort(key=lambda h: (h[2][:2].tolist(), len(h[2])))
        label, _ = link_sets([h[2] for h in held], num, den, cut)
        for i in np.flatnonzero(label != np.arange(len(held))):
            a.append(held[i][1])
            b.append(held[label[i]][1])
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def size_range(num: int, den: int):
    """Column of the range of sizes of `n`: sets that can be linked lie in one range or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)) * 1.0001)).cast("int")


def _cut(rows: DataFrame, by: list[str], tokens: int, sets: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a number `cut` each, so that the rows of one number have half of the tokens and sets at most, as a rule; and the numbers of each `by`."""
    cuts = F.greatest(F.ceil(F.sum("n") * 2 / tokens), F.ceil(F.count("*") * 2 / sets)).alias("cuts")
    volume = rows.groupBy(*by).agg(cuts)
    blocks = volume.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
    return rows.join(volume, by).withColumn("cut", F.pmod(F.xxhash64("sid"), F.col("cuts"))).drop("cuts"), blocks


def hub_blocks(large: DataFrame, tokens: int, sets: int) -> DataFrame:
    """Each block of large(grp, bin, sid, n, data), with hubs of its own and the neighbouring size ranges as further members."""
    rows, blocks = _cut(large, ["grp", "bin"], tokens, sets)
    slot = F.pmod(F.xxhash64("sid", F.lit("hub")), F.lit(HUBS)).alias("slot")
    names = rows.groupBy("grp", "bin", slot).agg(F.min("sid").alias("sid")).drop("slot")
    hubs = rows.join(names, ["grp", "bin", "sid"]).withColumnsRenamed({"bin": "bin0", "cut": "cut0"})
    hubs = hubs.withColumn("bin", F.explode(F.array(F.col("bin0") - 1, F.col("bin0"), F.col("bin0") + 1))).join(blocks, ["grp", "bin"]).where("bin != bin0 or cut != cut0")
    cols = [F.xxhash64("grp", "bin", "cut").alias("grp"), F.lit(0).alias("side"), "sid", "n", "data"]
    return rows.select(cols).union(hubs.select(cols))


def block_pairs(large: DataFrame, labels: DataFrame, tokens: int, sets: int) -> DataFrame:
    """Pairs of blocks of large(grp, bin, sid, n, data) that may have links, but for pairs within the component of most sets of a group; labels(sid, part) has the sets that are linked already."""
    rows = large.join(labels, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    main = rows.groupBy("grp", "part").count().groupBy("grp").agg(F.max_by("part", F.struct("count", "part")).alias("main_part"))
    rows = rows.join(main, "grp").withColumn("main", F.col("part") == F.col("main_part")).drop("part", "main_part")
    rows, blocks = _cut(rows, ["grp", "bin", "main"], tokens, sets)
    other = blocks.withColumnsRenamed({"bin": "bin2", "main": "main2", "cut": "cut2"})
    order = F.struct("bin2", "main2", "cut2") >= F.struct(F.col("bin").alias("bin2"), F.col("main").alias("main2"), F.col("cut").alias("cut2"))
    pair = blocks.join(other, "grp").where("bin2 between bin and bin + 1 and not (main and main2)").where(order)
    key = F.xxhash64("grp", "bin", "main", "cut", "bin2", "main2", "cut2").alias("pair")
    first = rows.join(pair, ["grp", "bin", "main", "cut"]).select(key.alias("grp"), F.lit(0).alias("side"), "sid", "n", "data")
    again = pair.where("bin != bin2 or main != main2 or cut != cut2")
    second = rows.withColumnsRenamed({"bin": "bin2", "main": "main2", "cut": "cut2"}).join(again, ["grp", "bin2", "main2", "cut2"])
    return first.union(second.select(key.alias("grp"), F.lit(1).alias("side"), "sid", "n", "data"))


def jaccard_components(docs: DataFrame, *, words: int = 3, threshold: tuple[int, int] = (90, 100), group_tokens: int = 4_000_000, group_sets: int = 20_000, hot_sets: int = HOT_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) for each row of docs(doc_id, text): links at Jaccard >= threshold, followed to components."""
    spark: SparkSession = docs.sparkSession
    num, den = threshold
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counters = spark.sparkContext.broadcast(token_counters(docs, words))  # COUNTERS x 4 bytes
    sets = scratch.keep(arrow_map(docs, lambda it: _prefixes(it, words, num, den, counters), "doc_id long, k1 long, k2 long, n long, tokens array<long>, lead int, sig binary"), "prefixes")
    sets, who = named(sets, scratch)
    tokens = sets.where("tokens is not null").select("sid", "n", "lead", F.posexplode("tokens").alias("place", "tok")).withColumn("first", F.col("place") < F.col("lead")).drop("lead", "place")
    # tokens that the same sets share make one group (a mark that two groups have by chance joins them, which loses nothing)
    # each token goes to its group's other rows once: sums over a window instead of a join with sums, which would shuffle all tokens twice
    of = {
        "lo": F.min("sid"), "hi": F.max("sid"), "sets": F.count("*"), "mark": F.bit_xor("sid"), "least": F.min("n"), "most": F.max("n"), "smallest": F.min(F.when(F.col("first"), F.col("n"))),
    }
    shared = tokens.withColumns({k: c.over(Window.partitionBy("tok")) for k, c in of.items()})
    # of a linked pair the smaller set has the first common token in its index prefix: a group without such a set has no link
    shared = shared.where((F.col("lo") != F.col("hi")) & F.col("smallest").isNotNull() & ((F.col("sets") > 2) | (F.col("least") * den >= F.col("most") * num)))  # two sets alone must be of like sizes
    rows = shared.where(F.col("first") | (F.col("n") >= F.col("smallest"))).select(F.xxhash64("lo", "hi", "sets", "mark").alias("held"), "sid", "n", "sets").distinct()
    band = size_range(num, den)
    # a hot group is split by size ranges that overlap, and each into blocks that meet in pairs
    blocks = F.ceil(F.col("sets") * 2 / hot_sets).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda c: F.least(own, c) * blocks + F.greatest(own, c))
    split = F.flatten(F.transform(F.array(band, band + 1), lambda x: F.transform(pairs, lambda c: x.cast("long") * (1 << 32) + c)))
    parts_of = F.when(F.col("sets") > hot_sets, split).otherwise(F.array(F.lit(-1).cast("long")))
    signs = sets.where("sig is not null").groupBy("sid").agg(F.first("sig").alias("sig"))
    signed_rows = rows.join(signs, "sid").select("held", F.explode(parts_of).alias("part"), "n", "sid", "sig")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed_rows.repartition(parts, "held", "part").sortWithinPartitions("held", "part", "n", "sid")
    edges = scratch.keep(arrow_map(dealt, lambda it: _candidates(it, num, den), "a long, b long").distinct(), "edges")
    scratch.sweep()
    coarse = scratch.keep(components(edges, scratch), "coarse")
    scratch.drop(edges)

    # one document stands for each set of a coarse group, and its whole text is read again
    member = who.where("doc_id is not null").join(coarse.withColumnRenamed("node", "sid"), "sid")
    member = scratch.keep(member.select("doc_id", "sid", "n", F.col("label").alias("grp"), "k1", "k2"), "members")
    big = scratch.keep(member.groupBy("grp").agg(F.sum("n").alias("size"), F.count("*").alias("sets")).where((F.col("size") > group_tokens) | (F.col("sets") > group_sets)).select("grp"), "big")
    scratch.sweep()

    def fetch(batches):
        for batch in batches:
            sid, n, grp = (batch.column(k) for k in (2, 3, 4))
            keys = list(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True))
            for i, j, data, offs in text_slices(batch):
                got = shingle_sets(data, offs, words)
                ok = np.array([set_key(s) == x if len(s) else False for s, x in zip(got, keys[i:j], strict=True)])
                out = [s.tobytes() if k else None for s, k in zip(got, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([sid.slice(i, j - i), n.slice(i, j - i), grp.slice(i, j - i), pa.array(out, pa.binary())], names=["sid", "n", "grp", "data"]).filter(pa.array(ok))

    texts = picked(docs, member.select("doc_id"), "left_semi").join(member.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "sid", "n", "grp", "k1", "k2")
    full = arrow_map(texts, fetch, "sid long, n long, grp long, data binary")

    def solve(rows: DataFrame) -> DataFrame:
        dealt = rows.select("grp", "side", "sid", "data", "n").repartition(parts, "grp").sortWithinPartitions("grp", "side", "n", "sid").select("grp", "side", "sid", "data")
        return arrow_map(dealt, lambda it: _link_groups(it, num, den), "a long, b long")

    if big.isEmpty():
        links = scratch.keep(solve(full.withColumn("side", F.lit(0))), "links")
    else:
        held = scratch.keep(full, "sets")
        small = held.join(big, "grp", "left_anti").withColumn("side", F.lit(0))
        large = held.join(big, "grp").withColumn("bin", band)
        near = scratch.keep(solve(hub_blocks(large, group_tokens, group_sets)), "near")
        labels = components(near, scratch).withColumnsRenamed({"node": "sid", "label": "part"})
        links = scratch.keep(near.union(solve(small)).union(solve(block_pairs(large, labels, group_tokens, group_sets))), "links")
    scratch.sweep()
    fine = components(links, scratch)
    least = who.where("doc_id is not null").select("sid", F.col("doc_id").alias("least"))
    joined = least.join(fine.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    smallest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    label = scratch.keep(joined.join(smallest, "label").select("sid", "component_id"), "labels")
    out = sets.select("doc_id", "n", "sid").join(label, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.col("sid").alias("set_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("set_id")
