"""Exact top-k inner-product search by KD-trees per shard.

Vectors are cut into shards by the first levels of one KD-tree, whose median splits
come from a bounded sample; every vector is dealt, and a cell with more rows than a
shard holds (copies of one vector, say) is cut further by hash. A task builds the
KD-tree of its shard once (median splits of the widest dimension, tight boxes), and
queries stream past it in batches: each query goes best first through the nodes, by
the greatest score that a node's box allows, until that is below its kth score.

A first round sends each query to one home shard, the one that promises most, and
finds the shards' exact boxes. The kth scores are propagated to the second round, in
which a query goes only to shards whose box reaches its kth score. So vectors are
shuffled once a round, whatever the number of queries up to `slice_queries`, and only
queries are sent several times. A shard is asked by at most `slice_queries` queries in
one task; beyond, queries are cut into slices and the shard has a task for each.

Edge cases: null vectors, null ids and vectors with null or non-finite components take
no part; vectors are compared with vectors of their own length only, empty ones too
(score 0); a query id that repeats is asked once, with the least of its vectors; rows
that repeat an id are candidates each, except for the query of that id; equal scores go
to the smaller id; fewer candidates than k give them all; a component whose integer, or
a score that, doesn't fit 64 bits raises an error; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyseal.llm.common import Scratch, arrow_map

LEAF = 256
BATCH = 2048  # queries that go through a tree together
NONE = np.iinfo(np.int64).min


def bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Greatest inner product of each query with any point of each box (a row each of lo and hi)."""
    return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T


def kind_for(vectors: np.ndarray, queries: np.ndarray):
    """A type whose sums of products are exact: floats while they are whole, then 64-bit, then unbounded integers."""
    wide = max((abs(int(f(vectors))) for f in (np.min, np.max)), default=0) if vectors.size else 0
    wide *= max((abs(int(f(queries))) for f in (np.min, np.max)), default=0) if queries.size else 0
    wide *= max(vectors.shape[1], 1)
    return np.float64 if wide < 1 << 52 else np.int64 if wide < 1 << 62 else object


def _whole(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and scores.size and max(abs(int(scores.max())), abs(int(scores.min()))) >= (1 << 63) - 1:
        raise OverflowError("an inner product doesn't fit 64 bits")
    return scores.astype(np.int64)


class KDTree:
    """Nodes (first row, last row, left, right) over rows in tree order, and their tight boxes."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order, self.nodes, stack = np.arange(len(vectors)), [[0, len(vectors), -1, -1]], [0]
        while stack:
            x = stack.pop()
            a, b = self.nodes[x][:2]
            if b - a <= LEAF:
                continue
            part = vectors[order[a:b]]
            spread = part.max(0).astype(np.float64) - part.min(0) if part.shape[1] else np.zeros(0)
            if not spread.size or spread.max() <= 0:
                continue  # equal vectors stay one leaf
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, int(spread.argmax())], mid)]
            for side, (c, d) in enumerate(((a, a + mid), (a + mid, b))):
                self.nodes[x][2 + side] = len(self.nodes)
                stack.append(len(self.nodes))
                self.nodes.append([c, d, -1, -1])
        self.vectors, self.ids = vectors[order], ids[order]
        self.lo = np.stack([self.vectors[a:b].min(0) for a, b, _, _ in self.nodes])
        self.hi = np.stack([self.vectors[a:b].max(0) for a, b, _, _ in self.nodes])
        self._cast: dict = {}

    def _as(self, kind):
        if kind not in self._cast:
            self._cast[kind] = tuple(x.astype(kind) for x in (self.vectors, self.lo, self.hi))
        return self._cast[kind]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best rows with a score of at least `least`, without rows of its own id."""
        m = len(queries)
        kind = kind_for(self.vectors, queries)
        vectors, lo, hi = self._as(kind)
        queries = queries.astype(kind)
        best_s, best_i = np.full((m, k), NONE), np.full((m, k), np.iinfo(np.int64).max)
        kth = least.astype(np.int64).copy()
        low = -np.inf if kind is np.float64 else NONE if kind is np.int64 else -(1 << 200)
        front = np.full((m, len(self.nodes)), low, kind)  # bounds of the nodes that each query may visit next
        front[:, 0] = bounds(queries, lo[:1], hi[:1])[:, 0]
        active = np.arange(m)
        while len(active):
            node = front[active].argmax(1)
            promise = front[active, node]
            go = (promise >= kth[active]) & (promise > low)
            active, node = active[go], node[go]
            front[active, node] = low
            for x in np.unique(node):
                rows = active[node == x]
                a, b, left, right = self.nodes[x]
                if left >= 0:
                    front[np.ix_(rows, [left, right])] = bounds(queries[rows], lo[[left, right]], hi[[left, right]])
                    continue
                for c in range(a, b, 4 * LEAF):
                    self._leaf(rows, queries[rows] @ vectors[c : min(c + 4 * LEAF, b)].T, self.ids[c : min(c + 4 * LEAF, b)], query_ids, kth, best_s, best_i, k)
        q, c = np.nonzero((best_s != NONE) & (best_s >= least[:, None]))
        return q, best_i[q, c], best_s[q, c]

    @staticmethod
    def _leaf(rows, s, ids, query_ids, kth, best_s, best_i, k) -> None:
        own = ids[None, :] == query_ids[rows][:, None]
        s[own] = 0  # whatever the score with itself
        s = _whole(s)
        s[own] = NONE
        r, c = np.nonzero((s >= kth[rows][:, None]) & ~own)
        if not len(r):
            return
        # the rows' best so far and what reaches their kth score, sorted together
        near = np.unique(r)
        old_r, old_c = np.nonzero(best_s[rows[near]] != NONE)
        old = rows[near[old_r]]
        who = np.concatenate([rows[r], old])
        score, name = np.concatenate([s[r, c], best_s[old, old_c]]), np.concatenate([ids[c], best_i[old, old_c]])
        order = np.lexsort((name, -score, who))
        who, score, name = who[order], score[order], name[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        place = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
        keep = place < k
        who, place = who[keep], place[keep]
        best_s[who, place], best_i[who, place] = score[keep], name[keep]
        full = rows[near]
        kth[full] = np.maximum(kth[full], best_s[full, -1])


class Cut:
    """The first levels of a KD-tree: cells by median splits of a sample; a vector's cell is found by descent."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[list] = []  # (dimension, bound, left, right), or (-1, cell, 0, 0)
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self._grow(sample, cells)

    def _grow(self, part: np.ndarray, cells: int) -> int:
        own = len(self.nodes)
        self.nodes.append([-1, 0, 0, 0])
        spread = part.max(0).astype(np.float64) - part.min(0) if part.size else np.zeros(0)
        d = int(spread.argmax()) if spread.size else 0
        if cells > 1 and len(part) > 1 and spread.size and spread[d] > 0:
            values = np.sort(part[:, d])
            bound = values[len(values) * (cells // 2) // cells]
            bound = bound if bound > values[0] else values[values > values[0]][0]
            left = self._grow(part[part[:, d] < bound], cells // 2)
            self.nodes[own] = [d, int(bound), left, self._grow(part[part[:, d] >= bound], cells - cells // 2)]
        else:
            self.nodes[own][1] = len(self.lo)
            self.lo.append(part.min(0) if len(part) else np.zeros(part.shape[1], np.int64))
            self.hi.append(part.max(0) if len(part) else np.zeros(part.shape[1], np.int64))
        return own

    def cells(self, v: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(v), np.int32), [(0, np.arange(len(v)))]
        while stack:
            x, rows = stack.pop()
            d, bound, left, right = self.nodes[x]
            if d < 0:
                out[rows] = bound
            elif len(rows):
                under = v[rows, d] < bound
                stack += [(left, rows[under]), (right, rows[~under])]
        return out

    def best(self, q: np.ndarray) -> np.ndarray:
        """The cell whose sample promises each query most."""
        return bounds(q.astype(np.float64), np.stack(self.lo).astype(np.float64), np.stack(self.hi).astype(np.float64)).argmax(1).astype(np.int32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch):
    """(dim, rows) of a batch with a column dim."""
    dims = np.asarray(batch.column("dim"))
    for d in np.unique(dims).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(dims == d)))


ROW = "shard int, slice int, box int, side int, dim int, vec_id long, v array<long>, least long"
FOUND = "shard int, dim int, query_id long, vec_id long, score long, lo array<long>, hi array<long>"


def _asked(batches, k: int, with_boxes: bool):
    """Rows sorted by (shard, slice, side, ...): a shard's vectors (side 0), then its queries, to what is found and, for the first slice, the shard's box."""
    none = pa.nulls(0, pa.list_(pa.int64()))
    now, held, tree = None, [], None

    def grown():
        return KDTree(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    for batch in batches:
        key = np.stack([np.asarray(batch.column(c)) for c in ("shard", "slice", "side")], 1)
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            shard, part, side = key[a].tolist()
            rows = batch.slice(a, b - a)
            dim = rows.column("dim")[0].as_py()
            if (shard, part) != now:
                if with_boxes and held and now[1] == 0:
                    yield _box(now[0], tree or grown())
                now, held, tree = (shard, part), [], None
            v, ids = _matrix(rows.column("v"), dim), np.asarray(rows.column("vec_id"))
            if side == 0:
                held.append((v, ids))
                continue
            if not held:
                continue
            tree = tree or grown()
            least = np.asarray(rows.column("least"))
            for i in range(0, len(v), BATCH):
                q, found, score = tree.search(v[i : i + BATCH], ids[i : i + BATCH], least[i : i + BATCH], k)
                n = len(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(ids[i : i + BATCH][q]), pa.array(found), pa.array(score), pa.nulls(n, none.type), pa.nulls(n, none.type)],
                    names=["shard", "dim", "query_id", "vec_id", "score", "lo", "hi"],
                )
    if with_boxes and held and now[1] == 0:
        yield _box(now[0], tree or grown())


def _box(shard: int, tree: KDTree) -> pa.RecordBatch:
    null = pa.nulls(1, pa.int64())
    lists = [pa.array([x[0].tolist()], pa.list_(pa.int64())) for x in (tree.lo, tree.hi)]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([tree.lo.shape[1]], pa.int32()), null, null, null, *lists], names=["shard", "dim", "query_id", "vec_id", "score", "lo", "hi"])


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, shard_values: int = 512_000, sample_rows: int = 20_000, slice_queries: int = 1_000_000, most_boxes: int = 4096) -> DataFrame:
    """vectors and queries (vec_id long, v array<long>, no nulls) to (query_id, vec_id, score, rank).

    A shard has about `shard_values` components; the cut is fitted on at most `sample_rows` vectors of a length. At most `most_boxes`
    boxes a length are sent to all executors: with more shards, neighbouring ones share a box.
    """
    spark = vectors.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark, "topk")
    vectors = scratch.keep(vectors.select("vec_id", "v", F.size("v").alias("dim")), "vectors")
    queries = scratch.keep(queries.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("dim")), "queries")
    asked = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each vector length
    counts = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect() if r["dim"] in asked}
    rows_of = {d: max(1, shard_values // max(d, 1)) for d in counts}
    cuts = {}
    for d, n in counts.items():
        cells = -(-n // rows_of[d])
        if cells > 1 and d:
            sample = vectors.where(F.col("dim") == d).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(sample_rows, 64 * cells)).select("v").collect()
            cuts[d] = Cut(np.array([r["v"] for r in sample], np.int64), cells)
        else:
            cuts[d] = Cut(np.zeros((0, d), np.int64), 1)
    held = sc.broadcast(cuts)

    def dealt(batches, query: bool):
        for batch in batches:
            for d, rows in _by_dim(batch):
                if d in held.value:
                    v = _matrix(rows.column("v"), d)
                    cell = held.value[d].best(v) if query else held.value[d].cells(v)
                    yield rows.append_column("cell", pa.array(cell, pa.int32()))

    celled = scratch.keep(arrow_map(vectors, lambda it: dealt(it, False), "vec_id long, v array<long>, dim int, cell int"), "cells")
    sizes = {(r["dim"], r["cell"]): r["n"] for r in celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}  # a row a shard
    # shards are numbered in tree order, so that neighbours in number are neighbours in space
    plan, first = [], 0
    for d in counts:
        own = [(c, -(-sizes.get((d, c), 0) // (2 * rows_of[d])) or 1) for c in range(len(cuts[d].lo))]
        join = -(-sum(p for _, p in own) // most_boxes)
        at = 0
        for c, parts in own:
            plan.append((d, c, first + at, parts, first, join, -(-asked[d] // slice_queries)))
            at += parts
        first += at
    cells = F.broadcast(spark.createDataFrame(plan, "dim int, cell int, first int, parts int, origin int, join int, slices int"))  # a row a cell
    box = F.expr("origin + (shard - origin) div join").cast("int")
    placed = celled.join(cells, ["dim", "cell"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int"))
    placed = placed.select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), box.alias("box"), F.lit(0).alias("side"), "dim", "vec_id", "v", F.lit(0).cast("long").alias("least"))
    at_home = arrow_map(queries, lambda it: dealt(it, True), "vec_id long, v array<long>, dim int, cell int").join(cells, ["dim", "cell"])
    at_home = at_home.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("slices")).cast("int"))
    at_home = scratch.keep(at_home.select("shard", "slice", box.alias("box"), F.lit(1).alias("side"), "dim", "vec_id", "v", F.lit(-(1 << 62) * 2 + 1).cast("long").alias("least")), "home")

    def solved(asks: DataFrame, boxes: bool) -> DataFrame:
        rows = placed.union(asks.select(*placed.columns)).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "side", "vec_id")
        return arrow_map(rows, lambda it: _asked(it, k, boxes), FOUND)

    round_one = scratch.keep(solved(at_home, True), "first")
    found = round_one.where("query_id is not null")
    # a row a box: the union of its shards' boxes
    joins = {d: (origin, join) for d, _, _, _, origin, join, _ in plan}
    boxes: dict[int, dict[int, list]] = {}
    for r in round_one.where("lo is not null").select("shard", "dim", "lo", "hi").toLocalIterator():
        origin, join = joins[r["dim"]]
        own = boxes.setdefault(r["dim"], {}).setdefault(origin + (r["shard"] - origin) // join, [r["lo"], r["hi"], []])
        own[0], own[1] = [min(x) for x in zip(own[0], r["lo"], strict=True)], [max(x) for x in zip(own[1], r["hi"], strict=True)]
        own[2].append(r["shard"])
    tables = sc.broadcast({d: (np.array([x[0] for x in b.values()], np.int64).reshape(len(b), d), np.array([x[1] for x in b.values()], np.int64).reshape(len(b), d), [x[2] for x in b.values()]) for d, b in boxes.items()})

    def shipped(batches):
        """Each query with its kth score to the shards whose box reaches it, but for its home."""
        for batch in batches:
            for d, rows in _by_dim(batch):
                if d not in tables.value:
                    continue
                lo, hi, shards = tables.value[d]
                v, least, home = _matrix(rows.column("v"), d), np.asarray(rows.column("least")), np.asarray(rows.column("shard"))
                kind = kind_for(np.concatenate([lo, hi]), v)
                for i in range(0, len(v), BATCH):
                    part = slice(i, i + BATCH)
                    q, b = np.nonzero(bounds(v[part].astype(kind), lo.astype(kind), hi.astype(kind)) >= least[part][:, None])
                    many = np.array([len(shards[x]) for x in b], np.int64)
                    row, to = np.repeat(q, many) + i, np.array([s for x in b for s in shards[x]], np.int32)
                    away = to != home[row]
                    out = rows.take(pa.array(row[away]))
                    yield out.set_column(out.schema.names.index("shard"), "shard", pa.array(to[away]))

    kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)  # with fewer there is no kth score to propagate
    bounded = at_home.join(kth, at_home["vec_id"] == kth["query_id"], "left").select("shard", "slice", "box", "side", "dim", "vec_id", "v", F.coalesce("kth", "least").alias("least"))
    second = solved(arrow_map(bounded, shipped, ROW), False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = found.select("query_id", "vec_id", "score").union(second.select("query_id", "vec_id", "score"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integer_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v) with floor(scale * x) of each component, without the rows that take no part. Integers that don't fit 64 bits raise an error."""
    x = F.col("x")
    usable = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**63, F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long")))
    made = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return made.where(F.col("vec_id").isNotNull() & x.isNotNull() & usable).select("vec_id", whole.alias("v"))


def op10_topk(spark, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows, rows.where("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score")


OP10_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), q as (
  select vec_id, min(v) as v from e where vec_id % 20 = 0 group by vec_id
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
  from q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 20
"""
