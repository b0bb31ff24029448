"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class factor is a softmax
over hashed features of the history: a bias, the previous word, the word before it
(skip) and the pair (n-gram). It starts from smoothed counts of classes by feature and
is trained by synchronous gradient steps: training documents are dealt to `steps`
shards by their id, and a step sums the gradient over one shard, on all tasks from
common parameters, in a tree, and updates them with a rate for each weight. So every
training document takes part once, and how the table is cut into partitions changes
nothing but the order of sums. P(word | class) is a softmax over one weight a word,
whose best value has a closed form, the log count (smoothed by one); the model differs
from the unigram base by what the history tells.

Words are known by 128-bit keys (the word itself up to 15 bytes, 120 bits of its
BLAKE2b digest beyond). Their counts are exact over all training documents. The `head` words by count
(whole ranges of counts, at most that many) have identities on the workers, which
bounds what is broadcast; all rarer words form the tail class and get their counts by a
join, where no key is hot, as at least `head` words have higher counts. Classes of the
head: the most frequent words are clustered by what precedes them, the others join the
class whose letter pairs they resemble. Words met once are in the tail class, too: left
out, each would be unseen, so their number is the weight of all unseen words (one event,
as in the base) and twice the number of words met twice is theirs (Good and Turing).

What is learnt of histories grows with the training tokens: each of the three feature
families has a hashed row for every 4096 tokens or fewer, from 2^12 up to `most_rows`
rows (2^15); beyond 134 million training tokens it stays, as all workers hold the table.
History words beyond the `head` (2^18) are one id (held-out figures by size: README).

Edge cases: a null or empty text is one end token; a null id counts as held out;
repeated rows are scored each; columns other than doc_id and text are not read; without
training tokens every word has base probability 1 in 1 and the model equals the base;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseal.llm.common import LOWER, Scratch, arrow_map, mix, pages_sum, signed, span_keys, text_slices, word_spans
from tallyseal.llm.tokens import ChunkStore

CLASSES = 48  # of head words; the tail is one more
CONTEXTS = 64
CLUSTERED = 8192
FAMILIES = 3
SHARES = (0.7, 0.45, 0.45)  # of what each family's counts tell, to start with: families repeat each other
BATCH = 16_384
PAGES = 64
TASK_TOKENS = 1 << 26


@dataclass
class Vocabulary:
    """Head words by falling count: keys, counts and classes; index -1 is the tail."""

    a: np.ndarray
    b: np.ndarray
    count: np.ndarray  # one more entry, 0, for index -1
    klass: np.ndarray | None = None  # one more entry, CLASSES, for index -1

    def store(self) -> ChunkStore:
        made = ChunkStore()
        made.add(self.a, self.b, np.zeros(0, np.uint32), np.zeros(len(self.a), np.int64), np.ones(len(self.a), bool))
        return made


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, a, b, offsets): keys of the words of texts, each closed by the end token, which is (0, 0)."""
    for i, j, data, offs in text_slices(batch):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offs)
        a, b = span_keys(data, starts, ends)
        cuts = first + np.arange(j - i + 1)
        keep = np.ones(int(cuts[-1]), bool)
        keep[cuts[1:] - 1] = False
        out = np.zeros((2, len(keep)), np.uint64)
        out[0, keep], out[1, keep] = a, b
        yield i, out[0], out[1], cuts.astype(np.int64)


def _trained(ids: pa.Array, parts: int, part: int) -> np.ndarray:
    return np.array([k is not None and zlib.crc32(str(k).encode()) % parts != part for k in ids.to_pylist()], bool)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in sorted order, first of each key in that order, number of each)."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.flatnonzero(new)
    return order, first, np.diff(first, append=len(order))


def _count(batches, fold) -> Iterator[pa.RecordBatch]:
    store, counts = ChunkStore(most=400_000), np.zeros(1 << 14, np.int64)

    def rows():
        n = store.count
        return pa.RecordBatch.from_arrays([pa.array(signed(store.a[:n])), pa.array(signed(store.b[:n])), pa.array(counts[:n])], names=["a", "b", "c"])

    for batch in batches:
        use = _trained(batch.column(0), *fold)
        for i, a, b, cuts in _tokens(batch):
            take = np.repeat(use[i : i + len(cuts) - 1], np.diff(cuts))
            a, b = a[take], b[take]
            at = store.find(a, b)
            missing = np.flatnonzero(at < 0)
            if len(missing):
                order, first, n = _distinct(a[missing], b[missing])
                one = missing[order[first]]
                new = store.add(a[one], b[one], np.zeros(0, np.uint32), np.zeros(len(one), np.int64), np.ones(len(one), bool))
                while store.count > len(counts):
                    counts = np.concatenate([counts, np.zeros_like(counts)])
                counts[new] = n
            counts[: store.count] += np.bincount(at[at >= 0], minlength=store.count)
            if store.full():
                yield rows()
                store.clear()
                counts[:] = 0
    yield rows()


def _indexed(batches, fold, vocabulary, steps: int) -> Iterator[pa.RecordBatch]:
    """A row a document: its shard (-1: held out), head ids of its tokens, and the distinct tail words with their numbers."""
    from pyspark import TaskContext

    store, key = vocabulary.value.store(), TaskContext.get().partitionId() << 33
    for batch in batches:
        names = batch.column(0)
        shard = np.array([zlib.crc32(f"shard {k}".encode()) % steps if u else -1 for k, u in zip(names.to_pylist(), _trained(names, *fold), strict=True)], np.int32)
        for i, a, b, cuts in _tokens(batch):
            m = len(cuts) - 1
            ids = store.find(a, b)
            tail = np.flatnonzero(ids < 0)
            owner = np.searchsorted(cuts, tail, "right") - 1
            order = np.lexsort((b[tail], a[tail], owner))
            ta, tb, to = a[tail][order], b[tail][order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1]) | (to[1:] != to[:-1])
            first = np.flatnonzero(new)
            ends = pa.array(np.searchsorted(to[first], np.arange(m + 1)).astype(np.int32))
            rare = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (signed(ta[first]), signed(tb[first]), np.diff(first, append=len(order)).astype(np.int64))]
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(key + np.arange(m)), names.slice(i, m), pa.array(shard[i : i + m]), lists, *rare], names=["key", "doc_id", "shard", "ids", "tail_a", "tail_b", "tail_n"])
            key += m


def _lists(batch: pa.RecordBatch, column: str = "ids") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets) of some documents at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    cuts, flat, i = np.asarray(col.offsets).astype(np.int64), np.asarray(col.values), 0
    while i < len(col):
        j = min(max(int(np.searchsorted(cuts, cuts[i] + (1 << 17), "right")) - 1, i + 1), len(col))
        yield i, flat[cuts[i] : cuts[j]].astype(np.int64), cuts[i : j + 1] - cuts[i]
        i = j


def _history(ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous id and the one before; -2 in front of a text."""
    one, two = np.full(len(ids), -2, np.int64), np.full(len(ids), -2, np.int64)
    one[1:] = ids[:-1]
    one[offs[:-1]] = -2
    two[2:] = ids[:-2]
    two[offs[:-1]] = -2
    second = offs[:-1] + 1
    two[second[second < offs[1:]]] = -2
    return one, two


def _features(one: np.ndarray, two: np.ndarray, rows: int) -> np.ndarray:
    """A row in each family's table."""
    a, b = (one + 3).astype(np.uint64), (two + 3).astype(np.uint64)
    pair = mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
    return (np.stack([mix(a), mix(b ^ np.uint64(0x5BD1E995)), pair]) & np.uint64(rows - 1)).astype(np.uint16)


def _logits(tables: list[np.ndarray], bias: np.ndarray, feats: np.ndarray) -> np.ndarray:
    z = tables[0].take(feats[0], 0)
    for w, f in zip(tables[1:], feats[1:], strict=True):
        z += w.take(f, 0)
    z += bias
    return z


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(z - shift), its sums by row and the shift: each row's largest value, or 0 where plain exponentials neither overflow nor vanish."""
    if z.max(initial=0) < 60:
        e = np.exp(z)
        sums = e.sum(1)
        if sums.min(initial=1) > 1e-20:
            return e, sums, 0.0
    top = z.max(1)
    e = np.exp(z - top[:, None])
    return e, e.sum(1), top


def _feature_sums(g: np.ndarray, f: np.ndarray, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and the sums of their rows of g: features with few rows go rank by rank together, the others one by one."""
    order = np.argsort(f, kind="stable")  # by radix, of 16-bit integers
    rows = f[order].astype(np.int64)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    sizes = np.diff(first, append=len(f))
    sums = g.take(order[first], 0)
    for rank in range(1, few):
        more = np.flatnonzero((sizes > rank) & (sizes <= few))
        if not len(more):
            break
        sums[more] += g.take(order[first[more] + rank], 0)
    for k in np.flatnonzero(sizes > few).tolist():
        sums[k] = g.take(order[first[k] : first[k] + sizes[k]], 0).sum(0)
    return rows[first], sums


def gradient(model: Model, ids: np.ndarray, offs: np.ndarray, klass: np.ndarray, into: np.ndarray) -> None:
    """Adds probability less truth of each class to the rows of each token's features."""
    feats, y = _features(*_history(ids, offs), model.rows), klass[ids]
    for s in range(0, len(y), BATCH):
        f, t = feats[:, s : s + BATCH], y[s : s + BATCH]
        g, sums, _ = _exponentials(_logits(model.tables, model.bias, f))
        g /= sums[:, None]
        g[np.arange(len(t)), t] -= 1
        for k in range(FAMILIES):
            at, part = _feature_sums(g, f[k])
            into[k, at] += part


@dataclass
class Model:
    tables: list[np.ndarray]  # weights by feature row and class, a table a family
    bias: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.tables[0])

    @staticmethod
    def started(counts: np.ndarray, shares: np.ndarray, prior: float = 60.0) -> Model:
        """From counts[family, row, class] and the classes' shares of all tokens: part of what each feature tells beyond the shares."""
        tables = [p * np.log((c + prior * shares) / (c.sum(1, keepdims=True) + prior) / shares) for p, c in zip(SHARES, counts, strict=True)]
        return Model([x.astype(np.float32) for x in tables], np.log(shares).astype(np.float32))

    def step(self, grad: np.ndarray, counts: np.ndarray, shares: np.ndarray, part: float, rate: float) -> Model:
        """One update by the gradient of a part of the tokens; each weight's rate falls with the tokens that speak about it."""
        tables = []
        for w, g, c in zip(self.tables, grad, counts, strict=True):
            speak = c + c.sum(1, keepdims=True) * shares
            speak *= part * 0.5
            speak += 2.0
            tables.append((w - np.clip(rate * g / speak, -1.0, 1.0)).astype(np.float32))
        return Model(tables, self.bias)


def _pages(total: np.ndarray, first: list[tuple[int, bytes]] = ()) -> pa.RecordBatch:
    from pyspark import TaskContext

    pages = [*first, *((k, x.tobytes()) for k, x in enumerate(np.array_split(total.ravel(), PAGES)))]
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pages], pa.int32()), pa.array([part] * len(pages), pa.int32()), pa.array([x for _, x in pages], pa.binary())], names=["page", "part", "data"])


PAGE = "page int, part int, data binary"


def _joined(rows: list, kind, shape) -> np.ndarray:
    data = [np.frombuffer(r["data"], kind) for r in sorted(rows, key=lambda r: r["page"])]
    return np.concatenate(data).reshape(shape) if data else np.zeros(shape, kind)


def _contexts(batches) -> Iterator[pa.RecordBatch]:
    total = np.zeros((CLUSTERED, CONTEXTS), np.uint32)
    for batch in batches:
        for _, ids, offs in _lists(batch):
            one, _ = _history(ids, offs)
            ok = (ids >= 0) & (ids < CLUSTERED)
            before = np.where((one >= 0) & (one < CONTEXTS - 2), one, np.where(one == -2, CONTEXTS - 2, CONTEXTS - 1))
            total += np.bincount(ids[ok] * CONTEXTS + before[ok], minlength=total.size).astype(np.uint32).reshape(total.shape)
    yield _pages(total)


def _feature_counts(batches, klass, rows: int) -> Iterator[pa.RecordBatch]:
    total, width = np.zeros((FAMILIES, rows * (CLASSES + 1)), np.uint32), CLASSES + 1
    for batch in batches:
        for _, ids, offs in _lists(batch):
            y = klass.value[ids]
            for k, f in enumerate(_features(*_history(ids, offs), rows)):
                cell, n = np.unique(f.astype(np.int64) * width + y, return_counts=True)
                total[k, cell] += n.astype(np.uint32)
    yield _pages(total)


def _gradients(batches, klass, model) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((FAMILIES, model.value.rows, CLASSES + 1), np.float32), 0
    for batch in batches:
        for _, ids, offs in _lists(batch):
            gradient(model.value, ids, offs, klass.value, total)
            n += len(ids)
    yield _pages(total, [(-1, np.array([n], np.float64).tobytes())])


def cluster(a: np.ndarray, b: np.ndarray, count: np.ndarray, contexts: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Class of each head word: spherical k-means of the contexts of frequent words, then the most likely class by letter pairs for the others."""
    n = min(len(a), CLUSTERED)
    x = np.sqrt(contexts[:n].astype(np.float64))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    mass = np.log1p(count[:n].astype(np.float64))
    k = min(CLASSES, n)
    centre, label = x[:k].copy(), np.zeros(n, np.int64)
    for _ in range(rounds):
        label = (x @ centre.T).argmax(1)
        new = np.zeros_like(centre)
        np.add.at(new, label, x * mass[:, None])
        size = np.linalg.norm(new, axis=1, keepdims=True)
        centre = np.where(size > 0, new / np.maximum(size, 1e-9), centre)
    out = np.zeros(len(a), np.int64)
    out[:n] = label
    if len(a) > n:
        table = np.full((1024, k), 0.1)
        cells, inside = letter_pairs(a[:n], b[:n])
        np.add.at(table, (cells[inside], np.broadcast_to(label[:, None], cells.shape)[inside]), 1.0)
        table = np.log(table / table.sum(0)).astype(np.float32)
        for s in range(n, len(a), 20_000):
            cells, inside = letter_pairs(a[s : s + 20_000], b[s : s + 20_000])
            out[s : s + 20_000] = (table[cells] * inside[:, :, None]).sum(1).argmax(1)
    return out


def letter_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the pairs of letters of each word, marks around it included, and which are there; of words over 15 bytes nothing is known."""
    text = np.concatenate([a.astype("<u8").view(np.uint8).reshape(-1, 8), b.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]], 1).astype(np.int64)
    size = (b >> np.uint64(56)).astype(np.int64)
    size[size > 15] = -1
    wide = np.concatenate([np.full((len(a), 1), ord("^")), text, np.zeros((len(a), 1), np.int64)], 1)
    wide[np.arange(len(a))[size >= 0], size[size >= 0] + 1] = ord("$")
    return (wide[:, :-1] * 31 + wide[:, 1:]) & 1023, np.arange(16)[None, :] <= size[:, None]


def _score(batches, vocabulary, model, once: float, tail_mass: float) -> Iterator[pa.RecordBatch]:
    """A row a document: what its head words give. once: the weight of a word met once."""
    v, m = vocabulary.value, model.value
    log_count = np.log10(v.count + 1.0)
    mass = np.log10(np.maximum(np.bincount(v.klass[:-1], v.count[:-1] + 1.0, CLASSES + 1), 1.0))
    in_class = np.where(v.klass < CLASSES, log_count - mass[v.klass], np.log10(once / tail_mass))
    for batch in batches:
        for i, ids, offs in _lists(batch):
            feats, klass, own = _features(*_history(ids, offs), m.rows), v.klass[ids], np.zeros(len(ids))
            for s in range(0, len(ids), BATCH):
                z, part = _logits(m.tables, m.bias, feats[:, s : s + BATCH]), klass[s : s + BATCH]
                _, sums, shift = _exponentials(z)
                own[s : s + BATCH] = z[np.arange(len(part)), part] - shift - np.log(sums)
            own /= np.log(10.0)
            head = ids >= 0
            logs = np.where(head, log_count[ids], 0.0)
            own += np.where(head, in_class[ids], 0.0)
            first, n = offs[:-1], len(offs) - 1
            cols = [np.diff(offs), np.add.reduceat(head.astype(np.int64), first), np.add.reduceat(logs, first), np.add.reduceat(own, first)]
            more = [batch.column(batch.schema.get_field_index(k)).slice(i, n) for k in ("key", "doc_id", "shard")]
            yield pa.RecordBatch.from_arrays([*more, *map(pa.array, cols)], names=["key", "doc_id", "shard", "n_tokens", "head_known", "head_log", "model"])


def _float_sum(df: DataFrame, parts: int) -> DataFrame:
    """As pages_sum, of float32 pages; page -1 holds one float64."""

    def fold(key, table):
        kind = np.float64 if key[0].as_py() == -1 else np.float32
        order = np.argsort(np.asarray(table.column("part")))  # one order of sums, whatever comes first
        total = np.zeros(1, np.float64)
        for k in order.tolist():
            total = total + np.frombuffer(table.column("data")[k].as_buffer(), kind)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([total.astype(kind).tobytes()], pa.binary())})

    levels = 1
    while 64**levels < parts:
        levels += 1
    for _ in range(levels):
        parent = F.expr("int(part div 64)").alias("parent")
        df = df.select("page", parent, "part", "data").groupBy("page", "parent").applyInArrow(fold, PAGE)
    return df


def score_texts(docs: DataFrame, *, fold: tuple[int, int] = (7, 2), head: int = 1 << 18, most_rows: int = 1 << 15, steps: int = 4, rate: float = 0.5) -> DataFrame:
    """docs(doc_id, text) to one row a document; documents with crc32(id as text) mod fold[0] = fold[1] are held out of all learning."""
    spark = docs.sparkSession
    sc, scratch = spark.sparkContext, Scratch(docs.sparkSession, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = arrow_map(docs, lambda it: _count(it, fold), "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    counts = scratch.keep(counted.withColumn("band", F.floor(F.log2("c") * 16).cast("int")), "counts")
    bands = sorted(((r["band"], r["n"], r["c"]) for r in counts.groupBy("band").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()), reverse=True)  # at most some 1000 rows
    total, distinct, taken, least = sum(b[2] for b in bands), sum(b[1] for b in bands), 0, 1 << 30
    for band, n, _ in bands:
        if taken + n > head:
            break
        taken, least = taken + n, band
    chosen = counts.where(F.col("band") >= least).select("a", "b", "c").toArrow()  # at most `head` rows
    a, b, c = (np.asarray(chosen.column(k).combine_chunks()) for k in ("a", "b", "c"))
    order = np.lexsort((b, a, -c))
    a, b, count = a[order].view(np.uint64), b[order].view(np.uint64), np.append(c[order], 0).astype(np.float64)
    plain = sc.broadcast(Vocabulary(a, b, count))
    schema = "key long, doc_id long, shard int, ids array<int>, tail_a array<long>, tail_b array<long>, tail_n array<long>"
    indexed = scratch.keep(arrow_map(docs, lambda it: _indexed(it, fold, plain, steps), schema), "indexed")
    # sums have a fixed size a task, so tasks of the sums are as many as run at once, or one for so many tokens
    learnt = indexed.where("shard >= 0").select("shard", "ids")
    parts = max(1, min(learnt.rdd.getNumPartitions(), max(sc.defaultParallelism, total // TASK_TOKENS + 1)))
    together = learnt.coalesce(parts)
    contexts = _joined(pages_sum(arrow_map(together.select("ids"), _contexts, PAGE), parts).collect(), np.uint32, (CLUSTERED, CONTEXTS))
    klass = np.append(cluster(a, b, count[:-1], contexts) if len(a) else np.zeros(0, np.int64), CLASSES)
    klass[:-1][count[:-1] == 1] = CLASSES
    classed, classes = sc.broadcast(Vocabulary(a, b, count, klass)), sc.broadcast(klass)
    plain.destroy()
    rows = 1 << 12
    while rows < most_rows and rows * 4096 < total:
        rows *= 2
    shape = (FAMILIES, rows, CLASSES + 1)
    seen = _joined(pages_sum(arrow_map(together.select("ids"), lambda it: _feature_counts(it, classes, rows), PAGE), parts).collect(), np.uint32, shape).astype(np.float32)
    shares = np.bincount(klass[:-1], count[:-1], CLASSES + 1)
    shares[CLASSES] = total - shares.sum()
    shares = ((shares + 0.5) / (shares + 0.5).sum()).astype(np.float32)
    model = Model.started(seen, shares)
    for k in range(steps if total else 0):
        now = sc.broadcast(model)
        made = arrow_map(learnt.where(F.col("shard") == k).select("ids").coalesce(parts), lambda it, now=now: _gradients(it, classes, now), PAGE)
        got = _float_sum(made, parts).collect()
        n = sum(np.frombuffer(r["data"], np.float64)[0] for r in got if r["page"] < 0)
        if n:
            model = model.step(_joined([r for r in got if r["page"] >= 0], np.float32, shape), seen, shares, n / total, rate)
        del got
        now.destroy()
        scratch.sweep()
    rare = counts.where(F.col("band") < least).select("a", "b", "c")
    met = counts.agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"), F.coalesce(F.sum(F.when((F.col("band") < least) & (F.col("c") > 1), F.col("c"))), F.lit(0)).alias("rare")).first()
    once, unseen = float(np.clip(2.0 * met["twice"] / max(met["once"], 1), 0.05, 1.0)), met["once"] + 1.0
    tail_mass = met["rare"] + once * met["once"] + unseen
    weights = sc.broadcast(model)
    scored = arrow_map(indexed.select("key", "doc_id", "shard", "ids"), lambda it: _score(it, classed, weights, once, tail_mass), "key long, doc_id long, shard int, n_tokens long, head_known long, head_log double, model double")
    scored = scratch.keep(scored, "scored")
    tails = indexed.select("key", F.explode(F.arrays_zip("tail_a", "tail_b", "tail_n")).alias("t")).select("key", F.col("t.tail_a").alias("a"), F.col("t.tail_b").alias("b"), F.col("t.tail_n").alias("k"))
    weight = F.log10(F.when(F.col("c") == 1, F.lit(once)).otherwise(F.col("c").cast("double")))
    joined = tails.join(rare, ["a", "b"]).groupBy("key").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.col("k") * weight).alias("own"))
    each = float(np.log10(total + distinct + 1.0))
    out = scored.join(joined, "key", "left")
    known, logs, own = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0)), F.coalesce("own", F.lit(0.0))
    tail, base = F.col("n_tokens") - F.col("head_known"), F.col("head_log") + logs - F.col("n_tokens") * each
    score = F.col("model") + own + (tail - known) * float(np.log10(unseen)) - tail * float(np.log10(tail_mass))
    return out.select(
        "doc_id", (F.col("shard") < 0).alias("held_out"), "n_tokens", (F.col("head_known") + known).alias("n_known"), F.lit(int(total)).alias("train_tokens"),
        base.alias("base_score"), (score if total else base).alias("score"),
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
