"""Spelling variants: words at one edit, by forward and reversed dictionaries.

An edit (one code point inserted, deleted or replaced) leaves one half of a word as it is. Of two words of m and m or m + 1 code points that
are one edit apart, the first difference lies either in the first m // 2 places, and then their ends agree, or behind, and then their
beginnings agree. So each word stands in the blocks of its beginning (forward dictionary) and of its end (reversed dictionary), once as the
shorter and once as the longer of a pair. Words are dealt by block and sorted, so a block is a range of the sorted dictionary that a task
scans. A block is a range of places [lo, hi) for the first difference, all that lies outside being equal; a block with too many words is
cut into two ranges, which both halve what may differ, and a pair belongs to the one that holds its first difference: every pair is found
once. Blocks of over `block_words` words are cut by further rounds over the table, so that no task holds more, and within tasks down to 48
words or to one place, where a block has no more words than there are letters; pairs of a block are then compared.

Words are runs of letters up to U+00FF, so a word's code points are its Latin-1 bytes.

Edge cases: a null text has no words; a null document id is an empty text in a run's hash; repeated rows count each; ties of a form go to the
smallest in code-point order; words of any length take part; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseal.llm.common import LOWER, Scratch, arrow_map, merged_counts, span_keys, text_slices
from tallyseal.llm.tokens import gather

SHORTEST = 7
SMALL = 48
LONG_RUN = 48
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _crc_table() -> np.ndarray:
    """Of the reflected CRC-32, by its rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each run behind a prefix whose crc32 is `first`: all runs byte by byte together, long ones alone."""
    state, lens = ~first, ends - starts
    long = np.flatnonzero(lens > LONG_RUN)
    order = np.argsort(lens, kind="stable")
    order = order[: len(order) - len(long)]
    cuts = np.searchsorted(lens[order], np.arange(LONG_RUN), "right")
    for step in range(int(lens[order[-1]]) if len(order) else 0):
        live = order[cuts[step] :]
        s = state[live]
        state[live] = _CRC[(s ^ data[starts[live] + step]) & np.uint32(255)] ^ (s >> np.uint32(8))
    state = ~state
    raw = memoryview(np.ascontiguousarray(data))
    for k in long.tolist():
        state[k] = zlib.crc32(raw[starts[k] : ends[k]], int(first[k]))
    return state


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text of each) of the maximal runs of letters up to U+00FF."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _LETTER[data]
    wide = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF, in UTF-8
    inside[wide] = True
    inside[wide + 1] = True
    heads = offs[:-1][offs[:-1] < offs[1:]]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[heads] = inside[heads]
    stop[:-1] &= ~inside[1:]
    stop[heads[1:] - 1] = inside[heads[1:] - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(offs, starts, "right") - 1


def _misspelt(word: bytes, h: int) -> bytes:
    text = word.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1 :]).encode()


def words_of(data: np.ndarray, offs: np.ndarray, names: list, every: int) -> tuple[pa.Array, pa.Array]:
    """(distinct words of SHORTEST code points or more, number of each) of some texts."""
    data = LOWER[data]
    starts, ends, owner = letter_runs(data, offs)
    prefix = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in names], np.uint32)
    h = run_crcs(data, starts, ends, prefix[owner])
    odd = np.flatnonzero(h % every == 0)
    raw = data.tobytes()
    changed = [_misspelt(raw[s:e], x) for s, e, x in zip(starts[odd].tolist(), ends[odd].tolist(), h[odd].tolist(), strict=True)]
    changed = [w for w in changed if len(w) >= SHORTEST and len(w.decode()) >= SHORTEST]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    keep = points[ends] - points[starts] >= SHORTEST
    keep[odd] = False
    starts, ends = starts[keep], ends[keep]
    if changed:  # behind the others
        tail = np.frombuffer(b"".join(changed), np.uint8)
        cuts = len(data) + np.cumsum([len(w) for w in changed])
        data, starts, ends = np.concatenate([data, tail]), np.concatenate([starts, cuts - [len(w) for w in changed]]), np.concatenate([ends, cuts])
    a, b = span_keys(data, starts, ends)
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    at = np.flatnonzero(new)
    one = order[at]
    lens = ends[one] - starts[one]
    cuts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    flat = np.ascontiguousarray(data[gather(starts[one], lens)]) if len(one) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(cuts), pa.py_buffer(flat)]), pa.array(np.diff(at, append=len(order)).astype(np.int64))


def _count(batches, every: int) -> Iterator[pa.RecordBatch]:
    def tables():
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, offs in text_slices(batch):
                words, n = words_of(data, offs, names[i:j], every)
                yield pa.table({"word": words, "n": n})

    for t in merged_counts(tables(), ["word"]):
        for b in t.combine_chunks().to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1)], names=["word", "n"])


def count_words(docs: DataFrame, every: int = 31) -> DataFrame:
    """(word, n) of docs(doc_id, text): words of SHORTEST code points or more that occur twice or more."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(texts, lambda it: _count(it, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


# -- blocks: (m, lo, hi, key), a word `w` as Latin-1 bytes ------------------------------------------------------------------------------


def _key(w: bytes, m: int, lo: int, hi: int) -> bytes:
    """What words of a block have in common: all in front of `lo`, and the m - hi places at their end."""
    return w[:lo] + b"\n" + (w[len(w) - (m - hi) :] if hi < m else b"")


def first_blocks(w: bytes) -> list[tuple[int, int, int]]:
    """(m, lo, hi) of the blocks of a word, as the shorter and as the longer of a pair."""
    return [x for m in (len(w), len(w) - 1) if m >= SHORTEST for x in ((m, m // 2, m + 1), (m, 0, m // 2))]


def halves(m: int, lo: int, hi: int) -> list[tuple[int, int]]:
    mid = (lo + hi) // 2
    return [(lo, mid), (mid, hi)]


def near_pairs(block: list[bytes], m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs of m and m or m + 1 code points whose one edit has its first difference in [lo, hi)."""
    lens = np.array([len(w) for w in block])
    table = np.zeros((len(block), m + 2), np.uint8)
    for k, w in enumerate(block):
        table[k, : len(w)] = np.frombuffer(w, np.uint8)
    short, longer = np.flatnonzero(lens == m), np.flatnonzero(lens == m + 1)
    x, y = np.triu_indices(len(short), 1)
    i, j = short[x], short[y]
    apart = table[i, :m] != table[j, :m]
    where = apart.argmax(1)
    good = (apart.sum(1) == 1) & (where >= lo) & (where < hi)
    found = [(i[good], j[good])]
    if len(longer) and len(short):
        i, j = np.repeat(short, len(longer)), np.tile(longer, len(short))
        apart = table[i, : m + 1] != table[j, : m + 1]  # where the shorter ends a zero stands
        where = apart.argmax(1)
        late = table[i, :m] != table[j, 1 : m + 1]
        late &= np.arange(m)[None, :] >= where[:, None]
        good = ~late.any(1) & (where >= lo) & (where < hi)
        found.append((i[good], j[good]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def place_pairs(block: list[bytes], m: int, at: int) -> Iterator[tuple[int, int]]:
    """near_pairs of a block of one place: words of m code points all differ there alone; a longer one without it must be one of them."""
    short = {w: k for k, w in enumerate(block) if len(w) == m}
    some = list(short.values())
    for x, i in enumerate(some):
        for j in some[x + 1 :]:
            yield i, j
    for k, w in enumerate(block):
        if len(w) > m and (i := short.get(w[:at] + w[at + 1 :])) is not None and (at == m or block[i][at] != w[at]):
            yield i, k


def scan_block(words: list[bytes], m: int, lo: int, hi: int, small: int = SMALL) -> Iterator[tuple[int, int]]:
    """Pairs of one block, by their places in it; ranges are halved while a block is large."""
    stack = [(list(range(len(words))), lo, hi)]
    while stack:
        own, lo, hi = stack.pop()
        if hi - lo == 1:
            yield from ((own[i], own[j]) for i, j in place_pairs([words[k] for k in own], m, lo))
        elif len(own) <= small:
            i, j = near_pairs([words[k] for k in own], m, lo, hi)
            yield from ((own[a], own[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True))
        else:
            for a, b in halves(m, lo, hi):
                parts: dict[bytes, list[int]] = {}
                for k in own:
                    parts.setdefault(_key(words[k], m, a, b), []).append(k)
                stack += [(p, a, b) for p in parts.values() if len(p) > 1]


BLOCK = "m int, lo int, hi int, key binary, word string, n long"


def _blocks(batches, ranges) -> Iterator[pa.RecordBatch]:
    """Rows with a word and n, `ranges` giving the blocks of a row, to rows of BLOCK."""
    for batch in batches:
        cols = {k: batch.column(batch.schema.get_field_index(k)).to_pylist() for k in batch.schema.names if k != "key"}
        out: list[list] = [[], [], [], [], []]
        for k, word in enumerate(cols["word"]):
            w = word.encode("latin-1")
            for m, lo, hi in ranges(w, cols, k):
                for x, v in zip(out, (m, lo, hi, _key(w, m, lo, hi), k), strict=True):
                    x.append(v)
        at = pa.array(out[4], pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in out[:3]), pa.array(out[3], pa.binary()), *(batch.column(batch.schema.get_field_index(k)).take(at) for k in ("word", "n"))], names=["m", "lo", "hi", "key", "word", "n"])


def _scan(batches) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK sorted by block and word to (word, near, near_n), both ways."""

    def groups():
        held: list = []
        now = None
        for batch in batches:
            for m, lo, hi, key, word, n in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (block := (m, lo, hi, key)) != now:
                    if len(held) > 1:
                        yield now, held
                    held, now = [], block
                held.append((word, n))
        if len(held) > 1:
            yield now, held

    out: list[list] = [[], [], []]

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

    for (m, lo, hi, _), held in groups():
        for i, j in scan_block([w.encode("latin-1") for w, _ in held], m, lo, hi):
            for a, b in ((held[i], held[j]), (held[j], held[i])):
                for x, v in zip(out, (a[0], *b), strict=True):
                    x.append(v)
        if len(out[0]) > 20_000:
            yield made()
            out = [[], [], []]
    yield made()


def near_words(words: DataFrame, scratch: Scratch, block_words: int = 20_000) -> DataFrame:
    """(word, near, near_n), both ways, of words(word, n) that are one edit apart."""
    block = ["m", "lo", "hi", "key"]
    now = scratch.keep(arrow_map(words.select("word", "n"), lambda it: _blocks(it, lambda w, cols, k: first_blocks(w)), BLOCK), "blocks")
    ready = []
    while True:
        large = scratch.keep(now.groupBy(block).count().where((F.col("count") > block_words) & (F.col("hi") - F.col("lo") > 1)).drop("count"), "large")
        if large.isEmpty():
            ready.append(now)
            break
        ready.append(now.join(large, block, "left_anti").select(now.columns))
        split = now.join(large, block, "left_semi").select(now.columns)
        now = scratch.keep(arrow_map(split, lambda it: _blocks(it, lambda w, cols, k: [(cols["m"][k], *x) for x in halves(cols["m"][k], cols["lo"][k], cols["hi"][k])]), BLOCK), "blocks")
    every = ready[0]
    for x in ready[1:]:
        every = every.union(x)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(parts, *block).sortWithinPartitions(*block, "word")
    return arrow_map(dealt, _scan, "word string, near string, near_n long")


def roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of edges(word, form) without cycles: each round doubles how far a word looks ahead."""
    now = scratch.keep(edges.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = scratch.keep(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")


def group_variants(docs: DataFrame, *, every: int = 31, times: int = 10, block_words: int = 20_000) -> DataFrame:
    """docs(doc_id, text) to (word, form, root, n, n_near, form_n), a row a word: its form is its near word of largest n, if that is `times` its own n."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(count_words(docs, every), "words")
    near = near_words(words, scratch, block_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    told = scratch.keep(told.select("word", "f.form", "f.form_n", "n", "n_near"), "forms")
    ends = roots(told.where("form is not null").select("word", "form"), scratch)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive table_(k, c) as materialized (
  select i, list_reduce(list_concat([i::ubigint], range(8)::ubigint[]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) from range(256) t(i)
),
crc_table as materialized (select list(c order by k) as t from table_),
runs as (
  select doc_id, run, count(*) as k from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) group by all
),
hashed as (
  select run, k, xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::ubigint)), lambda c, b: xor(t[((xor(c, b) & 255) + 1)::bigint], c >> 8))) as h
  from (select *, coalesce(doc_id::varchar, '') || ':' || run as s from runs), crc_table
),
words as materialized (
  select word, sum(k)::bigint as n from (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed)
  where length(word) >= 7 group by word having sum(k) > 1
),
holes as materialized (select word, n, i, substr(word, 1, i) || chr(10) || substr(word, i + 2) as hole from (select *, unnest(range(length(word))) as i from words)),
pairs as (
  select a.word, b.word as near, b.n as near_n from holes a join holes b on a.hole = b.hole and a.word <> b.word
  union select a.word, b.word, b.n from holes a join words b on replace(a.hole, chr(10), '') = b.word
  union select b.word, a.word, a.n from holes a join words b on replace(a.hole, chr(10), '') = b.word
),
best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by word
),
forms as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n from words w left join best using (word)),
steps as (
  select word, word as at from forms union all select s.word, f.form from steps s join forms f on s.at = f.word where f.form is not null
),
root as (select s.word, s.at as root from steps s join forms f on s.at = f.word where f.form is null)
select word, form, root, n, n_near, form_n from forms join root using (word)
"""
