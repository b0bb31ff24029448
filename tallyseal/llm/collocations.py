"""Phrase collocations by hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass k counts phrases of k words exactly and, in the same reading, phrases of k + 1 words by bucket of their hash. Bits of the buckets with
`least` occurrences or more are sent to all tasks of the next pass, with a bitmap of the phrases of k words that are frequent (Apriori: a
phrase is frequent only if its two parts of one word less are). Only what passes both is counted next, and only phrases whose two parts
pass are put into buckets. Bitmaps let too much pass at most, and all that passes is counted exactly, so results don't depend on
their sizes. Tasks merge counts of equal phrases before they hand them on, and sums are taken map-side again before the shuffle.

Buckets follow the input's size from 2^16 to 2^24 (one byte each while they are counted, 2 MB of bits to broadcast at most), bitmaps of
frequent phrases their number from 2^16 to 2^27 bits (16 MB). Beyond that pruning wears off and more phrases are counted, none is lost.

Scores are exact: products are decimals of 38 digits. Ranks are taken within 64 slices of a language by hash and then over the slices'
first rows, so that a language with most of the rows is no single task's.

Edge cases: null and empty texts have no words; a null lang is `und`; repeated rows count each; ties are settled by the contract's order;
texts of any length take part whole; rows of other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyseal.llm.common import LOWER, Scratch, arrow_map, joined_hash, merged_counts, mix, span_keys, text_slices, window_hashes, word_spans
from tallyseal.llm.tokens import gather

PAGE = 1 << 16
SLICE = 1 << 18  # bytes of text looked at together
HELD = 100_000  # rows of counts that a task merges
SLICES = 64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\v\f\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_BLANK = np.zeros(256, bool)
_BLANK[32] = True


def lang_hashes(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


class Slice:
    """Words of some texts, and which phrases of them stand in one piece."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: list[str]):
        self.data = LOWER[data]
        self.starts, self.ends, first = word_spans(self.data, offs, _GAP)
        self.doc = np.searchsorted(first, np.arange(len(self.starts)), "right") - 1
        self.langs, self.lang = langs, lang_hashes(langs)[self.doc]
        piece = np.cumsum(_BREAK[self.data])[self.starts] if len(data) else self.starts
        self.glued = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.a, self.b = span_keys(self.data, self.starts, self.ends)
        self.word = joined_hash(mix(self.a), mix(self.b))

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, is it one) for each word that k words may begin at."""
        n = max(len(self.word) - k + 1, 0)
        good = np.ones(n, bool)
        for j in range(k - 1):
            good &= self.glued[j : j + n]
        return joined_hash(window_hashes(self.word, k), self.lang[:n]), good

    def counted(self, k: int, hashes: np.ndarray, at: np.ndarray) -> pa.Table:
        """(lang, phrase, n) of the phrases that begin at `at`; phrases of one hash are told apart by their words."""
        order = at[np.argsort(hashes[at], kind="stable")]
        new = np.ones(len(order), bool)
        x, y = order[1:], order[:-1]
        new[1:] = self.lang[x] != self.lang[y]
        for j in range(k):
            new[1:] |= (self.a[x + j] != self.a[y + j]) | (self.b[x + j] != self.b[y + j])
        first = np.flatnonzero(new)
        one = order[first]
        words = (one[:, None] + np.arange(k)).ravel()
        lens = self.ends[words] - self.starts[words]
        lens[np.arange(len(words)) % k != k - 1] += 1  # a space behind each word but the last
        cuts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        flat = np.append(self.data, np.uint8(32))[gather(self.starts[words], lens)]
        flat[cuts[1:][np.arange(len(words)) % k != k - 1] - 1] = 32
        text = pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(np.ascontiguousarray(cuts[::k])), pa.py_buffer(np.ascontiguousarray(flat))])
        names = pa.DictionaryArray.from_arrays(pa.array(self.doc[one].astype(np.int32)), pa.array(self.langs, pa.large_string())).cast(pa.large_string())
        return pa.table({"lang": names, "phrase": text, "n": pa.array(np.diff(first, append=len(order)).astype(np.int64))})


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


ROW = "lang string, phrase string, n long, page int, part int, data binary"


def _page_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pages with anything in them, as rows of ROW."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k in range(0, len(total), PAGE):
        if total[k : k + PAGE].any():
            none = [pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([k // PAGE], pa.int32()), pa.array([part], pa.int32()), pa.array([total[k : k + PAGE].tobytes()], pa.binary())], names=["lang", "phrase", "n", "page", "part", "data"])


def _pass(batches, k: int, frequent, buckets_now, next_size: int) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of k words that both bitmaps let pass, and saturated bucket counts of phrases of k + 1 words (none if next_size is 0)."""
    total = np.zeros(next_size, np.uint8)

    def tables():
        nonlocal total
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j, data, offs in text_slices(batch, most=SLICE):
                s = Slice(data, offs, langs[i:j])
                h, good = s.phrases(k)
                if k > 1:
                    before, _ = s.phrases(k - 1)
                    known = has_bit(frequent.value, before)
                    good &= known[:-1] & known[1:] if len(known) else good
                    at = np.flatnonzero(good)
                    good[at] = has_bit(buckets_now.value, h[at])
                if next_size:
                    more, ok = s.phrases(k + 1)
                    if len(good):
                        ok &= good[:-1] & good[1:]
                    at, c = np.unique((more[ok] & np.uint64(next_size - 1)).astype(np.int64), return_counts=True)
                    total[at] += np.minimum(c, 255 - total[at]).astype(np.uint8)
                yield s.counted(k, h, np.flatnonzero(good))

    for t in merged_counts(tables(), ["lang", "phrase"], HELD):
        for b in t.combine_chunks().to_batches(max_chunksize=20_000):
            none = [pa.nulls(len(b), x) for x in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2), *none], names=["lang", "phrase", "n", "page", "part", "data"])
    if next_size:
        yield from _page_rows(total)


def _folded(pages: DataFrame, parts: int, add: bool) -> DataFrame:
    """Pages (page, part, data) of bytes, added up to 255 or joined by OR, in a tree of 64 children a node."""

    def fold(key, table):
        total = None
        for x in table.column("data"):
            page = np.frombuffer(x.as_buffer(), np.uint8)
            total = page.copy() if total is None else total + np.minimum(page, 255 - total) if add else total | page
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    levels = 1
    while 64**levels < parts:
        levels += 1
    for _ in range(levels):
        pages = pages.select("page", F.expr("int(part div 64)").alias("part"), "data").groupBy("page", "part").applyInArrow(fold, "page int, part int, data binary")
    return pages


def _bits_of(rows: list, size: int) -> np.ndarray:
    """Collected pages of bits; those that aren't there are zero."""
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        page = np.frombuffer(r["data"], np.uint8)
        out[r["page"] * (PAGE // 8) :][: len(page)] = page
    return out


def _bucket_bits(made: DataFrame, size: int, parts: int, least: int) -> np.ndarray:
    def enough(batches):
        for b in batches:
            data = [np.packbits(np.frombuffer(x.as_buffer(), np.uint8) >= least, bitorder="little").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["page", "data"])

    sums = _folded(made.where("page is not null").select("page", "part", "data"), parts, True)
    return _bits_of(arrow_map(sums.select("page", "data"), enough, "page int, data binary").collect(), size)  # size / 8 bytes in all


def _frequent_bits(frequent: DataFrame, k: int, size: int) -> np.ndarray:
    """Bits of the hashes of phrases (lang, phrase) of k words."""

    def mark(batches):
        from pyspark import TaskContext

        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j, data, offs in text_slices(batch, "phrase"):
                starts, ends, first = word_spans(data, offs, _BLANK)
                a, b = span_keys(data, starts, ends)
                h = joined_hash(window_hashes(joined_hash(mix(a), mix(b)), k)[first[:-1]], lang_hashes(langs[i:j])) & np.uint64(size - 1)
                np.bitwise_or.at(bits, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        step, part = PAGE // 8, TaskContext.get().partitionId()
        pages = [(p // step, bits[p : p + step].tobytes()) for p in range(0, len(bits), step) if bits[p : p + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pages], pa.int32()), pa.array([part] * len(pages), pa.int32()), pa.array([x for _, x in pages], pa.binary())], names=["page", "part", "data"])

    made = arrow_map(frequent.select("lang", "phrase"), mark, "page int, part int, data binary")
    return _bits_of(_folded(made, frequent.rdd.getNumPartitions(), False).collect(), size)


def _power(n: int, least: int, most: int) -> int:
    return 1 << min(max(int(n - 1).bit_length(), least), most)


def frequent_phrases(docs: DataFrame, scratch: Scratch, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, a) with a >= least of k words for each k], (lang, n) words in all) of docs(lang, text)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = _power(size // 16 + 1, 16, 24) if size < 1 << 60 else 1 << 24
    parts, out, totals, bitmaps = texts.rdd.getNumPartitions(), [], None, (None, None)
    for k in range(1, longest + 1):
        more = buckets if k < longest else 0
        made = scratch.keep(arrow_map(texts, lambda it, k=k, b=bitmaps, more=more: _pass(it, k, *b, more), ROW), f"pass{k}")
        counted = made.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        if k == 1:
            totals = scratch.keep(made.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        out.append(scratch.keep(counted.where(F.col("a") >= least), f"frequent{k}"))
        for b in filter(None, bitmaps):
            b.destroy()
        if more:
            frequent = _frequent_bits(out[-1], k, _power(16 * out[-1].count() + 1, 16, 27))
            bitmaps = sc.broadcast(frequent), sc.broadcast(_bucket_bits(made, buckets, parts, least))  # 16 and 2 MB at most
        scratch.drop(made)
    return out, totals


def _sub(words: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, share: tuple[int, int] = (50, 100), top: int = 2000) -> DataFrame:
    """docs(lang, text) to (lang, rank, phrase, a, l, r, n, score), the first `top` phrases of 2 to `longest` words of each language.

    A phrase inside a longer frequent one with at least the `share` of its occurrences is left out. longest must be 2 or more, least from 1 to 255.
    """
    if longest < 2 or not 1 <= least <= 255:
        raise ValueError("longest must be 2 or more, and least from 1 to 255, which bucket counts can tell")
    scratch = Scratch(docs.sparkSession, "phrases")
    by_size, totals = frequent_phrases(docs, scratch, longest, least)
    words, cut_up, inside = F.split("phrase", " "), [], []
    for k, own in enumerate(by_size[1:], 2):
        cuts = F.array(*[F.struct(F.lit(c).alias("k"), _sub(words, 1, c).alias("left"), _sub(words, c + 1, k - c).alias("right")) for c in range(1, k)])
        cut_up.append(own.select("lang", "phrase", "a", F.inline(cuts)))
        if k > 2:
            inner = F.array_distinct(F.array(*[_sub(words, i, n) for n in range(2, k) for i in range(1, k - n + 2)]))
            inside.append(own.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")))
    every = reduce(DataFrame.union, by_size)
    sides = [every.select("lang", F.col("phrase").alias(side), F.col("a").alias(side[0])) for side in ("left", "right")]
    cut = reduce(DataFrame.union, cut_up).join(sides[0], ["lang", "left"]).join(sides[1], ["lang", "right"])
    exact = [F.col(c).cast("decimal(19,0)") for c in ("a", "a", "l", "r")]
    over, under = (exact[0] * exact[1]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), exact[2] * exact[3]
    cut = cut.withColumn("over", over).withColumn("under", under).withColumn("score", F.expr("over div under"))
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    if inside:
        scored = scored.join(reduce(DataFrame.union, inside).groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left")
        scored = scored.where(F.col("longer").isNull() | (F.col("longer") * share[1] < F.col("a") * share[0])).drop("longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    sliced = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    few = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) x(k))),
f as materialized (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 10),
c as (select *, string_split(phrase, ' ') as w from f where k > 1),
cut as (select lang, phrase, a, i, array_to_string(w[1 : i], ' ') as x, array_to_string(w[i + 1 : ], ' ') as y from (select *, unnest(range(1, k)) as i from c)),
s as (
  select cut.lang, cut.phrase, cut.a, l.a as l, r.a as r, (1000000::hugeint * cut.a * cut.a // (l.a::hugeint * r.a))::bigint as score, i
  from cut join f l on l.lang = cut.lang and l.phrase = x join f r on r.lang = cut.lang and r.phrase = y
),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, i) as t from s) where t = 1),
inner_ as (select lang, phrase, max(a) as longer from (select lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) as phrase from c where k = 3) group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank
  from best b left join inner_ using (lang, phrase) where longer is null or 100 * longer < 50 * b.a
)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""
