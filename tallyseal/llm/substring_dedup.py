"""Substring dedup: removal of word runs that occur elsewhere in the corpus.

Windows of `window` words are routed by their smallest k-gram hash: consecutive
windows with one smallest k-gram form a segment, equal windows always meet under
the same k-gram, and one row a segment (about one in 14 words) goes through the
shuffle instead of the text. Segments with equal words collapse to one row with a
count before and in the shuffle. Only k-grams met more than once are looked at
further: the words of one copy of each distinct segment become a reference shard,
a generalised suffix automaton with occurrence counts is built over the shard, and
the shard's segments are streamed through it for matching statistics; a position
whose match of `window` words occurs twice or more marks that window. Shards of all
documents sent to every document would cost the square of the corpus; routing
sends a document's words only to shards that can hold a match.

Runs that share a k-gram for more than 2048 windows (one word over and over, say) are
cut, so equal stretches collapse here, too. A k-gram whose distinct segments have more
than `shard_words` words is not built in one task: its windows are counted one by one
under their own hash, by native aggregation. A task's memory follows that bound and its
longest text.

Edge cases: null and empty texts have no words and keep none; texts shorter than
the window are kept; a passage repeated within one text counts; documents with a
null or a repeated id are told apart by position in the scan's files and all
returned; ties cannot arise, as every copy loses its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.llm.common import Scratch, all_columns, arrow_map, signed, span_hashes, text_slices, window_hashes, word_hashes, word_spans
from tallyseal.llm.jaccard_join import are_few

KGRAM = 8
LONGEST = 2048  # windows of a segment
HEAVY, MOST_HEAVY = 2_000, 100_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def _segments(hashes: np.ndarray, window: int):
    """(anchor, segment hash, first window, windows, repeats itself) of the segments of one text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return None
    grams = window_hashes(hashes, KGRAM)
    anchors = _sliding_min(grams, window - KGRAM + 1)
    starts = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    counts = np.diff(np.concatenate([starts, [n]]))
    if counts.max() > LONGEST:
        cut = -(-counts // LONGEST)
        at = (np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)) * LONGEST
        starts, counts = np.repeat(starts, cut) + at, np.minimum(np.repeat(counts, cut) - at, LONGEST)
    segs = span_hashes(hashes, starts, starts + counts + window - 1)
    own = np.zeros(len(starts), bool)
    spans = counts + window - KGRAM  # k-grams of each segment
    first = np.cumsum(spans) - spans
    met = grams[np.arange(spans.sum()) + np.repeat(starts - first, spans)] == np.repeat(anchors[starts], spans)
    if (np.add.reduceat(met, first, dtype=np.int64) > 1).any():  # equal windows of one segment hold its anchor at two places
        w = window_hashes(hashes, window)
        owner = np.repeat(np.arange(len(starts)), counts)
        order = np.lexsort((owner, w))
        same = (w[order][1:] == w[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        own[owner[order][1:][same]] = True
    return anchors[starts], segs, starts, counts, own


def _route(batches, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offs in text_slices(batch):
            hashes, first = word_hashes(data, offs, lower=False)
            rows: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for k in range(j - i):
                got = _segments(hashes[first[k] : first[k + 1]], window)
                if got is not None:
                    for x, v in zip(rows, (*got, np.full(len(got[0]), i + k)), strict=True):
                        x.append(v)
            if not rows[0]:
                continue
            anchor, seg, start, count, own, row = map(np.concatenate, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(anchor)), pa.array(signed(seg)), ids.take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(own)],
                names=["anchor", "seg", "key", "first", "wins", "own"],
            )


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the number of occurrences of each state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def add(self, words, weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(0)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur
            count[last] += weight

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        self.len.append(self.len[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def close(self) -> None:
        """Counts of longer states go to the suffixes that they end with."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated(self, words, window: int) -> list[bool]:
        """For each start of a window in words: does the window occur twice or more? Streams with a match kept at most `window` long."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        v = match = 0
        out = []
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                match = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                match += 1
            if match > window:
                match = window
            while length[link[v]] >= match and v:
                v = link[v]
            if i >= window - 1:
                out.append(match == window and count[v] >= 2)
        return out


def _shards(batches, window: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, seg, weight, words) sorted by anchor to (anchor, seg, marks) for segments with a marked window."""

    def groups():
        held: list = []
        now = None
        for batch in batches:
            for anchor, seg, weight, words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and anchor != now:
                    yield now, held
                    held = []
                now = anchor
                held.append((seg, weight, np.frombuffer(words, np.uint64).tolist()))
        if held:
            yield now, held

    out: list[list] = [[], [], []]
    for anchor, held in groups():
        automaton = SuffixAutomaton()
        for _, weight, words in held:
            automaton.add(words, weight)
        automaton.close()
        for seg, _, words in held:
            marks = automaton.repeated(words, window)
            if any(marks):
                for x, v in zip(out, (anchor, seg, np.flatnonzero(marks).tolist()), strict=True):
                    x.append(v)
        if len(out[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], names=["anchor", "seg", "marks"])
            out = [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], names=["anchor", "seg", "marks"])


def _fetch(batches, window: int, single: bool) -> Iterator[pa.RecordBatch]:
    """The words of wanted segments (or, single, the windows' hashes) from whole texts."""
    for batch in batches:
        wanted = batch.column(batch.schema.get_field_index("wanted"))
        out: list[list] = [[], [], [], []]
        for i, j, data, offs in text_slices(batch):
            hashes, first = word_hashes(data, offs, lower=False)
            for k, want in enumerate(wanted.slice(i, j - i).to_pylist()):
                own = hashes[first[k] : first[k + 1]]
                for w in want:
                    a, n = w["first"], w["wins"]
                    words = own[a : a + n + window - 1]
                    if len(words) != n + window - 1 or int(signed(span_hashes(words, np.array([0]), np.array([len(words)])))[0]) != w["seg"]:
                        continue  # another text under the same id
                    data_ = window_hashes(words, window) if single else words
                    for x, v in zip(out, (w["anchor"], w["seg"], w["weight"], data_.tobytes()), strict=True):
                        x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "seg", "weight", "words"])


def _rewrite(batches, window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Whole texts with their marked segments to word counts, digest and, if asked for, the kept text."""
    for batch in batches:
        hits = batch.column(batch.schema.get_field_index("hits"))
        words, removed, digests, kept_texts = [], [], [], []
        for i, j, data, offs in text_slices(batch):
            starts, ends, first = word_spans(data, offs)
            raw = data.tobytes()
            for k, hit in enumerate(hits.slice(i, j - i).to_pylist()):
                a, b = first[k], first[k + 1]
                n = int(b - a)
                gone = np.zeros(n + 1, np.int64)
                for h in hit or ():
                    at = np.arange(h["wins"]) if h["marks"] is None else np.array(h["marks"], np.int64)
                    at = at + h["first"]
                    at = at[at + window <= n]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = b" ".join(raw[s:e] for s, e in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist(), strict=True))
                words.append(n)
                removed.append(n - int(keep.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept if removed[-1] else raw[offs[k] : offs[k + 1]])
        more = {k: batch.column(batch.schema.get_field_index(k)) for k in batch.schema.names if k == "_row"}
        cols = [batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(kept_texts, pa.binary()).cast(pa.string())] if texts else [])
        yield pa.RecordBatch.from_arrays([*cols, *more.values()], names=["key", "n_words", "n_removed", "kept_sha256", *["kept"] * texts, *more])


def _with_lists(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """texts(key, ...) joined (inner, left) with lists(key, ...). Only texts that have a list are shuffled, the others stay where they are, while the keys of lists, counted before, are few."""
    keys = lists.select("key")
    if not are_few(keys):
        return texts.join(lists.hint("shuffle_hash"), "key", how)
    met = texts.join(F.broadcast(keys), "key", "left_semi").join(lists.hint("shuffle_hash"), "key")
    return met if how == "inner" else met.unionByName(texts.join(F.broadcast(keys), "key", "left_anti"), allowMissingColumns=True)


def find_repeats(keyed: DataFrame, scratch: Scratch, window: int, shard_words: int) -> DataFrame:
    """(key, hits) for keyed(key, text) with unique keys: the segments of a text that hold windows met elsewhere, and which."""
    spark = keyed.sparkSession
    rows = scratch.keep(arrow_map(keyed, lambda it: _route(it, window), "anchor long, seg long, key long, first int, wins int, own boolean"), "segments")
    distinct = rows.groupBy("anchor", "seg").agg(F.count("*").alias("weight"), F.min(F.struct("key", "first")).alias("at"), F.max("wins").alias("wins"), F.max("own").alias("own"))
    distinct = scratch.keep(distinct.select("anchor", "seg", "weight", "at.key", "at.first", "wins", "own"), "distinct")
    scratch.sweep()
    size = F.sum(F.col("wins").cast("long") + window - 1)
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("variants"), size.alias("size"), F.max("own").alias("any_own")).where("variants > 1 or any_own")
    whole = scratch.keep(distinct.where("weight > 1").select("anchor", "seg", F.lit(None).cast("array<int>").alias("marks")), "whole")
    wanted = distinct.join(shared, "anchor").withColumn("hot", F.col("size") > shard_words)
    wanted = scratch.keep(wanted.groupBy("key").agg(F.collect_list(F.when(~F.col("hot"), F.struct("anchor", "seg", "first", "wins", "weight"))).alias("wanted"), F.collect_list(F.when(F.col("hot"), F.struct("anchor", "seg", "first", "wins", "weight"))).alias("hot")), "wanted")
    scratch.drop(distinct)
    texts = _with_lists(keyed, wanted, "inner")
    schema = "anchor long, seg long, weight long, words binary"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = arrow_map(texts.select("key", "text", "wanted"), lambda it: _fetch(it, window, False), schema).repartition(parts, "anchor").sortWithinPartitions("anchor")
    marks = arrow_map(dealt, lambda it: _shards(it, window), "anchor long, seg long, marks array<int>")
    # a segment met twice is repeated as a whole; the automaton's marks of the others
    verdict = marks.join(whole.select("anchor", "seg"), ["anchor", "seg"], "left_anti").union(whole)
    done = [wanted, whole]
    if not wanted.where(F.size("hot") > 0).isEmpty():

        def windows(batches):
            for batch in _fetch(batches, window, True):
                hashes = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
                lens = np.array([len(x) for x in hashes], np.int64)
                row = pa.array(np.repeat(np.arange(len(lens)), lens))
                at = np.concatenate([np.arange(n) for n in lens]) if len(lens) else lens
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), batch.column(2).take(row), pa.array(at.astype(np.int32)), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], names=["anchor", "seg", "weight", "at", "win"])

        each = scratch.keep(arrow_map(_with_lists(keyed, wanted.where(F.size("hot") > 0).select("key", F.col("hot").alias("wanted")), "inner").select("key", "text", "wanted"), windows, "anchor long, seg long, weight long, at int, win long"), "windows")
        done.append(each)
        often = each.groupBy("anchor", "win").agg(F.sum("weight").alias("k")).where("k > 1")
        # windows met most often, at most one in HEAVY, would each be one task's; they are sent out if they are few
        once, heavy = each.where("weight = 1"), often.where(F.col("k") > HEAVY).select("anchor", "win")
        often = often.select("anchor", "win")
        if heavy.limit(MOST_HEAVY + 1).count() <= MOST_HEAVY:
            heavy = F.broadcast(heavy)
            met = once.join(heavy, ["anchor", "win"]).union(once.join(heavy, ["anchor", "win"], "left_anti").join(often, ["anchor", "win"]).select("anchor", "win", *[c for c in once.columns if c not in ("anchor", "win")]))
        else:
            met = once.join(often, ["anchor", "win"])
        found = met.groupBy("anchor", "seg").agg(F.collect_set("at").alias("marks"))
        verdict = verdict.union(found)
    verdict = scratch.keep(verdict, "verdict")
    scratch.drop(*done)
    hits = rows.join(verdict, ["anchor", "seg"]).groupBy("key").agg(F.collect_list(F.struct("first", "wins", "marks")).alias("hits"))
    hits = scratch.keep(hits, "hits")
    scratch.drop(rows, verdict)
    return hits


def remove_repeats(docs: DataFrame, *, window: int = 35, shard_words: int = 240_000, texts: bool = False, stats: tuple[str, str, str] = ("n_words", "n_removed", "kept_sha256")) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_words, n_removed, kept_sha256).

    With texts: all columns of docs, text being what is kept (a text that loses nothing stays byte for byte), and the three under the
    names of `stats`, which must not be names of docs' columns. A window has KGRAM words or more.
    """
    if window < KGRAM:
        raise ValueError(f"a window must have {KGRAM} words or more")
    if texts and {c.lower() for c in docs.columns} & {c.lower() for c in stats}:
        raise ValueError("name the three results so that no column of the input has their names")
    scratch = Scratch(docs.sparkSession, "substring")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.struct(*[x for x, c in zip(all_columns(docs), docs.columns, strict=True) if c != "text"]).alias("_row")] * texts)
    if keyed.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        keyed = keyed.withColumn("key", F.col("doc_id"))
    else:  # ids that are no key: rows get numbers of their own in a written copy
        keyed = scratch.keep(keyed.withColumn("key", F.monotonically_increasing_id()), "numbered")
    hits = find_repeats(keyed.select("key", "text"), scratch, window, shard_words)
    own = keyed.select("key", "text", *["_row"] * texts, *([] if texts else [F.struct("doc_id").alias("_row")]))
    joined = _with_lists(own, hits, "left").select("key", "text", "hits", "_row")
    schema = T.StructType.fromDDL("key long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts).add(joined.schema["_row"])
    out = arrow_map(joined, lambda it: _rewrite(it, window, texts), schema)
    if not texts:
        return out.select("_row.doc_id", "n_words", "n_removed", "kept_sha256")
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(("n_words", "n_removed", "kept_sha256"), stats, strict=True)])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
