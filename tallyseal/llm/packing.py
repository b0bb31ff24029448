"""Packing: bounded-space online best fit.

Every partition keeps `open_windows` open windows. A document's ids are cut into
full windows and a rest; the rest goes to the open window that it leaves least
room in. When none fits, the fullest window is closed: filled up with the head of
the rest where both parts keep `min_piece` ids at least, padded otherwise. What is
left open at the end of a partition is merged with the leftovers of 63 other
partitions, largest piece first. Memory is a batch and the open windows' list,
whatever the size of the input; nothing but piece rows is shuffled, and only the
leftovers of them.

Edge cases: null and empty texts are one end id; a null id stays null; repeated
rows are packed each; texts of any length are cut; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseal.llm.common import Scratch, arrow_map
from tallyseal.llm.tokens import default_path, encoder, id_runs

FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{k} long" for k in FIELDS)


class OpenWindows:
    """Best fit over a bounded number of windows; number() gives the id of a new window."""

    def __init__(self, size: int, most: int, min_piece: int):
        self.size, self.most, self.min_piece = size, most, min_piece
        self.free: list[tuple[int, int]] = []  # (room, window), sorted
        self.count = 0

    def new(self) -> int:
        self.count += 1
        return self.count - 1

    def place(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(window, offset, length) of the pieces that an item of at most `size` ids is cut into."""
        while length:
            k = bisect_left(self.free, (length, -1))
            if k < len(self.free):
                room, w = self.free.pop(k)
            elif len(self.free) < self.most:
                room, w = self.size, self.new()
            else:
                room, w = self.free.pop(0)  # the fullest is emitted
                if room >= self.min_piece and length - room >= self.min_piece:
                    yield w, self.size - room, room
                    length -= room
                    continue
                room, w = self.size, self.new()
            yield w, self.size - room, length
            if room > length:
                insort(self.free, (room - length, w))
            length = 0


def _pack(batches, path: str, end_id: int, size: int, most: int, min_piece: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    encode, windows = encoder(path), OpenWindows(size, most, min_piece)
    held: list[tuple] = []

    def batch_of(rows: list[tuple], left: bool) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * (7 + with_ids)
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))] if with_ids else [])
        arrays += [pa.array(np.full(len(rows), part, np.int64)), pa.array(np.full(len(rows), left))]
        return pa.RecordBatch.from_arrays(arrays, names=[*FIELDS, *["ids"] * with_ids, "part", "left_over"])

    for batch in batches:
        names = batch.column(0).to_pylist()
        for i, j, ids, firsts in id_runs(batch, encode, end_id):
            for k in range(j - i):
                own = ids[firsts[k] : firsts[k + 1]]
                n, at = len(own), 0
                while at < n:
                    spans = [(windows.new(), 0, size)] if n - at >= size else list(windows.place(n - at))
                    for w, offset, length in spans:
                        piece = own[at : at + length]
                        held.append((names[i + k], at, length, zlib.crc32(piece), n, part << 36 | w, offset, *([piece.tolist()] if with_ids else [])))
                        at += length
        if len(held) > 20_000:
            alive = {part << 36 | w for _, w in windows.free}
            yield batch_of([r for r in held if r[5] not in alive], False)
            held = [r for r in held if r[5] in alive]
    alive = {part << 36 | w for _, w in windows.free}
    yield batch_of([r for r in held if r[5] not in alive], False)
    yield batch_of([r for r in held if r[5] in alive], True)


def _merge(batches, size: int) -> Iterator[pa.RecordBatch]:
    """Leftover pieces sorted by group, longest first: first fit decreasing by best fit, windows unbounded in number but not in origin (64 partitions' open windows)."""
    names, now, windows = None, None, None
    for batch in batches:
        names = batch.schema.names
        group, length = batch.column(names.index("grp")).to_pylist(), batch.column(names.index("length")).to_pylist()
        seq, offset = [], []
        for g, n in zip(group, length, strict=True):
            if g != now:
                now, windows = g, OpenWindows(size, 1 << 60, size)
            ((w, at, _),) = windows.place(n)
            seq.append(1 << 62 | g << 32 | w)
            offset.append(at)
        table = {k: batch.column(names.index(k)) for k in names if k != "grp"} | {"sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offset, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(table.values()), names=list(table))


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, size: int = 1024, open_windows: int = 64, min_piece: int = 32, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) to one row a piece; with_ids adds the piece's ids. A window is padded to `size` by whoever reads it."""
    path = tokenizer or default_path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession, "packing")
    schema = SCHEMA + ", ids array<int>" * with_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = scratch.keep(arrow_map(texts, lambda it: _pack(it, path, end_id, size, open_windows, min_piece, with_ids), schema + ", part long, left_over boolean"), "pieces")
    cols = [*FIELDS, *["ids"] * with_ids]
    left = made.where("left_over").withColumn("grp", F.expr("part div 64")).repartition("grp").sortWithinPartitions("grp", F.desc("length"), "part", "sequence_id", "offset", "doc_id")
    merged = arrow_map(left.select(*cols, "grp"), lambda it: _merge(it, size), schema)
    return made.where("not left_over").select(*cols).union(merged.select(*cols))


def op1_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
