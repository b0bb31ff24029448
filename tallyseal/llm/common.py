"""What the operators share: scratch tables, text batches and vectorised word hashes."""

from __future__ import annotations

import atexit
import gc
import hashlib
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy step looks at together.
SLICE_BYTES = 1 << 20

_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and Spark runs in this process alone, a folder of the process (tests). Raises RuntimeError on a cluster without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_roots:
            _own_roots[app] = tempfile.mkdtemp(prefix="tallyseal-")
            import shutil

            atexit.register(shutil.rmtree, _own_roots[app], True)
        root = "file://" + _own_roots[app]
    return f"{root.rstrip('/')}/tallyseal-{app}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written in the shared folder. They cut lineage: a lost executor costs only tasks of the running stage."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.n = spark, f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}", 0

    def new_path(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:02d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new_path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more, and lets Spark remove the shuffle files of ended jobs."""
        for t in tables:
            _delete(self.spark, t._scratch_path)
        self.sweep()

    def sweep(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of at most `most` bytes unless one text is longer; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:
        lens = np.where(np.asarray(col.is_null()), 0, np.diff(offs))
        full = np.concatenate([[0], np.cumsum(lens)])
        keep = [data[offs[i] : offs[i] + lens[i]] for i in range(n)]
        data, offs = (np.concatenate(keep) if keep else data), full
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i]).astype(np.int64)
        i = j


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd, with as many ones as zeros.
_TIMES = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that its key holds as they are.
EXACT = 15
_LOW_BYTES = np.array([0] + [0xFFFFFFFFFFFFFFFF >> (64 - 8 * k) for k in range(1, 9)], np.uint64)


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two spans in a row. Each step is mixed, so that no sum of positions can cancel out, whatever patterns the values form."""
    return mix(left * _TIMES + right)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive hashes, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, level, span = None, 0, values, 1
    while True:
        if width & span:
            part = level[at : at + n]
            out, at = part if out is None else joined_hash(out, part), at + span
        if span * 2 > width:
            return out
        level = joined_hash(level[:-span], level[span:])
        span *= 2


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), of any lengths, of a sequence of hashes: their lengths' powers of two, folded."""
    lens = (ends - starts).astype(np.int64)
    out, at, level, span = mix(lens.astype(np.uint64)), starts.astype(np.int64), values, 1
    most = int(lens.max(initial=0))
    while span <= most:
        use = np.flatnonzero(lens & span)
        out[use] = joined_hash(out[use], level[at[use]])
        at[use] += span
        if span * 2 <= most:
            level = joined_hash(level[:-span], level[span:])
        span *= 2
    return out


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers that tell spans of bytes apart: the bytes themselves up to 15, and 120 bits of a BLAKE2b digest beyond."""
    padded = np.zeros(len(data) + 24, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 16, "<u8", padded, strides=(1,))
    lens = ends - starts
    a = eight[starts] & _LOW_BYTES[np.minimum(lens, 8)]
    b = eight[starts + 8] if len(data) else a
    b = (b & _LOW_BYTES[np.clip(lens - 8, 0, 7)]) | (np.minimum(lens, EXACT).astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(lens > EXACT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        marks = b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        pairs = np.frombuffer(marks, "<u8").reshape(-1, 2)
        a[long], b[long] = pairs[:, 0], (pairs[:, 1] & _LOW_BYTES[7]) | np.uint64((EXACT + 1) << 56)
    return a, b


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ (or of what isn't `space`) and, for each text, the index of its first word (one more entry than texts)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = first[1:] - 1 if len(first) else first
    stop[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each text's first word."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), first
    return joined_hash(*(mix(x) for x in span_keys(data, starts, ends))), first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    return df.mapInArrow(f, schema)


def pages_sum(df: DataFrame, parts: int) -> DataFrame:
    """Sums little-endian uint32 pages (page int, part int, data binary) in a tree of 64 children a node."""

    def fold(key, table):
        total = None
        for x in table.column("data"):
            page = np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64)
            total = page if total is None else total + page
        data = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    for _ in range(max(1, math.ceil(math.log(max(parts, 2), 64)))):
        df = df.select("page", F.expr("int(part div 64)").alias("part"), "data").groupBy("page", "part").applyInArrow(fold, "page int, part int, data binary")
    return df


#: Rows of counts that a task merges before it hands them on.
HELD = 400_000


def merged_counts(tables: Iterator[pa.Table], keys: list[str], held: int = HELD) -> Iterator[pa.Table]:
    """Tables of keys and counts `n`, counts of equal keys added as far as `held` rows allow."""
    some, rows = [], 0
    for t in tables:
        some.append(t)
        rows += len(t)
        if rows > held:
            one = pa.concat_tables(some).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])
            some, rows = ([one], len(one)) if len(one) * 2 < held else ([], 0)
            if not some:
                yield one
    if some:
        yield pa.concat_tables(some).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def unused(columns, name: str) -> str:
    """The name, with underscores behind it until no column has it, in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of a table, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def documents_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
