"""Token-ID files: ORC with integer run-length encoded ids in ascending document order.

Texts are dealt to ranges of the document id, encoded there, and written as one ORC
file a range. Files carry row indexes and a Bloom filter on doc_id, so a reader skips
stripes and row groups by metadata; each row has its range and its first id's place in
it, so a reader of any stripe knows where it stands without reading the others.

Edge cases: null and empty texts are one end id; rows with a null id come first; rows
that repeat an id follow each other, by text; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseal.llm.common import Scratch, arrow_map
from tallyseal.llm.tokens import default_path, encoder, id_runs

FILE_BYTES = 256 << 20
SCHEMA = "doc_id long, part int, part_start long, ids array<int>"


def _encode(batches, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at, encode = TaskContext.get().partitionId(), 0, encoder(path)
    for batch in batches:
        for i, j, ids, firsts in id_runs(batch, encode, end_id):
            lists = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(at + firsts[:-1]), lists], names=["doc_id", "part", "part_start", "ids"])
            at += len(ids)


def file_count(docs: DataFrame) -> int:
    """By the size that the scan's statistics tell; no job is run."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # Spark takes an input of unknown size for as large as can be
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // FILE_BYTES)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 1, files: int | None = None, stripe_mb: int = 64) -> None:
    """docs(doc_id, text) to ORC files under path; a retried task writes the same rows. files: one a shuffle partition, or more where that would make files of over FILE_BYTES of the input's estimated bytes."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    files = files or file_count(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = texts.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    writer = arrow_map(ranged, lambda it: _encode(it, tokenizer, end_id), SCHEMA).write
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_mb << 20)}
    writer.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach stripe statistics and Bloom filters, and stripes are read in parallel."""
    return spark.read.schema(SCHEMA).orc(path)


def range_starts(tokens: DataFrame) -> DataFrame:
    """(part, start): ids in all ranges before. One row a file."""
    spark = tokens.sparkSession
    sizes = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.max(F.col("part_start") + F.size("ids")).alias("n")).collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    return spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "part int, start long")


def _digest(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        offs = np.asarray(lists.offsets)
        ids = np.asarray(lists.values).astype(np.uint32)
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offs).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").new_path("ids")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    tokens = read_tokens(spark, path)
    placed = tokens.join(F.broadcast(range_starts(tokens)), "part")  # one row a file
    return arrow_map(placed.select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "ids"), _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
