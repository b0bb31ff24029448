"""Hash index: which records have a frozen hash, answered from one bucket's files.

An index is a folder of batches. A batch is a Parquet table, a folder for each bucket (the first `digits` hex digits of the hash) with the
rows sorted by hash, so that row groups and pages tell by their bounds whether they can hold a hash, and with a Bloom filter on it. Which
batches count is told by numbered manifests: a batch is written first and counts once the next manifest names it, so readers see whole
batches only, a failed append leaves nothing that is read, and of two writers at once one is refused and can try again. An append under a
name that the index has is left out (a job that is run again adds nothing twice). Compaction rewrites all batches as one.

A lookup of one hash reads one file of each batch (more where a bucket is larger than a task's advised size); a lookup of many is a join by bucket and hash.

Edge cases: rows with a null hash are left out; hashes are hex (any letter case is kept as it is, as digests here are lower case) or
base64, whose first characters are escaped in folder names; equal rows are all kept; an empty table makes a batch without files; a hash
shorter than `digits` has a bucket of its own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.sources.shared import Folder

BUCKET, BATCH = "_bucket", "_batch"


@dataclass(frozen=True)
class HashIndex:
    """An index at a path; its options stand in its manifests."""

    spark: SparkSession
    path: str

    @property
    def _manifests(self) -> Folder:
        return Folder(self.spark, f"{self.path}/_manifests")

    def _last(self) -> tuple[int, dict]:
        names = [n for n in self._manifests.names() if n.endswith(".json") and not n.startswith("_")]
        if not names:
            raise FileNotFoundError(f"no index at {self.path}")
        return int(names[-1].removesuffix(".json")), json.loads(self._manifests.read(names[-1]))

    def _publish(self, number: int, state: dict) -> None:
        try:
            self._manifests.create(f"{number:012d}.json", json.dumps(state))
        except FileExistsError:
            raise RuntimeError(f"another writer changed the index at {self.path}; try again") from None

    @staticmethod
    def create(spark: SparkSession, path: str, *, hash_col: str = "frozen_hash", digits: int = 2) -> HashIndex:
        """An index without rows. 16 ** digits buckets: as many as make a bucket's files of a few hundred MB."""
        if not 1 <= digits <= 5:
            raise ValueError("digits must be from 1 to 5")
        index = HashIndex(spark, path.rstrip("/"))
        index._publish(0, {"hash_col": hash_col, "digits": digits, "schema": None, "batches": {}})
        return index

    def batches(self) -> dict[str, str]:
        """Names of the batches that count, and their folders."""
        return self._last()[1]["batches"]

    def _bucket(self, state: dict, c: Column) -> Column:
        return F.substring(c, 1, state["digits"])

    def _write(self, rows: DataFrame, state: dict, folder: str) -> None:
        h = F.col(state["hash_col"])
        made = rows.where(h.isNotNull()).withColumn(BUCKET, self._bucket(state, h))
        # small buckets share a task, and one that is larger than advised, by a very common hash for one, is split among several
        dealt = made.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, state["hash_col"])
        bloom = {f"parquet.bloom.filter.enabled#{state['hash_col']}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        dealt.write.mode("overwrite").options(**bloom).partitionBy(BUCKET).parquet(f"{self.path}/{folder}")

    def append(self, rows: DataFrame, name: str) -> bool:
        """Adds rows as the batch `name`; False, and nothing is done, where the index has it."""
        number, state = self._last()
        if name in state["batches"]:
            return False
        if state["hash_col"] not in rows.columns or {BUCKET, BATCH} & set(rows.columns):
            raise ValueError(f"rows must have the column {state['hash_col']}, and none named {BUCKET} or {BATCH}")
        schema = rows.schema.jsonValue()
        if state["schema"] is not None and [(f["name"], f["type"]) for f in state["schema"]["fields"]] != [(f["name"], f["type"]) for f in schema["fields"]]:
            raise ValueError("rows must have the columns of the index, in its order")
        folder = f"{BATCH}={number + 1:012d}"
        self._write(rows, state, folder)
        self._publish(number + 1, state | {"schema": schema, "batches": state["batches"] | {name: folder}})
        return True

    def compact(self) -> None:
        """Rewrites the batches as one. Folders that no longer count stay for readers of older manifests; vacuum() deletes them."""
        number, state = self._last()
        if len(set(state["batches"].values())) > 1:
            folder = f"{BATCH}={number + 1:012d}"
            self._write(self.rows(), state, folder)
            self._publish(number + 1, state | {"batches": dict.fromkeys(state["batches"], folder)})

    def vacuum(self) -> list[str]:
        """Deletes what the last manifest doesn't name: batches before compactions, failed appends, older manifests. Not to be run beside readers or writers."""
        number, state = self._last()
        folder = Folder(self.spark, self.path)
        gone = [n for n in folder.names() if n.startswith(f"{BATCH}=") and n not in state["batches"].values()]
        for n in gone:
            folder.delete(n)
        for n in self._manifests.names():
            if n != f"{number:012d}.json":
                self._manifests.delete(n)
        return gone

    def _read(self, state: dict) -> DataFrame:
        own = T.StructType.fromJson(state["schema"]) if state["schema"] else T.StructType([T.StructField(state["hash_col"], T.StringType())])
        full = T.StructType([*own.fields, T.StructField(BATCH, T.StringType()), T.StructField(BUCKET, T.StringType())])
        folders = Folder(self.spark, self.path)
        there = [f"{self.path}/{n}" for n in sorted(set(state["batches"].values())) if folders.names() and n in folders.names()]
        if not there:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*there)

    def rows(self) -> DataFrame:
        """All rows, as they were appended."""
        return self._read(self._last()[1]).drop(BUCKET, BATCH)

    def lookup(self, value: str) -> DataFrame:
        """The rows with a hash: one bucket is read."""
        _, state = self._last()
        found = self._read(state).where((F.col(BUCKET) == self._bucket(state, F.lit(value))) & (F.col(state["hash_col"]) == value))
        return found.drop(BUCKET, BATCH)

    def lookup_all(self, wanted: DataFrame, hash_col: str | None = None, *, few: bool = False) -> DataFrame:
        """The rows of wanted, a row for each record with its hash, with the index's other columns. A null hash finds nothing. few: ask first, in a job of its own, which buckets are wanted (16 ** digits values at most), and read only these."""
        _, state = self._last()
        h = hash_col or state["hash_col"]
        asked = wanted.withColumn(BUCKET, self._bucket(state, F.col(h)))
        own = self._read(state).drop(BATCH)
        if few:
            own = own.where(F.col(BUCKET).isin([r[0] for r in asked.where(F.col(BUCKET).isNotNull()).select(BUCKET).distinct().collect()]))
        own = own.withColumnRenamed(state["hash_col"], h) if h != state["hash_col"] else own
        clash = set(own.columns) & set(wanted.columns) - {h}
        if clash:
            raise ValueError(f"both sides have columns named {sorted(clash)}")
        return asked.join(own, [BUCKET, h]).drop(BUCKET)
