"""Receipts written once and seen whole: a transactional sink for envelopes and their manifest.

A batch is one Parquet table with the envelope, its identity and what else the rows have, written in one evaluation of the input, so that the
receipt and the manifest row of one record agree even where ids are made at random and a task is run again. Numbers are observed in the same
pass. A batch counts once the next numbered state file names it: a job that is killed, or a task that is tried twice, leaves no row that is
read, and a batch of a name that counts already is left out. Receipts and manifest are two views of the table.

Edge cases: rows without an envelope are stored, have no place in receipts or manifest and are counted as `unsigned`; an envelope whose
payload can't be read has a manifest row without identity and is counted as `unreadable`; repeated rows are kept; an empty batch counts, with
zeros; columns of the input keep their names, of which none may be one of `envelope_json`, `receipt_id`, `_receipt_hash`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.operators import receipts
from tallyseal.sources.shared import Folder

OWN = ("envelope_json", "receipt_id", "_receipt_hash")


@dataclass(frozen=True)
class ReceiptStore:
    spark: SparkSession
    path: str

    @property
    def _states(self) -> Folder:
        return Folder(self.spark, f"{self.path}/_states")

    def _last(self) -> tuple[int, dict]:
        names = [n for n in self._states.names() if n.endswith(".json") and not n.startswith("_")]
        return (int(names[-1].removesuffix(".json")), json.loads(self._states.read(names[-1]))) if names else (0, {"batches": {}})

    def batches(self) -> dict[str, dict]:
        """Numbers of each batch that counts: rows, receipts, unsigned, unreadable."""
        return {k: v["numbers"] for k, v in self._last()[1]["batches"].items()}

    def append(self, signed: DataFrame, name: str) -> dict:
        """Writes signed(envelope, ...) as the batch `name` and returns its numbers. RuntimeError where another writer came first: nothing of this batch is seen then."""
        number, state = self._last()
        if name in state["batches"]:
            return state["batches"][name]["numbers"]
        clash = {c.lower() for c in signed.columns} & set(OWN)
        if clash or "envelope" not in signed.columns:
            raise ValueError(f"rows must have an envelope, and no columns named {sorted(clash) or OWN}")
        e = F.col("envelope")
        p = receipts.payload_of(e)
        seen = Observation()
        made = signed.select("*", F.inline(F.array(F.struct(F.when(e.isNotNull(), receipts.envelope_json(e)).alias("envelope_json"), p["receipt_id"].alias("receipt_id"), p["frozen_hash"].alias("_receipt_hash")))))
        made = made.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("envelope_json").alias("receipts"), F.count_if(e.isNull()).alias("unsigned"), F.count_if(e.isNotNull() & F.col("receipt_id").isNull()).alias("unreadable"))
        folder = f"batch-{number + 1:012d}"
        made.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        numbers = {k: int(v or 0) for k, v in seen.get.items()}
        batch = {"folder": folder, "numbers": numbers, "schema": made.schema.jsonValue()}
        try:
            self._states.create(f"{number + 1:012d}.json", json.dumps({"batches": state["batches"] | {name: batch}}))
        except FileExistsError:
            raise RuntimeError(f"another writer changed the store at {self.path}; try again") from None
        return numbers

    def rows(self, name: str | None = None) -> DataFrame:
        """What was stored, of one batch or of all (whose columns must then be alike), with `_file`, the file that holds each row."""
        batches = self._last()[1]["batches"]
        if name is not None and name not in batches:
            raise KeyError(name)
        chosen = [batches[name]] if name is not None else list(batches.values())
        if not chosen:
            raise FileNotFoundError(f"no batch at {self.path}")
        schema = T.StructType.fromJson(chosen[0]["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{b['folder']}" for b in chosen]).select("*", F.col("_metadata.file_path").alias("_file"))

    def receipts(self, name: str | None = None) -> DataFrame:
        """(value): JSON text of the envelopes."""
        return self.rows(name).where("envelope_json is not null").select(F.col("envelope_json").alias("value"))

    def manifest(self, name: str | None = None) -> DataFrame:
        """(receipt_id, frozen_hash, file): the file is the one of the store that holds the receipt."""
        return self.rows(name).where("envelope_json is not null").select("receipt_id", F.col("_receipt_hash").alias("frozen_hash"), F.substring_index("_file", "/", -2).alias("file"))
