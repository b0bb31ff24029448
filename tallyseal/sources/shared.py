"""Files in folders that the driver and all executors share, by Hadoop's file systems."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset and Spark runs in this process alone, in a folder of the process. RuntimeError on a cluster without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tallyseal-")
            atexit.register(shutil.rmtree, _own[app], True)
        root = "file://" + _own[app]
    return f"{root.rstrip('/')}/tallyseal-{app}/{tag}-{uuid.uuid4().hex[:12]}"


class Folder:
    """A folder of small files that the driver reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at(""))) if self._fs.exists(self._at("")) else []

    def create(self, name: str, text: str) -> None:
        """Writes a new file whole, or raises FileExistsError: the data goes to a file of another name, which is renamed."""
        draft = self._at(f"_{name}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            raise FileExistsError(f"{self.path}/{name}")

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


