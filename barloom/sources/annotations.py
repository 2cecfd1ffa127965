"""Annotations of runs in versions, each of which is there as a whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, run_id string, ts_ns long, text string"
_STORED = f"{SCHEMA}, version long, row long"


class Annotations:
    """A folder of appended parts and of manifests, ``_versions/<number>.json``, that list what counts.

    A writer puts its rows in a part of its own and then renames a finished manifest to the next number, which must be
    free; until then, and if it is killed, readers see the version before. Deletions are marks in the manifest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The last version's number; 0 without one."""
        folder = self._at("_versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"parts": [], "deleted": []}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/_versions/{version}.json", wholetext=True).collect()))

    def _commit(self, version: int, manifest: dict) -> None:
        made, target = self._at(f"_versions/.{uuid.uuid4().hex}"), self._at(f"_versions/{version}.json")
        self._fs.mkdirs(self._at("_versions"))
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise RuntimeError(f"version {version} was written by another; read and try again")

    def _rows(self, manifest: dict) -> DataFrame:
        if not manifest["parts"]:
            return self.spark.createDataFrame([], _STORED)
        rows = self.spark.read.schema(_STORED).parquet(*(f"{self.path}/{p}" for p in manifest["parts"]))
        if not manifest["deleted"]:
            return rows
        gone = self.spark.createDataFrame([tuple(x) for x in manifest["deleted"]], "version long, row long")
        return rows.join(F.broadcast(gone), ["version", "row"], "left_anti")

    def append(self, rows: DataFrame) -> int:
        """Adds ``rows`` (id, run_id, ts_ns, text); returns the version that has them."""
        before = self.version()
        manifest, part = self._manifest(before), f"part-{uuid.uuid4().hex}"
        stored = rows.select(*(c.split()[0] for c in SCHEMA.split(", "))).withColumns({"version": F.lit(before + 1).cast("long"), "row": F.monotonically_increasing_id()})
        stored.write.parquet(f"{self.path}/{part}")
        self._commit(before + 1, manifest | {"parts": [*manifest["parts"], part]})
        return before + 1

    def delete(self, id_: str, run_id: str = "") -> bool:
        """Removes the first annotation with this id, of this run or of any; False if there is none."""
        if not id_:
            raise ValueError("an id is needed")
        before = self.version()
        manifest = self._manifest(before)
        same = self._rows(manifest).where(F.col("id") == id_)
        first = (same.where(F.col("run_id") == run_id) if run_id else same).agg(F.min(F.struct("version", "row")).alias("r")).first().r
        if first is None:
            return False
        self._commit(before + 1, manifest | {"deleted": [*manifest["deleted"], [first.version, first.row]]})
        return True

    def read(self, run_id: str | None = None) -> DataFrame:
        """Annotations of a run, or all, of the last version, in the order of ``version`` and ``row``."""
        rows = self._rows(self._manifest(self.version()))
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)
