"""A catalogue of fitted heads with atomic versions.

A head is written into a data folder of its own, which nobody reads yet.  Then a manifest, one small JSON file that names the head and
its folder, is moved into place by a rename that never replaces a file.  Readers list manifests only, so
a head that was half written (no manifest) doesn't exist for them, and of two writers of the same (experiment, step, sequence, version)
one wins whole; the other is told so.  Lookups go by equality of the keys.

Manifests are one per head, so the driver lists as many as heads were ever kept; weights are read by Spark from the named folders.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_COLUMNS = "label_id int, weights array<double>, bias double"
MANIFEST = ("experiment", "step", "seq_key", "version", "promoted", "trial", "epoch", "learning_rate", "data")


class HeadCatalogue:
    """Heads below ``root``: ``manifests/*.json`` and ``data/<unique>/``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _rename_new(self, source: str, target: str) -> bool:
        """Move a file to a name that must be free."""
        sc = self.spark.sparkContext
        where = self._fs.makeQualified(self._path(target)).toUri()
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, sc._jsc.hadoopConfiguration())
        none = sc._gateway.new_array(getattr(sc._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._path(source)), self._fs.makeQualified(self._path(target)), none)
        except Exception as e:  # noqa: BLE001 - only a name that is taken is an answer, the rest is raised
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        return True

    def publish(self, rows: DataFrame, experiment: str, step: int, seq_key: str, version: int = 0, promoted: bool = False,
                trial: int = -1, epoch: int | None = None, learning_rate: float | None = None) -> bool:
        """Add a head, (label_id, weights, bias) rows; False when this version is already there (it stays as it is)."""
        name = hashlib.sha256(json.dumps([experiment, step, seq_key, version]).encode()).hexdigest()
        target = f"{self.root}/manifests/{name}.json"
        if self._fs.exists(self._path(target)):
            return False
        data = f"data/{uuid.uuid4().hex}"
        rows.select("label_id", "weights", "bias").write.parquet(f"{self.root}/{data}")
        values = (experiment, step, seq_key, version, promoted, trial, epoch, learning_rate, data)
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}.json"
        out = self._fs.create(self._path(draft), False)
        out.write(json.dumps(dict(zip(MANIFEST, values))).encode())
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        if self._rename_new(draft, target):
            return True
        self._fs.delete(self._path(draft), False)
        self._fs.delete(self._path(f"{self.root}/{data}"), True)
        return False

    def manifests(self) -> list[dict]:
        """What the catalogue holds, by experiment, step, sequence and version."""
        where = self._path(f"{self.root}/manifests")
        if not self._fs.exists(where):
            return []
        found = []
        for status in self._fs.listStatus(where):
            stream = self._fs.open(status.getPath())
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append(json.loads(text))
        return sorted(found, key=lambda m: (m["experiment"], m["step"], m["seq_key"], m["version"]))

    def lookup(self, experiment: str, step: int, seq_key: str) -> dict | None:
        """The manifest of the head to use: a promoted one before others, then the lowest version; None if there is none."""
        own = [m for m in self.manifests() if (m["experiment"], m["step"], m["seq_key"]) == (experiment, step, seq_key)]
        return min(own, key=lambda m: (not m["promoted"], m["version"]), default=None)

    def rows(self, manifests: Sequence[dict]) -> DataFrame:
        """The heads of these manifests: manifest columns, label_id, weights, bias."""
        schema = ("experiment string, step bigint, seq_key string, version bigint, promoted boolean, trial bigint, epoch bigint, learning_rate double, " + HEAD_COLUMNS)
        out = self.spark.createDataFrame([], schema)
        for m in manifests:
            part = self.spark.read.schema(HEAD_COLUMNS).parquet(f"{self.root}/{m['data']}")
            kinds = {"step": "bigint", "version": "bigint", "trial": "bigint", "epoch": "bigint", "learning_rate": "double"}
            out = out.unionByName(part.select(*[F.lit(m[c]).cast(kinds.get(c, "boolean" if c == "promoted" else "string")).alias(c) for c in MANIFEST[:-1]], "label_id", "weights", "bias"))
        return out

    def heads(self) -> DataFrame:
        """All heads."""
        return self.rows(self.manifests())
