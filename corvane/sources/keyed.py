"""Keyed tables on shared storage: copies of changed buckets, one manifest that makes a version visible, a ledger of migrations.

Rows are dealt into buckets by their key's hash. A change writes new copies of the buckets that it touches and then one manifest that
names the current copy of each bucket; a reader takes the newest manifest. A crash before the manifest leaves the old
state, and files that no manifest names are never read. Two writers of the same version can't both succeed: manifests
are never overwritten. Old copies stay for readers of old versions until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored

Migration = tuple[str, Callable[[DataFrame], DataFrame]]


class KeyedTable:
    """Rows with a key: upsert, delete that tells what it deleted, look-up that reads one bucket, migrations.

    Null keys are refused. ``schema`` is that of a new table; an existing one has its own.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        if not self._versions():
            self._commit(0, {"schema": StructType.fromDDL(schema).json(), "buckets": {}, "count": buckets, "ledger": []})
        self.buckets = self._state()[1]["count"]

    # --- files ---
    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._at(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _state(self) -> tuple[int, dict]:
        version = self._versions()[-1]
        return version, json.loads(self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()["value"])

    def _commit(self, version: int, state: dict) -> None:
        """The manifest is written beside its place and renamed, which fails if the version is there."""
        hidden, fs = self._at(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target, _ = self._at(f"{self.path}/manifest/{version}.json")
        if fs.exists(target) or not fs.rename(hidden, target):
            fs.delete(hidden, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another")

    # --- rows ---
    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in state["buckets"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _write(self, state: dict, rows: DataFrame, touched: list[int]) -> dict:
        """The state with new copies of the touched buckets, which hold ``rows``."""
        name = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("__b__", self._bucket())
        placed.repartition(max(1, len(touched)), "__b__").write.partitionBy("__b__").parquet(f"{self.path}/{name}")
        folder, fs = self._at(f"{self.path}/{name}")
        made = {s.getPath().getName() for s in fs.listStatus(folder)}
        buckets = {b: p for b, p in state["buckets"].items() if int(b) not in touched}
        return state | {"buckets": buckets | {str(b): f"{name}/__b__={b}" for b in touched if f"__b__={b}" in made}}

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets

    def rows(self) -> DataFrame:
        return self._read(self._state()[1])

    def get(self, value) -> DataFrame:
        """Rows of one key, from its bucket alone."""
        one = self.spark.createDataFrame([(value,)], StructType([self.rows().schema[self.key]]))
        return self._read(self._state()[1], self._touched(one)).where(F.col(self.key) == F.lit(value))

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those with their keys. Keys that repeat in ``rows`` or are null are an error."""
        version, state = self._state()
        schema = StructType.fromJson(json.loads(state["schema"]))
        new = stored(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), "upsert")
        if new.groupBy(self.key).count().where(F.col("count").__gt__(1) | F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"{self.key} is null or repeats")
        touched = self._touched(new)
        if touched:
            kept = self._read(state, touched).join(new.select(self.key), self.key, "left_anti").select(*schema.names)
            self._commit(version + 1, self._write(state, kept.unionByName(new), touched))

    def delete(self, keys: DataFrame) -> DataFrame:
        """The key of each row of ``keys`` and whether it was ``deleted``; nothing is written if none is there."""
        version, state = self._state()
        asked = stored(keys.select(self.key).distinct(), "delete")
        touched = self._touched(asked)
        old = self._read(state, touched)
        found = asked.join(old.select(self.key).withColumn("deleted", F.lit(True)), self.key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        found = stored(found, "deleted")
        if found.where("deleted").limit(1).count():
            self._commit(version + 1, self._write(state, old.join(asked, self.key, "left_anti").select(*old.columns), touched))
        return found

    def migrate(self, migrations: list[Migration]) -> list[str]:
        """Apply those that the ledger doesn't hold, in order, each with its own version; their names. What has been applied must be the
        beginning of the list."""
        applied = []
        for k, (name, change) in enumerate(migrations):
            version, state = self._state()
            if k < len(state["ledger"]):
                if state["ledger"][k] != name:
                    raise ValueError(f"the ledger has {state['ledger'][k]} where {name} is asked for")
                continue
            changed = change(self._read(state))
            state = self._write(state | {"schema": changed.schema.json(), "ledger": [*state["ledger"], name]}, changed, list(range(self.buckets)))
            self._commit(version + 1, state)
            applied.append(name)
        return applied

    def vacuum(self) -> None:
        """Delete what the current version doesn't name. There must be no readers of older ones, and no writer."""
        named = {p.split("/")[1] for p in self._state()[1]["buckets"].values()}
        folder, fs = self._at(f"{self.path}/data")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)
