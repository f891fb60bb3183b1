"""Tables with keyed upsert on plain parquet (S-16, S-18, X-01, X-03, X-04).

Rows lie in buckets by the hash of their key. A change writes new files for the buckets that it
touches, and then one small manifest that says, for each bucket, which folder holds it. The
highest manifest that is whole is the table: until it is written readers see the old version, and a
run that dies before leaves nothing but files that nobody reads. Two writers who start from the same
version can't both finish: a manifest is created once or not at all.

Work and rewritten bytes follow the buckets touched, so choose as many that one is worth rewriting
(about a GB); a bucket with a hot key is written by several tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer finished first; the change can be tried again."""


class KeyedTable:
    """``keys`` name the columns of which rows are replaced as a whole; null keys are keys of their own."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def _at(self, *parts: object):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))

    def _manifest(self, version: int) -> dict | None:
        """None for one that is not there or was not written to its end."""
        at = self._at("_versions", f"{version}.json")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def _current(self) -> dict:
        """The newest whole manifest; ``taken`` is the highest number used, whole or not."""
        taken = 0
        if self._fs.exists(self._at("_versions")):
            names = [s.getPath().getName() for s in self._fs.listStatus(self._at("_versions"))]
            numbers = sorted((int(n[:-5]) for n in names if n.endswith(".json")), reverse=True)
            taken = max(numbers, default=0)
            for n in numbers:
                found = self._manifest(n)
                if found is not None:
                    return found | {"taken": taken}
        return {"version": 0, "holds": {}, "applied": {}, "taken": taken}

    def version(self) -> int:
        return self._current()["version"]

    def _swap(self, manifest: dict) -> None:
        at = self._at("_versions", f"{manifest['version']}.json")
        try:
            stream = self._fs.create(at, False)
        except Exception as e:
            raise Conflict(f"version {manifest['version']} of {self.path} was written by another") from e
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()

    # ---- rows

    def _files(self, holds: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{v}/{_BUCKET}={b}" for b, v in sorted(holds.items(), key=lambda x: int(x[0])) if v]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one that was not vacuumed."""
        found = self._current() if version is None else self._manifest(version) if version else {"holds": {}}
        if found is None:
            raise ValueError(f"{self.path} has no version {version}")
        return self._files(found["holds"])

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        wanted = self._typed(keys.select(*self.keys)).distinct()
        touched = {str(r[0]) for r in wanted.select(self._bucket().alias("b")).distinct().collect()}  # at most one for each bucket
        rows = self._files({b: v for b, v in self._current()["holds"].items() if b in touched})
        return rows.join(wanted, self._same(rows, wanted), "left_semi")

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Keys of the table's types: a number's hash depends on its type."""
        return rows.withColumns({k: F.col(k).cast(self.schema[k].dataType) for k in self.keys})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    # ---- changes

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, batch: tuple[str, int] | None = None) -> bool:
        """All rows of each key that occurs in ``new`` are replaced by its rows in ``new``.

        ``merge(old, new)`` gives the rows to be written instead, from the keys' old rows and ``new``. A
        ``batch`` (source, number) that was applied before changes nothing. Returns whether it was applied.
        """
        columns = self.schema.names

        def change(old: DataFrame, fresh: DataFrame) -> DataFrame:
            keys = fresh.select(*self.keys).distinct()
            others = old.join(keys, self._same(old, keys), "left_anti")
            if merge is None:
                return others.select(*columns).unionByName(fresh.select(*columns))
            mine = old.join(keys, self._same(old, keys), "left_semi")
            return others.select(*columns).unionByName(merge(mine, fresh).select(*columns))

        return self._write(new, change, batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """S-19: the rows of these keys go."""
        return self._write(keys.select(*self.keys), lambda old, gone: old.join(gone, self._same(old, gone), "left_anti"), batch)

    def _write(self, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None) -> bool:
        now = self._current()
        if batch and now["applied"].get(batch[0], -1) >= batch[1]:
            return False
        version = now["taken"] + 1
        # a name of its own for each attempt, so that a writer who comes second overwrites nothing
        name = f"{version}-{uuid.uuid4().hex[:12]}"
        staged = f"{self.path}/staged/{name}"
        # written once: the change must not be taken from two different readings of its source
        new = self._typed(new)
        new.write.mode("overwrite").parquet(staged)
        fresh = self.spark.read.schema(new.schema).parquet(staged)
        touched = {str(r[0]) for r in fresh.select(self._bucket().alias("b")).distinct().collect()}
        holds = dict(now["holds"])
        if touched:
            rows = change(self._files({b: v for b, v in holds.items() if b in touched}), fresh)
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn(_BUCKET, self._bucket())
            rows.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
            written = {b for b in touched if self._fs.exists(self._at("data", name, f"{_BUCKET}={b}"))}
            holds |= {b: name if b in written else "" for b in touched}
        applied = now["applied"] | ({batch[0]: batch[1]} if batch else {})
        self._swap({"version": version, "holds": holds, "applied": applied})
        self._fs.delete(self._at("staged", name), True)
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the last ``keep``, and files that those don't hold. Not while a writer is at work."""
        now = self._current()
        numbers = [n for n in range(now["taken"] + 1) if self._manifest(n) is not None]
        kept = numbers[-max(keep, 1):]
        held = {name for n in kept for name in self._manifest(n)["holds"].values()}
        if self._fs.exists(self._at("data")):
            for folder in self._fs.listStatus(self._at("data")):
                if folder.getPath().getName() not in held:
                    self._fs.delete(folder.getPath(), True)
        for n in set(range(1, now["taken"])) - set(kept):
            self._fs.delete(self._at("_versions", f"{n}.json"), False)
        self._fs.delete(self._at("staged"), True)
