"""Keyed tables as folders of Parquet: appended batch by batch, updated by the buckets that change, compacted into a base.

A table's rows lie under ``data/part=<name>/bucket=<n>``, where the bucket is a hash of the key. What is live is told by the last file of ``manifest``, which lists for each
part its live buckets, and how far each source has been read; a file of the manifest is created once and never overwritten, so a change is there wholly or not at all, and of two
writers at once one starts anew from what the other left. Parts are never written to again, so a reader keeps what it has begun to read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART, BUCKET = "part", "bucket"
#: Times that a change is begun anew after other writers' changes.
TRIES = 10


class Changed(Exception):
    """Another writer changed the same buckets meanwhile."""


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last change of each key; equal to replaying all of them in order."""
    whole = F.max_by(F.struct(*changes.columns), seq)
    return changes.groupBy(F.col(key).alias("__key")).agg(whole.alias("x")).select("x.*")


class KeyedTable:
    """The rows at ``path`` by buckets of ``key``. ``buckets`` must stay as it was when the table was begun."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names("manifest") if n.endswith(".json"))

    def manifest(self) -> dict:
        """``version``, ``parts`` (name to live buckets), ``sources`` (name to the last batch that was taken) and ``schema`` of the table as it is now."""
        numbers = self.versions()
        if not numbers:
            return {"version": 0, "parts": {}, "sources": {}, "schema": None}
        name = f"{self.path}/manifest/{numbers[-1]:012d}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()[0])

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """Writes the manifest that ``change`` makes of the present one; anew if another writer was faster. No change, no version."""
        for _ in range(TRIES):
            now = self.manifest()
            then = change(json.loads(json.dumps(now)))
            if then is None:
                return now["version"]
            then["version"] = now["version"] + 1
            target, own = self._at(f"{self.path}/manifest/{then['version']:012d}.json"), self._at(f"{self.path}/manifest/.{uuid.uuid4().hex}")
            out = self._files.create(own, False)
            out.write(bytearray(json.dumps(then).encode()))
            out.close()
            # A manifest appears whole: it is written aside and given its name, which it gets only if that is free.
            if not self._files.exists(target) and self._files.rename(own, target):
                return then["version"]
            self._files.delete(own, False)
        raise Changed(self.path)

    def _write(self, rows: DataFrame, name: str) -> tuple[str, list[int]]:
        """A new part, and the buckets that it has."""
        part = f"{name}-{uuid.uuid4().hex[:8]}"
        rows.withColumn(BUCKET, self.bucket()).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{PART}={part}")
        return part, sorted(int(n.split("=")[1]) for n in self._names(f"data/{PART}={part}") if n.startswith(f"{BUCKET}="))

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        wanted = None if buckets is None else set(buckets)
        leaves = [f"{self.path}/data/{PART}={part}/{BUCKET}={b}" for part, live in manifest["parts"].items() for b in live if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*leaves) if leaves else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame, source: str = "", number: int | None = None) -> int:
        """Adds rows as a part of their own and rewrites nothing. A numbered batch of a source is taken once: given again, after a failure, it changes nothing."""
        known = self.manifest()
        if number is not None and known["sources"].get(source, -1) >= number:
            return known["version"]
        part, live = self._write(rows, "batch")

        def add(m: dict) -> dict | None:
            if number is not None and m["sources"].get(source, -1) >= number:
                return None
            if number is not None:
                m["sources"][source] = number
            m["schema"] = m["schema"] or json.dumps(rows.schema.jsonValue())
            m["parts"][part] = live
            return m

        return self._commit(add)

    def read(self, value=None, seq: str | None = None) -> DataFrame:
        """All rows, or those of one key, for which its bucket alone is read; with ``seq``, the last row of each key."""
        now = self.manifest()
        if value is None:
            rows = self._rows(now)
        else:
            kind = StructType.fromJson(json.loads(now["schema"]))[self.key].dataType
            own = self.spark.range(1).select(F.lit(value).cast(kind).alias(self.key)).select(self.bucket()).first()[0]
            rows = self._rows(now, [own]).filter(F.col(self.key) == F.lit(value).cast(kind))
        return latest(rows, self.key, seq) if seq else rows

    def _replace(self, seen: dict, buckets: list[int], rows: DataFrame, name: str, others_may_add: bool) -> int:
        part, live = self._write(rows, name)
        wanted = set(buckets)

        def swap(m: dict) -> dict:
            of = lambda x: {p: sorted(wanted & set(bs)) for p, bs in x["parts"].items() if wanted & set(bs)}
            before, after = of(seen), of(m)
            if any(after.get(p) != bs for p, bs in before.items()) or (not others_may_add and after != before):
                raise Changed(self.path)
            for p in before:
                m["parts"][p] = [b for b in m["parts"][p] if b not in wanted]
            m["parts"] = {p: bs for p, bs in m["parts"].items() if bs} | ({part: live} if live else {})
            return m

        return self._commit(swap)

    def update(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets in which ``changes`` has keys: each to ``apply(rows, changes)`` of them; all others stay as they lie. Returns the buckets."""
        touched = sorted(r[0] for r in changes.filter(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect())  # one number per bucket
        for _ in range(TRIES):
            seen = self.manifest()
            if not touched or seen["schema"] is None:
                return []
            try:
                self._replace(seen, touched, apply(self._rows(seen, touched), changes), "update", False)
                return touched
            except Changed:
                continue
        raise Changed(self.path)

    def compact(self, seq: str, parts: int = 2) -> list[int]:
        """Rewrites the buckets that lie in ``parts`` parts or more as one, with the last row of each key. Rows that are appended meanwhile stay. Returns the buckets."""
        seen = self.manifest()
        many = [b for b in range(self.buckets) if sum(b in bs for bs in seen["parts"].values()) >= parts]
        if many:
            self._replace(seen, many, latest(self._rows(seen, many), self.key, seq), "base", True)
        return many

    def vacuum(self) -> list[str]:
        """Deletes parts that the last manifest does not list, and older manifests. Only when no one reads or writes the table."""
        now = self.manifest()
        gone = [n for n in self._names("data") if n.split("=", 1)[-1] not in now["parts"]]
        for n in gone:
            self._files.delete(self._at(f"{self.path}/data/{n}"), True)
        for v in self.versions()[:-1]:
            self._files.delete(self._at(f"{self.path}/manifest/{v:012d}.json"), False)
        return gone
