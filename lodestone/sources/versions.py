"""Versioned tables (K12): staged writes, one pointer swap, snapshots and rollback.

A table is a folder of immutable data folders and of numbered pointers. A write stages its data under a name of its own
and then publishes the next number by one rename that fails if the number is taken; readers take the highest number, so
they see a whole version or the one before, never half. A crash before the rename leaves data that nothing points to,
which vacuum() deletes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer has published the version that this one was to be."""


class CheckError(RuntimeError):
    """The staged data didn't pass its check; nothing was published."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The published numbers, rising."""
        at = self._at("pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def pointer(self, version: int | None = None) -> dict:
        """What a version points to, the latest by default."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise LookupError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        stream = self._fs.open(self._at("pointers", f"{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, the latest by default. The frame stays on that version, whatever is published later."""
        held = self.pointer(version)
        return self.spark.read.schema(self.spark.createDataFrame([], held["schema"]).schema).parquet(f"{self.path}/{held['data']}")

    def stage(self, df: DataFrame) -> dict:
        """Write data that nothing points to yet."""
        data = f"data/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.path}/{data}")
        return {"data": data, "schema": df.schema.simpleString().removeprefix("struct<").removesuffix(">")}

    def publish(self, staged: dict, parent: int, note: str = "") -> int:
        """Point the next version at staged data; ConflictError if there is one already."""
        version = parent + 1
        own = self._at("pointers", f".{uuid.uuid4().hex}")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(staged | {"version": version, "parent": parent, "note": note}).encode()))
        out.close()
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = none
        try:
            self._context.rename(own, self._at("pointers", f"{version:012d}.json"), kinds)
        except Exception as e:
            self._fs.delete(own, False)
            if version in self.versions():
                raise ConflictError(f"version {version} of {self.path} was published meanwhile") from e
            raise
        return version

    def replace(self, df: DataFrame, *, check: Callable[[DataFrame], str | None] | None = None, note: str = "") -> int:
        """Stage, check what was staged as it will be read, publish. A check returns what is wrong, or nothing."""
        parent = self.versions()[-1] if self.versions() else 0
        staged = self.stage(df)
        wrong = check(self.spark.read.schema(df.schema).parquet(f"{self.path}/{staged['data']}")) if check else None
        if wrong:
            self._fs.delete(self._at(staged["data"]), True)
            raise CheckError(wrong)
        return self.publish(staged, parent, note)

    def rollback(self, version: int) -> int:
        """Publish an earlier version's data again as the latest one."""
        held = self.pointer(version)
        return self.publish({k: held[k] for k in ("data", "schema")}, self.versions()[-1], f"rollback to {version}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete pointers older than the last `keep`, and data that none points to; not while a writer is at work."""
        known = self.versions()
        for old in known[:-keep]:
            self._fs.delete(self._at("pointers", f"{old:012d}.json"), False)
        used = {self.pointer(v)["data"] for v in known[-keep:]}
        at = self._at("data")
        gone = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(at) if f"data/{s.getPath().getName()}" not in used] if self._fs.exists(at) else []
        for name in gone:
            self._fs.delete(self._at(name), True)
        return gone
