"""Tables of documents that are replaced safely.

A store is a folder with tables whose rows are dealt to buckets by a hash of
their document. Files are never changed: a commit writes the touched buckets
anew to a folder of its own, copies what stays, and then names the live
folder of each bucket in one small file, the snapshot. Readers take the
newest snapshot; until it is there they see the state before, and whatever a
commit that failed has written is not seen at all. One commit may change
several tables at once. A commit that bears the name of a source and a number
that was applied already changes nothing, so a batch may be replayed.

One writer at a time: of two at once the later fails.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; on a single machine
    without it, as in tests, one under /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return root or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


class Staging:
    """Results that are needed several times, each written once to a folder of its own in the
    shared one: their lineage ends there, and they survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/staging-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Change(NamedTuple):
    """New rows of a table. gone: the documents (by the key column) whose earlier rows go,
    whether or not there are new ones; without it the rows take the place of the whole
    table. append: no earlier row goes, and no file is read. key: the table's own key column."""

    table: str
    rows: DataFrame
    gone: DataFrame | None = None
    append: bool = False
    key: str | None = None


class Conflict(RuntimeError):
    """Another writer was faster."""


class Store:
    """Tables under `root`; each has a key column, by which its rows are dealt. A new store has
    as many buckets as there are shuffle partitions, if it isn't said how many."""

    def __init__(self, spark: SparkSession, root: str, key: str = "document_id", buckets: int | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in self._names("snapshots")) if m)

    def snapshot(self, version: int | None = None) -> dict:
        """What the newest snapshot says, or that of a version: version, applied, and of each
        table its schema, key and the live folders of each bucket."""
        known = self.versions()
        if version is None and not known:
            return {"version": -1, "buckets": self.buckets, "applied": {}, "tables": {}}
        version = known[-1] if version is None else version
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/snapshots/{version:012d}.json").collect()
        return json.loads(lines[0][0])

    def bucket(self, key: Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets or self.buckets)).cast("int")

    def _folders(self, table: dict, buckets: set[int] | None = None) -> list[str]:
        return [f"{self.root}/data/{f}/bucket={b}" for b, folders in sorted(table["live"].items()) if buckets is None or int(b) in buckets for f in folders]

    def _rows(self, table: dict | None, schema: str | StructType | None, buckets: set[int] | None = None) -> DataFrame:
        if table is None and schema is None:
            raise ValueError("the table is not there yet, so its schema must be given")
        schema = StructType.fromJson(table["schema"]) if table else schema
        folders = self._folders(table, buckets) if table else []
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, table: str, schema: str | StructType | None = None, version: int | None = None) -> DataFrame:
        """A table as the newest snapshot, or that of a version, has it; where there is none yet,
        an empty one of the schema."""
        return self._rows(self.snapshot(version)["tables"].get(table), schema)

    def read_document(self, table: str, value: str | int, schema: str | StructType | None = None) -> DataFrame:
        """The rows of one document, from the files of its bucket only."""
        return self.read_keys(table, [value], schema)

    def read_keys(self, table: str, values: list, schema: str | StructType | None = None) -> DataFrame:
        """The rows with a few keys, from the files of their buckets only."""
        now = self.snapshot()
        own = now["tables"].get(table)
        key = own["key"] if own else self.key
        kind = dict(self._rows(own, schema, set()).dtypes)[key]
        sought = self.spark.createDataFrame([(v,) for v in values], f"{key} {kind}").distinct()
        buckets = {r[0] for r in sought.select(self.bucket(F.col(key), now["buckets"])).distinct().collect()}
        return self._rows(own, schema, buckets).join(F.broadcast(sought), key, "left_semi")

    def commit(self, *changes: Change, applied: tuple[str, int] | None = None) -> int:
        """Write the changes and switch to them; the version that holds them. applied: a
        source and the number of its batch."""
        before = self.snapshot()
        if applied and before["applied"].get(applied[0], -1) >= applied[1]:
            return before["version"]
        tables = before["tables"] | {c.table: self._written(before, c) for c in changes}
        done = before["applied"] | ({applied[0]: applied[1]} if applied else {})
        return self._switch({"version": before["version"] + 1, "buckets": before["buckets"], "applied": done, "tables": tables})

    def _written(self, before: dict, change: Change) -> dict:
        old, n = before["tables"].get(change.table), before["buckets"]
        key = old["key"] if old else change.key or self.key
        rows, live = change.rows, {}
        buckets_of = lambda df: {r[0] for r in df.select(self.bucket(F.col(key), n)).distinct().collect()}
        if old and change.append:
            rows, live = self._rows(old, None, set()).unionByName(rows), dict(old["live"])
        elif old and change.gone is not None:
            gone = change.gone.select(key).distinct()
            touched = buckets_of(gone) | buckets_of(rows)
            live = {b: folders for b, folders in old["live"].items() if int(b) not in touched}
            kept = self._rows(old, None, touched)
            rows = kept.join(gone, key, "left_anti").select(*kept.columns).unionByName(rows)
        folder = uuid.uuid4().hex
        # A bucket is a task's, but for one so large that it is split.
        dealt = rows.withColumn("bucket", self.bucket(F.col(key), n)).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        for b in (m[1] for m in (re.fullmatch(r"bucket=(\d+)", name) for name in self._names(f"data/{folder}")) if m):
            live[b] = [*live.get(b, []), folder]
        return {"schema": json.loads(rows.schema.json()), "key": key, "live": live}

    def _switch(self, snapshot: dict) -> int:
        final = self._path(f"{self.root}/snapshots/{snapshot['version']:012d}.json")
        draft = self._path(f"{self.root}/snapshots/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(snapshot).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {snapshot['version']} of {self.root} is already there")
        return snapshot["version"]

    def reset(self, *tables: str) -> int:
        """The tables without their rows; the others stay as they are."""
        now = self.snapshot()
        empty = {t: now["tables"][t] | {"live": {}} for t in tables if t in now["tables"]}
        return self._switch({**now, "version": now["version"] + 1, "tables": now["tables"] | empty})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forget all but the newest snapshots, and delete what those that stay don't name;
        not while another commit is being written. Gives the deleted folders' names."""
        known = self.versions()
        used = {f for v in known[-keep:] for t in self.snapshot(v)["tables"].values() for folders in t["live"].values() for f in folders}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/snapshots/{v:012d}.json"), False)
        gone = [f for f in self._names("data") if f not in used]
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/data/{f}"), True)
        return gone
