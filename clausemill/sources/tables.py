"""Stored tables that can be changed: copy-on-write by bucket of documents, one manifest per commit.

Rows lie in ``<root>/<table>/version=<v>/bucket=<b>``, the bucket from a hash of the document. A change writes the buckets
that it touches into a new version and then the manifest that names, for every table and bucket, the version to read.
The manifest is the commit: until it is there readers see the old rows, and from then on those of all tables
together. A change is named by its caller; one whose name is already committed is not done again, so it can be
retried whenever its outcome is unknown. There is one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import write_back

BUCKETS = 64
KEY = "doc_id"

#: A row per table and bucket; bucket -1 holds the table's schema and how many rows the commit changed in it.
MANIFEST = "name string, bucket int, version int, kind string, commit string, changed bigint"


@dataclass
class Snapshot:
    """What a manifest says: of every table its schema and the version of each bucket, and the commits so far."""

    version: int = 0
    kinds: dict[str, str] = field(default_factory=dict)
    buckets: dict[str, dict[int, int]] = field(default_factory=dict)
    commits: dict[str, dict[str, int]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.count = spark, root, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(KEY).cast("string")), F.lit(self.count)).cast("int")

    def snapshot(self) -> Snapshot:
        """The latest manifest: at most a row for each table and bucket and one for each commit and table."""
        try:
            rows = self.spark.read.schema(MANIFEST + ", at int").parquet(f"{self.root}/manifest")
        except AnalysisException:  # no such folder: nothing was ever committed
            return Snapshot()
        last = rows.agg(F.max("at")).first()[0]
        if last is None:
            return Snapshot()
        out = Snapshot(version=last)
        for r in rows.filter(F.col("at") == last).collect():
            if r["commit"] is not None:
                out.commits.setdefault(r["commit"], {})[r["name"]] = r["changed"]
            elif r["bucket"] < 0:
                out.kinds[r["name"]] = r["kind"]
                out.buckets.setdefault(r["name"], {})
            else:
                out.buckets.setdefault(r["name"], {})[r["bucket"]] = r["version"]
        return out

    def _commit(self, now: Snapshot) -> None:
        rows = [(name, -1, None, kind, None, None) for name, kind in now.kinds.items()]
        rows += [(name, b, v, None, None, None) for name, held in now.buckets.items() for b, v in held.items()]
        rows += [(name, None, None, None, commit, changed) for commit, tables in now.commits.items() for name, changed in tables.items()]
        frame = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.root}/manifest/at={now.version}")

    def _read(self, now: Snapshot, name: str, only: set[int] | None = None) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(now.kinds[name]))
        held = {b: v for b, v in now.buckets[name].items() if only is None or b in only}
        if not held:
            return self.spark.createDataFrame([], kind)
        folders = [f"{self.root}/{name}/version={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(kind).parquet(*folders)

    def read(self, name: str) -> DataFrame:
        """The committed rows of a table."""
        return self._read(self.snapshot(), name)

    def _write(self, now: Snapshot, name: str, rows: DataFrame, touched: set[int] | None) -> None:
        """Rows of the ``touched`` buckets (None: all) into the snapshot's version; buckets without rows are left out."""
        folder = f"{self.root}/{name}/version={now.version}"
        placed = rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", KEY)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        kept = {b: v for b, v in now.buckets.get(name, {}).items() if touched is not None and b not in touched}
        try:
            written = self.spark.read.parquet(folder).select("bucket").distinct().collect()  # at most a row per bucket
        except AnalysisException:  # no rows, no files to take a schema from
            written = []
        now.buckets[name] = kept | {r["bucket"]: now.version for r in written}

    def create(self, commit: str, **tables: DataFrame) -> None:
        """Lay down whole tables, each with a ``doc_id``; those of the same name are replaced."""
        now = self.snapshot()
        if commit in now.commits:
            return
        now.version += 1
        for name, rows in tables.items():
            now.kinds[name] = rows.schema.json()
            self._write(now, name, rows, None)
        now.commits[commit] = {name: 0 for name in tables}
        self._commit(now)

    def change(self, commit: str, keys: DataFrame, changes: dict[str, Callable[[DataFrame], DataFrame]], counts: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, int]:
        """Rewrite, in every table of ``changes``, the buckets that hold one of the ``keys`` (``doc_id``).

        ``changes`` maps a table's rows in those buckets to what they become, ``counts`` to the rows that change. Returns how many
        rows change in each table; a commit that is already there returns what it did.
        """
        now = self.snapshot()
        if commit in now.commits:
            return now.commits[commit]
        touched = {r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most a row per bucket
        old = {name: self._read(now, name, touched) for name in changes}
        changed = {name: counts[name](rows).count() for name, rows in old.items()}
        now.version += 1
        for name, rows in old.items():
            if changed[name]:
                self._write(now, name, changes[name](rows), touched)
        now.commits[commit] = changed
        self._commit(now)
        return changed

    def remove(self, commit: str, gone: DataFrame, *names: str) -> dict[str, int]:
        """Delete all rows of the documents ``gone`` (``doc_id``) from the tables, in one commit; the rows deleted from each."""
        gone = gone.select(KEY).distinct()
        names = names or tuple(self.snapshot().kinds)
        return self.change(
            commit, gone, {n: lambda rows: rows.join(gone, KEY, "left_anti") for n in names}, {n: lambda rows: rows.join(gone, KEY, "left_semi") for n in names}
        )

    def delete(self, commit: str, ids: DataFrame) -> dict[str, int]:
        """Delete the documents named by ``ids`` that are no samples, and what other tables hold of them."""
        wanted = ids.select(KEY).distinct()
        return self.remove(commit, self.read("documents").filter(~F.col("is_sample")).join(wanted, KEY, "left_semi"))

    def purge(self, commit: str, as_of: Column) -> dict[str, int]:
        """Delete expired documents that are no samples, and what other tables hold of them."""
        return self.remove(commit, self.read("documents").filter((F.col("expires_at") < as_of) & ~F.col("is_sample")))

    def write_back(self, commit: str, updates: DataFrame, columns: list[str]) -> int:
        """Overwrite ``columns`` of the documents that ``updates`` (one row a document) has a value for; how many it has a row for."""
        keys = updates.select(KEY)
        done = self.change(
            commit, keys, {"documents": lambda rows: write_back(rows, updates, columns)}, {"documents": lambda rows: rows.join(keys, KEY, "left_semi")}
        )
        return done["documents"]

    def add(self, commit: str, **tables: DataFrame) -> dict[str, int]:
        """Add rows of new documents to tables that are there, in one commit; the rows added to each.

        Rows of documents that a table already holds are not added, so that a load can be repeated.
        """
        now = self.snapshot()
        if commit in now.commits:
            return now.commits[commit]
        now.version += 1
        changed = {}
        for name, rows in tables.items():
            rows = rows.select(*self._read(now, name).columns)
            touched = {r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()}
            old = self._read(now, name, touched)
            fresh = rows.join(old.select(KEY).distinct(), KEY, "left_anti").select(*rows.columns)
            changed[name] = fresh.count()
            if changed[name]:
                self._write(now, name, old.unionByName(fresh), touched)
        now.commits[commit] = changed
        self._commit(now)
        return changed
