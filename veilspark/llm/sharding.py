"""Sharding by size-tiered compaction, with DataFrame writes and file-system renames only.

Arrivals are appended as small immutable Parquet files.  Compaction looks at sizes alone: files within one tier (a
factor of ``fanout`` in size) are merged, in runs up to the target size, once a tier holds ``fanout`` of them;
files near the target are left alone.  So a row is rewritten once per tier, log(target / arrival) times in all.
What is valid is said by a manifest, a text file with a version number that holds what the version added and removed: it is
written aside and renamed into place, which succeeds for one writer only.  Now and then a snapshot of all shards is put beside it.  A writer that comes second looks at the new manifest and tries again:
arrivals are added to whatever is there, a merge is committed while the shards that it replaces are still valid.
Readers hold on to the version that they opened, as long as ``vacuum`` retains it.

The store needs a file system on which a rename to an existing name fails, in one step with the rename itself: HDFS
and its like, or one machine's disk.  Object stores whose rename copies don't give that.
"""

from __future__ import annotations

import contextlib
import json
import random
import re
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MB = 1 << 20
#: Commits that one change tries while others come first, and seconds between them, at most.
ATTEMPTS, PAUSE = 100, 0.5
#: Versions from one snapshot to the next.
SNAPSHOT_EVERY = 32
#: Runs of a merging job, at most.
RUNS_AT_ONCE = 256
#: Lines of a table of files that is broadcast, at most (some 20 MB); larger ones are joined by shuffles.
BROADCAST_FILES = 100_000
#: What ``vacuum`` retains unless told otherwise: versions, and the age in seconds of any file that it removes.
VERSIONS, AGE = 10, 7 * 24 * 3600.0


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    level: int  # merges behind it


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A folder of shards with its manifests.  The driver holds a line per file, never rows."""

    def __init__(self, spark: SparkSession, root: str, *, target: int = 128 * MB, fanout: int = 4, least: int = MB):
        self.spark, self.root, self.target, self.fanout, self.least = spark, root.rstrip("/"), target, fanout, least
        self.java = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.java.Path(self.root).getFileSystem(self.conf)
        # Merges are written by a session of their own: a union of single partitions is to keep them apart, not to become one.
        self.merging = spark.newSession()
        self.merging.conf.set("spark.sql.unionOutputPartitioning", "false")

    # Manifests

    def versions(self) -> list[int]:
        place = self.java.Path(f"{self.root}/manifest")
        if not self.files.exists(place):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(place)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and shards of a version, the latest by default; a version that was never there, or that vacuum
        expired, is a ValueError.  Versions are followed back to the last snapshot."""
        for again in (True, False):
            known = self.versions()
            if version is None and not known:
                return {"version": 0, "shards": []}
            wanted = known[-1] if version is None else version
            if wanted not in known:
                raise ValueError(f"version {wanted} isn't there; there are {known[:1]} to {known[-1:]}")
            try:
                return self._whole(wanted)
            except FileNotFoundError:  # vacuum has put a later snapshot in place of what was to be read
                if not again:
                    raise
        raise AssertionError

    def _whole(self, version: int) -> dict:
        changes, at = [], version
        while at and (base := self._text(self._snapshot_path(at))) is None:
            own = self._text(self._manifest_path(at))
            if own is None:
                raise FileNotFoundError(f"manifest of version {at}")
            if "shards" in own:
                base = own
                break
            changes.append(own)
            at -= 1
        shards = {x["path"]: x for x in (base["shards"] if at else ())}
        for own in reversed(changes):
            for path in own["removed"]:
                shards.pop(path, None)
            shards |= {x["path"]: x for x in own["added"]}
        return {"version": version, "schema": (changes[0] if changes else base)["schema"], "shards": list(shards.values())}

    def _text(self, place) -> dict | None:
        if not self.files.exists(place):
            return None
        stream = self.files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _manifest_path(self, version: int):
        return self.java.Path(f"{self.root}/manifest/v{version:09d}.json")

    def _snapshot_path(self, version: int):
        return self.java.Path(f"{self.root}/manifest/s{version:09d}.json")

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self.manifest(version)["shards"]]

    def commit(self, shards: list[Shard], version: int, schema: T.StructType | None, now: dict | None = None) -> int:
        """Make these the shards of a version, given the manifest of the one before; a ConflictError if the version is there."""
        old, new = {x["path"] for x in (now or {"shards": []})["shards"]}, {s.path for s in shards}
        text = {"version": version, "schema": schema and schema.jsonValue(), "added": [s.__dict__ for s in shards if s.path not in old], "removed": sorted(old - new)}
        self._put(text, self._manifest_path(version))
        if version % SNAPSHOT_EVERY == 0:
            self._snapshot(version)
        return version

    def _put(self, text: dict, place) -> None:
        """Write aside and rename into place."""
        aside = self.java.Path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self.files.create(aside, False)
        try:
            out.write(bytearray(json.dumps(text).encode()))
        finally:
            out.close()
        options = self.spark._sc._gateway.new_array(getattr(self.java, "Options$Rename"), 0)
        try:
            self.java.FileContext.getFileContext(self.java.Path(self.root).toUri(), self.conf).rename(aside, place, options)
        except Exception as e:
            self.files.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"{place.getName()} exists") from e
            raise

    def _snapshot(self, version: int) -> None:
        """All shards of a version in one file; whoever is first writes what all others would."""
        if not self.files.exists(self._snapshot_path(version)):
            with contextlib.suppress(ConflictError):
                self._put(self._whole(version), self._snapshot_path(version))

    def _changed(self, change: Callable[[dict], tuple[list[Shard], T.StructType | None] | None]) -> int | None:
        """Commit what ``change`` makes of the latest manifest; again on the next one when another writer was first.
        Nothing is committed where it makes None."""
        for attempt in range(ATTEMPTS):
            now = self.manifest()
            made = change(now)
            if made is None:
                return None
            try:
                return self.commit(made[0], now["version"] + 1, made[1], now)
            except ConflictError:
                time.sleep(random.random() * PAUSE * min(1.0, attempt / 10))
        raise ConflictError(f"other writers were first {ATTEMPTS} times")

    # Data

    def _write(self, df: DataFrame, rows_per_file: int = 0) -> list[tuple[str, int]]:
        """Paths and sizes of the files that df becomes; partitions in order."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(folder)
        found = [(s.getPath().toString(), s.getLen()) for s in self.files.listStatus(self.java.Path(folder))]
        return [(p, n) for p, n in sorted(found) if p.endswith(".parquet")]

    def _remove(self, paths: list[str]) -> None:
        for p in paths:
            self.files.delete(self.java.Path(p), False)

    def append(self, df: DataFrame, *, rows_per_file: int = 0) -> int:
        """Add rows as small shards, as many as df has partitions (more with rows_per_file), without a shuffle.
        Further columns widen the store's schema; a known column of another type is refused."""
        self.widened(df.schema)
        new = [Shard(p, n, 0) for p, n in self._write(df, rows_per_file)]
        try:
            return self._changed(lambda now: ([Shard(**x) for x in now["shards"]] + new, self.widened(df.schema, now)))
        except Exception:
            self._remove([s.path for s in new])
            raise

    def widened(self, other: T.StructType, manifest: dict | None = None) -> T.StructType:
        """The store's schema with the further columns of another."""
        fields = {f.name.lower(): f for f in self._schema_of(manifest or self.manifest()) or ()}
        for f in other:
            had = fields.setdefault(f.name.lower(), f)
            if had.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"{f.name} is {had.dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])

    def tier(self, size: int) -> int:
        tier, limit = 0, self.least
        while size >= limit:
            tier, limit = tier + 1, limit * self.fanout
        return tier

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similarly sized shards to merge, up to the target size each."""
        tiers: dict[int, list[Shard]] = defaultdict(list)
        for s in shards:
            if s.bytes * 2 <= self.target:
                tiers[self.tier(s.bytes)].append(s)
        runs = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fanout:
                continue
            run: list[Shard] = []
            for s in sorted(own, key=lambda s: (s.bytes, s.path)):
                if run and sum(x.bytes for x in run) + s.bytes > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> int | None:
        """Merge until no tier is full; returns the last version committed, None if nothing was to do.

        A run is read by one task and becomes one file, so no row is shuffled.  A job has RUNS_AT_ONCE runs at most: its plan
        stays as small however many there are.  A run whose shards another writer replaced meanwhile is dropped, with its file."""
        version = None
        while True:
            now = self.manifest()
            runs = self.plan([Shard(**x) for x in now["shards"]])
            if not runs:
                return version
            schema, made = self._schema_of(now), {}
            for at in range(0, len(runs), RUNS_AT_ONCE):
                merged = None
                for run in runs[at : at + RUNS_AT_ONCE]:
                    one = self.merging.read.schema(schema).parquet(*[s.path for s in run]).coalesce(1)
                    merged = one if merged is None else merged.unionByName(one)
                # the number of a file is that of its task, and so of its run; an empty run leaves no file
                made |= {at + int(re.search(r"/part-(\d+)-", p)[1]): (p, n) for p, n in self._write(merged)}
            lost: list[str] = []

            def replaced(now: dict) -> tuple[list[Shard], T.StructType | None] | None:
                valid = {x["path"] for x in now["shards"]}
                done = [k for k, run in enumerate(runs) if all(s.path in valid for s in run)]
                lost[:] = [p for k, (p, _) in made.items() if k not in done]
                gone = {s.path for k in done for s in runs[k]}
                new = [Shard(*made[k], 1 + max(s.level for s in runs[k])) for k in done if k in made]
                return ([Shard(**x) for x in now["shards"] if x["path"] not in gone] + new, self._schema_of(now)) if done else None

            try:
                version = self._changed(replaced) or version
            except Exception:
                lost = [p for p, _ in made.values()]
                raise
            finally:
                self._remove(lost)

    def schema(self, version: int | None = None) -> T.StructType | None:
        """Of all arrivals up to a version; manifests of old stores don't name it, there the shards are asked."""
        return self._schema_of(self.manifest(version))

    def _schema_of(self, manifest: dict) -> T.StructType | None:
        if manifest.get("schema"):
            return T.StructType.fromJson(manifest["schema"])
        paths = [s["path"] for s in manifest["shards"]]
        return self.spark.read.option("mergeSchema", True).parquet(*paths).schema if paths else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the columns of all arrivals up to it; null where an arrival had none."""
        shards = self.shards(version)
        if not shards:
            raise ValueError("nothing was appended")
        return self.spark.read.schema(self.schema(version)).parquet(*[s.path for s in shards])

    def vacuum(self, *, versions: int = VERSIONS, age: float = AGE) -> int:
        """Expire all but the latest ``versions`` versions, if they were replaced ``age`` seconds ago or more, and
        remove data files of that age that no remaining version names; returns how many.

        So a reader has ``age`` seconds for a version that it opened, and a writer as long from its first file to its
        commit; with an age of 0 there must be no other reader or writer.  Ages are by the store's times and this
        machine's clock."""
        limit = (time.time() - age) * 1000
        known = self.versions()
        # a version was replaced when the next one was written
        old = [v for v, following in zip(known, known[1:]) if v in known[: -max(1, versions)] and self.files.getFileStatus(self._manifest_path(following)).getModificationTime() <= limit]
        if old:
            self._snapshot(min(v for v in known if v not in old))  # what remains is read without what goes
        for v in old:
            self.files.delete(self._manifest_path(v), False)
            self.files.delete(self._snapshot_path(v), False)
        valid = {x["path"] for v in self.versions() for x in self.manifest(v)["shards"]}
        gone, base = 0, self.java.Path(f"{self.root}/data")
        for folder in self.files.listStatus(base) if self.files.exists(base) else ():
            for f in self.files.listStatus(folder.getPath()):
                if f.getPath().toString() not in valid and f.getPath().getName().endswith(".parquet") and f.getModificationTime() <= limit:
                    gone += bool(self.files.delete(f.getPath(), False))
        return gone


#: The columns that shard_of_rows adds.
OF_SHARD = ("shard", "shard_bytes", "level", "version")


def shard_of_rows(store: ShardStore, *columns: str) -> DataFrame:
    """The given columns of each row with the shard that holds it: shard, shard_bytes, level, version.  Columns of
    rows with one of these names are left out.  Rows with nulls, repeated rows and empty texts each have theirs."""
    version = store.versions()[-1]
    files = [(s.path.rsplit("/", 1)[1], s.bytes, s.level) for s in store.shards(version)]
    table = store.spark.createDataFrame(files, "shard string, shard_bytes long, level int")
    rows = store.read(version)
    place = rows.metadataColumn("_metadata")["file_name"].alias("shard")
    rows = rows.select(*[F.col(f"`{c}`") for c in columns if c.lower() not in OF_SHARD], place)
    table = F.broadcast(table) if len(files) <= BROADCAST_FILES else table
    return rows.join(table, "shard", "left").withColumn("version", F.lit(version))
