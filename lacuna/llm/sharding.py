"""Shards under size-tiered compaction, with versioned manifests.

`append` writes arrivals as immutable shards, one for each task, and commits a manifest that lists them beside the
shards of the version before. `compact` puts live shards into tiers by size, each tier `fanout` times as large as the
one below; a tier that holds `fanout` shards or more is merged into files of about `target_bytes`. Merging reads the
shards of the tier and hands whole ones to as few tasks as files are wanted: no shuffle, no key, so a source that
holds a third of all rows is as good as any other. Shards of the target size are left alone.

Each write goes to a folder of its own name, which no other writer knows, and never replaces anything. A commit writes
what came and went since the version before, and every `full_every` versions all that is live, under a draft name, and
then claims the version: by a rename that fails where the version exists, or by a hard link on a local file system, where
only that is exclusive. Readers see the version before or the new one; of two writers one gets an error, has committed
nothing and has harmed nothing. `vacuum` removes files that none of the last `retain` versions lists and that are older
than `least_age` seconds, so writers in flight and readers of those versions keep theirs; a job that died leaves such
files and nothing else. Listing, renaming and removal go through the file system that Spark uses for the folder.

A manifest holds one schema for all its shards. An append may bring further columns, leave some out, or have wider or narrower
numbers: columns meet by name, whatever its case, a column that a shard lacks is null there, and numbers are read in the widest type so far. An
append whose types don't widen into one another is refused and changes nothing.

Cases: an empty table is appended as no rows and yields no assignment, with the columns and types that others have;
nulls, repeated rows, long texts and extra columns are stored as they are. Shards of one size are taken by name.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


RESULT = ("shard", "shard_bytes", "version")


@dataclass(frozen=True)
class Settings:
    target_bytes: int = 128 << 20
    least_bytes: int = 1 << 20
    fanout: int = 4
    full_every: int = 16
    retain: int = 3
    least_age: float = 86_400.0


#: Types that a reader takes for one another, each narrower than those behind it.
WIDENING = (("byte", "short", "integer", "long"), ("float", "double"), ("byte", "short", "integer", "double"))


def widest(held: T.DataType, new: T.DataType, column: str) -> T.DataType:
    if held == new:
        return held
    for chain in WIDENING:
        if {held.typeName(), new.typeName()} <= set(chain):
            return max(held, new, key=lambda x: chain.index(x.typeName()))
    raise ValueError(f"column {column}: {new.simpleString()} is appended to {held.simpleString()}")


def merged(held: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both, by name, held ones first; all may be null."""
    fields = {f.name.lower(): T.StructField(f.name, f.dataType, True) for f in (held or [])}
    for f in new:
        known = fields.get(f.name.lower())
        fields[f.name.lower()] = T.StructField(known.name, widest(known.dataType, f.dataType, f.name), True) if known else T.StructField(f.name, f.dataType, True)
    return T.StructType(list(fields.values()))


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class Store:
    """A folder of shards: data/run-n/part files and manifests/n.json."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings()) -> None:
        self.spark, self.folder, self.settings = spark, folder, settings
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.sc().hadoopConfiguration())

    def _list(self, folder: str) -> list[tuple[str, int, bool]]:
        path = self._path(f"{self.folder}/{folder}")
        if not self._fs.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in self._fs.listStatus(path))

    def version(self) -> int:
        return max((int(name[:-5]) for name, _, _ in self._list("manifests") if name.endswith(".json") and name[0] not in "._"), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self, version: int | None = None) -> tuple[dict[str, Shard], str | None]:
        """The live shards of a version by path, and the schema of what was appended."""
        version, steps = self.version() if version is None else version, []
        if not version:
            return {}, None
        while not steps or not steps[-1]["full"]:
            steps.append(self._manifest(version))
            version -= 1
        live: dict[str, Shard] = {}
        for step in reversed(steps):
            for path in step["removed"]:
                live.pop(path, None)
            live |= {x["path"]: Shard(**x) for x in step["added"]}
        return live, steps[0]["schema"]

    def shards(self, version: int | None = None) -> list[Shard]:
        return [x for _, x in sorted(self._state(version)[0].items())]

    def _claim(self, draft: str, final: str) -> bool:
        """Give a finished file its name, unless the name is taken."""
        old, new = self._path(draft), self._path(final)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        try:
            if self._fs.getScheme() == "file":  # its rename replaces silently, a hard link never does
                paths = [jvm.java.nio.file.Paths.get(x.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0)) for x in (new, old)]
                jvm.java.nio.file.Files.createLink(*paths)
            else:
                whole = self._fs.makeQualified(old)
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark._jsc.sc().hadoopConfiguration())
                context.rename(whole, self._fs.makeQualified(new), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(old, False)
        return True

    def _commit(self, before: int, added: list[Shard], removed: list[Shard], schema: str | None = None) -> int:
        new = before + 1
        live, known = self._state(before)
        gone = {x.path for x in removed}
        full = new % self.settings.full_every == 1 or not before
        if full:
            added, gone = [x for p, x in live.items() if p not in gone] + added, set()
        body = json.dumps({"version": new, "full": full, "schema": schema or known, "removed": sorted(gone), "added": [asdict(x) for x in sorted(added, key=lambda x: x.path)]})
        draft = f"{self.folder}/manifests/.{new:08d}-{uuid.uuid4().hex}.draft"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(body, "utf-8"))
        out.close()
        if not self._claim(draft, f"{self.folder}/manifests/{new:08d}.json"):
            raise RuntimeError(f"version {new} was committed by another writer; begin anew from it")
        return new

    def _write(self, frame: DataFrame) -> list[Shard]:
        name = f"data/run-{uuid.uuid4().hex}"
        frame.write.mode("errorifexists").parquet(f"{self.folder}/{name}")
        return [Shard(f"{name}/{file}", size) for file, size, is_folder in self._list(name) if not is_folder and file[0] not in "._"]

    def schema(self, version: int | None = None) -> T.StructType | None:
        """The columns of a version's shards; None before the first."""
        known = self._state(version)[1]
        return T.StructType.fromJson(json.loads(known)) if known else None

    def append(self, documents: DataFrame) -> int:
        before = self.version()
        schema = merged(self.schema(before) if before else None, documents.schema)
        return self._commit(before, self._write(documents), [], schema.json())

    def tier(self, shard: Shard) -> int:
        """0 for the smallest, None-like -1 for those that have the target size."""
        if 2 * shard.bytes > self.settings.target_bytes:
            return -1
        at, limit = 0, self.settings.least_bytes
        while shard.bytes > limit:
            at, limit = at + 1, limit * self.settings.fanout
        return at

    def compact(self) -> int:
        """Merge tiers until none has `fanout` shards; each round of merges is one commit."""
        while True:
            before = self.version()
            tiers: dict[int, list[Shard]] = {}
            for shard in self.shards(before):
                tiers.setdefault(self.tier(shard), []).append(shard)
            full = {t: x for t, x in tiers.items() if t >= 0 and len(x) >= self.settings.fanout}
            if not full:
                return before
            added, removed = [], []
            for _, own in sorted(full.items()):
                files = max(1, round(sum(x.bytes for x in own) / self.settings.target_bytes))
                added += self._write(self.read(own).coalesce(files))
                removed += own
            self._commit(before, added, removed)

    def read(self, shards: list[Shard] | None = None) -> DataFrame:
        """Rows of live shards, or of those given, in the columns of the last version."""
        own = self.shards() if shards is None else shards
        return self.spark.read.schema(self.schema()).parquet(*[f"{self.folder}/{x.path}" for x in own])

    def settled(self) -> bool:
        """Whether no tier holds as many shards as are merged."""
        tiers = Counter(self.tier(x) for x in self.shards())
        return all(n < self.settings.fanout for t, n in tiers.items() if t >= 0)

    def vacuum(self) -> int:
        """Remove what no retained version lists and no writer in flight can have written; how many files went."""
        last, gone = self.version(), 0
        live = {p for v in range(max(1, last - self.settings.retain + 1), last + 1) for p in self._state(v)[0]}
        oldest = (time.time() - self.settings.least_age) * 1000
        for run, _, is_folder in self._list("data"):
            for s in self._fs.listStatus(self._path(f"{self.folder}/data/{run}")) if is_folder else []:
                name = s.getPath().getName()
                if name[0] not in "._" and f"data/{run}/{name}" not in live and s.getModificationTime() <= oldest:
                    gone += bool(self._fs.delete(s.getPath(), False))
        return gone

    def stored(self, version: int | None = None) -> DataFrame:
        """The documents of a version with `shard`, `shard_bytes` and `version`, replacing columns of those names."""
        version = self.version() if version is None else version
        live, schema = self._state(version)
        if not live:
            frame = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(schema)) if schema else "doc_id bigint")
            return frame.drop(*RESULT).selectExpr("*", "string(null) as shard", "bigint(null) as shard_bytes", f"{version} as version")
        frame = self.read(list(live.values()))
        kept = [F.col(f"`{c}`") for c in frame.columns if c.lower() not in RESULT]
        folder, file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.regexp_extract("_metadata.file_name", r"^(part-\d+)", 1)
        return frame.select(*kept, F.concat_ws("/", folder, file).alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(version).alias("version"))

    def assignment(self) -> DataFrame:
        """(doc_id, shard, shard_bytes, version) of every document in the last version."""
        return self.stored().select("doc_id", *RESULT)


def shard(documents: DataFrame, folder: str, settings: Settings = Settings(), arrivals: int = 1, key: str = "doc_id") -> Store:
    """Append documents to the store of a folder, in as many arrivals by hash of their key, and compact it."""
    store = Store(documents.sparkSession, folder, settings)
    for a in range(arrivals):
        store.append(documents.where(F.pmod(F.xxhash64(key), F.lit(arrivals)) == a) if arrivals > 1 else documents)
    store.compact()
    store.vacuum()
    return store
