"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

Arrivals are appended as runs of small files. Runs whose sizes are alike are
merged, once enough of them have gathered, into one run of target-sized files.
Neither step changes a file: it writes new ones and then commits a manifest, a
small JSON document that lists the live runs, under a name that must not be
there yet. Readers see the old version or the new one. On HDFS the commit is a
rename that refuses to overwrite, on a local disk a hard link; both are atomic.
On object stores that rename is a check and a copy, so writers must take turns.

Merging concatenates whole files (a scan and ``coalesce``), so no row is
shuffled. Only metadata, one entry a run, is held by the driver.

Defined results: appending an empty table commits a version without new runs;
reading an empty store gives an empty table of the first schema. Nulls, equal
rows, long texts and columns of any name are kept as they are; what ``read``
appends gets a longer name where a column already has it. The arrival key may
be null (a run of its own). A task lost in the middle is retried by Spark's
committer and leaves no trace, and a lost driver leaves only files that no
manifest names, which ``vacuum`` removes once they are old enough not to be
those of an append that is still running.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Run:
    """Some immutable files that were written together."""

    run_id: int
    path: str
    rows: int
    bytes: int
    files: int
    merged: int = 0


class ShardStore:
    def __init__(
        self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, alike: float = 2.0, widest: int = 64
    ):
        """alike: largest over smallest size of runs that merge; widest: runs that one merge takes at most."""
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.alike, self.widest = target_bytes, fanout, alike, widest
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- files, through Hadoop's file systems --
    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self) -> object:
        return self._path(self.root).getFileSystem(self._conf)

    def _list(self, path: str) -> list[object]:
        p = self._path(path)
        return list(self._fs().listStatus(p)) if self._fs().exists(p) else []

    def _files(self, path: str) -> tuple[int, int]:
        """Bytes and number of data files in a folder."""
        found = [s.getLen() for s in self._list(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        return sum(found), len(found)

    # -- manifests --
    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        names = [s.getPath().getName() for s in self._list(f"{self.root}/manifests")]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "runs": [], "schema": None, "next_run": 1}
        path = self._path(f"{self.root}/manifests/v{version:012d}.json")
        read = self._jvm.org.apache.commons.io.IOUtils.toString
        stream = self._fs().open(path)
        try:
            found = json.loads(read(stream, "UTF-8"))
        finally:
            stream.close()
        return found | {"runs": [Run(**r) for r in found["runs"]]}

    def _commit(self, base: int, runs: list[Run], schema: str, next_run: int) -> int:
        """Publish version base + 1; raises if another writer was there first."""
        body = {"version": base + 1, "runs": [asdict(r) for r in runs], "schema": schema, "next_run": next_run}
        part = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs().create(part, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        final = self._path(f"{self.root}/manifests/v{base + 1:012d}.json")
        if self._fs().getUri().getScheme() == "file":
            place = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(place(final), place(part))
            self._fs().delete(part, False)
            return base + 1
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(context.makeQualified(part), context.makeQualified(final), none)
        return base + 1

    # -- operations --
    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Write df as one run for each value of arrival (one run without it) in one job; commit; return the version."""
        now = self.manifest()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        name = "arrival"
        while name in {c.lower() for c in df.columns}:
            name += "_"
        key = F.lit(0) if arrival is None else arrival
        df.withColumn(name, key).write.partitionBy(name).parquet(folder)
        parts = sorted(s.getPath().toString() for s in self._list(folder) if s.isDirectory())
        rows: dict[str, int] = {}
        if parts:
            written = self.spark.read.schema(df.schema).parquet(*parts)
            counted = written.groupBy(F.regexp_extract(written.metadataColumn("_metadata")["file_path"], f"({name}=[^/]*)/[^/]*$", 1).alias("at")).count()
            rows = {r["at"]: r["count"] for r in counted.collect()}  # a row a run
        next_run = now["next_run"]
        runs = list(now["runs"])
        for at in parts:
            size, files = self._files(at)
            runs.append(Run(next_run, at, rows.get(at.rsplit("/", 1)[1], 0), size, files))
            next_run += 1
        return self._commit(now["version"], runs, now["schema"] or df.schema.json(), next_run)

    def due(self, runs: list[Run]) -> list[Run]:
        """The smallest tier of fanout or more runs of like sizes; empty when none has gathered."""
        order = sorted(runs, key=lambda r: (r.bytes, r.run_id))
        at = 0
        while at < len(order):
            tier = [r for r in order[at:] if r.bytes <= self.alike * max(order[at].bytes, 1)][: self.widest]
            if len(tier) >= self.fanout:
                return tier
            at += 1
        return []

    def compact(self) -> int:
        """Merge due tiers until none is left; each merge is a commit of its own. Returns the newest version."""
        while True:
            now = self.manifest()
            tier = self.due(now["runs"])
            if not tier:
                return now["version"]
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            files = max(1, math.ceil(sum(r.bytes for r in tier) / self.target_bytes))
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            self.spark.read.schema(schema).parquet(*[r.path for r in tier]).coalesce(files).write.parquet(folder)
            size, n = self._files(folder)
            merged = Run(now["next_run"], folder, sum(r.rows for r in tier), size, n, max(r.merged for r in tier) + 1)
            gone = {r.run_id for r in tier}
            self._commit(
                now["version"], [r for r in now["runs"] if r.run_id not in gone] + [merged], now["schema"], now["next_run"] + 1
            )

    def vacuum(self, versions: int = 2, age: float = 24 * 3600) -> int:
        """Remove what only versions before the newest ``versions`` name, and unnamed data last written more than ``age`` seconds ago.

        Returns the number of folders removed. Readers of the versions that stay go on undisturbed.
        """
        newest = self.version()
        first = max(1, newest - versions + 1)
        names = {s.getPath().getName(): s for s in self._list(f"{self.root}/manifests")}
        kept = [n for n in range(first, newest + 1) if f"v{n:012d}.json" in names]
        plain = lambda p: self._path(p).toUri().getPath()
        live = {plain(r.path) for n in kept for r in self.manifest(n)["runs"]}
        old = [n for n in range(1, first) if f"v{n:012d}.json" in names]
        named = {plain(r.path) for n in old for r in self.manifest(n)["runs"]}
        before = (time.time() - age) * 1000
        removed = 0
        for top in self._list(f"{self.root}/data"):
            inner = [s for s in self._list(top.getPath().toString()) if s.isDirectory() and not s.getPath().getName().startswith("_")]
            gone = []
            for s in inner or [top]:
                at = s.getPath().toUri().getPath()
                if at not in live and (at in named or max(s.getModificationTime(), top.getModificationTime()) < before):
                    gone.append(s)
            for s in [top] if len(gone) == len(inner) and gone else gone:
                self._fs().delete(s.getPath(), True)
            removed += len(gone)
        for n in old:
            self._fs().delete(names[f"v{n:012d}.json"].getPath(), False)
        return removed

    def located(self, version: int | None = None) -> DataFrame:
        """(row, run_id, shard): the rows of a version as structs, each with its run, and its shard (run and file number)."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing was ever appended")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        if not now["runs"]:
            return self.spark.createDataFrame([], T.StructType().add("row", schema).add("run_id", T.LongType()).add("shard", T.StringType()))
        rows = self.spark.read.schema(schema).parquet(*[r.path for r in now["runs"]])
        at = rows.metadataColumn("_metadata")["file_path"]
        held = rows.select(
            F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row"),
            F.regexp_extract(at, "([^/]+(?:/[^/=]+=[^/]*)?)/[^/]*$", 1).alias("folder"),
            F.regexp_extract(at, "part-([0-9]+)", 1).alias("part"),
        )
        names = {"/".join(r.path.split("/")[-2:]) if "=" in r.path.rsplit("/", 1)[1] else r.path.rsplit("/", 1)[1]: r.run_id for r in now["runs"]}
        table = self.spark.createDataFrame(list(names.items()), "folder string, run_id bigint")  # a row a run
        shard = F.concat_ws("/", F.format_string("run-%06d", "run_id"), "part")
        return held.join(F.broadcast(table), "folder").select("row", "run_id", shard.alias("shard"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with run_id and shard appended (and underscores to these names while a column has them)."""
        rows = self.located(version)
        taken = {c.lower() for c in rows.schema["row"].dataType.names}
        names = []
        for name in ("run_id", "shard"):
            while name in taken:
                name += "_"
            names.append(name)
        return rows.select("row.*", F.col("run_id").alias(names[0]), F.col("shard").alias(names[1]))


def shard_documents(docs: DataFrame, store: ShardStore, arrivals: int = 16) -> DataFrame:
    """Append docs in so many arrivals, compact, and read the committed version: one row a document.

    doc_id, version, run_id, merged (rewrites of its run), shard, n_bytes, text_md5.
    """
    spread = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(arrivals))
    store.append(docs, spread)
    version = store.compact()
    now = store.manifest(version)
    merged = F.create_map(*[F.lit(x) for r in now["runs"] for x in (r.run_id, r.merged)]) if now["runs"] else None
    return store.located(version).select(
        "row.doc_id",
        F.lit(version).cast("bigint").alias("version"),
        "run_id",
        (merged[F.col("run_id")] if merged is not None else F.lit(None)).cast("int").alias("merged"),
        "shard",
        F.octet_length("row.text").cast("bigint").alias("n_bytes"),
        F.md5(F.col("row.text").cast("binary")).alias("text_md5"),
    )
