"""Processing only new or changed records, with the target table as the state.

Every output row carries its source key, the version of the source it was made from and the
run that made it. What a run still has to do is the source anti-joined against the latest
version of each key in the target; there is no separate bookkeeping that could disagree with
the data. A run's rows are written to a folder of their own and become visible when the next
manifest is put into place, so a run that dies before that leaves no trace and its records
stay pending, and a run that is repeated after it finds nothing left to do.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import materialize, materialize_parts
from .manifests import Manifests

RUN, SEQ = "_run", "_seq"


class VersionedTarget:
    """A Parquet table of (keys, version, extra columns, _run, _seq) to which runs are added.

    A run is known by its source and its number: (query id, epoch) of a stream, ('batch', run id) else. The manifest
    keeps every run that was ever published, also after compact(), so none is published twice. The latest
    version of a key is that of the run published last (_seq, the number of its manifest), whatever the runs are called.

    Nulls: a source row with a null version is unreadable and never pending; key columns compare
    null-safe. Repeated rows: latest_sighting() reduces them first. An empty or missing target
    makes everything pending. Extra source columns pass through pending() unchanged.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], version: str):
        self.spark, self.root, self.keys, self.version = spark, root.rstrip("/"), keys, version
        self.names = [f.name for f in schema.fields]
        self.schema = T.StructType([*schema.fields, T.StructField(RUN, T.LongType(), True), T.StructField(SEQ, T.LongType(), True)])
        self._manifests = Manifests(spark, f"{self.root}/_manifests")

    def manifest(self) -> dict:
        """The last published version. runs: [source, number, seq, folder] in the order of publishing; base: [seq, folder] of the
        last compacted state."""
        return self._manifests.last() or {"version": 0, "runs": [], "base": None}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{f}" for f in folders))

    # -- state -----------------------------------------------------------------------------

    def rows(self, runs: list[int] | None = None, source: str = "batch") -> DataFrame:
        """All published rows, or those of some runs of a source: what they published, also after compact()."""
        found = [r for r in self.manifest()["runs"] if runs is None or (r[0] == source and r[1] in runs)]
        if lost := [r[1] for r in found if r[3] is None]:
            raise ValueError(f"the rows of the runs {lost} were dropped by forget()")
        return self._read([r[3] for r in found])

    def state(self) -> DataFrame:
        """The latest published version of each key: the compacted state and the runs since."""
        m = self.manifest()
        seq, base = m["base"] or (0, None)
        rows = self._read([*([base] if base else []), *(r[3] for r in m["runs"] if r[2] > seq)])
        return rows.groupBy(*self.keys).agg(F.max_by(self.version, SEQ).alias(self.version)) if self.version not in self.keys else rows.select(*self.keys).distinct()

    def pending(self, source: DataFrame) -> DataFrame:
        """The source rows whose (key, version) is not what the target holds last."""
        return self._without(source.where(F.col(self.version).isNotNull()), self.state())

    def _without(self, source: DataFrame, held: DataFrame) -> DataFrame:
        columns = list(dict.fromkeys([*self.keys, self.version]))
        old = held.select([F.col(c).alias(f"__held_{c}") for c in columns])
        same = F.lit(True)
        for c in columns:
            same = same & source[c].eqNullSafe(old[f"__held_{c}"])
        return source.join(old, same, "left_anti")

    # -- runs ------------------------------------------------------------------------------

    def publish(self, run: int, rows: DataFrame, source: str = "batch") -> None:
        """Write the rows of a run and make them visible in one step. A run that is already published is
        left as it is if it brings nothing else; records it didn't publish are an error, not lost."""
        m = self.manifest()
        known = next((r for r in m["runs"] if r[:2] == [source, run]), None)
        if known is not None:
            held = self.state() if known[3] is None else self._read([known[3]])
            if not self._without(rows, held).isEmpty():
                raise ValueError(f"run {run} of {source} was published with other records; give these a run of their own")
            return
        seq = m["version"] + 1
        folder = f"data/run={run}-{uuid.uuid4().hex}"
        rows.select(*self.names, F.lit(run).cast("long").alias(RUN), F.lit(seq).cast("long").alias(SEQ)).write.parquet(f"{self.root}/{folder}")
        self._manifests.put(seq, {**m, "version": seq, "runs": [*m["runs"], [source, run, seq, folder]]})

    def compact(self) -> None:
        """Publish the latest state as one folder, so that state() stays as cheap as the number of keys. The runs
        and their rows stay."""
        m = self.manifest()
        seq, base = m["base"] or (0, None)
        rows = self._read([*([base] if base else []), *(r[3] for r in m["runs"] if r[2] > seq)])
        folder = f"data/state-{uuid.uuid4().hex}"
        rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), SEQ).alias("r")).select("r.*").write.parquet(f"{self.root}/{folder}")
        self._manifests.put(m["version"] + 1, {**m, "version": m["version"] + 1, "base": [m["version"], folder]})

    def forget(self) -> None:
        """Delete the folders of the runs that compact() has merged. The runs stay known; their rows can't be asked for any more."""
        m = self.manifest()
        done = [r for r in m["runs"] if m["base"] and r[2] <= m["base"][0] and r[3] is not None]
        runs = [[*r[:3], None] if r in done else r for r in m["runs"]]
        self._manifests.put(m["version"] + 1, {**m, "version": m["version"] + 1, "runs": runs})
        for r in done:
            self._manifests.remove(f"{self.root}/{r[3]}")


def latest_sighting(scans: DataFrame, keys: list[str], version: str, order: list[str]) -> DataFrame:
    """One row per key: the version with the greatest order columns. Null versions are ignored.
    It aggregates before the shuffle, so a key with very many sightings is no hot group."""
    return scans.where(F.col(version).isNotNull()).groupBy(*keys).agg(F.max_by(version, F.struct(*order)).alias(version))


def replay_runs(target: VersionedTarget, scans: DataFrame, runs: list[tuple[int, str]], run_col: str, order: list[str], compact_every: int = 4) -> DataFrame:
    """What each run had to process: runs (in order, with their status) see the rows of scans
    under their id, a run with status 'ok' publishes what it processed, any other run does not
    and leaves its records pending. Returns keys, version and run_col. The scans are read once; a run
    reads its own part of them, and the target is compacted every few runs."""
    wanted = sorted(runs)
    first = scans.where(F.col(run_col).isin([r for r, _ in wanted]))
    parts = materialize_parts(latest_sighting(first, [run_col, *target.keys], target.version, order), "sightings", run_col)
    found, published = [], 0
    for run, status in wanted:
        pending = target.pending(parts.where(F.col(run_col) == run).drop(run_col))
        if status == "ok":
            target.publish(run, pending)
            pending = target.rows([run]).drop(RUN, SEQ)
            published += 1
            if published % compact_every == 0:
                target.compact()
        found.append(pending.withColumn(run_col, F.lit(run)))
    none = parts.where(F.lit(False)).select(*target.keys, target.version, F.lit(0).alias(run_col))  # the result where there is no run
    return reduce(DataFrame.unionByName, found, none)


def salted_lookup(big: DataFrame, small: DataFrame, key: str, spread: F.Column, salts: int = 16) -> DataFrame:
    """Inner join of a table with a hot key to a table in which the key is (nearly) unique: the
    rows of the hot key are spread over `salts` tasks by `spread`, the other side is repeated."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"]).drop("__salt")


def stored_chunks(chunks: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, content_hash) of the stored chunks of the files in wanted (path), each once."""
    # repeated rows of files and of chunks count once, and only files that were scanned matter
    known = files.select("path", F.col("id").alias("file_id")).distinct().join(wanted.select("path").distinct(), "path", "left_semi")
    held = chunks.where(F.col("content_hash").isNotNull()).select("file_id", "content_hash").distinct()
    return salted_lookup(held, known, "file_id", F.col("content_hash")).select("path", "content_hash").distinct()


def replay_chunks(target: VersionedTarget, chunk_scans: DataFrame, chunks: DataFrame, files: DataFrame, runs: list[tuple[int, str]]) -> DataFrame:
    """(path, chunk_index, run_id) of the chunks that each run cut and whose content the target doesn't hold for their file.
    A chunk's key is (path, content_hash), for chunks move within a file: the content is the version. The stored chunks are
    published first, as the seed of the target; then each run is anti-joined against it and, with status 'ok', published."""
    seen = latest_sighting(chunk_scans, ["run_id", "path", "chunk_index"], "content_hash", ["scanned_at", "scan_id"])
    parts = materialize_parts(seen, "chunk-sightings", "run_id")
    target.publish(0, stored_chunks(chunks, files, parts), source="stored")
    out = parts.where(F.lit(False)).select("path", "chunk_index", F.col("run_id").cast("int").alias("run_id"))
    for run, status in sorted(runs):
        pending = materialize(target.pending(parts.where(F.col("run_id") == run)), "pending-chunks")
        if status == "ok":
            target.publish(run, pending.select("path", "content_hash").distinct())
        out = out.unionByName(pending.select("path", "chunk_index", F.col("run_id").cast("int").alias("run_id")))
    return out


def chunk_target(spark: SparkSession, root: str) -> VersionedTarget:
    return VersionedTarget(spark, root, T.StructType([T.StructField("path", T.StringType()), T.StructField("content_hash", T.BinaryType())]), ["path", "content_hash"], "content_hash")
