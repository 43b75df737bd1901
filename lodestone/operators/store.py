"""The index as versioned Parquet tables: upsert of files, replacement of their chunks, one new version a run.

A run writes the new rows of the files it touched and the list of these files, nothing else. A manifest
names the folders of all runs; a row counts if no later run touched its file. So a run costs what it changes, and
readers see it as a whole or not at all. compact() merges the runs into one folder a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import TABLES
from .manifests import Manifests

OF_FILE, SEQ = "_file_id", "_seq"
COMPACT_EVERY = 16


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._manifests = Manifests(spark, f"{self.root}/_manifests")

    def manifest(self) -> dict:
        """version; tables: the folders of each table; touched: the folders that list touched files."""
        return self._manifests.last() or {"version": 0, "tables": {}, "touched": []}

    def exists(self) -> bool:
        return self.manifest()["version"] > 0

    def _stored(self, table: str) -> T.StructType:
        return T.StructType([*TABLES[table].fields, T.StructField(OF_FILE, T.LongType()), T.StructField(SEQ, T.LongType())])

    def _current(self, table: str, manifest: dict) -> DataFrame | None:
        folders = manifest["tables"].get(table)
        if not folders:
            return None
        rows = self.spark.read.schema(self._stored(table)).parquet(*(f"{self.root}/{f}" for f in folders))
        if not manifest["touched"]:
            return rows
        touched = self.spark.read.schema(f"{OF_FILE} long, {SEQ} long").parquet(*(f"{self.root}/{f}" for f in manifest["touched"]))
        last = touched.groupBy(OF_FILE).agg(F.max(SEQ).alias("__last"))
        return rows.join(last, OF_FILE, "left").where(F.col("__last").isNull() | (F.col(SEQ) >= F.col("__last"))).drop("__last")

    def read(self, table: str) -> DataFrame:
        """A table of the current version; an empty one before the first run."""
        rows = self._current(table, self.manifest())
        return self.spark.createDataFrame([], TABLES[table]) if rows is None else rows.select(TABLES[table].names)

    def publish(self, touched: DataFrame, tables: dict[str, DataFrame]) -> int:
        """Replace all rows of the touched files (file_id) in all tables by the rows given, in one step. files rows have
        their own id, children a column file_id; vector rows, which are keyed by their chunk, need file_id besides. Fails if
        another run published in between. Every COMPACT_EVERY runs the folders are merged after it."""
        manifest = self.manifest()
        version = manifest["version"] + 1
        folders = {k: list(v) for k, v in manifest["tables"].items()}
        for name, df in tables.items():
            owner = F.col("id" if name == "files" else "file_id").cast("long").alias(OF_FILE)
            fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]
            folder = f"data/{name}-{version}-{uuid.uuid4().hex[:12]}"
            df.select(*fields, owner, F.lit(version).cast("long").alias(SEQ)).write.parquet(f"{self.root}/{folder}")
            folders.setdefault(name, []).append(folder)
        mark = f"data/touched-{version}-{uuid.uuid4().hex[:12]}"
        touched.select(F.col("file_id").cast("long").alias(OF_FILE), F.lit(version).cast("long").alias(SEQ)).distinct().write.parquet(f"{self.root}/{mark}")
        self._manifests.put(version, {"version": version, "tables": folders, "touched": [*manifest["touched"], mark]})
        if len(manifest["touched"]) + 1 >= COMPACT_EVERY:
            self.compact()
        return version

    def compact(self) -> int:
        """Merge all runs into one folder a table. Folders that neither this version nor the one before names are removed:
        readers of the version before still find theirs."""
        manifest = self.manifest()
        version = manifest["version"] + 1
        folders = {}
        for name in manifest["tables"]:
            folders[name] = [f"data/{name}-{version}-{uuid.uuid4().hex[:12]}"]
            self._current(name, manifest).select(self._stored(name).names).write.parquet(f"{self.root}/{folders[name][0]}")
        self._manifests.put(version, {"version": version, "tables": folders, "touched": []})
        kept = {f for m in (manifest, {"tables": folders, "touched": []}) for part in (*m["tables"].values(), m["touched"]) for f in part}
        for name in self._manifests.names(f"{self.root}/data"):
            if f"data/{name}" not in kept:
                self._manifests.remove(f"{self.root}/data/{name}")
        return version

    def clean(self) -> bool:
        """Remove the index; False if there was none."""
        return self._manifests.remove(self.root)


def file_ids(path: str = "path"):
    """Ids that a re-index and a lost task give again: a positive hash of the path."""
    return F.xxhash64(path).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that new (path, modified_at, file_hash) gives the files table: a known path keeps its id; 'ok' without an
    error. Of repeated rows of new one stays."""
    new = new.select("path", "modified_at", "file_hash").dropDuplicates(["path"])
    ids = old.groupBy("path").agg(F.min("id").alias("id"))
    return new.join(ids, "path", "left").select(
        F.coalesce("id", file_ids()).alias("id"), "path", "modified_at", "file_hash", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("last_error")
    )


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of old with the same path, which keep their id; others are added."""
    fresh = changed_files(old, new)
    return old.join(new.select("path"), "path", "left_anti").select(fresh.columns).unionByName(fresh)


def replace_children(old: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """All children of touched files (file_id) go, also where no new ones come; then the new ones are added."""
    return old.join(touched.select("file_id").distinct(), "file_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))


def unchanged(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The listing with a column unchanged: the stored modified_at of its path is the same."""
    stored = files.groupBy("path").agg(F.max(F.struct("modified_at")).getField("modified_at").alias("__stored"))
    return listing.join(stored, "path", "left").withColumn("unchanged", F.coalesce(F.col("__stored") == F.col("modified_at"), F.lit(False))).drop("__stored")


def _directories_above(path: str = "path"):
    """All directories that a path lies below, from the top one ('') down."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def below_marked(paths: DataFrame, is_marker) -> DataFrame:
    """(path, is_pruned) of the paths of a table: whether a directory above it holds a marker file. A path joins the marked ones of its own
    directories; the root isn't one, as what was named to be indexed is never pruned."""
    rows = paths.select("path").distinct()
    marked = rows.where(is_marker).select(F.element_at(_directories_above(), -1).alias("__above")).where("__above <> ''").distinct()
    below = rows.where(F.size(F.split("path", "/", -1)) > 1).select("path", F.explode(_directories_above()).alias("__above")).join(marked, "__above").select("path").distinct()
    return rows.join(below.withColumn("__m", F.lit(True)), "path", "left").select("path", F.coalesce("__m", F.lit(False)).alias("is_pruned"))


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored files that the listing no longer has. What lies below a folder that couldn't be read isn't missing."""
    gone = files.join(listing.select("path").distinct(), "path", "left_anti")
    if "outcome" not in listing.columns:
        return gone
    blocked = listing.where("outcome = 'unreadable'").select(F.col("path").alias("__above")).distinct()
    below = gone.select("path", F.explode(_directories_above()).alias("__above")).join(blocked, "__above").select("path").distinct()
    return gone.join(below, "path", "left_anti")
