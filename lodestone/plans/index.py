"""Indexing a directory: scan, skip what is unchanged, extract, chunk, embed, publish one version."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..embed import Embedder, embed_column
from ..operators.chunking import token_chunks
from ..operators.store import IndexStore, changed_files, missing_files, unchanged
from ..session import discard, materialize
from ..sources.extract import read_texts
from ..sources.listing import Rules, listing as list_tree

log = logging.getLogger("lodestone")


def run_stats(outcomes: DataFrame) -> DataFrame:
    """One row of counters over (outcome, n_chunks): a file counts under one outcome."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    names = ["indexed", "unchanged", "too_large", "filtered", "media_indexed", "media_filtered", "unreadable", "errors"]
    return outcomes.agg(*map(count, names), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("chunks_embedded"))


def index_directory(spark: SparkSession, root: str, store: IndexStore, embedder: Embedder, rules: Rules | None = None, recursive: bool = True, media=None, remove_missing: bool = False) -> dict[str, int]:
    """Counters of the run. A file that can't be read or extracted keeps its stored state and is tried again;
    a file without text gets a row and no chunks. media: an optional function from a listing of media files to
    (path, embedding array<float>, error). remove_missing also drops stored files under the root that are gone, with
    all they have in any table; what lies below an unreadable folder stays. Only rows of touched files are written."""
    rules = rules or Rules()
    listing = materialize(list_tree(spark, root, rules, recursive), "listing")  # every part of the run sees the same tree
    files = store.read("files")
    # written first, so that contents of unchanged files are never opened
    todo = materialize(unchanged(listing.where("outcome = 'candidate'"), files).where(~F.col("unchanged")), "todo")
    texts = materialize(read_texts(todo.where("kind = 'text'").repartition(max(1, spark.sparkContext.defaultParallelism), "path")), "texts")
    good = texts.where("error is null")
    fresh = materialize(changed_files(files, good), "files")
    cut = token_chunks(good.join(fresh.select(F.col("id").alias("file_id"), "path"), "path"), "file_id", "text", embedder.count_tokens, embedder.token_budget)
    chunks = cut.select(
        file_ids_of("id", "chunk_index").alias("id"), F.col("id").alias("file_id"), "chunk_index", "content", F.unhex(F.sha2("content", 256)).alias("content_hash"), "start_line", "end_line", F.lit(embedder.model_id).alias("embedding_model")
    )
    embedded = materialize(embed_column(chunks, "content", embedder), "embedded")
    scratch = [listing, todo, texts, fresh, embedded]
    touched = fresh.select(F.col("id").alias("file_id"))
    tables = {"files": fresh, "chunks": embedded.drop("embedding"), "vec_chunks": embedded.select(F.col("id").alias("rowid"), "embedding", "file_id")}
    pictures = todo.where("kind = 'media'").select("path", "modified_at")
    media_done = None
    if media is not None:
        media_done = materialize(media(pictures), "media")
        rows = materialize(media_rows(files, media_done, pictures), "media_rows")
        scratch += [media_done, rows]
        shown = rows.select(F.col("file_id").alias("id"), "path", "modified_at", "file_hash", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("last_error"))
        tables |= {"files": fresh.unionByName(shown), "media_embeddings": rows, "vec_media": rows.select(F.col("id").alias("rowid"), "embedding", "file_id")}
        touched = touched.unionByName(rows.select("file_id"))
    if remove_missing:
        under = F.startswith(F.col("path"), F.lit(os.path.realpath(root).rstrip("/") + "/"))
        touched = touched.unionByName(missing_files(files.where(under), listing).select(F.col("id").alias("file_id")))
    touched = materialize(touched.distinct(), "touched")
    scratch.append(touched)
    if not touched.isEmpty():  # else there is nothing to publish
        store.publish(touched, tables)
    per_file = embedded.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks")).join(fresh.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "n_chunks")
    outcomes = (
        listing.where("outcome != 'candidate'").select("path", "outcome")
        # a file's stored time may have changed with this run, so what was unchanged is what wasn't to do
        .unionByName(listing.where("outcome = 'candidate'").join(todo.select("path"), "path", "left_anti").select("path", F.lit("unchanged").alias("outcome")))
        .unionByName(texts.select("path", F.when(F.col("error").isNull(), "indexed").otherwise("errors").alias("outcome")))
        .unionByName(pictures.select("path", F.lit("media_filtered").alias("outcome")) if media_done is None else media_done.select("path", F.when(F.col("error").isNull(), "media_indexed").otherwise("errors").alias("outcome")))
        .join(per_file, "path", "left")
    )
    for r in texts.where("error is not null").select("path", "error").limit(20).collect():
        log.warning("%s: %s", r.path, r.error)
    stats = run_stats(outcomes).first().asDict()
    for df in scratch:
        discard(df)
    return stats


def media_rows(files: DataFrame, done: DataFrame, pictures: DataFrame) -> DataFrame:
    """Rows of embedded still images: done has (path, embedding, file_hash, model, error); frame 0 of each, with what its file's row needs."""
    good = done.where("error is null").join(pictures, "path")
    ids = changed_files(files, good.select("path", "modified_at", "file_hash")).select(F.col("id").alias("file_id"), "path")
    return good.join(ids, "path").select(
        file_ids_of("file_id", F.lit(0)).alias("id"), "file_id", F.lit(0).alias("frame_index"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"),
        F.col("file_hash").alias("content_hash"), F.col("model").alias("embedding_model"), "embedding", "path", "modified_at", "file_hash")


def saw_anything(stats: dict[str, int]) -> bool:
    """Whether the run met any file at all."""
    return any(n for k, n in stats.items() if k != "chunks_embedded")


def file_ids_of(*columns):
    return F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def summary(stats: dict[str, int], seconds: float) -> str:
    lines = [f"indexed {stats['indexed']} files, {stats['chunks_embedded']} chunks in {seconds:.1f} s"]
    for key, words in (("unchanged", "unchanged"), ("media_indexed", "images indexed"), ("too_large", "too large"), ("filtered", "filtered"), ("media_filtered", "images skipped"), ("unreadable", "unreadable"), ("errors", "failed")):
        if stats[key]:
            lines.append(f"  {stats[key]} {words}")
    return "\n".join(lines)
