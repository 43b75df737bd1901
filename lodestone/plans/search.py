"""Search: embed the query, nearest vectors, joins, post-filters, diversified results; images apart."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..embed import Embedder
from ..functions.text import hyperlink, label, snippet
from ..operators.knn import diversify, join_chunks, join_media, nearest, post_filter
from ..operators.store import IndexStore
from ..schema import MAX_PER_FILE, MAX_RESULTS, POOL

log = logging.getLogger("lodestone")


@dataclass
class Options:
    """Numbers of 0 or less mean the configured value, and where that is 0 or less the built-in one."""

    max: int = 0
    media_max: int = 0
    per_file: int = 0
    restrict: str | None = None


class Results(NamedTuple):
    files: DataFrame
    media: DataFrame | None


def search_texts(vectors: DataFrame, chunks: DataFrame, files: DataFrame, query: list[float], model: str, most: int = MAX_RESULTS, per_file: int = MAX_PER_FILE, restrict: str | None = None) -> DataFrame:
    """(path, start_line, end_line, content, score) of the best chunks."""
    pool = nearest(vectors, query, POOL)
    found = post_filter(join_chunks(pool, chunks, files), model, restrict)
    return diversify(found, most, per_file).select("path", "start_line", "end_line", "content", "score")


def search_media(vectors: DataFrame, media: DataFrame, files: DataFrame, query: list[float], model: str, most: int = MAX_RESULTS, restrict: str | None = None) -> DataFrame:
    """(path, frame_index, score) of the best images; not diversified."""
    pool = nearest(vectors, query, POOL)
    return post_filter(join_media(pool, media, files), model, restrict).orderBy("distance", "rowid").limit(most).select("path", "frame_index", "score")


def search(store: IndexStore, query: str, embedder: Embedder, options: Options = Options(), media_embedder: Embedder | None = None, defaults: tuple[int, int, int] = (0, 0, 0)) -> Results:
    """A failure of the image search is logged and leaves the texts; one of the text search is raised."""
    pick = lambda given, configured, builtin: given if given > 0 else configured if configured > 0 else builtin
    restrict = os.path.abspath(options.restrict) if options.restrict is not None else None
    most = pick(options.max, defaults[0], MAX_RESULTS)
    texts = search_texts(store.read("vec_chunks"), store.read("chunks"), store.read("files"), embedder.embed([query])[0].tolist(), embedder.model_id, most, pick(options.per_file, defaults[2], MAX_PER_FILE), restrict)
    pictures = None
    if media_embedder is not None:
        try:
            pictures = search_media(store.read("vec_media"), store.read("media_embeddings"), store.read("files"), media_embedder.embed([query])[0].tolist(), media_embedder.model_id, pick(options.media_max, defaults[1], MAX_RESULTS), restrict)
        except Exception:  # noqa: BLE001 - images are an addition
            log.exception("image search failed")
    return Results(texts, pictures)


def printed(results: Results, links: bool = False) -> str:
    """Lines as the command line shows them; at most the few result rows are collected. links: paths are links that terminals open."""
    shown = lambda text: hyperlink(F.col("path"), text) if links else text
    rows = results.files.select(shown(label(F.col("path"), F.col("start_line"), F.col("end_line"))).alias("label"), "score", snippet(F.col("content")).alias("snippet")).collect()
    out = [f"{r.label}  (score: {r.score:.2f})\n    {r.snippet}" for r in rows]
    pictures = results.media.select(shown(F.col("path")).alias("path"), "score").collect() if results.media is not None else []
    if pictures:
        out += ["media:", *(f"{r.path}  (score: {r.score:.2f})" for r in pictures)]
    return "\n".join(out) if out else "no results found"
