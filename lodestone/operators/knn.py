"""Exact nearest neighbours by L2 distance, the joins and filters after it, and diversification.

The scan computes distances with one matrix product per Arrow batch and keeps the best k of each
batch, so what leaves a task is k rows, not the table. Filters by model and path
come after the limit: a narrow restriction may leave fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.paths import under_dir
from ..functions.vectors import score
from ..schema import MAX_PER_FILE, MAX_RESULTS, POOL


def _usable(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, vec = b.column(0), b.column(1)
    good = (np.diff(vec.offsets.to_numpy()) == width) & vec.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    at = pa.array(np.flatnonzero(good))
    return ids.take(at).to_numpy(), vec.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(vectors: DataFrame, query: list[float], k: int = POOL, id_col: str = "rowid", vec_col: str = "embedding") -> DataFrame:
    """(rowid, distance) of the k nearest vectors, ties to the smaller id. Null vectors and those of another
    width take no part; repeated rows count once."""
    q = np.asarray(query, np.float64)

    def best(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        for b in source:
            i, x = _usable(b, len(q))
            d = np.sqrt(((x.astype(np.float64) - q) ** 2).sum(1))
            ids, dist = np.concatenate([ids, i]), np.concatenate([dist, d])
            ids, first = np.unique(ids, return_index=True)
            dist = dist[first]
            order = np.lexsort((ids, dist))[:k]
            ids, dist = ids[order], dist[order]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(dist)], names=["rowid", "distance"])

    found = vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(best, "rowid long, distance double")
    return found.groupBy("rowid").agg(F.min("distance").alias("distance")).orderBy("distance", "rowid").limit(k)


def _block(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that can be among the k nearest of a query, sorted by id: repeated rows once and, of equal
    vectors, the k + 1 smallest ids, as ties go to the smaller id and a query leaves out only its own."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    same = same.ravel()
    order = np.lexsort((ids, same))
    order = order[np.r_[True, (ids[order][1:] != ids[order][:-1]) | (same[order][1:] != same[order][:-1])]]
    first = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    order = order[place <= k]
    order = order[np.argsort(ids[order], kind="stable")]
    return ids[order], x[order]


def _nearest_of_block(qi: np.ndarray, q: np.ndarray, ti: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position in the block, distance) of the k nearest ids of each query, ties to the smaller id. All that the
    matrix product can't tell from the k-th is compared by exact distances. ti is sorted."""
    norms = (q * q).sum(1)[:, None], (t * t).sum(1)[None, :]
    d = norms[0] + norms[1] - 2 * q @ t.T
    d[qi[:, None] == ti[None, :]] = np.inf
    starts = np.flatnonzero(np.r_[True, ti[1:] != ti[:-1]])
    of_id = d if len(starts) == len(ti) else np.minimum.reduceat(d, starts, axis=1)
    kth = np.partition(of_id, k - 1, axis=1)[:, k - 1] if of_id.shape[1] > k else np.full(len(q), np.inf)
    slack = 1e-12 * t.shape[1] * (norms[0].ravel() + norms[1].max(initial=0.0))
    who, near = np.nonzero((d <= (kth + slack)[:, None]) & np.isfinite(d))
    exact = np.empty(len(who))
    for s in range(0, len(who), 1 << 14):
        a, b = who[s : s + (1 << 14)], near[s : s + (1 << 14)]
        exact[s : s + (1 << 14)] = np.sqrt(((q[a] - t[b]) ** 2).sum(1))
    # of an id its smallest distance, then the first k of each query
    order = np.lexsort((exact, ti[near], who))
    order = order[np.r_[True, (who[order][1:] != who[order][:-1]) | (ti[near][order][1:] != ti[near][order][:-1])][: len(order)]]
    order = order[np.lexsort((ti[near][order], exact[order], who[order]))]
    first = np.flatnonzero(np.r_[True, who[order][1:] != who[order][:-1]][: len(order)])
    order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < k]
    return who[order], near[order], exact[order]


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, width: int = 384, id_col: str = "rowid", vec_col: str = "embedding", rows: int = 4096) -> DataFrame:
    """(query_id, rowid, distance, rank) of the k nearest other vectors of every query, ties to the smaller id; repeated
    rows count once. Queries and table meet in blocks of `rows` vectors; each pair of blocks is one matrix product and
    leaves at most k rows a query."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            ids, x = _usable(b, width)
            for s in range(0, len(ids), rows):
                yield pa.RecordBatch.from_arrays([pa.array([ids[s : s + rows].astype(np.int64).tobytes()]), pa.array([x[s : s + rows].astype(np.float32).tobytes()])], names=["ids", "vecs"])

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for qi, qv, ti, tv in zip(*(c.to_pylist() for c in b.columns)):
                qi, ti = np.frombuffer(qi, np.int64), np.frombuffer(ti, np.int64)
                ti, t = _block(ti, np.frombuffer(tv, np.float32).reshape(-1, width), k)
                q = np.frombuffer(qv, np.float32).reshape(-1, width).astype(np.float64)
                who, near, exact = _nearest_of_block(qi, q, ti, t.astype(np.float64), k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[who]), pa.array(ti[near]), pa.array(exact)], names=["query_id", "rowid", "distance"])

    blocks = vectors.select(F.col(id_col).cast("long"), vec_col).mapInArrow(pack, "ids binary, vecs binary")
    asked = queries.select(F.col(id_col).cast("long"), vec_col).mapInArrow(pack, "ids binary, vecs binary")
    met = asked.select(F.col("ids").alias("qi"), F.col("vecs").alias("qv")).crossJoin(blocks).mapInArrow(meet, "query_id long, rowid long, distance double")
    once = met.groupBy("query_id", "rowid").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "rowid")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_vectors(rows: DataFrame, key: str, vec_col: str) -> DataFrame:
    """(key, mean): the mean vector of each key, in double precision. Each task sums its own rows of a key before the shuffle and
    each partition the sums of its keys after it, a batch at a time, so neither a key with very many rows nor very many keys cost more."""
    key_type = rows.schema[key].dataType.simpleString()

    def summed(keys: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, at = np.unique(keys, return_inverse=True)
        sums, counts = np.zeros((len(names), x.shape[1])), np.zeros(len(names), np.int64)
        np.add.at(sums, at, x)
        np.add.at(counts, at, n)
        return names, sums, counts

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def partial(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            keys, vec = b.column(0), b.column(1)
            good = pa.array(np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False) & keys.is_valid().to_numpy(zero_copy_only=False)))
            if len(good):
                k, flat = keys.take(good).to_numpy(zero_copy_only=False), vec.take(good).flatten().to_numpy(zero_copy_only=False)
                names, sums, counts = summed(k, flat.astype(np.float64).reshape(len(good), -1), np.ones(len(good), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names), lists(sums), pa.array(counts)], names=[key, "total", "n"])

    def whole(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows come sorted by key: only the last key of a batch may go on in the next
        for b in source:
            k, n = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1)
            if held is not None:
                k, x, n = np.concatenate([held[0], k]), np.concatenate([held[1], x]), np.concatenate([held[2], n])
            names, sums, counts = summed(k, x, n)
            held = names[-1:], sums[-1:], counts[-1:]
            if len(names) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(names[:-1]), lists(sums[:-1] / counts[:-1, None])], names=[key, "mean"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), lists(held[1] / held[2][:, None])], names=[key, "mean"])

    sums = rows.select(key, vec_col).mapInArrow(partial, f"{key} {key_type}, total array<double>, n long")
    return sums.repartition(key).sortWithinPartitions(key).mapInArrow(whole, f"{key} {key_type}, mean array<double>")


def join_chunks(pool: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The pool with its chunks and files; vectors without a chunk drop out. The pool has at most POOL
    rows, which bounds what is broadcast."""
    parts = chunks.select(F.col("id").alias("rowid"), "file_id", "chunk_index", "content", "start_line", "end_line", "embedding_model").join(F.broadcast(pool), "rowid").dropDuplicates(["rowid"])
    return files.select(F.col("id").alias("file_id"), "path").join(F.broadcast(parts), "file_id").dropDuplicates(["rowid"])


def join_media(pool: DataFrame, media: DataFrame, files: DataFrame) -> DataFrame:
    parts = media.select(F.col("id").alias("rowid"), "file_id", "frame_index", "embedding_model").join(F.broadcast(pool), "rowid").dropDuplicates(["rowid"])
    return files.select(F.col("id").alias("file_id"), "path").join(F.broadcast(parts), "file_id").dropDuplicates(["rowid"])


def post_filter(candidates: DataFrame, model: str | None = None, restrict: str | None = None) -> DataFrame:
    """Only the current model and only below a directory; both after the limit of the pool."""
    if model is not None:
        candidates = candidates.where(F.col("embedding_model") == model)
    if restrict is not None:
        candidates = candidates.where(under_dir(F.col("path"), restrict))
    return candidates.withColumn("score", score(F.col("distance")))


def diversify(candidates: DataFrame, most: int = MAX_RESULTS, per_file: int = MAX_PER_FILE) -> DataFrame:
    """At most per_file rows of a path before others are backfilled, `most` rows in all, by score.
    Adds phase (1 for backfilled rows). Candidates are at most a pool, so one window over them is bounded."""
    ranked = candidates.withColumn("rk", F.row_number().over(Window.orderBy("distance", "rowid"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    ranked = ranked.withColumn("rif", F.row_number().over(Window.partitionBy("path").orderBy("rk")))
    phase = F.lit(0) if per_file <= 0 else F.when((F.col("n") <= most) | (F.col("rif") <= per_file), 0).otherwise(1)
    return ranked.withColumn("phase", phase).orderBy("phase", "rk").limit(max(0, most)).orderBy(F.desc("score"), "phase", "rk").drop("n", "rif", "rk")
