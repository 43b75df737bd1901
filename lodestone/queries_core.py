"""Queries over the index tables for the core operators, with their DuckDB counterparts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .embed import HashEmbedder, embed_column
from .functions.paths import DEFAULT_MB, MB_BY_TYPE, MEDIA_EXTENSIONS, TEXT_EXTENSIONS, GitignoreRule, base_name, classify, directories, extension, gitignored, hidden_or_ignored, matches_any, size_limit, too_large
from .functions.text import CJK, clean_extracted, clean_text, elapsed, file_uri, label, page_marked, pre_tokens, snippet, space_out_cjk
from .functions.tokenizer import WordPiece, encode_column
from .functions.vectors import l2_normalize, score
from .operators.chunking import fixed_chunks, token_chunks
from .operators.incremental import VersionedTarget, chunk_target, latest_sighting, replay_chunks, replay_runs
from .operators.knn import diversify, join_chunks, join_media, mean_vectors, nearest, nearest_batch, post_filter
from .operators.store import IndexStore, below_marked, missing_files, replace_children, unchanged, upsert_files
from .plans.index import index_directory, run_stats
from .plans.search import Options, search
from .session import scratch_path, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New or changed files of every run but the first, and new or changed chunks of run 8."""
    runs = [(r.run_id, r.status) for r in table(spark, sf_dir, "index_runs").select("run_id", "status").distinct().collect()]  # eight rows
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_hash", T.BinaryType())])
    target = VersionedTarget(spark, scratch_path(spark, "p2"), schema, ["path"], "file_hash")
    files = (
        replay_runs(target, table(spark, sf_dir, "file_scans").where(F.col("path").isNotNull()), runs, "run_id", ["scanned_at", "scan_id"])
        .where(F.col("run_id") > 1)
        .select(F.lit("file").alias("level"), F.col("run_id").cast("int").alias("run_id"), "path", F.lit(-1).alias("chunk_index"))
    )
    cut = replay_chunks(chunk_target(spark, scratch_path(spark, "p2-chunks")), table(spark, sf_dir, "chunk_scans"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files"), [r for r in runs if r[0] == 8] or [(8, "running")])
    return files.unionByName(cut.select(F.lit("chunk").alias("level"), "run_id", "path", F.col("chunk_index").cast("int").alias("chunk_index")))


P2_FOUND_SQL = """
WITH seen AS (
  SELECT run_id, path, arg_max(file_hash, (scanned_at, scan_id)) AS file_hash
  FROM file_scans WHERE file_hash IS NOT NULL AND path IS NOT NULL GROUP BY run_id, path
), f AS (
  SELECT s.run_id, s.path, s.file_hash,
         (SELECT arg_max(o.file_hash, o.run_id) FROM seen o JOIN (SELECT DISTINCT run_id, status FROM index_runs) r USING (run_id)
          WHERE r.status = 'ok' AND o.path = s.path AND o.run_id < s.run_id) AS before
  FROM seen s
), c AS (
  SELECT path, chunk_index, arg_max(content_hash, (scanned_at, scan_id)) AS content_hash
  FROM chunk_scans WHERE content_hash IS NOT NULL GROUP BY path, chunk_index
), held AS (SELECT DISTINCT f.path, k.content_hash FROM chunks k JOIN files f ON f.id = k.file_id)
SELECT 'file' AS level, run_id, path, CAST(-1 AS INTEGER) AS chunk_index FROM f
WHERE run_id > 1 AND file_hash IS DISTINCT FROM before
UNION ALL
SELECT 'chunk', CAST(8 AS INTEGER), path, chunk_index FROM c
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.path = c.path AND h.content_hash = c.content_hash)
"""

# -- search ------------------------------------------------------------------------------------

DIRECTORY = "/home"


def _query_vector(spark: SparkSession, sf_dir: str, name: str) -> list[float]:
    """The vector of the smallest id that has one: a query whose nearest vector is known."""
    usable = table(spark, sf_dir, name).where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    return usable.agg(F.min_by("embedding", "rowid")).first()[0]


def _model(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The model most rows were embedded with."""
    return table(spark, sf_dir, name).where("embedding_model is not null").groupBy("embedding_model").count().orderBy(F.desc("count"), "embedding_model").first()[0]


def _pool(spark, sf_dir):
    return nearest(table(spark, sf_dir, "vec_chunks"), _query_vector(spark, sf_dir, "vec_chunks"))


def _candidates(spark, sf_dir, restrict=None):
    found = join_chunks(_pool(spark, sf_dir), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files"))
    return post_filter(found, _model(spark, sf_dir, "chunks"), restrict)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("score", "distance") else F.col(c) for c in columns])


def knn_pool(spark, sf_dir):
    """The 200 nearest vectors of a query."""
    return _rounded(_pool(spark, sf_dir).withColumn("score", score(F.col("distance"))), "rowid", "distance", "score")


def knn_post_filter(spark, sf_dir):
    """The pool with chunk and file, only the current model: filtered after the limit."""
    return _rounded(_candidates(spark, sf_dir), "rowid", "path", "chunk_index", "start_line", "end_line", "score")


def knn_restrict(spark, sf_dir):
    """The same, only below a directory."""
    return _rounded(_candidates(spark, sf_dir, DIRECTORY), "rowid", "path", "score")


def knn_diversified(spark, sf_dir):
    """Five results with two of a file at most, and how they are shown."""
    rows = diversify(_candidates(spark, sf_dir))
    return rows.select("rowid", label(F.col("path"), F.col("start_line"), F.col("end_line")).alias("label"), F.round("score", 6).alias("score"), snippet(F.col("content")).alias("snippet"))


def media_search(spark, sf_dir):
    """The five best images of the current model, not diversified."""
    pool = nearest(table(spark, sf_dir, "vec_media"), _query_vector(spark, sf_dir, "vec_media"))
    found = post_filter(join_media(pool, table(spark, sf_dir, "media_embeddings"), table(spark, sf_dir, "files")), _model(spark, sf_dir, "media_embeddings"))
    return _rounded(found.orderBy("distance", "rowid").limit(5), "rowid", "path", "frame_index", "score")


def knn_batch(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 50, against all."""
    vectors = table(spark, sf_dir, "vec_chunks").where(F.exists("embedding", lambda x: x != 0))
    found = nearest_batch(vectors, vectors.where("rowid % 50 = 0"))
    return found.select("query_id", "rowid", F.round("distance", 6).alias("distance"), "rank")


def orphan_vectors(spark, sf_dir):
    """Vectors without a chunk: they take places in the pool and then drop out of the join."""
    vectors = table(spark, sf_dir, "vec_chunks").select("rowid").distinct()
    return vectors.join(table(spark, sf_dir, "chunks").select(F.col("id").alias("rowid")), "rowid", "left_anti")


def stale_models(spark, sf_dir):
    """Chunks by whether the current model made them."""
    model = _model(spark, sf_dir, "chunks")
    chunks = table(spark, sf_dir, "chunks").select("id", "embedding_model").distinct()
    return chunks.groupBy(F.coalesce(F.col("embedding_model") == model, F.lit(False)).alias("is_current")).agg(F.count(F.lit(1)).alias("n_chunks"))


def file_mean_vectors(spark, sf_dir):
    """The mean vector of each file, of length 1, as rows (file_id, dim, value)."""
    # one shuffle of the vectors, by rowid, for both the repeated rows and the join; partial sums leave a task, not one row for each element
    vectors = table(spark, sf_dir, "vec_chunks").where("embedding is not null").repartition("rowid").dropDuplicates(["rowid"])
    of_file = table(spark, sf_dir, "chunks").select(F.col("id").alias("rowid"), "file_id").dropDuplicates(["rowid"])
    joined = vectors.join(of_file, "rowid")
    means = mean_vectors(joined.select("file_id", "embedding"), "file_id", "embedding")
    return means.select("file_id", F.posexplode(l2_normalize(F.col("mean"))).alias("dim", "value")).select("file_id", "dim", F.round("value", 6).alias("value"))


# -- text --------------------------------------------------------------------------------------


def chunk_fixed(spark, sf_dir):
    """Chunks of 500 code points of every document."""
    return fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def chunk_hashes(spark, sf_dir):
    """SHA-256 of the contents against the stored hashes."""
    digest = F.lower(F.sha2("content", 256))
    # distinct after the digest: contents aren't shuffled
    return table(spark, sf_dir, "chunks").select("id", digest.alias("sha256_hex"), (digest == F.lower(F.hex("content_hash"))).alias("is_stored")).distinct()


def chunk_token_aware(spark, sf_dir):
    """Chunks that also keep within 126 words."""
    return token_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", _count_words, 126).withColumnRenamed("id", "doc_id")


def _count_words(text: str) -> int:
    return len(text.split())


def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", snippet(F.col("text")).alias("snippet"))


def clean_text_lines(spark, sf_dir):
    """Extracted text without trailing blanks and runs of empty lines."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", clean_extracted(F.col("text")).alias("text"))


def page_marked_text(spark, sf_dir):
    """The chunks of .pdf files as pages with their marks."""
    pdf = table(spark, sf_dir, "files").where(F.lower("path").endswith(".pdf")).select(F.col("id").alias("file_id")).distinct()
    chunks = table(spark, sf_dir, "chunks").where("content is not null").join(pdf, "file_id").dropDuplicates(["id"])
    return chunks.select("id", page_marked(F.col("chunk_index") + 1, F.col("content")).alias("page"))


def pre_token_counts(spark, sf_dir):
    """Words and punctuation of the normalised text of every document."""
    cleaned = F.lower(clean_text(space_out_cjk(F.col("text"))))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(pre_tokens(cleaned)).cast("long").alias("n_tokens"))


def word_pieces(spark, sf_dir):
    """Encodings of chunk contents with a small vocabulary of letters and frequent endings: all ids but the padding."""
    tokenizer = WordPiece({t: i for i, t in enumerate(PIECES)})
    rows = table(spark, sf_dir, "chunks").where("content is not null").select("id", "content").dropDuplicates(["id"])
    encoded = rows.select("id", encode_column(F.col("content"), tokenizer).alias("e"))
    n = F.aggregate("e.mask", F.lit(0), lambda s, x: s + x.cast("int"))
    return encoded.select("id", n.cast("long").alias("n_ids"), F.array_join(F.slice("e.ids", F.lit(1), n), " ").alias("ids"))


PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz0123456789.,-", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789"), "the", "and", "##ing", "##ed"]


def hash_embedding_norms(spark, sf_dir):
    """Documents embedded by the hashing embedder, with the length of their vectors."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return embed_column(rows, "text", HashEmbedder()).select("doc_id", F.round(norm, 4).alias("norm"))


def index_documents(spark, sf_dir):
    """Every document chunked within the budgets of the hashing embedder and embedded: chunks and the mean length of their vectors, by language."""
    embedder = HashEmbedder()
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower(F.trim("lang")).alias("lang"))
    cut = token_chunks(rows, "doc_id", "text", embedder.count_tokens, embedder.token_budget).withColumnRenamed("id", "doc_id")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    embedded = embed_column(cut, "content", embedder).select("doc_id", norm.alias("norm"))
    per_document = embedded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("norm").alias("norm"))
    return per_document.join(rows.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.round(F.sum("norm") / F.sum("n"), 4).alias("mean_norm"))


def _tree(spark: SparkSession, sf_dir: str) -> IndexStore:
    """The documents written out as files of a tree in the shared folder, scanned, extracted, chunked, embedded and stored; then a
    fifth of them changed and the tree indexed again."""
    base = scratch_path(spark, "tree")
    if not base.startswith(("file:", "/")):
        raise ValueError("the tree must lie on a file system that is mounted everywhere")
    root = base.removeprefix("file://")

    def put(rows: DataFrame) -> None:
        def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in source:
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    folder = f"{root}/files/{i % 97}"
                    os.makedirs(folder, exist_ok=True)
                    with open(f"{folder}/{i}.txt", "wb") as f:
                        f.write(text.encode())
                    if text.startswith("CHANGED "):
                        os.utime(f"{folder}/{i}.txt", (1, 1))  # so that the time differs within a second too
                yield b.select([0])

        rows.mapInArrow(write, "doc_id long").write.format("noop").mode("overwrite").save()

    documents = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select("doc_id", "text")
    os.makedirs(f"{root}/files", exist_ok=True)
    put(documents)
    store = IndexStore(spark, f"file://{root}/index")
    index_directory(spark, f"{root}/files", store, HashEmbedder())
    put(documents.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("CHANGED "), "text")))
    index_directory(spark, f"{root}/files", store, HashEmbedder())
    return store


def indexed_tree(spark, sf_dir):
    """What the index of that tree holds, by file and chunk."""
    store = _tree(spark, sf_dir)
    files = store.read("files").select(F.col("id").alias("file_id"), base_name(F.col("path")).alias("name"))
    chunks = store.read("chunks").join(files, "file_id").join(store.read("vec_chunks").select(F.col("rowid").alias("id")), "id", "left_semi")
    return chunks.select("name", "chunk_index", "content", "start_line", "end_line", (F.lower(F.hex("content_hash")) == F.sha2("content", 256)).alias("is_hashed"))


def found_in_tree(spark, sf_dir):
    """The scores of the five results for the first eight words of the first long document, with two results of a file at most."""
    store = _tree(spark, sf_dir)
    words = F.filter(F.split("text", r"[\s\x1C-\x1F\x85\p{Z}]+"), lambda w: w != "")
    query = table(spark, sf_dir, "documents").where((F.size(words) >= 8) & (F.col("doc_id") % 5 != 0)).agg(F.min_by(F.array_join(F.slice(words, 1, 8), " "), "doc_id")).first()[0]
    scores = search(store, query, HashEmbedder(), Options(max=5, per_file=2)).files
    return scores.select(F.round("score", 4).alias("score"))


# -- files -------------------------------------------------------------------------------------


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "files").select("path").distinct()


def classify_files(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", extension(F.col("path")).alias("ext"), classify(F.col("path")).alias("kind"))


def size_limits(spark, sf_dir):
    """Sightings above the limit of their type."""
    rows = table(spark, sf_dir, "file_scans").where("size_bytes is not null").select("path", "size_bytes").distinct()
    return rows.select("path", "size_bytes", (size_limit(F.col("path"), 0, {"pdf": 0, "md": 1}) / 64).cast("long").alias("limit_bytes"), too_large(F.col("path"), F.col("size_bytes") * 64, default_mb=0, by_type={"pdf": 0, "md": 1}).alias("is_too_large"))


def pruned_directories(spark, sf_dir):
    """Files below a hidden directory or one of an ignored name."""
    return _paths(spark, sf_dir).select("path", hidden_or_ignored(F.col("path"), ["engine", "s*r", "weird[name", "?esk"]).alias("is_pruned"))


def ignored_names(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", matches_any(base_name(F.col("path")), ["*_1.*", "[a-c]*.md", ".env", "x["], False).alias("is_ignored"))


GITIGNORE = "# comment\n*.log\nengine/\n/u0001/*\n*draft*\n!keep.md\n"


def gitignored_files(spark, sf_dir):
    """Files below /home against the rules of a .gitignore there."""
    rows = _paths(spark, sf_dir).where(F.startswith("path", F.lit("/home/"))).withColumn("relative", F.expr("substring(path, 7)"))
    return rows.select("path", gitignored(F.col("relative"), GitignoreRule.parse(GITIGNORE)).alias("is_ignored"))


def marker_pruned(spark, sf_dir):
    """Files below a directory that holds a marker file: here any .toml."""
    return below_marked(_paths(spark, sf_dir), extension(F.col("path")) == ".toml")


def _last_seen(spark, sf_dir, run: int) -> DataFrame:
    seen = table(spark, sf_dir, "file_scans").where((F.col("run_id") == run) & F.col("path").isNotNull())
    return seen.groupBy("path").agg(F.max_by(F.struct("modified_at", "file_hash", "size_bytes"), F.struct("scanned_at", "scan_id")).alias("s")).select("path", "s.*")


def unchanged_files(spark, sf_dir):
    """What run 8 saw with the stored modification time."""
    return unchanged(_last_seen(spark, sf_dir, 8).select("path", "modified_at"), table(spark, sf_dir, "files"))


def upserted_files(spark, sf_dir):
    """The files table after run 8, where it could read them."""
    seen = _last_seen(spark, sf_dir, 8).where("file_hash is not null")
    rows = upsert_files(table(spark, sf_dir, "files").distinct(), seen)
    return rows.select("path", "modified_at", F.lower(F.hex("file_hash")).alias("file_hash"), "status", "last_error").distinct()


def replaced_chunks(spark, sf_dir):
    """Chunks per file after run 8's chunks took the place of those of the files it cut again."""
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["id"]).select("file_id", "chunk_index", "content_hash")
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "path").distinct()
    new = latest_sighting(table(spark, sf_dir, "chunk_scans"), ["path", "chunk_index"], "content_hash", ["scanned_at", "scan_id"]).join(files, "path").select("file_id", "chunk_index", "content_hash")
    return replace_children(chunks, new, new).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_index").alias("last_index"))


def files_without_chunks(spark, sf_dir):
    """Indexed files that have a row and no chunks."""
    files = table(spark, sf_dir, "files").where("status = 'ok'").select("id", "path").distinct()
    return files.join(table(spark, sf_dir, "chunks").select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "path")


def missing_from_run(spark, sf_dir):
    """Stored files that run 7 didn't see."""
    return missing_files(_paths(spark, sf_dir), _last_seen(spark, sf_dir, 7))


def run_counters(spark, sf_dir):
    """Outcomes of run 8 as one row of counters."""
    seen = unchanged(_last_seen(spark, sf_dir, 8), table(spark, sf_dir, "files"))
    kind = classify(F.col("path"))
    outcome = (
        F.when(kind == "none", "filtered").when(F.col("file_hash").isNull(), "unreadable").when(too_large(F.col("path"), F.col("size_bytes")), "too_large")
        .when(F.col("unchanged"), "unchanged").when(kind == "media", "media_indexed").otherwise("indexed")
    )
    per_file = table(spark, sf_dir, "chunk_scans").where("content_hash is not null").groupBy("path").agg(F.count_distinct("chunk_index").alias("n_chunks"))
    return run_stats(seen.select("path", outcome.alias("outcome")).join(per_file, "path", "left"))


def file_uris(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", file_uri(F.col("path")).alias("uri"))


def run_durations(spark, sf_dir):
    runs = table(spark, sf_dir, "index_runs").where("finished_at is not null").distinct()
    return runs.select("run_id", elapsed(F.expr("timestampdiff(SECOND, started_at, finished_at)")).alias("took"))


def vectors_to_delete(spark, sf_dir):
    """Vectors of the chunks of files that run 8 cut again: what a re-index deletes."""
    touched = table(spark, sf_dir, "files").join(table(spark, sf_dir, "chunk_scans").select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
    chunks = table(spark, sf_dir, "chunks").join(touched.distinct(), "file_id", "left_semi").select(F.col("id").alias("rowid"))
    return table(spark, sf_dir, "vec_chunks").select("rowid").distinct().join(chunks, "rowid", "left_semi")


def todo_files(spark, sf_dir):
    """Files of run 8 whose stored modification time differs: contents of the others are never read."""
    stored = table(spark, sf_dir, "files").select("path", "modified_at").distinct()
    return _last_seen(spark, sf_dir, 8).select("path", "modified_at").join(stored, ["path", "modified_at"], "left_anti")


def file_errors(spark, sf_dir):
    """Errors by status: how many files, and the first in the order of paths."""
    files = table(spark, sf_dir, "files").select("id", "path", "status", "last_error").distinct()
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("last_error") != "").alias("n_errors"), F.min(F.when(F.col("last_error") != "", F.concat_ws(": ", "path", "last_error"))).alias("first_error"))


def path_parts(spark, sf_dir):
    """Base names, directories and depth of all documents with a path."""
    rows = table(spark, sf_dir, "documents").where("path is not null")
    return rows.select("doc_id", base_name(F.col("path")).alias("name"), F.array_join(directories(F.col("path")), "/").alias("directory"), F.size(directories(F.col("path"))).cast("long").alias("depth"))


def json_jobs(spark, sf_dir):
    """Image files as JSON jobs and read back again."""
    rows = _paths(spark, sf_dir).where(classify(F.col("path")) == "media")
    job = F.to_json(F.struct(F.lit("image").alias("kind"), F.col("path").alias("payload")))
    return rows.select("path", F.from_json(job, "kind string, payload string").alias("j")).select("path", "j.kind", "j.payload")


def folder_sizes(spark, sf_dir):
    """Documents and characters by folder, with subtotals; one folder holds a tenth of the rows, and sums leave each task before the shuffle."""
    rows = table(spark, sf_dir, "documents").select("folder", F.lower(F.trim("source")).alias("source"), F.char_length("text").cast("long").alias("n"))
    return rows.rollup("source", "folder").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_chars"), F.grouping_id().cast("long").alias("level"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_pool, knn_post_filter, knn_restrict, knn_diversified, media_search, knn_batch, orphan_vectors, stale_models, file_mean_vectors, chunk_fixed, chunk_hashes, chunk_token_aware, snippets, clean_text_lines,
        page_marked_text, pre_token_counts, word_pieces, hash_embedding_norms, index_documents, indexed_tree, found_in_tree, classify_files, size_limits, pruned_directories, ignored_names, gitignored_files, marker_pruned, unchanged_files, upserted_files, replaced_chunks,
        files_without_chunks, missing_from_run, run_counters, file_uris, run_durations, vectors_to_delete, todo_files, file_errors, path_parts, json_jobs, folder_sizes, p2_found,
    )
}

_KNN = """
WITH v AS (SELECT DISTINCT rowid AS rid, embedding FROM {vec} WHERE embedding IS NOT NULL),
q AS (SELECT embedding FROM v WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY rid LIMIT 1),
pool AS (SELECT v.rid, list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance FROM v, q ORDER BY 2, 1 LIMIT 200),
m AS (SELECT embedding_model FROM {child} WHERE embedding_model IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
c AS (SELECT DISTINCT id, file_id, {columns}, embedding_model FROM {child} WHERE id IN (SELECT rid FROM pool)),
f AS (SELECT DISTINCT id, path FROM files),
found AS (SELECT p.rid, p.distance, 1 - p.distance * p.distance / 2 AS score, f.path, c.* EXCLUDE (id, file_id) FROM pool p JOIN c ON c.id = p.rid JOIN f ON f.id = c.file_id WHERE c.embedding_model = (SELECT embedding_model FROM m))
"""
_TEXT = _KNN.format(vec="vec_chunks", child="chunks", columns="chunk_index, start_line, end_line, content")
_MEDIA = _KNN.format(vec="vec_media", child="media_embeddings", columns="frame_index")
_SEEN8 = "seen AS (SELECT path, arg_max(struct_pack(modified_at, file_hash, size_bytes), (scanned_at, scan_id)) AS s FROM file_scans WHERE run_id = {run} AND path IS NOT NULL GROUP BY path)"
_PATHS = "(SELECT DISTINCT path FROM files)"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"lower(regexp_extract({_NAME}, '(\\.[^.]*)$', 1))"
_KIND = f"""CASE WHEN regexp_full_match({_NAME}, '\\.DS_Store|\\.env|\\.env\\.[^/]*') THEN 'none' WHEN {_EXT} IN ({", ".join(repr(e) for e in TEXT_EXTENSIONS)}) THEN 'text' WHEN {_EXT} IN ({", ".join(repr(e) for e in MEDIA_EXTENSIONS)}) THEN 'media' ELSE 'none' END"""
_MB = "CASE " + " ".join(f"WHEN {_EXT} = '.{k}' THEN {v}" for k, v in MB_BY_TYPE.items()) + f" ELSE {DEFAULT_MB} END"
_DIRS = "list_filter(string_split(path, '/')[:-2], lambda x: x <> '')"
_LABEL = "path || ':' || start_line || '-' || end_line"
_FLAT = "trim(regexp_replace({0}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"



def _words(x: str) -> str:
    return r"list_filter(regexp_split_to_array($X, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda w: w <> '')".replace("$X", x)


def _cut(rows: str) -> str:
    """Chunks of (doc_id, text): pos, n is the candidate; it stands once it has 126 words pos most, else it shrinks."""
    return r"""RECURSIVE cut AS (
  SELECT doc_id AS id, text, CAST(1 AS BIGINT) AS pos, CAST(least(500, length(text)) AS BIGINT) AS n, 0 AS k, CAST(1 AS BIGINT) AS line, len($FIRST) AS w FROM $ROWS WHERE length(text) > 0
  UNION ALL
  SELECT id, text, pos, n, k, line, len($NEXT) FROM (
    SELECT id, text, CASE WHEN stands THEN pos + n ELSE pos END AS pos, CASE WHEN stands THEN least(500, length(text) - (pos + n - 1)) ELSE greatest(1, least(n - 1, n * 126 // w)) END AS n, CASE WHEN stands THEN k + 1 ELSE k END AS k,
           CASE WHEN stands THEN line + length(substring(text, pos, n)) - length(replace(substring(text, pos, n), chr(10), '')) ELSE line END AS line
    FROM (SELECT *, n <= 1 OR w <= 126 AS stands FROM cut)) WHERE n > 0
), pieces AS (SELECT id, CAST(k AS INTEGER) AS chunk_index, substring(text, pos, n) AS content, CAST(line AS INTEGER) AS start_line, w,
  CAST(line + length(substring(text, pos, n)) - length(replace(substring(text, pos, n), chr(10), '')) AS INTEGER) AS end_line FROM cut WHERE n <= 1 OR w <= 126)""".replace("$FIRST", _words("substring(text, 1, 500)")).replace("$NEXT", _words("substring(text, pos, n)")).replace("$ROWS", rows)


def _pre_tokens(x: str) -> str:
    """The words and marks of a text in lower case, with control characters dropped and spaces around ideographs."""
    clean = r"regexp_replace(regexp_replace(regexp_replace($X, '([$CJK])', ' \1 ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FFFD}]', '', 'g'), '[\t\n\r\p{Zs}]', ' ', 'g')".replace("$X", x).replace("$CJK", CJK)
    return r"list_filter(string_split(regexp_replace($X, '([!-/:-@\[-`{-~\p{P}])', ' \1 ', 'g'), ' '), lambda x: x <> '')".replace("$X", clean)


_TREE = _cut("(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'CHANGED ' || text ELSE text END AS text FROM documents)")
_CUT = _cut("documents")

ORACLES = {
    "p2_found": P2_FOUND_SQL,
    "knn_pool": _TEXT + "SELECT rid AS rowid, round(distance, 6) AS distance, round(1 - distance * distance / 2, 6) AS score FROM pool",
    "knn_post_filter": _TEXT + "SELECT rid AS rowid, path, chunk_index, start_line, end_line, round(score, 6) AS score FROM found",
    "knn_restrict": _TEXT + f"SELECT rid AS rowid, path, round(score, 6) AS score FROM found WHERE path = '{DIRECTORY}' OR starts_with(path, '{DIRECTORY}/')",
    "knn_diversified": _TEXT + f""", ranked AS (SELECT *, row_number() OVER (ORDER BY distance, rid) AS rk, count(*) OVER () AS n FROM found),
capped AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rk) AS rif FROM ranked),
phased AS (SELECT *, CASE WHEN n <= 5 OR rif <= 2 THEN 0 ELSE 1 END AS phase FROM capped),
picked AS (SELECT * FROM phased ORDER BY phase, rk LIMIT 5)
SELECT rid AS rowid, {_LABEL} AS label, round(score, 6) AS score,
       CASE WHEN length({_FLAT.format('content')}) > 150 THEN left({_FLAT.format('content')}, 150) || '...' ELSE {_FLAT.format('content')} END AS snippet FROM picked""",
    "media_search": _MEDIA + "SELECT rid AS rowid, path, frame_index, round(score, 6) AS score FROM found ORDER BY distance, rid LIMIT 5",
    "knn_batch": """
WITH v AS (SELECT DISTINCT rowid AS rid, CAST(embedding AS DOUBLE[]) AS e FROM vec_chunks WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.rid AS query_id, v.rid AS rowid, list_distance(q.e, v.e) AS distance FROM v AS q, v WHERE q.rid % 50 = 0 AND q.rid <> v.rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, rowid) AS INTEGER) AS rank FROM d)
SELECT query_id, rowid, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""",
    "orphan_vectors": "SELECT DISTINCT v.rowid AS rowid FROM vec_chunks v WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.id = v.rowid)",
    "stale_models": """WITH m AS (SELECT embedding_model FROM chunks WHERE embedding_model IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT coalesce(c.embedding_model = m.embedding_model, false) AS is_current, count(*) AS n_chunks FROM (SELECT DISTINCT id, embedding_model FROM chunks) c, m GROUP BY 1""",
    "file_mean_vectors": """
WITH v AS (SELECT DISTINCT rowid AS rid, embedding FROM vec_chunks WHERE embedding IS NOT NULL), c AS (SELECT DISTINCT id, file_id FROM chunks),
u AS (SELECT c.file_id, unnest(range(384)) AS dim, unnest(CAST(v.embedding AS DOUBLE[])) AS x FROM v JOIN c ON c.id = v.rid),
a AS (SELECT file_id, CAST(dim AS INTEGER) AS dim, avg(x) AS value FROM u GROUP BY 1, 2),
n AS (SELECT file_id, sqrt(sum(value * value)) AS norm FROM a GROUP BY 1)
SELECT a.file_id, a.dim, round(CASE WHEN n.norm = 0 THEN a.value ELSE a.value / n.norm END, 6) AS value FROM a JOIN n USING (file_id)""",
    "chunk_fixed": """
WITH c AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, k, substring(text, k * 500 + 1, 500) AS content, length(substring(text, 1, k * 500)) - length(replace(substring(text, 1, k * 500), chr(10), '')) AS before FROM c)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, content, CAST(1 + before AS INTEGER) AS start_line, CAST(1 + before + length(content) - length(replace(content, chr(10), '')) AS INTEGER) AS end_line FROM p""",
    "chunk_hashes": "SELECT DISTINCT id, sha256(content) AS sha256_hex, sha256(content) = lower(hex(content_hash)) AS is_stored FROM chunks",
    "chunk_token_aware": f"WITH {_CUT} SELECT id AS doc_id, chunk_index, content, start_line, end_line FROM pieces",
    "hash_embedding_norms": f"SELECT doc_id, CASE WHEN len({_words('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents WHERE text IS NOT NULL",
    "index_documents": f"""WITH {_CUT}
SELECT lower(trim(d.lang)) AS lang, count(*) AS n_chunks, round(count(*) FILTER (w > 0) / count(*), 4) AS mean_norm FROM pieces p JOIN documents d ON d.doc_id = p.id GROUP BY 1""",
    "indexed_tree": f"WITH {_TREE} SELECT id || '.txt' AS name, chunk_index, content, start_line, end_line, true AS is_hashed FROM pieces",
    "found_in_tree": f"""WITH {_TREE},
q AS (SELECT list_slice({_words('text')}, 1, 8) AS ws FROM documents WHERE len({_words('text')}) >= 8 AND doc_id % 5 <> 0 ORDER BY doc_id LIMIT 1),
words AS (SELECT id, chunk_index, unnest({_words('lower(content)')}) AS word FROM pieces UNION ALL SELECT -1, 0, unnest({_words("lower(array_to_string(ws, ' '))")}) FROM q),
h AS (SELECT id, chunk_index, CAST('0x' || left(md5(word), 16) AS UBIGINT) AS h FROM words),
v AS (SELECT id, chunk_index, h % 384 AS dim, sum(CASE WHEN h >= 9223372036854775808 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM h GROUP BY 1, 2, 3),
n AS (SELECT id, chunk_index, sqrt(sum(x * x)) AS n FROM v GROUP BY 1, 2),
s AS (SELECT a.id, a.chunk_index, sum(a.x * b.x) AS dot FROM v a JOIN v b ON b.id = -1 AND a.dim = b.dim WHERE a.id >= 0 GROUP BY 1, 2),
c AS (SELECT s.id, s.chunk_index, s.dot / n.n / (SELECT n FROM n WHERE id = -1) AS score FROM s JOIN n USING (id, chunk_index) WHERE n.n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_index) AS rif FROM c)
SELECT round(r.score, 4) AS score FROM r WHERE rif <= 2 ORDER BY r.score DESC LIMIT 5""",
    "pre_token_counts": f"SELECT doc_id, len({_pre_tokens('lower(text)')}) AS n_tokens FROM documents WHERE text IS NOT NULL",
    # greedy longest pieces of a word are the leftmost matches of one pattern
    "word_pieces": r"""WITH p AS (SELECT DISTINCT id, $TOKENS AS ws FROM chunks WHERE content IS NOT NULL),
e AS (SELECT id, flatten(list_transform(ws, lambda w: CASE WHEN length(w) <= 100 AND regexp_full_match(w, '(the|and|[a-z0-9.,-])(ing|ed|[a-z0-9])*')
  THEN list_prepend(regexp_extract(w, '^(the|and|[a-z0-9.,-])'), list_transform(regexp_extract_all(regexp_replace(w, '^(the|and|[a-z0-9.,-])', ''), 'ing|ed|[a-z0-9]'), lambda x: '##' || x)) ELSE ['[UNK]'] END)) AS ts FROM p)
SELECT id, CAST(least(len(ts), 126) + 2 AS BIGINT) AS n_ids, array_to_string(list_concat([2], list_transform(list_slice(ts, 1, 126), lambda t: list_position([$PIECES], t) - 1), [3]), ' ') AS ids FROM e""".replace(
        "$TOKENS", _pre_tokens("strip_accents(lower(content))")).replace("$PIECES", ", ".join(f"'{t}'" for t in PIECES)),
    "snippets": f"SELECT doc_id, CASE WHEN length({_FLAT.format('text')}) > 150 THEN left({_FLAT.format('text')}, 150) || '...' ELSE {_FLAT.format('text')} END AS snippet FROM documents WHERE text IS NOT NULL",
    "clean_text_lines": """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9))) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: x <> '' OR i = 1 OR l[i - 1] <> ''), chr(10)) AS text FROM l""",
    "page_marked_text": """WITH c AS (SELECT DISTINCT id, chunk_index, content FROM chunks WHERE content IS NOT NULL AND file_id IN (SELECT id FROM files WHERE lower(path) LIKE '%.pdf')),
l AS (SELECT id, chunk_index, list_transform(string_split(content, chr(10)), lambda x: rtrim(x, ' ' || chr(9))) AS l FROM c)
SELECT id, '--- page ' || (chunk_index + 1) || ' ---' || chr(10) || array_to_string(list_filter(l, lambda x, i: x <> '' OR i = 1 OR l[i - 1] <> ''), chr(10)) || chr(10) AS page FROM l""",
    "classify_files": f"SELECT path, {_EXT} AS ext, {_KIND} AS kind FROM {_PATHS}",
    "size_limits": f"""WITH s AS (SELECT DISTINCT path, size_bytes FROM file_scans WHERE size_bytes IS NOT NULL),
l AS (SELECT path, size_bytes, CASE WHEN {_EXT} = '.md' THEN 16384 ELSE 0 END AS limit_bytes FROM s)
SELECT path, size_bytes, CAST(limit_bytes AS BIGINT) AS limit_bytes, limit_bytes > 0 AND size_bytes > limit_bytes AS is_too_large FROM l""",
    "pruned_directories": f"SELECT path, len(list_filter({_DIRS}, lambda d: starts_with(d, '.') OR d = 'engine' OR d = 'weird[name' OR regexp_full_match(d, 's[^/]*r|[^/]esk'))) > 0 AS is_pruned FROM {_PATHS}",
    "ignored_names": f"SELECT path, regexp_full_match({_NAME}, '[^/]*_1\\.[^/]*|[a-c][^/]*\\.md|\\.env') AS is_ignored FROM {_PATHS}",
    "gitignored_files": f"""SELECT path, regexp_matches({_NAME}, '\\.log$|draft') OR regexp_matches(substring(path, 7), '(^|/)engine/|^u0001/[^/]+(/|$)') OR regexp_full_match({_NAME}, '!keep\\.md')
 OR len(list_filter({_DIRS}[2:], lambda d: regexp_matches(d, '\\.log$|draft|^!keep\\.md$'))) > 0 AS is_ignored FROM {_PATHS} WHERE starts_with(path, '/home/')""",
    "marker_pruned": f"""WITH p AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM {_PATHS}), m AS (SELECT DISTINCT dir FROM p WHERE {_EXT} = '.toml')
SELECT path, EXISTS (SELECT 1 FROM m WHERE p.dir = m.dir OR starts_with(p.dir, m.dir || '/')) AS is_pruned FROM p""",
    "unchanged_files": f"""WITH {_SEEN8.format(run=8)}, f AS (SELECT path, max(modified_at) AS stored FROM files GROUP BY path)
SELECT seen.path, s.modified_at AS modified_at, coalesce(f.stored = s.modified_at, false) AS unchanged FROM seen LEFT JOIN f USING (path)""",
    "upserted_files": f"""WITH {_SEEN8.format(run=8)}, n AS (SELECT path, s FROM seen WHERE s.file_hash IS NOT NULL)
SELECT path, s.modified_at AS modified_at, lower(hex(s.file_hash)) AS file_hash, 'ok' AS status, CAST(NULL AS VARCHAR) AS last_error FROM n
UNION ALL SELECT DISTINCT path, modified_at, lower(hex(file_hash)), status, last_error FROM files WHERE path NOT IN (SELECT path FROM n)""",
    "replaced_chunks": """WITH n AS (SELECT path, chunk_index, arg_max(content_hash, (scanned_at, scan_id)) AS h FROM chunk_scans WHERE content_hash IS NOT NULL GROUP BY 1, 2),
t AS (SELECT f.id AS file_id, n.chunk_index FROM n JOIN (SELECT DISTINCT id, path FROM files) f USING (path)),
a AS (SELECT file_id, chunk_index FROM (SELECT DISTINCT id, file_id, chunk_index FROM chunks) WHERE file_id NOT IN (SELECT file_id FROM t) UNION ALL SELECT * FROM t)
SELECT file_id, count(*) AS n_chunks, max(chunk_index) AS last_index FROM a GROUP BY 1""",
    "files_without_chunks": "SELECT DISTINCT id, path FROM files WHERE status = 'ok' AND id NOT IN (SELECT file_id FROM chunks WHERE file_id IS NOT NULL)",
    "missing_from_run": f"SELECT path FROM {_PATHS} WHERE path NOT IN (SELECT path FROM file_scans WHERE run_id = 7 AND path IS NOT NULL)",
    "run_counters": f"""WITH {_SEEN8.format(run=8)}, f AS (SELECT path, max(modified_at) AS stored FROM files GROUP BY path),
k AS (SELECT path, count(DISTINCT chunk_index) AS n FROM chunk_scans WHERE content_hash IS NOT NULL GROUP BY 1),
o AS (SELECT path, CASE WHEN {_KIND} = 'none' THEN 'filtered' WHEN s.file_hash IS NULL THEN 'unreadable' WHEN s.size_bytes > ({_MB}) * 1048576 THEN 'too_large'
 WHEN coalesce(stored = s.modified_at, false) THEN 'unchanged' WHEN {_KIND} = 'media' THEN 'media_indexed' ELSE 'indexed' END AS outcome, n FROM seen LEFT JOIN f USING (path) LEFT JOIN k USING (path))
SELECT {", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in ("indexed", "unchanged", "too_large", "filtered", "media_indexed", "media_filtered", "unreadable", "errors"))}, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks_embedded FROM o""",
    "file_uris": f"SELECT path, 'file://' || list_reduce(list_prepend(url_encode(path), ['%2F', '%24', '%26', '%2B', '%2C', '%3A', '%3B', '%3D', '%40']), lambda u, c: replace(u, c, url_decode(c))) AS uri FROM {_PATHS}",
    "run_durations": "SELECT DISTINCT run_id, CASE WHEN date_diff('second', started_at, finished_at) < 60 THEN printf('%4.1fs', CAST(date_diff('second', started_at, finished_at) AS DOUBLE)) ELSE printf('%dm%02ds', date_diff('second', started_at, finished_at) // 60, date_diff('second', started_at, finished_at) % 60) END AS took FROM index_runs WHERE finished_at IS NOT NULL",
    "vectors_to_delete": "SELECT DISTINCT v.rowid AS rowid FROM vec_chunks v WHERE v.rowid IN (SELECT id FROM chunks WHERE file_id IN (SELECT id FROM files WHERE path IN (SELECT path FROM chunk_scans)))",
    "todo_files": f"""WITH {_SEEN8.format(run=8)} SELECT path, s.modified_at AS modified_at FROM seen
WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = seen.path AND f.modified_at = seen.s.modified_at)""",
    "file_errors": """SELECT status, count(*) AS n_files, count(*) FILTER (last_error <> '') AS n_errors, min(path || ': ' || last_error) FILTER (last_error <> '') AS first_error
FROM (SELECT DISTINCT id, path, status, last_error FROM files) GROUP BY status""",
    "path_parts": f"SELECT doc_id, {_NAME} AS name, array_to_string({_DIRS}, '/') AS directory, len({_DIRS}) AS depth FROM documents WHERE path IS NOT NULL",
    "json_jobs": f"SELECT path, 'image' AS kind, path AS payload FROM {_PATHS} WHERE {_KIND} = 'media'",
    "folder_sizes": """SELECT lower(trim(source)) AS source, folder, count(*) AS n_documents, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars, CAST(grouping(lower(trim(source)), folder) AS BIGINT) AS level
FROM documents GROUP BY ROLLUP (lower(trim(source)), folder)""",
}
