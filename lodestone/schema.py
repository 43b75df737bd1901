"""Schemas of the index tables and default settings."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("modified_at", T.LongType()),
    T.StructField("file_hash", T.BinaryType()), T.StructField("status", T.StringType()), T.StructField("last_error", T.StringType()),
])
CHUNKS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("file_id", T.LongType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()),
    T.StructField("content_hash", T.BinaryType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("embedding_model", T.StringType()),
])
VEC_CHUNKS = T.StructType([T.StructField("rowid", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
MEDIA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("file_id", T.LongType()), T.StructField("frame_index", T.IntegerType()), T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()), T.StructField("content_hash", T.BinaryType()), T.StructField("embedding_model", T.StringType()),
])
VEC_MEDIA = VEC_CHUNKS
TABLES = {"files": FILES, "chunks": CHUNKS, "vec_chunks": VEC_CHUNKS, "media_embeddings": MEDIA, "vec_media": VEC_MEDIA}

TEXT_WIDTH, MEDIA_WIDTH = 384, 512
# Fixed values of the search and of chunking.
CHUNK_RUNES, POOL, MAX_RESULTS, MAX_PER_FILE, SNIPPET_RUNES = 500, 200, 5, 2, 150
