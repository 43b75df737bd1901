"""Token counts of a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the word pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, id_col: str, text_col: str, keep: list[str] = [], vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, n_tokens) of every row; a null text has null, an empty one 0. Whole texts are encoded."""
    columns = [F.col(id_col).alias("id"), *keep]
    schema = texts.select(*columns, F.lit(None).cast("int").alias("n_tokens")).schema

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in source:
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], names=[*b.schema.names[:-1], "n_tokens"])

    return texts.select(*columns, F.col(text_col).alias("__text")).mapInArrow(count, schema)
