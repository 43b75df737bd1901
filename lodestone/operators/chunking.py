"""Chunks of a fixed number of code points, and chunks that also keep within a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import line_breaks
from ..schema import CHUNK_RUNES


def fixed_chunks(texts: DataFrame, id_col: str, text_col: str, runes: int = CHUNK_RUNES) -> DataFrame:
    """(id, chunk_index, content, start_line, end_line): every `runes` code points; null and empty texts have
    none. A chunk that ends in a line break ends in the next line."""
    if runes <= 0:
        raise ValueError("the chunk size must be positive")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.char_length("text") > 0)
    # cut once into an array, so that the cost stays linear in the text
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{runes}}}"), F.lit(0))
    cut = rows.select("id", pieces.alias("pieces"))
    # line breaks before each piece, as a running sum within the row: nothing is shuffled
    breaks = F.transform("pieces", line_breaks)
    before = F.aggregate(breaks, F.array(F.lit(1)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    zipped = F.zip_with("pieces", F.slice(before, F.lit(1), F.size("pieces")), lambda p, n: F.struct(p.alias("content"), n.alias("start_line")))
    out = cut.select("id", F.posexplode(zipped).alias("chunk_index", "c")).select("id", "chunk_index", "c.content", "c.start_line")
    return out.withColumn("end_line", F.col("start_line") + line_breaks(F.col("content")))


def token_chunks(texts: DataFrame, id_col: str, text_col: str, count_tokens: Callable[[str], int] | None, max_tokens: int, runes: int = CHUNK_RUNES) -> DataFrame:
    """Like fixed_chunks with lines, each chunk also within max_tokens of count_tokens. A candidate that is too
    large is scaled by max_tokens / tokens, by one code point at least, down to a single one."""
    if runes <= 0:
        raise ValueError("the chunk size must be positive")
    id_type = texts.schema[id_col].dataType.simpleString()

    def fit(text: str, at: int) -> int:
        n = min(runes, len(text) - at)
        if not count_tokens or max_tokens <= 0:
            return n
        while n > 1:
            tokens = count_tokens(text[at : at + n])
            if tokens <= max_tokens:
                break
            n = max(1, min(n - 1, n * max_tokens // tokens))
        return n

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, k, line = 0, 0, 1
                while text and at < len(text):
                    piece = text[at : at + fit(text, at)]
                    end = line + piece.count("\n")
                    for c, v in zip(out, (i, k, piece, line, end)):
                        c.append(v)
                    at, k, line = at + len(piece), k + 1, end
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32())],
                                             names=["id", "chunk_index", "content", "start_line", "end_line"])

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {id_type}, chunk_index int, content string, start_line int, end_line int")
