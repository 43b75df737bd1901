"""Embedders: the interface, a deterministic hashing one, and ONNX models where files are configured."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .functions.tokenizer import WordPiece


class Embedder(Protocol):
    """Vectors in the order of the texts. Instances are pickled to the workers, so models open lazily."""

    model_id: str
    width: int
    token_budget: int

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def count_tokens(self, text: str) -> int: ...


class HashEmbedder:
    """Bag of hashed words, of length 1; for tests and where no model is configured."""

    def __init__(self, width: int = 384, token_budget: int = 126):
        self.width, self.token_budget, self.model_id = width, token_budget, f"hash-{width}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for r, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "big")
                out[r, h % self.width] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def count_tokens(self, text: str) -> int:
        return len(text.split())


class OnnxEmbedder:
    """A text encoder with last_hidden_state, mean-pooled over the attention mask and normalised."""

    def __init__(self, model_path: str, tokenizer_path: str, batch_size: int = 32):
        self.model_path, self.tokenizer_path, self.batch_size = model_path, tokenizer_path, batch_size
        digest = hashlib.sha256()
        with open(model_path, "rb") as f:
            for block in iter(lambda: f.read(1 << 20), b""):
                digest.update(block)
        self.model_id = digest.hexdigest()
        self._open()
        self.token_budget = self._tokenizer.content_budget

    def _open(self) -> None:
        import onnxruntime

        self._tokenizer = WordPiece.load(self.tokenizer_path)
        self._session = onnxruntime.InferenceSession(self.model_path, providers=["CPUExecutionProvider"])
        shapes = {o.name: o.shape for o in self._session.get_outputs()}
        if "last_hidden_state" not in shapes or not isinstance(shapes["last_hidden_state"][-1], int):
            raise ValueError("the model has no last_hidden_state of a known width")
        self.width = shapes["last_hidden_state"][-1]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_session", "_tokenizer")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def count_tokens(self, text: str) -> int:
        return self._tokenizer.count(text)

    def embed(self, texts: list[str]) -> np.ndarray:
        out, size = [], self.batch_size if self.batch_size > 0 else max(1, len(texts))
        for s in range(0, len(texts), size):
            ids, mask, types = (np.array(x, np.int64) for x in zip(*map(self._tokenizer.encode, texts[s : s + size])))
            hidden = self._session.run(["last_hidden_state"], {"input_ids": ids, "attention_mask": mask, "token_type_ids": types})[0]
            out.append(mean_pool(hidden, mask))
        return np.concatenate(out) if out else np.zeros((0, self.width), np.float32)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens of the mask, then length 1; rows without tokens stay zero."""
    m = mask[:, :, None].astype(np.float32)
    pooled = (hidden * m).sum(1) / np.maximum(m.sum(1), 1)
    norm = np.linalg.norm(pooled, axis=1, keepdims=True)
    return np.divide(pooled, norm, out=pooled, where=norm > 0)


def embed_column(rows: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding") -> DataFrame:
    """Adds the vectors of a text column, an Arrow batch at a time."""
    schema = rows.withColumn(out_col, F.lit(None).cast("array<float>")).schema
    at = rows.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            v = embedder.embed([t or "" for t in b.column(at).to_pylist()]).astype(np.float32)
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * embedder.width
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, schema)
