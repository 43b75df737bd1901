"""Image and text vectors of a CLIP-style model in ONNX files, and the job handler around it."""

from __future__ import annotations

import hashlib
import io
import json
import os
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .schema import MEDIA_WIDTH

# The files of a model folder, image size, colour statistics, and length of a text.
MODEL_FILES = ("vision_model_q4f16.onnx", "text_model_q4f16.onnx", "tokenizer.json")
SIDE, TOKENS = 224, 77
MEAN = np.array([0.48145466, 0.4578275, 0.40821073], np.float32)
STD = np.array([0.26862954, 0.26130258, 0.27577711], np.float32)
DEFAULT_MODEL_ID = "openai/clip-vit-base-patch32-q4f16-onnx"


def missing_files(folder: str) -> list[str]:
    return [f for f in MODEL_FILES if not os.path.exists(os.path.join(folder, f))]


def crop_and_scale(pixels: np.ndarray) -> np.ndarray:
    """Middle SIDE x SIDE of an (h, w, 3) array of bytes, scaled by the colour statistics, as (3, SIDE, SIDE)."""
    h, w = pixels.shape[:2]
    top, left = (h - SIDE) // 2, (w - SIDE) // 2
    middle = pixels[top : top + SIDE, left : left + SIDE].astype(np.float32) / 255.0
    return ((middle - MEAN) / STD).transpose(2, 0, 1)


def resized(width: int, height: int) -> tuple[int, int]:
    """The shorter side becomes SIDE, the longer keeps the ratio, rounded down."""
    return (SIDE, SIDE * height // width) if width <= height else (SIDE * width // height, SIDE)


def preprocess_image(raw: bytes) -> np.ndarray:
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("images need the optional package Pillow") from e
    try:
        import pillow_heif

        pillow_heif.register_heif_opener()
    except ImportError:
        pass
    image = Image.open(io.BytesIO(raw)).convert("RGB")
    return crop_and_scale(np.asarray(image.resize(resized(*image.size), Image.BICUBIC)))


def normalized(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


class ClipEmbedder:
    """Both encoders of a model folder; sessions open lazily in each worker."""

    width, token_budget = MEDIA_WIDTH, TOKENS - 2

    def __init__(self, folder: str, model_id: str = DEFAULT_MODEL_ID):
        if lacking := missing_files(folder):
            raise FileNotFoundError(f"{folder} lacks {', '.join(lacking)}")
        self.folder, self.model_id = folder, model_id
        self._open: dict = {}

    def __getstate__(self):
        return {"folder": self.folder, "model_id": self.model_id, "_open": {}}

    def _session(self, name: str):
        import onnxruntime

        if name not in self._open:
            self._open[name] = onnxruntime.InferenceSession(os.path.join(self.folder, name), providers=["CPUExecutionProvider"])
        return self._open[name]

    def embed_images(self, raws: list[bytes]) -> np.ndarray:
        session = self._session(MODEL_FILES[0])
        return normalized(session.run(None, {session.get_inputs()[0].name: np.stack([preprocess_image(r) for r in raws])})[0])

    def _encode(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        if "tokenizer" not in self._open:
            self._open["tokenizer"] = Tokenizer.from_file(os.path.join(self.folder, MODEL_FILES[2]))
        return padded(self._open["tokenizer"].encode(text).ids)

    def embed(self, texts: list[str]) -> np.ndarray:
        session = self._session(MODEL_FILES[1])
        return normalized(session.run(None, {session.get_inputs()[0].name: np.array([self._encode(t) for t in texts], np.int64)})[0])

    def count_tokens(self, text: str) -> int:
        return len(self._encode(text))


def padded(ids: list[int]) -> list[int]:
    """Cut to TOKENS, keeping the last id as the end mark, and padded with 0."""
    ids = ids if len(ids) <= TOKENS else [*ids[: TOKENS - 1], ids[-1]]
    return ids + [0] * (TOKENS - len(ids))


def image_function(embedder: ClipEmbedder):
    """The function that index_directory takes as media: one bad image has its error, others go on."""

    def run(listing: DataFrame) -> DataFrame:
        def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in source:
                out: list[tuple] = []
                for path in b.column(0).to_pylist():
                    try:
                        with open(path, "rb") as f:
                            raw = f.read()
                        out.append((path, embedder.embed_images([raw])[0].tolist(), hashlib.sha256(raw).digest(), embedder.model_id, None))
                    except Exception as e:  # noqa: BLE001 - belongs to its file alone
                        out.append((path, None, None, embedder.model_id, f"{type(e).__name__}: {e}"))
                kinds = [pa.string(), pa.list_(pa.float32()), pa.binary(), pa.string(), pa.string()]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "embedding", "file_hash", "model", "error"])

        return listing.select("path").mapInArrow(read, "path string, embedding array<float>, file_hash binary, model string, error string")

    return run


def handle(job: dict, embedder: ClipEmbedder | None, dummy: bool = False) -> dict:
    """One job {id, kind, payload} to {id, embedding, error}; a job without a kind is an image. Without a model: zeros in dummy mode, else an error."""
    out = {"id": job.get("id"), "embedding": None, "error": None}
    if embedder is None and not dummy:
        return out | {"error": "no model folder"}
    if dummy:
        return out | {"embedding": [0.0] * MEDIA_WIDTH}
    if not job.get("payload"):
        return out | {"error": "no payload"}
    try:
        if (job.get("kind") or "image") == "image":
            with open(job["payload"], "rb") as f:
                return out | {"embedding": embedder.embed_images([f.read()])[0].tolist()}
        if job.get("kind") == "text":
            return out | {"embedding": embedder.embed([job["payload"]])[0].tolist()}
        return out | {"error": f"unknown kind {job.get('kind')!r}"}
    except Exception as e:  # noqa: BLE001 - a job's failure is its answer
        return out | {"error": str(e)}


def serve(lines: Iterable[str], embedder: ClipEmbedder | None, dummy: bool = False) -> Iterator[str]:
    """Answers to JSON lines, in their order. Blank lines are skipped; one that isn't JSON has an error without id."""
    for line in lines:
        if not line.strip():
            continue
        try:
            job = json.loads(line)
            if not isinstance(job, dict):
                raise ValueError("a job must be an object")
        except ValueError as e:
            yield json.dumps({"id": None, "embedding": None, "error": f"bad job: {e}"})
            continue
        yield json.dumps(handle(job, embedder, dummy))


def main(args: list[str]) -> int:
    """image <file> [--model-dir=DIR] prints the width and the vector; without arguments, jobs come from standard input."""
    folder = next((a.partition("=")[2] for a in args if a.startswith("--model-dir=")), "")
    embedder = ClipEmbedder(folder) if folder else None
    if args[:1] == ["image"] and len(args) > 1:
        answer = handle({"id": "image", "kind": "image", "payload": args[1]}, embedder)
        print(answer["error"] if answer["error"] else f"{len(answer['embedding'])} {answer['embedding']}")
        return int(bool(answer["error"]))
    for line in serve(sys.stdin, embedder):
        print(line, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
