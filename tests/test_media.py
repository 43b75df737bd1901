import json

import numpy as np
import pytest

from lodestone import media


def test_pixels():
    pixels = np.full((300, 224, 3), 255, np.uint8)
    out = media.crop_and_scale(pixels)
    assert out.shape == (3, 224, 224) and np.allclose(out[:, 0, 0], (1 - media.MEAN) / media.STD)
    assert media.resized(100, 201) == (224, 450) and media.resized(401, 200) == (449, 224)


def test_padding_and_length():
    assert media.padded([1, 2]) == [1, 2] + [0] * 75
    assert media.padded(list(range(100)))[-1] == 99 and len(media.padded(list(range(100)))) == 77
    assert not media.normalized(np.zeros((1, 3), np.float32)).any()


def test_missing_files(tmp_path):
    with pytest.raises(FileNotFoundError, match="vision_model_q4f16.onnx, text_model_q4f16.onnx, tokenizer.json"):
        media.ClipEmbedder(str(tmp_path))


class Fake:
    def embed(self, texts):
        return np.array([[1.0, 2.0]])

    def embed_images(self, raws):
        raise ValueError("not an image")


def test_jobs(tmp_path):
    (tmp_path / "x.png").write_bytes(b"x")
    lines = ['{"id": "1", "kind": "text", "payload": "q"}', "", "no json", '{"id": "2", "kind": "image", "payload": "%s"}' % (tmp_path / "x.png"), '{"id": "3", "kind": "video", "payload": "x"}', '{"id": "4", "kind": "text"}', "[]"]
    got = [json.loads(x) for x in media.serve(lines, Fake())]
    assert [(g["id"], g["embedding"], bool(g["error"])) for g in got] == [("1", [1.0, 2.0], False), (None, None, True), ("2", None, True), ("3", None, True), ("4", None, True), (None, None, True)]
    (tmp_path / "y.png").write_bytes(b"y")
    assert media.handle({"id": "5", "payload": str(tmp_path / "y.png")}, Fake())["error"] == "not an image"  # without a kind it's an image
    assert len(media.handle({"id": "1"}, None, dummy=True)["embedding"]) == 512 and media.handle({"id": "1"}, None)["error"]
