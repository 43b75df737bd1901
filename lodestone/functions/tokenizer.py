"""A BERT-style tokenizer: normalise, split, greedy longest-match word pieces, fixed-length encoding."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Code point ranges of CJK ideographs.
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]


_ASCII = {o: None for o in (*range(32), 127)} | {ord(c): " " for c in "\t\n\r"}


def _punctuation(c: str) -> bool:
    o = ord(c)
    return 33 <= o <= 47 or 58 <= o <= 64 or 91 <= o <= 96 or 123 <= o <= 126 or unicodedata.category(c).startswith("P")


class WordPiece:
    """vocab: token -> id, with [CLS], [SEP], [PAD] and [UNK]."""

    def __init__(self, vocab: dict[str, int], max_length: int = 128, lowercase: bool = True, strip_accents: bool | None = None, clean: bool = True, cjk: bool = True, max_word: int = 100):
        missing = [t for t in ("[CLS]", "[SEP]", "[PAD]", "[UNK]") if t not in vocab]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        if max_length < 3:
            raise ValueError("max_length must leave room for a token between [CLS] and [SEP]")
        self.vocab, self.max_length, self.lowercase, self.clean, self.cjk, self.max_word = vocab, max_length, lowercase, clean, cjk, max_word
        self.strip = lowercase if strip_accents is None else strip_accents
        self._known: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> "WordPiece":
        """From a tokenizer.json with a WordPiece model and a BERT normaliser."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = spec.get("normalizer") or {}
        length = (spec.get("truncation") or {}).get("max_length") or 128
        return cls(spec["model"]["vocab"], length, norm.get("lowercase", True), norm.get("strip_accents"), norm.get("clean_text", True), norm.get("handle_chinese_chars", True), spec["model"].get("max_input_chars_per_word", 100))

    @property
    def content_budget(self) -> int:
        return self.max_length - 2

    def normalize(self, text: str) -> str:
        if self.cjk:
            text = "".join(f" {c} " if any(a <= ord(c) <= b for a, b in CJK_RANGES) else c for c in text) if not text.isascii() else text
        if self.clean and text.isascii():
            text = text.translate(_ASCII)
        elif self.clean:
            kept = []
            for c in text:
                if c in "\t\n\r" or unicodedata.category(c) == "Zs":
                    kept.append(" ")
                elif c not in "\0\ufffd" and unicodedata.category(c) != "Cc":
                    kept.append(c)
            text = "".join(kept)
        if self.lowercase and text.isascii():
            text = text.lower()
        elif self.lowercase:
            text = "".join(low if len(low := c.lower()) == 1 else low[0] for c in text)
        if self.strip and not text.isascii():
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        return text

    def words(self, text: str) -> list[str]:
        out: list[str] = []
        for run in text.split():
            if run.isalnum():  # nothing to split off
                out.append(run)
                continue
            word = ""
            for c in run:
                if _punctuation(c):
                    out += [word, c] if word else [c]
                    word = ""
                else:
                    word += c
            if word:
                out.append(word)
        return out

    def pieces(self, word: str) -> list[str]:
        if len(word) > self.max_word:
            return ["[UNK]"]
        out, at = [], 0
        while at < len(word):
            end = len(word)
            while end > at:
                piece = ("##" if at else "") + word[at:end]
                if piece in self.vocab:
                    break
                end -= 1
            if end == at:
                return ["[UNK]"]
            out.append(piece)
            at = end
        return out

    def _pieces_of(self, word: str) -> list[int]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            found = self._known[word] = [self.vocab[t] for t in self.pieces(word)]
        return found

    def tokens(self, text: str) -> list[str]:
        return [t for w in self.words(self.normalize(text)) for t in self.pieces(w)]

    def count(self, text: str) -> int:
        return sum(len(self._pieces_of(w)) for w in self.words(self.normalize(text)))

    def ids(self, text: str) -> list[int]:
        """The ids of a text between [CLS] and [SEP], as many as max_length has room for."""
        out, room = [self.vocab["[CLS]"]], self.max_length - 1
        for w in self.words(self.normalize(text)):
            out += self._pieces_of(w)
            if len(out) >= room:
                break
        return [*out[:room], self.vocab["[SEP]"]]

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(ids, attention mask, type ids), each of max_length."""
        ids = self.ids(text)
        pad = self.max_length - len(ids)
        return ids + [self.vocab["[PAD]"]] * pad, [1] * len(ids) + [0] * pad, [0] * self.max_length


def encode_column(text: Column, tokenizer: WordPiece) -> Column:
    """struct(ids, mask, type_ids) by an Arrow batch at a time; null stays null."""
    length = tokenizer.max_length

    @F.arrow_udf("struct<ids:array<bigint>,mask:array<bigint>,type_ids:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids = np.full((len(texts), length), tokenizer.vocab["[PAD]"], np.int64)
            mask = np.zeros((len(texts), length), np.int64)
            for r, t in enumerate(texts.to_pylist()):
                row = tokenizer.ids(t or "")
                ids[r, : len(row)], mask[r, : len(row)] = row, 1
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * length)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (ids, mask, np.zeros_like(ids))], names=["ids", "mask", "type_ids"])

    return F.when(text.isNotNull(), run(text))
