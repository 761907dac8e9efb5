"""Public tokenizers as executors use them: files are read on the driver, and
their tables (their size is the vocabulary's) are broadcast.

``ByteLevel`` is a byte-level BPE file of the tokenizers library; ``Pieces`` a
sentencepiece model.  ``ByteLevel`` encodes with tiktoken from the same entries,
as it is three times as fast: both split by the same pattern, classify every
Unicode character alike (checked for all of them) and merge by the entries'
ranks, so ids are equal (tests compare them with the tokenizers library).
"""

from __future__ import annotations

import json

import numpy as np
import sentencepiece
import tiktoken

from ledgerfold.llm.bpe import byte_symbols

#: Fixed value: how byte-level BPE files of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Byte-level BPE.  ``special``: whether special tokens' strings inside a
    text become special tokens or are plain text."""

    def __init__(self, path: str, special: bool):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {symbol: b for b, symbol in enumerate(byte_symbols())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.special = added if special else {}
        self._ready()

    def _ready(self):
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.bytes = [b""] * (1 + max([*self.ranks.values(), *self.special.values()]))
        for token, i in [*self.ranks.items(), *((s.encode("utf-8"), i) for s, i in self.special.items())]:
            self.bytes[i] = token

    def __getstate__(self):
        return self.ranks, self.special

    def __setstate__(self, state):
        self.ranks, self.special = state
        self._ready()

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        one = self.encoding.encode_ordinary
        return [one(t) for t in texts]


class Pieces:
    """A sentencepiece model; texts get the space that it adds in front."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = f.read()
        self._ready()

    def _ready(self):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        p = self.processor
        self.bytes = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode("utf-8")
                      for i in range(p.get_piece_size())]

    def __getstate__(self):
        return self.model

    def __setstate__(self, state):
        self.model = state
        self._ready()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1) if texts else []
