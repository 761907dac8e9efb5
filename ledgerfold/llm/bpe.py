"""BPE encoding and decoding with word ends, as a public tokenizer file defines
them (NFC, lower case, white space dropped, byte-level symbols).

A word's encoding is a contiguous rank array: the boundaries of its parts and,
for each two adjacent parts, the rank of their merge.  The smallest rank (the
leftmost on ties) is found by a scan, its inner boundary is deleted and the two
neighbouring ranks are looked up again.  Words over ``SHORT`` symbols would make
the scan quadratic; they use a heap of the same ranks over linked parts, with
the same result.

Each task remembers the encodings of frequent words in a table of bounded size.
The tokenizer's tables (their size is the vocabulary's, about 50k entries) are
read on the driver and broadcast.

Word classes and lower case come from the ``regex`` package and from Python's
Unicode tables (15.1); characters assigned in later versions of Unicode may be
split or folded differently from the tokenizers library, all others agree.

Defined results: null text counts as empty; an empty text has no ids and
decodes to the empty text.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerfold.llm.common import batch, positional

SHORT = 128
REMEMBERED = 200_000
NO_RANK = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable
    Latin-1, otherwise the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class Tokenizer:
    """Encoder and decoder of one tokenizer file (model BPE with word ends)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"]
        self.vocab = dict(model["vocab"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.pattern = pattern
        self._ready()

    def _ready(self):
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.words = regex.compile(self.pattern)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("special", "end", "vocab", "ranks", "pattern")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def parts(self, word: str) -> list[str]:
        """The merged parts of one pre-tokenised word."""
        text = "".join(self.symbols[b] for b in word.encode("utf-8"))
        n = len(text)
        text += self.end
        bounds = [*range(n), len(text)]
        if n > SHORT:
            return self._long(text, bounds)
        rank = self.ranks.get
        ranks = [rank((text[bounds[i]:bounds[i + 1]], text[bounds[i + 1]:bounds[i + 2]]), NO_RANK) for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((text[bounds[i]:bounds[i + 1]], text[bounds[i + 1]:bounds[i + 2]]), NO_RANK)
            if i:
                ranks[i - 1] = rank((text[bounds[i - 1]:bounds[i]], text[bounds[i]:bounds[i + 1]]), NO_RANK)
        return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _long(self, text: str, bounds: list[int]) -> list[str]:
        n = len(bounds) - 1
        stop, after, before = bounds[1:], [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(i):
            j = after[i] if i >= 0 else -1
            if j >= 0:
                r = self.ranks.get((text[bounds[i]:stop[i]], text[bounds[j]:stop[j]]))
                if r is not None:
                    heapq.heappush(heap, (r, i, stop[i], stop[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            j = after[i]
            if stop[i] != middle or j < 0 or stop[j] != end:
                continue                                    # one of the parts has changed since
            stop[i], after[i], stop[j] = end, after[j], -1
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(text[bounds[i]:stop[i]])
            i = after[i]
        return out

    def _pieces(self, text: str):
        """Texts between special tokens, and the special tokens."""
        if self.split is None or not any(s in text for s in self.special):
            return [text]
        return [p for p in self.split.split(text) if p]

    def _entry(self, word: str) -> tuple[str, int, str]:
        parts = [p for p in self.parts(word) if p in self.vocab]
        return " ".join(str(self.vocab[p]) for p in parts), len(parts), " ".join(parts)

    def encoded(self, text: str) -> tuple[str, int, str]:
        """(ids in decimal joined by spaces, their number, decoded text)."""
        found = []
        for piece in self._pieces(text):
            if piece in self.special:
                found.append((str(self.special[piece]), 1, piece))
                continue
            # lower() maps a final capital sigma by its context, the tokenizer does not
            words = self.words.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known     # words still in use are taken over from it
            known, older = self.known, self.older
            for word in set(words):
                if word not in known:
                    known[word] = older.get(word) or self._entry(word)
            found += map(known.__getitem__, words)
        if not found:
            return "", 0, ""
        ids, n, tokens = zip(*found, strict=True)
        return " ".join(filter(None, ids)), sum(n), " ".join(filter(None, tokens))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encoded(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces (the file names no decoder)."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def load(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as f:
        return Tokenizer(json.load(f))


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256; with ``ids``
    also the ids themselves and the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields],
              "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if ids else [])]
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches):
        tokenizer = shared.value
        for item in batches:
            for at in range(0, item.num_rows, 256):
                rows = item.slice(at, 256)
                n, id_digests, decoded_digests, id_lists, decoded = [], [], [], [], []
                for value in rows.column(len(keep)):
                    joined, count, tokens = tokenizer.encoded(value.as_py() or "")
                    n.append(count)
                    id_digests.append(digest(joined))
                    decoded_digests.append(digest(tokens))
                    if ids:
                        id_lists.append([int(x) for x in joined.split()])
                        decoded.append(tokens)
                more = [pa.array(id_lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if ids else []
                yield batch(names, [*rows.columns[:len(keep)], pa.array(n, pa.int64()), pa.array(id_digests, pa.string()), pa.array(decoded_digests, pa.string()), *more])

    return positional(docs.select(*keep, text)).mapInArrow(run, ", ".join(schema))
