"""Byte-pair encoding and decoding of whole texts with a given public vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.words import raw_texts, text_of

_ENTRIES = 100_000
_LONGEST_KEPT = 64
#: Chunks of these characters are in composed form, lower-case one to one, and need no library call.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ſ]+")
#: Fixed value: the file's own split rule, over those characters in lower case.
_PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def merged(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to a symbol list, least rank first and leftmost among equals.

    The symbols form a doubly linked list; a heap holds (rank, place, pair). An
    entry is stale, and skipped, if its place no longer starts that pair.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    after = list(range(1, n)) + [-1]
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if found := ranks.get((symbols[i], symbols[i + 1])):
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if found := ranks.get((new, symbols[k])):
                heapq.heappush(heap, (found[0], i, new, symbols[k], found[1]))
        h = before[i]
        if h >= 0 and (found := ranks.get((symbols[h], new))):
            heapq.heappush(heap, (found[0], h, symbols[h], new, found[1]))
    return [s for s in symbols if s >= 0]


class Recent:
    """Bounded memory of computed values; what was not asked for in the last two fillings is forgotten."""

    def __init__(self, entries: int) -> None:
        self.entries, self.young, self.old = entries, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(key) > _LONGEST_KEPT:
            return
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def clear(self) -> None:
        self.young, self.old = {}, {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """A tokenizer file: its merges are applied here, its text rules by the library that reads the file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") is not None:
            raise ValueError("a BPE vocabulary without a decoder is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        rules = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = rules.normalizer, rules.pre_tokenizer
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain = split == _RULE and self.normalizer is not None
        self._shown = byte_symbols()
        self._chunks, self._words = Recent(_ENTRIES), Recent(_ENTRIES)

    def _pieces(self, chunk: str) -> Iterator[str | int]:
        """Parts of a chunk in order: ids of added tokens, and texts between them."""
        while chunk:
            at = [(chunk.find(s), -len(s), s) for s in self.added if s in chunk]
            if not at:
                yield chunk
                return
            start, _, found = min(at)
            if start:
                yield chunk[:start]
            yield self.added[found]
            chunk = chunk[start + len(found) :]

    def _word(self, word: str) -> list[int]:
        """Ids of one word, given in byte-level characters."""
        found = self._words.get(word)
        if found is None:
            symbols = [*word[:-1], word[-1] + self.end]
            found = merged([self.ids[s] for s in symbols if s in self.ids], self.ranks)
            self._words.put(word, found)
        return found

    def _encoded(self, chunk: str) -> tuple[bytes, bytes]:
        ids: list[int] = []
        if self.plain and _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            for word in _PLAIN_SPLIT.findall(chunk.lower()):
                ids += self._word(word if word.isascii() else "".join([self._shown[b] for b in word.encode()]))
        else:
            for piece in self._pieces(chunk):
                if isinstance(piece, int):
                    ids.append(piece)
                    continue
                for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(piece)):
                    ids += self._word(word)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode("utf-8")

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings put together, one space between them as the file names no decoder."""
        return " ".join([self.strings[i] for i in ids])

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded text, both texts in UTF-8.

        The text rules never join across ASCII blanks, so the chunks between them
        are encoded one by one and those seen lately are kept.
        """
        kept, ids, decoded = self._chunks, [], []
        young = kept.young
        for chunk in text.split():
            found = young.get(chunk)
            if found is None:
                found = kept.get(chunk)
                if found is None:
                    found = self._encoded(chunk.decode())
                    kept.put(chunk, found)
                young = kept.young
            if found[0]:
                ids.append(found[0])
                decoded.append(found[1])
        return b"".join(ids), b" ".join(decoded)

    def forget(self) -> None:
        """Drop the computed values; a Python worker outlives its task and serves later stages."""
        self._chunks.clear()
        self._words.clear()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")



def bpe(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Encode and decode every whole text: id, ``n_tokens``, then ``ids`` and ``decoded`` or, if asked, their SHA-256.

    ``path`` names a tokenizer file that every executor has. A null or empty text
    has no tokens and decodes to the empty text. Equal rows give equal results; an
    empty table gives none. A map over Arrow batches: no shuffle, and a lost task
    is simply run again.
    """
    path = path or default_path()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        try:
            for batch in batches:
                n_tokens, left, right = [], [], []
                for text in raw_texts(batch.column(1)):
                    ids, decoded = vocab.encode(text)
                    n_tokens.append(len(ids) // 4)
                    left.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<u4").astype(np.int32))
                    right.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(n_tokens, pa.int64()),
                        pa.array(left, pa.string() if digests else pa.list_(pa.int32())),
                        pa.array(right, pa.string()),
                    ],
                    names=[id_col, "n_tokens", *[c.split()[0] for c in tail.split(", ")]],
                )
        finally:
            vocab.forget()

    rows = docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {tail}")


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return bpe(docs, path, id_col, text_col, digests=True)
