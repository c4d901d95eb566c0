"""Token counts under a unigram vocabulary, without building the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.words import raw_texts, text_of

_ENTRIES = 400_000
_LONGEST_KEPT = 64
#: Fixed values of the public unigram rule: mark of a word's start, penalty of an unknown character.
MARK = "▁"
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Best segmentation of a word by the sum of piece scores, carrying only (score, count) per position.

    An automaton lists the vocabulary pieces that end at each position. Ties follow
    the public tokenizer: a candidate must be strictly better than the one found
    from an earlier start, so the longer last piece wins. A character that no
    one-character piece covers costs the least score less 10; it counts as its
    UTF-8 bytes if the vocabulary has ``byte_pieces``, else a run of them as one token.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool = False) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        self._kept: dict[bytes, int] = {}
        solid = rb"[^ \n]" if byte_pieces and not any("\n" in piece for piece, _ in pieces) else rb"[^ ]"
        #: Parts that no piece reaches across: blanks with what follows them, up to a line break that is always bytes.
        self._parts = None
        if not any(MARK in piece.lstrip(MARK) for piece, _ in pieces):
            self._parts = re.compile(rb" *" + solid + rb"+| +")
        self._breaks = self._parts is not None and solid == rb"[^ \n]"

    def word(self, word: str) -> int:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(word):
            ending[last + 1].append((size, score))
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        open_run = [False] * (n + 1)
        for end in range(1, n + 1):
            found = sorted(ending[end], reverse=True)
            top, tokens, run = None, 0, False
            for size, score in found:
                total = score + best[end - size]
                if top is None or total > top:
                    top, tokens, run = total, count[end - size] + 1, False
            if not found or found[-1][0] > 1:
                total = self.unknown + best[end - 1]
                if top is None or total > top:
                    more = len(word[end - 1].encode()) if self.byte_pieces else not open_run[end - 1]
                    top, tokens, run = total, count[end - 1] + more, True
            best[end], count[end], open_run[end] = top, tokens, run
        return count[n]

    def text(self, text: bytes) -> tuple[int, int]:
        """Tokens and words of a text in UTF-8."""
        kept, total = self._kept, 0
        words = text.split()
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.word(MARK + w.decode())
                if len(w) <= _LONGEST_KEPT:
                    if len(kept) >= _ENTRIES:
                        kept.clear()
                    kept[w] = n
            total += n
        return total, len(words)

    def whole(self, text: bytes) -> tuple[int, int]:
        """Tokens of a text in UTF-8 as one string, blanks as marks and a mark before it, and its words."""
        if not text:
            return 0, 0
        kept, total = self._kept, 0
        read = b" " + text.replace(MARK.encode(), b" ")
        if self._breaks:
            total += read.count(b"\n")
        for w in self._parts.findall(read) if self._parts else [read]:
            n = kept.get(w)
            if n is None:
                n = self.word(w.decode().replace(" ", MARK))
                if len(w) <= _LONGEST_KEPT:
                    if len(kept) >= _ENTRIES:
                        kept.clear()
                    kept[w] = n
            total += n
        return total, len(text.split())


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Normal pieces and scores of a sentencepiece file, byte and control pieces left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [
        (sp.id_to_piece(i), sp.get_score(i))
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]


def has_byte_pieces(path: str) -> bool:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return any(sp.is_byte(i) for i in range(sp.get_piece_size()))


def check_text_rules(path: str) -> None:
    """Whole texts are read by the rules of the public file; a file with others is refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError(f"{path} normalizes texts; only files that keep every character and add a start mark are read")


@lru_cache(maxsize=2)
def counter(path: str, whole_text: bool = False) -> UnigramCounter:
    if whole_text:
        check_text_rules(path)
    return UnigramCounter(pieces_of(path), whole_text and has_byte_pieces(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_text: bool = False,
) -> DataFrame:
    """Per row: id, ``n_words`` and ``n_tokens`` under the unigram rule.

    Words are the runs between ASCII blanks. With ``whole_text`` every character
    counts: the text is one string with a start mark and blanks as marks, and
    characters without a piece are bytes. Without it each word takes a start mark,
    blanks count nothing and a run of unknown characters is one token. ``path``
    names a sentencepiece file that every executor has; its pieces and scores are
    the vocabulary. Null and empty texts count 0. Equal rows give equal counts. A
    map over Arrow batches: no shuffle.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, whole_text)
        read = count.whole if whole_text else count.text
        for batch in batches:
            found = [read(t) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([n for n, _ in found], pa.int64()),
                ],
                names=[id_col, "n_words", "n_tokens"],
            )

    rows = docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint")
