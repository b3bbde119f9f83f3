"""Token counts by count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F


SPACE = "▁"
#: An unknown character costs this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
WORDS = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file, in id order (control and byte pieces left out)."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return [(p.piece, p.score) for p in proto.pieces if p.type == 1]


class UnigramCounter:
    """Piece counts of best segmentations.

    Spaces become ``▁``, and a text that doesn't begin with one gets one. A text is cut only where no piece can cross: before the marks that precede a
    word, so a run of marks is segmented with the word behind it. A character that no piece holds splits a word further, since every path passes it alone.
    Aho-Corasick lists all pieces that end at each character, longest first; dynamic programming keeps the best score
    and its piece count. A later candidate must be strictly better, so of equal
    segmentations the one with the longest last piece wins, as in the tokenizer. A character without
    a piece of its own may be passed as unknown at the worst score less ``UNKNOWN_PENALTY``; it counts as its UTF-8
    bytes with ``byte_fallback``, else a run of such characters counts as one. Words of up to ``short`` characters are remembered, at most ``memory`` of them.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, memory: int = 200_000, short: int = 64):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        letters = "".join(sorted({c for p, _ in vocabulary for c in p}))
        self.foreign = regex.compile(f"[^{regex.escape(letters)}]+") if letters else regex.compile(r"(?s).+")
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback, self.memory, self.short = byte_fallback, memory, short
        self.seen: dict[str, int] = {}
        if any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary):
            raise ValueError("a vocabulary piece crosses a word boundary")

    def best(self, word: str) -> int:
        """Pieces of the best segmentation of one word whose characters are all in the alphabet."""
        n, single, worst = len(word), self.single, -math.inf
        score, count, alone = array("d", [0.0]), array("q", [0]), bytearray(n + 1)
        found = self.automaton.iter(word)
        end, match = next(found, (n, None))
        for at in range(n):
            top, pieces = worst, 0
            while end == at:
                size, value = match
                value += score[at + 1 - size]
                if value > top:
                    top, pieces = value, count[at + 1 - size] + 1
                end, match = next(found, (n, None))
            if word[at] not in single:
                value = score[at] + self.unknown
                if value > top:
                    fused = alone[at] and not self.byte_fallback
                    more = len(word[at].encode("utf-8", "replace")) if self.byte_fallback else 0 if fused else 1
                    top, pieces, alone[at + 1] = value, count[at] + more, 1
            score.append(top)
            count.append(pieces)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, seen = 0, self.seen
        marked = text.replace(" ", SPACE)
        if not marked.startswith(SPACE):
            marked = SPACE + marked
        for m in WORDS.finditer(marked):
            word = m[0]
            got = seen.get(word)
            if got is None:
                got = self._word(word)
                if len(word) <= self.short:
                    if len(seen) >= self.memory:
                        seen.clear()
                    seen[word] = got
            total += got
        return total

    def _word(self, word: str) -> int:
        if not self.byte_fallback:
            return self.best(word)
        total, last = 0, 0
        for m in self.foreign.finditer(word):
            if m.start() > last:
                total += self.best(word[last : m.start()])
            total += len(m[0].encode("utf-8", "replace"))
            last = m.end()
        return total + (self.best(word[last:]) if last < len(word) else 0)


def token_counts(
    docs: DataFrame, vocabulary: str | list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True
) -> DataFrame:
    """(doc_id, n_tokens) for every row, over whole texts. Null and empty texts have 0 tokens; rows that repeat count alike.

    ``vocabulary`` is a model file's path or (piece, score) pairs. Words are remembered within a worker, in bounded memory.
    """
    pieces = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(pieces, byte_fallback)
        for batch in batches:
            counts = np.array([counter.count(t) for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["doc_id", "n_tokens"])

    return slim.mapInArrow(work, f"doc_id {slim.schema[0].dataType.simpleString()}, n_tokens long")
