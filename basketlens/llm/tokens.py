"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and a Viterbi that carries score and count.

Semantics (`Counter`, `token_counts`)
    The text is normalised as the vocabulary's tokenizer does: spaces become U+2581 and one is put before a text that is
    not empty. The count is that of the segmentation with the greatest sum of piece scores. Tie rules: segments are tried
    by their start, and a later one replaces an earlier one only if its score is greater, so of equal scores the one whose
    last piece starts first (is longest) stays. A code point that no piece of one code point covers may stand alone with
    UNKNOWN less than the least score; it counts as one piece for each of its UTF-8 bytes if the vocabulary has byte
    pieces, else neighbouring ones count as one. Null and empty texts have no tokens and score 0. Rows are counted on
    their own, repeated rows agree, other columns pass through, an empty table gives an empty result.

No piece but a run of U+2581 itself holds that character behind another, so the best segmentation of a text is that of
its runs of U+2581 and of the words they open, each apart; a task keeps the counts of words that it has seen, up to
CACHE of them, and forgets them all when they are more. The vocabulary is read on the driver, checked against
VOCABULARY_LIMIT and broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm.text_hash import released

SPACE = "▁"
UNKNOWN = 10.0
CACHE = 300_000
VOCABULARY_LIMIT = 2_000_000
#: Where the public tokenizers are installed; a parameter of `token_counts`.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Vocabulary:
    pieces: dict[str, float]
    has_bytes: bool

    @cached_property
    def counter(self) -> Counter:
        """One counter a worker: it lives as long as the broadcast vocabulary, so tasks that follow find known words."""
        return Counter(self)


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Scores of the ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > VOCABULARY_LIMIT:
        raise ValueError(f"{n} pieces are too many to broadcast")
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in plain}, any(model.is_byte(i) for i in range(n)))


class Counter:
    """Counts pieces of whole texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces, self.has_bytes = vocabulary.pieces, vocabulary.has_bytes
        self.unknown = min(vocabulary.pieces.values(), default=0.0) - UNKNOWN
        # a word is cut off where a run of spaces opens it; pieces that hold a space inside would reach over the cut
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces)
        self.seen: dict[str, tuple[float, int]] = {}

    def best(self, chunk: str) -> tuple[float, int]:
        """Score and count of the best segmentation of a chunk."""
        n = len(chunk)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (size, score) in self.automaton.iter(chunk):
            ending[end + 1].append((size, score))
        scores, counts, lone = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            # longest first: of equal scores the piece that starts first stays
            top, count, single, unknown = None, 0, False, False
            for size, score in sorted(ending[end], reverse=True):
                single = single or size == 1
                s = scores[end - size] + score
                if top is None or s > top:
                    top, count = s, counts[end - size] + 1
            if not single:
                s = scores[end - 1] + self.unknown
                if top is None or s > top:
                    top, unknown = s, True
                    if self.has_bytes:
                        count = counts[end - 1] + len(chunk[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        count = counts[end - 1] + (not lone[end - 1])
            scores[end], counts[end], lone[end] = top, count, unknown
        return scores[n], counts[n]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.apart or not self.has_bytes:  # unknown runs join over chunks where they count as one
            return self.best(text)
        total, count, seen = 0.0, 0, self.seen
        for chunk in _CHUNK.findall(text):
            found = seen.get(chunk)
            if found is None:
                if len(seen) >= CACHE:
                    seen.clear()
                found = seen[chunk] = self.best(chunk)
            total += found[0]
            count += found[1]
        return total, count


_RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])


def count_udf(documents: DataFrame, vocabulary: Vocabulary):
    """Column function over a text: (n_tokens, score)."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(_RESULT)
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = sent.value.counter
        for t in released(texts):
            found = [counter.count(x.as_py()) for x in t]
            yield pa.StructArray.from_arrays([pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], ["n_tokens", "score"])

    return count


def token_counts(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, score for every row."""
    counted = documents.select("doc_id", count_udf(documents, read_vocabulary(model))(F.col("text")).alias("c"))
    return counted.select("doc_id", "c.n_tokens", "c.score")
