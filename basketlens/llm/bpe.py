"""Byte-level BPE with the tiktoken library and a local rank file: whole texts to ids and back to their bytes.

Semantics (`encoded`, `decoded`)
    `ids` has the ids that tiktoken's `encode_ordinary` gives for the text: the pattern cuts the text into matches, each is
    merged on its own by the ranks, and strings of special tokens are ordinary text. They are packed as little-endian
    unsigned 32-bit integers, as token files are; `unpacked` gives an array. `decoded` joins the bytes of the ids again; for
    every valid text these are the text's UTF-8 bytes. A null text is encoded as an empty one; bytes that are no UTF-8 are
    read as U+FFFD. Rows are encoded on their own, so repeated rows agree; other columns pass through, whatever their names;
    an empty table gives an empty result. Decoding null ids gives null, unknown ids raise an error.

Long texts
    A text of over PART code points is encoded in parts that end where a match ends whatever follows: between anything but
    white space and white space, and between letters, digits and punctuation of the scripts in LETTERS and PUNCTUATION (not
    before a letter that follows punctuation, which may be a contraction). The pattern lets a run of white space match but
    for its last code point if something follows; over long runs its look-ahead would exhaust the library's stack, so a run
    of RUN and more is cut out and merged as the one match that it is.

The rank file is read on the driver, checked against RANKS_LIMIT and broadcast; each worker builds one encoding from it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.shared import free_name
from basketlens.llm.text_hash import released

PART, RUN = 1 << 15, 1 << 10
RANKS_LIMIT = 1_000_000

#: The code points of the Unicode property White_Space.
SPACES = "\x09\x0a\x0b\x0c\x0d\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and punctuation by blocks that no version of Unicode changes; any others just offer no place to cut.
LETTERS = "A-Za-zÀ-ÖØ-öα-ωА-яあ-んア-ン一-龥가-힣"
PUNCTUATION = r"!-/:-@\[-`{-~、。，"

_CUT = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])|(?<=[{LETTERS}])(?=[0-9{PUNCTUATION}])|(?<=[0-9])(?=[{LETTERS}{PUNCTUATION}])")
_RUN = re.compile(f"[{SPACES}]{{{RUN},}}")


@dataclass
class Ranks:
    """Merge ranks and the pattern that cuts a text before the merges."""

    ranks: dict[bytes, int]
    pattern: str

    @cached_property
    def codec(self) -> Codec:
        """One a worker: it lives as long as the broadcast ranks."""
        return Codec(self)


def read_ranks(path: str | None = None, pattern: str | None = None) -> Ranks:
    """A rank file: each line has a token's bytes in base 64 and its rank. By default the public 50k vocabulary and its pattern."""
    import public_tokenizers

    ranks: dict[bytes, int] = {}
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        for line in lines:
            if fields := line.split():
                ranks[base64.b64decode(fields[0])] = int(fields[1])
            if len(ranks) > RANKS_LIMIT:
                raise ValueError(f"over {RANKS_LIMIT} ranks are too many to broadcast")
    return Ranks(ranks, pattern or public_tokenizers.PATTERN)


def parts(text: str, part: int = PART) -> Iterator[tuple[str, bool]]:
    """The text in pieces that are encoded apart with the same ids; the flag says that a piece is one match."""
    begin = 0

    def cut(end: int) -> Iterator[tuple[str, bool]]:
        at = begin
        while at < end:
            place = _CUT.search(text, at + part, end) if end - at > part else None
            upto = place.start() if place else end
            yield text[at:upto], False
            at = upto

    for run in _RUN.finditer(text) if len(text) > part else ():
        yield from cut(run.start())
        begin = run.end() - (run.end() < len(text))
        yield text[run.start() : begin], True
    yield from cut(len(text))


class Codec:
    """Encodes and decodes with one rank file."""

    def __init__(self, ranks: Ranks):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=ranks.pattern, mergeable_ranks=ranks.ranks, special_tokens={})

    def encode(self, text: str, part: int = PART) -> bytes:
        found = [self.encoding._encode_single_piece(p) if one else self.encoding.encode_ordinary(p) for p, one in parts(text, part)]
        return b"".join(np.array(ids, dtype="<u4").tobytes() for ids in found)

    def decode(self, packed: bytes) -> bytes:
        return self.encoding.decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())


def encoded(documents: DataFrame, ranks: Ranks, text: str = "text") -> DataFrame:
    """Every row with a further column `ids` (with a `_` behind where the name is taken)."""
    sent = documents.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = sent.value.codec
        for t in released(texts):
            yield pa.array([codec.encode((x.as_py() or b"").decode("utf-8", "replace")) for x in t], pa.binary())

    return documents.withColumn(free_name(documents, "ids"), encode(F.col(f"`{text}`").cast("binary")))


def decoded(tokens: DataFrame, ranks: Ranks, ids: str = "ids") -> DataFrame:
    """Every row with a further column `bytes` (with a `_` behind where the name is taken), from the packed ids."""
    sent = tokens.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def decode(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = sent.value.codec
        for p in released(packed):
            yield pa.array([codec.decode(x.as_py()) if x.is_valid else None for x in p], pa.binary())

    return tokens.withColumn(free_name(tokens, "bytes"), decode(F.col(f"`{ids}`")))


def count(ids: Column) -> Column:
    """How many ids are packed."""
    return (F.octet_length(ids) / 4).cast("long")


def unpacked(ids: Column) -> Column:
    """The ids as an array of longs."""
    id_of = lambda x: F.conv(F.concat(*(F.substring(x, at, 2) for at in (7, 5, 3, 1))), 16, 10).cast("long")
    return F.transform(F.regexp_extract_all(F.hex(ids), F.lit(".{8}"), F.lit(0)), id_of)


def round_trip(documents: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to."""
    ranks = ranks or read_ranks()
    back = decoded(encoded(documents.select("doc_id", "text"), ranks), ranks)
    return back.select("doc_id", count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
