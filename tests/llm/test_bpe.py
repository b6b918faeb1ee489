import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from basketlens.llm.bpe import SPACES, Codec, decoded, encoded, parts, read_ranks, round_trip, unpacked
from basketlens.llm.queries import op12_byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return read_ranks()


def merged(piece, ranks):
    """One match by the definition: the neighbouring pair of least rank is merged until none is known."""
    found = [bytes([b]) for b in piece]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(found, found[1:], strict=False)) if a + b in ranks]:
        _, i = min(pairs)
        found[i : i + 2] = [found[i] + found[i + 1]]
    return [ranks[p] for p in found]


def by_definition(text, ranks):
    import regex

    pattern = public_tokenizers.PATTERN.replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]").replace(f"[^[{SPACES}]", f"[^{SPACES}")
    return [i for m in regex.finditer(pattern, text) for i in merged(m.group().encode(), ranks)]


ODD = ["", " ", "a", "  a", "a  ", "it's they'll 'S ''s", "x1y2 3z", "<|endoftext|>", "é́ ß ǅ", "日本語。テスト、漢字", "\x1c\x1d a\x1f", "　  x", "\U0001f600‍\U0001f469", "a\r\n\r\n b\t\tc", "\x00\x01", "0x1F600...!!", "ñ" * 50, "'" * 30 + "s", "१२३ ٣٤", "᠎ ﻿"]


def ids_of(codec, text, part=1 << 15):
    return np.frombuffer(codec.encode(text, part), dtype="<u4").tolist()


def test_ids_equal_the_definition_and_another_library(ranks):
    codec, other = Codec(ranks), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "ab Z09 .,'’é漢\n\t　s t"
    for text in [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(200))]:
        got = ids_of(codec, text)
        assert got == by_definition(text, ranks.ranks) == other.encode(text, add_special_tokens=False).ids
        assert codec.decode(np.array(got, dtype="<u4").tobytes()) == text.encode()


def test_parts_give_the_ids_of_the_whole(ranks):
    plain = tiktoken.Encoding("plain", pat_str=ranks.pattern, mergeable_ranks=ranks.ranks, special_tokens={})
    codec, rng = Codec(ranks), random.Random(4)
    for alphabet in ("ab Z09 .,'é漢\n\t　s t", "abc'! ", "漢字。かな、A1", "!'s,a0", "²½ a1"):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 3]) for _ in range(200))
            cut = [p for p, _ in parts(text, 7)]
            assert "".join(cut) == text and ids_of(codec, text, 7) == plain.encode_ordinary(text)
    assert len(list(parts("some words and 123 numbers " * 4, 5))) > 8


@pytest.mark.parametrize("text", [" " * 3_000_000, "x" + "\n" * 2_000_000 + "y", "a " * 40_000 + " " * 5_000 + "b" + " " * 2_000, "z" * 300_000, "!" * 300_000], ids=["spaces", "lines", "mixed", "letters", "marks"])
def test_long_texts_and_long_white_space(ranks, text):
    codec = Codec(ranks)
    packed = codec.encode(text)
    assert codec.decode(packed) == text.encode()
    if "y" in text:
        assert np.frombuffer(packed, dtype="<u4").tolist() == [ranks.ranks[b"x"], *codec.encoding._encode_single_piece("\n" * 1_999_999), ranks.ranks[b"\n"], ranks.ranks[b"y"]]


def test_odd_rows(spark, ranks):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, None, -1), (7, ODD[7], -2), (8, None, -3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    codec = Codec(ranks)
    made = decoded(encoded(table, ranks), ranks, "ids_").withColumn("list", unpacked("ids_"))
    got = {r.ids: r for r in made.collect()}
    assert len(got) == len(rows)
    for _, text, key in rows:
        assert got[key].list == ids_of(codec, text or "") and bytes(got[key].bytes) == (text or "").encode()
    assert encoded(table.limit(0), ranks).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bytes(decoded(encoded(broken, ranks), ranks).collect()[0].bytes) == "a�b".encode()


def test_query(spark, tiny, ranks):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    got = op12_byte_bpe(spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = other.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    empty = round_trip(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]
    assert empty.n_tokens == 0 and empty.ids_sha256 == empty.decoded_sha256 == hashlib.sha256(b"").hexdigest()
