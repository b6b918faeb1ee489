import random

import pytest

from basketlens.llm.queries import op5_token_counts
from basketlens.llm.tokens import SPACE, Counter, Vocabulary, read_vocabulary, token_counts

tokenizers = pytest.importorskip("tokenizers")


def library(vocabulary, has_bytes):
    """The tokenizers library's unigram model over the same pieces."""
    from tokenizers.models import Unigram

    pieces = [("<unk>", 0.0), *vocabulary.pieces.items()]
    least = min(vocabulary.pieces.values())
    if has_bytes:
        pieces += [(f"<0x{b:02X}>", least) for b in range(256)]
    return Unigram(pieces, 0, has_bytes)


def test_ties_and_unknowns_against_the_library():
    rng = random.Random(6)
    for has_bytes in (True, False):
        for _ in range(150):
            alphabet = "abcd"
            pieces = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))): float(-rng.randrange(1, 6)) for _ in range(rng.randrange(3, 25))}
            vocabulary = Vocabulary(pieces, has_bytes)
            model, counter = library(vocabulary, has_bytes), Counter(vocabulary)
            for _ in range(15):
                text = "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 20)))
                assert counter.best(text)[1] == len(model.tokenize(text)), (pieces, text)


def test_real_vocabulary_against_the_library(spark, tiny):
    vocabulary = read_vocabulary()
    model, counter = library(vocabulary, True), Counter(vocabulary)
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(40).collect()]
    texts += ["", " ", "   a  b ", "日本語 テキスト\n\n\tx", "a" * 3000, "▁x", "𝒳 é"]
    for t in texts:
        want = len(model.tokenize(SPACE + t.replace(" ", SPACE))) if t else 0
        assert counter.count(t)[1] == want


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b", 1), (3, "a b", 1)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert rows[1] == rows[2] == 0 < rows[3]
    assert token_counts(df.limit(0)).collect() == []


def test_query(spark, tiny):
    counter = Counter(read_vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = op5_token_counts(spark, tiny).collect()
    assert len(rows) == len(texts) and all((r.score, r.n_tokens) == counter.count(texts[r.doc_id]) for r in rows)
