import hashlib
import itertools
import random

import numpy as np

import basketlens.llm.fingerprint as fp
from basketlens.llm.queries import op10_fingerprints


def parsed(text):
    return fp._hex(fp.Parser().sketches([fp.code_points((text or "").encode())])[0])


def test_equal_substrings_share_names_at_any_offset():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(4000))
    shared, sketch = word(), lambda t: fp.Parser().sketches([fp.code_points(t.encode())])[0]
    a, b, c = sketch(word()[:137] + shared), sketch(word()[:1011] + shared), sketch(word())
    assert fp.likeness(a, b) > 0.5 > 0.1 > fp.likeness(a, c)


def test_batches_do_not_matter():
    rng = random.Random(2)
    texts = ["", "a", "aa", "ab", "aab" * 5, "a" * 5000, "xyz" * 900] + ["".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(300)]
    points = [fp.code_points(t.encode()) for t in texts]
    together = fp.Parser().sketches(points)
    rng.shuffle(order := list(range(len(texts))))
    again = fp.Parser().sketches([points[i] for i in order])
    for k, i in enumerate(order):
        assert np.array_equal(again[k], together[i])
        assert fp._hex(together[i]) == parsed(texts[i])


def test_near_copies_around_200_code_points():
    rng = random.Random(6)
    found = []
    for _ in range(20):
        long = "".join(rng.choice("abcdefghij ") for _ in range(205))
        a, b = fp.Parser().sketches([fp.code_points(t.encode()) for t in (long[:195], long)])
        found.append(fp.likeness(a, b))
    assert sum(found) / len(found) > 0.7


def verify(rows, docs):
    docs = sorted(docs, key=lambda d: d[0])
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for k, (i, t) in enumerate(docs):
        t, after, r = t or "", docs[(k + 1) % len(docs)][1] or "", got[i]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (parsed(t), parsed(new))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == after:
            assert r.near_next == 1


def run(spark, docs):
    return fp.fingerprints(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, range int").repartition(5)).collect()


def test_next_rows_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rng = random.Random(8)
    texts = [None, "", "é" * 9, "same", "same", "z" * 60_000] + ["".join(rng.choice("αβγ de") for _ in range(rng.randrange(400))) for _ in range(60)]
    docs = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    verify(run(spark, docs), docs)


def test_one_row_repeated_rows_and_none(spark):
    verify(run(spark, [(4, "alone again")]), [(4, "alone again")])
    assert [r.near_next for r in run(spark, [(1, "abc")] * 3)] == [1, 1, 1]
    assert len(run(spark, [(None, "abc"), (2, "x"), (None, None)])) == 3
    assert run(spark, []) == []


def test_query(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    rows = op10_fingerprints(spark, tiny).collect()
    verify(rows, docs)
    long = [r for r in rows if r.n_chars > 1000]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)


M64, M1, M2, GOLD = 2**64 - 1, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15


def plain_parse(text):
    """The parse of one text, symbol by symbol with Python's integers; the mixing function alone is shared."""
    mixed = lambda v: int(fp.mix(np.array([v & M64], dtype=np.uint64))[0])

    def toss(symbol, before):
        bit = 0
        while not ((symbol ^ before) >> bit) & 1:
            bit += 1
        return 2 * bit + ((symbol >> bit) & 1)

    symbols, level, names = [mixed(ord(c) + 1) for c in text], 0, set()
    while symbols:
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        symbols = [s if n == 1 else mixed(s * M1 + n) for s, n in runs]
        if level >= 1 or len(symbols) == 1:
            names |= {mixed(s + GOLD * (level + 1)) >> 32 for s in symbols}
        if len(symbols) == 1:
            break
        labels = symbols
        for _ in range(2):
            labels = [toss(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
        at = lambda i: labels[i] if i < len(labels) else 0
        cuts = [0, *(i for i in range(2, len(labels)) if at(i - 1) < at(i) >= at(i + 1)), len(labels)]
        phrases = [symbols[a:b] for a, b in itertools.pairwise(cuts)]
        symbols = [mixed(sum(mixed(s * M1 + k * M2) for k, s in enumerate(p)) + len(p)) for p in phrases]
        level += 1
    return "".join(f"{n:08x}" for n in sorted(names)[: fp.KEEP])


def test_equals_a_plain_parse():
    rng = random.Random(9)
    texts = ["", "a", "aaaa", "ab" * 40, "αβγ δέ ζ" * 30, "x\u0000y\U0001f600z" * 9]
    texts += ["".join(rng.choice(rng.choice(["ab", "abc ", "abcdefghijklmnop qrstuvwxyz"])) for _ in range(rng.randrange(1, 700))) for _ in range(60)]
    for got, text in zip(fp.Parser().sketches([fp.code_points(t.encode()) for t in texts]), texts, strict=True):
        assert fp._hex(got) == plain_parse(text)
