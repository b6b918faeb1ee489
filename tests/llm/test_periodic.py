import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm.oracles import OP11
from basketlens.llm.periodic import find_runs, looped, overlap, periodic_runs, repeated, run_digests, split_words

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def every_run(words, min_length=24, exponent=3):
    """Each period in turn: stretches of words that are equal to the word one period on."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(min_length, exponent * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    n, k = rng.choice([0, 3, 23, 24, 25, 60, 200]), rng.choice([1, 2, 3, 50])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 30 else 0):
        s, p = rng.randrange(n - 10), rng.randint(1, 12)
        for i in range(s + p, min(n, s + rng.randint(10, 70))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("min_length, exponent", [(24, 3), (10, 2), (7, 4)])
def test_runs_of_several_texts_equal_brute_force(min_length, exponent):
    rng = random.Random(5)
    for _ in range(120):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = [[] for _ in texts]
        for s, n, q in zip(*find_runs(np.array([w for t in texts for w in t], dtype=np.int64), offsets, min_length, exponent), strict=True):
            t = int(np.searchsorted(offsets, s, side="right")) - 1
            got[t].append((int(s - offsets[t]), int(n), int(q)))
        assert got == [every_run(t, min_length, exponent) for t in texts]


def test_mask_keeps_words_of_k_grams_that_occur_twice_in_one_text():
    assert overlap() == 16
    a, b = list(range(100, 120)), list(range(200, 216))
    ids = np.array([*a, *b, 1, *b, *a[:15]])
    assert np.flatnonzero(repeated(ids, np.array([0, len(ids)]), 16)).tolist() == [*range(20, 36), *range(37, 53)]
    assert not repeated(np.array([*b, *b]), np.array([0, 16, 32]), 16).any()  # each once in its text


@pytest.mark.parametrize("words", [np.zeros(200_000, int), np.arange(200_000) % 1000, np.tile(np.random.default_rng(1).integers(0, 2, 50_000), 2)], ids=["one word", "long period", "copy"])
def test_long_texts(words):
    start, length, period = find_runs(words, np.array([0, len(words)]))
    for s, n, q in zip(start, length, period, strict=True):
        assert n >= max(24, 3 * q) and (words[s : s + n - q] == words[s + q : s + n]).all()
        assert s == 0 or words[s - 1] != words[s - 1 + q]
        assert s + n == len(words) or words[s + n] != words[s + n - q]
    if len(start) == 1:
        assert (start[0], length[0]) == (0, len(words)) and period[0] in (1, 1000)


def test_words_are_stretches_of_other_bytes():
    offsets, values = split_words(pa.array([b" a\x0b\x0cb\x1cc d  e\n", b"", None, b" \t", "é x".encode()]))
    assert offsets.tolist() == [0, 4, 4, 4, 4, 6] and values.to_pylist() == [b"a", b"b\x1cc", b"d", b"e", "é".encode(), b"x"]


def test_odd_rows(spark):
    loop = "x  y z\n" * 9 + "end"
    rows = [(None, loop, 1), (3, None, 2), (4, "", 3), (5, " \n", 4), (7, loop, 5), (7, loop, 6), (8, "w " * 30_000, 7), (9, "solo", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = periodic_runs(table).collect()
    by = {r.runs: ([tuple(x) for x in r.runs_], r.collapsed) for r in got}
    assert len(got) == 8 and by[1] == by[5] == by[6] == ([(0, 27, 3)], "x y z end")
    assert by[2] == by[3] == by[4] == ([], "") and by[7] == ([(0, 30_000, 1)], "w") and by[8] == ([], "solo")
    assert periodic_runs(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(table, exponent=1)


def test_query_equals_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, None if i == 50 else " ".join(map(str, some_words(rng) + some_words(rng)))) for i in range(150)] + [(None, "a b")]
    got = {r.doc_id: tuple(r)[1:] for r in run_digests(periodic_runs(looped(spark.createDataFrame(docs, "doc_id long, text string")))).collect()}
    n_looped = 0
    for doc_id, text in docs:
        w, h = (text or "").split(), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            n_looped += 1
        runs = every_run(w)
        best = None
        for r in runs:
            best = r if best is None or r[1] * best[2] > best[1] * r[2] else best
        want = (len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2], SHA("".join(f"{s},{n},{q}\n" for s, n, q in runs)), SHA(collapse(w, runs)))
        assert got[doc_id] == want, doc_id
    assert n_looped > 5


def test_sql_equals_query_on_odd_rows(spark):
    import duckdb

    from basketlens.llm.queries import op11_periodic_runs  # noqa: F401  (registered)

    rng = random.Random(9)
    docs = [(i, rng.choice([None, "", " ", " ".join(map(str, some_words(rng)))])) for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = con.execute(OP11)
    names = [c[0] for c in want.description]
    got = run_digests(periodic_runs(looped(spark.createDataFrame(docs, "doc_id long, text string")))).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
