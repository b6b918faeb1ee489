from fractions import Fraction

import pytest

from basketlens.llm.mixing import mix, training_order
from basketlens.llm.queries import op3_mixing


def targets(sizes):
    """share 150 % of all sizes by weights 3, 1, 2; reshare what is above twice a source's size until none is"""
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    out, left, free = {}, Fraction(3, 2) * sum(sizes.values()), set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        free -= over
    return out


def verify(rows, docs):
    sizes = {}
    for _, source, size in docs:
        sizes[source] = sizes.get(source, 0) + size
    want = targets(sizes)
    taken, largest, got = {}, {}, {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, source, size in docs:
        r = got[i]
        assert (r.size, r.source_size) == (size, sizes[source])
        assert r.target == pytest.approx(float(want[source]))
        assert 0 <= r.taken <= 2 * size and (size == 0 or r.taken % size == 0)
        taken[source] = taken.get(source, 0) + r.taken
        largest[source] = max(largest.get(source, 0), size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 17), s) for i, s in enumerate(["b"] * 60 + ["a"] * 7 + [None] * 30 + ["é"] * 3 + ["z"] * 120)]
    rows += [(900, None, "a"), (901, "", "empty")]
    df = table(spark, rows)
    first = mix(df).collect()
    verify(first, [(i, s, len((t or "").split())) for i, t, s in rows])
    assert sorted(first) == sorted(mix(df.repartition(3)).collect())
    assert all(0 <= r.position <= 1 for r in first if r.position is not None)


def test_repeated_rows_long_texts_and_order(spark):
    rows = [(1, "w " * 5, "a")] * 40 + [(2, "w " * 50_000, "b"), (None, "w", "b"), (None, "w", "b"), (3, None, "c"), (4, "x " * 3, None)]
    df = table(spark, rows)
    out = mix(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.size), []).append(r.taken)
    assert len(by[1, 5]) == 40 and by[3, 0] == [0] and all(t in (0, 50_000, 100_000) for t in by[2, 50_000])
    at = [r.position for r in out]
    taken = [p for p in at if p is not None]
    assert taken == sorted(taken) and at[: len(taken)] == taken


def test_all_sources_capped_or_empty(spark):
    assert mix(table(spark, [])).collect() == []
    assert [r.taken for r in mix(table(spark, [(1, None, None)])).collect()] == [0]


def test_training_order_repeats_rows_and_sorts(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(200)]
    df = table(spark, rows)
    copies = {r.doc_id: r.copies for r in mix(df).collect()}
    out = training_order(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert {i: ids.count(i) for i in copies} == copies
    # rows that repeat an id take the other path
    twice = training_order(df.union(df.where("doc_id = 3")))
    assert twice.columns == df.columns and twice.count() > 0


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "source", "text").collect()
    import re

    verify(op3_mixing(spark, tiny).collect(), [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs])
