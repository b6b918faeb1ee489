import random
import zlib
from collections import Counter

import xxhash

from basketlens.llm.queries import op4_sharding
from basketlens.llm.sharding import _quotas, propagate, shards


def verify(rows, docs, count=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in docs)
    per = Counter(r.shard for r in rows)
    counts = [per.get(s, 0) for s in range(count)]
    assert max(counts) - min(counts) <= 1
    for s in range(count):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}


def table(spark, docs):
    return spark.createDataFrame([(i, t, 3, 4) for i, t in docs], "doc_id long, text string, shard int, part int")


def cut(rows, docs):
    """pairs of equal texts in different shards, over all pairs of equal texts"""
    where, text = {r.doc_id: r.shard for r in rows}, dict(docs)
    groups = {}
    for i, t in text.items():
        groups.setdefault(t, Counter())[where[i]] += 1
    pairs = lambda n: n * (n - 1) // 2
    every = sum(pairs(sum(c.values())) for c in groups.values())
    return 1 - sum(pairs(n) for c in groups.values() for n in c.values()) / every


def test_small_groups_stay_together(spark):
    docs = [(i, f"text {i // 4}" if i < 800 else f"alone {i}") for i in range(2000)]
    rows = shards(table(spark, docs)).collect()
    verify(rows, docs)
    assert cut(rows, docs) == 0


def test_a_group_with_a_third_of_all_rows(spark):
    docs = [(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(900)]
    rows = shards(table(spark, docs)).collect()
    verify(rows, docs)


def test_a_group_that_a_shard_holds_stays_whole(spark):
    """A group of 9/80 of all rows fits into a shard of 10/80; enough rows are unlinked to make room for it."""
    docs = [(i, "same" if i < 90 else f"t{i}") for i in range(800)]
    rows = shards(table(spark, docs)).collect()
    verify(rows, docs)
    assert cut(rows, docs) < 0.3


def test_odd_rows(spark):
    docs = [(1, None), (1, None), (None, ""), (2, "é"), (2, "é"), (3, "x" * 100_000)]
    verify(shards(table(spark, docs)).collect(), docs)
    assert shards(table(spark, [])).collect() == []


def test_query(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    verify(op4_sharding(spark, tiny).collect(), docs)


def spark_hash(*values):
    """Spark's xxhash64 of strings, ints (negative: none here) and longs, as a signed number."""
    seed = 42
    for v, kind in values:
        data = v.encode() if kind == "s" else int(v).to_bytes(4 if kind == "i" else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_propagation(rows, k):
    """Label propagation by dictionaries over rows (h, link, shard), round by round."""
    total, size = len(rows), Counter(link for _, link, _ in rows)
    limit = max(1, total // k)
    part = {h: spark_hash((3, "i"), (h, "l")) % -(-size[link] // limit) for h, link, _ in rows if link is not None and size[link] > 1}
    shard, link_of, r, asked = {h: s for h, _, s in rows}, {h: link for h, link, _ in rows}, 0, total + 1
    while True:
        votes = Counter((link_of[h], part[h], shard[h]) for h in part)
        groups = {}
        for (link, p, s), n in votes.items():
            groups.setdefault((link, p), []).append((n, spark_hash((link, "s"), (s, "i")), s))
        to = {g: max(v)[2] for g, v in groups.items() if len(v) > 1}
        flows = Counter()
        for (link, p, s), n in votes.items():
            if (link, p) in to and to[link, p] != s:
                flows[s, to[link, p]] += n
        if not flows or sum(flows.values()) >= asked:
            return shard, r
        r, asked = r + 1, sum(flows.values())
        have = Counter(shard[h] for h in part)
        share = _quotas([have[s] for s in range(k)], flows, total / k)
        for s in range(k):  # what the quotas must hold: no shard is expected above its capacity by requests that were let in
            leaving, entering = (sum(n * share[t] for (a, t), n in flows.items() if (a, t)[side] == s) for side in (0, 1))
            assert have[s] - leaving + entering <= max(total / k, have[s]) + 1
        moved = {h: to[link_of[h], p] for h, p in part.items() if (link_of[h], p) in to and spark_hash((r, "i"), (link_of[h], "s"), (p, "i")) % 1_000_000 / 1e6 < share[to[link_of[h], p]]}
        shard |= moved


def test_propagation_equals_dictionaries(spark):
    rng = random.Random(3)
    rows = [(i * 7919, rng.choice([None, "big", *(f"g{j}" for j in range(60))]), rng.randrange(4)) for i in range(900)]
    rows += [(10**9 + i, "big", i % 2) for i in range(500)]
    want, rounds = plain_propagation(rows, 4)
    got = {r.h: r.shard for r in propagate(spark.createDataFrame(rows, "h long, link string, shard int"), 4).collect()}
    assert rounds > 1 and got == want
