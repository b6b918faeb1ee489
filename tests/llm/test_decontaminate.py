import hashlib
import random
import re

import basketlens.llm.decontaminate as d
from basketlens.llm.queries import op8_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, ids = split(t), set(), set()
        for m in {len(x) for x in wins}:
            for a in range(len(w) - m + 1):
                if own := wins.get(tuple(w[a : a + m])):
                    hit |= set(range(a, a + m))
                    ids |= own
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def run(spark, docs, items):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, _hits int")
    found, hits = d.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns[:3] == ["doc_id", "text", "_hits"]
    return {r[0]: tuple(r[1]) for r in found.select("doc_id", hits).collect()}


def cases():
    rng = random.Random(1)
    vocab = ["a", "b", "c", "d", "é", "x1"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(120)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    docs += [(100, "q " * 5 + items[0][1].upper() + "!"), (101, None), (102, ""), (103, "---"), (104, "solo"), (105, "word " * 30_000 + items[1][1])]
    items += [(50, None), (51, ""), (52, "Solo"), (53, items[0][1]), (54, "...")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_patterns_agree(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(d, "PATTERN_BLOCK", 20)
    assert run(spark, docs[:30], items) == brute(docs[:30], items)


def test_twenty_blocks_are_searched_one_at_a_time(spark, monkeypatch):
    """Every plan holds the search of one table, and the workers' tables are bounded; copies and null texts included."""
    docs, items = cases()
    docs = docs[:20] + [(200 + i, docs[0][1]) for i in range(50)] + [(300, None), (301, items[0][1])]
    pairs = sum(len(set(d.windows(t.encode()))) for _, t in items if t)
    monkeypatch.setattr(d, "PATTERN_BLOCK", pairs // 20)
    sizes, sent = [], d._patterns
    monkeypatch.setattr(d, "_patterns", lambda p: sizes.append(p.count()) or sent(p))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, _key int")
    found, hits = d.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert len(sizes) >= 20 and sum(sizes) == pairs
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1
    assert {r[0]: tuple(r[1]) for r in found.select("doc_id", hits).collect()} == brute(docs, items)


def test_a_window_of_many_items_lies_in_several_blocks(spark, monkeypatch):
    items = [(i, "one two three") for i in range(200)]
    monkeypatch.setattr(d, "PATTERN_BLOCK", 30)
    docs = [(1, "x one two three one two"), (2, "one two")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    # an item without an id: its words are hit, no item is named
    assert run(spark, [(1, "a b c")], [(None, "a b")])[1][:3] == (3, 2, 0)
    assert run(spark, [], [(1, "a b")]) == {}
    assert run(spark, [(1, "a b c"), (2, None)], []) == brute([(1, "a b c"), (2, None)], [])


def test_query_on_whole_table(spark, tiny):
    got = {r[0]: tuple(r[1:]) for r in op8_decontaminate(spark, tiny).collect()}
    rows = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{tiny}/{t}.parquet").select(*c).collect()]
    assert got == brute(rows("documents", "doc_id", "text"), rows("benchmark", "item_id", "text"))
