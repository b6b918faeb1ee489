import corpus_pipeline as cp
from basketlens.llm.mixing import mix
from basketlens.llm.shared import prefix_sums
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as components


def test_stages_and_their_inputs(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, tiny)
        rows, before = out.collect(), docs.collect()
        ids = [r.doc_id for r in rows]
        if name == "near_dedup":
            want = components([(r.doc_id, r.text) for r in before], 5)
            assert sorted(ids) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {i for i, v in leaks([(r.doc_id, r.text) for r in before], items).items() if v[-1]}
            assert sorted(ids) == sorted(r.doc_id for r in before if r.doc_id not in bad)
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mix(docs).collect()}
            assert {i: ids.count(i) for i in copies} == copies
        if name == "sharding":
            assert len(rows) == len(before)
        else:
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]


def test_stages_take_odd_rows(spark, tiny):
    rows = [(1, None, None, None, None, 1), (1, None, None, None, None, 1), (None, "", "en", "a", 0, 2), (2, "x y z", "en", "a", 5, 3), (2, "x y", "en", "b", 3, 4), (3, "w " * 30_000, "en", "b", 60_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score int")
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, table, tiny)
            assert out.columns == table.columns
            out.collect()
        placed = cp.sharding_stage(spark, table, tiny).collect()
        assert len(placed) == table.count() and sorted((r.shard, r.slot) for r in placed) == sorted({(r.shard, r.slot) for r in placed})
    kept = [r.doc_id for r in cp.dedup_stage(spark, docs, tiny).collect()]
    assert sorted(kept, key=str) == [1, 2, 2, 3, None]


def test_texts_that_share_an_id_are_documents_of_their_own(spark, tiny):
    """Of ids 1 and 2, which hold three texts each, every text stays once; a copy and a near copy under other ids go."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (1, text("c")), (1, text("a")), (2, text("d")), (2, text("e")), (2, None), (3, text("b")), (4, text("d") + " end"), (5, text("f")), (5, text("f"))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, _key int")
    kept = [(r.doc_id, r.text) for r in cp.dedup_stage(spark, docs, tiny).collect()]
    texts = [t for _, t in kept]
    assert len(texts) == len(set(texts))
    assert {t for t in texts if t} - {text("d"), text("d") + " end"} == {text(c) for c in "abcef"}
    assert len({text("d"), text("d") + " end"} & set(texts)) == 1 and (2, None) in kept


def test_prefix_sums(spark):
    rows = [(k, i, i % 7) for k in ("a", None) for i in range(500)]
    got = prefix_sums(spark.createDataFrame(rows, "k string, id long, n long"), ["k"], ["id"], {"before": "n"}).collect()
    for k in ("a", None):
        own = sorted((r.before, r.n) for r in got if r.k == k)
        assert len(own) == 500 and own[0][0] == 0
        assert max(b + n for b, n in own) == sum(n for _, n in own)


def test_run(spark, tiny):
    out = cp.run(spark, tiny)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 0
