"""Distinct counts from bitmaps: parts in any split merge to the counts of a full run."""

import random

from pyspark.sql import functions as F

from basketlens.operators.coverage import id_bitmaps, merged, set_sizes


def test_parts_merge_to_the_full_run(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([rng.randrange(50), rng.randrange(10**6), 10**12 + rng.randrange(9)]), rng.random() < 0.5, rng.randrange(3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, x boolean, day int")
    sets, counts = {"all_": F.lit(True), "xs": F.col("x"), "ys": ~F.col("x") & (F.col("day") == 0)}, {"n": F.col("x")}
    parts = None
    for day in range(3):
        part = id_bitmaps(df.where(F.col("day") == day), ["k"], "id", sets, counts)
        parts = part if parts is None else parts.unionByName(part)
    sizes = {"all_": "all_", "xs": "xs", "union": ("xs", "ys")}
    got = {(r.k, r.all_, r.xs, r.union, r.n) for r in set_sizes(merged(parts, ["k"], list(sets), ["n"]), ["k"], sizes, ["n"]).collect()}
    whole = {(r.k, r.all_, r.xs, r.union, r.n) for r in set_sizes(id_bitmaps(df, ["k"], "id", sets, counts), ["k"], sizes, ["n"]).collect()}
    want = set()
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        xs, ys = {i for _, i, x, _ in mine if x}, {i for _, i, x, d in mine if not x and d == 0}
        want.add((k, len({r[1] for r in mine}), len(xs), len(xs | ys), sum(r[2] for r in mine)))
    assert got == whole == want
