"""One catalog run against a walk over the items in order, and its odd rows."""

import random

import pytest

from basketlens.operators.catalog_run import run_catalog
from basketlens.operators.resolve import checked_verdicts, resolve_by_tokens

ITEM = "pos int, sku string, barcode string, name string, brand string, price double, baseline boolean, sku2 string"


def walk(items, products, mappings, shelf, chain):
    """The run as a loop that keeps what it has seen."""
    by_code, by_sku, made, mapped, wanted, skipped = {}, dict(mappings), [], set(), {}, 0
    for pid, code in sorted(products):
        by_code.setdefault(code, pid)
    for _, sku, code, name, _, price, baseline, _ in sorted(items, key=lambda i: i[0]):
        if sku is None or not (name or "").strip() or price is None or not price > 0 or price == float("inf"):
            skipped += 1
            continue
        pid = by_sku.get(sku) or (by_code.get(code) if code else None)
        if pid is None:
            pid = f"{chain}/{sku}"
            made.append(pid)
            if code:
                by_code[code] = pid
        elif sku not in by_sku:
            mapped.add(sku)
        by_sku[sku] = pid
        if baseline is not False:
            wanted.setdefault(pid, price)
    snaps = {(p, x) for p, x in wanted.items() if dict(shelf).get(p) != x}
    return by_sku, sorted(made), snaps, {"total": len(items), "skipped": skipped, "created": len(made), "mapped": len(mapped), "snapshots": len(snaps)}


@pytest.mark.parametrize("seed", [1, 2])
def test_run_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    code = lambda: rng.choice([None, *(f"{i:013d}" for i in range(12))])
    items = [(i, rng.choice([None, *(f"s{j}" for j in range(30))]), code(), rng.choice(["a", "b", "c", " ", None]), "x", rng.choice([1.0, 2.0, 3.5, 0.0, None, float("nan")]), rng.choice([True, False, None]), "clash") for i in range(120)]
    products = [(f"p{i}", f"{i % 4:013d}") for i in range(5)] + [("p9", None)]
    mappings, shelf = [("s1", "p1"), ("s2", "p7"), ("s99", "p3")], [("p1", 2.0), ("p7", 1.0)]
    run = run_catalog(spark.createDataFrame(items, ITEM), spark.createDataFrame(products, "product_id string, barcode string"), spark.createDataFrame(mappings, "sku string, product_id string"), spark.createDataFrame(shelf, "product_id string, price double"), "ab")
    by_sku, made, snaps, report = walk(items, [p for p in products if p[1]], mappings, shelf, "ab")
    got = {r.sku: r.product_id for r in run.resolved.collect()}
    assert got == {k: v for k, v in by_sku.items() if k in got} and set(by_sku) - set(got) <= {"s1", "s2", "s99"}
    assert sorted(r.product_id for r in run.products.collect()) == made
    assert {(r.product_id, r.price) for r in run.snapshots.collect()} == snaps
    assert {r.measure: r.n for r in run.report.collect()} == report
    assert {r.sku for r in run.mappings.collect()} == {k for k in got if k not in ("s1", "s2")}


def test_empty_run(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    run = run_catalog(none(ITEM), none("product_id string, barcode string"), none("sku string, product_id string"), none("product_id string, price double"), "ab")
    assert run.resolved.count() == run.products.count() == run.snapshots.count() == 0
    assert {r.n for r in run.report.collect()} == {0}


def test_resolution_of_odd_names(spark):
    raw = spark.createDataFrame([(1, "φέτα δωδώνη 400"), (2, "φέτα 6x2"), (3, None), (4, ""), (5, "δωδώνη φέτα 400"), (6, "φέτα δωδώνη 400 6x2")], "raw_id long, raw string")
    catalog = spark.createDataFrame([(7, "Φέτα Δωδώνη 400"), (8, "Φέτα Δωδώνη 400"), (9, None)], "product_id long, product_name string")
    got = {r.raw_id: (r.product_id, r.reject_reason) for r in resolve_by_tokens(raw, catalog).collect()}
    assert got == {1: (7, None), 2: (None, "short"), 3: (None, "no candidate"), 4: (None, "no candidate"), 5: (None, "brand"), 6: (None, "tokens")}


def test_verdicts(spark):
    verdicts = spark.createDataFrame([(1, "φέτα α", "x", 95), (2, "φέτα α", "y", 95), (3, "φέτα α", "x", 89), (4, "φέτα α", None, None), (5, "φέτα α 6x2", "x", 99), (6, "γάλα", "x", 99)], "raw_id long, raw string, suggestion string, confidence int")
    candidates = spark.createDataFrame([(i, p, n) for i in range(1, 7) for p, n in (("x", "Φέτα β"), ("x", "Φέτα β"))], "raw_id long, product_id string, product_name string")
    got = {r.raw_id: (r.product_id, r.reject_reason) for r in checked_verdicts(verdicts, candidates).collect()}
    assert got == {1: ("x", None), 2: (None, "no candidate"), 3: (None, "low confidence"), 4: (None, "low confidence"), 5: (None, "pack"), 6: (None, "brand")}
