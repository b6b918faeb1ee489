"""One ingest run of a seller's whole catalog: the only place that makes products. Tables in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.num import is_price, normalize_barcode
from basketlens.operators.ingest import snapshot_on_change


@dataclass(frozen=True)
class CatalogRun:
    resolved: DataFrame
    products: DataFrame
    mappings: DataFrame
    snapshots: DataFrame
    report: DataFrame


def run_catalog(items: DataFrame, products: DataFrame, mappings: DataFrame, shelf: DataFrame, chain: str, need_barcode: bool = False) -> CatalogRun:
    """Items are (pos, sku, barcode, name, brand, price, baseline); pos is any orderable value and orders the run.

    Stored products are (product_id string, barcode), the chain's mappings (sku, product_id), its newest shelf prices
    (product_id, price). Items without a sku, a name or a sound price are skipped, with need_barcode also those without a barcode.
    The first item of a sku decides for the sku: its mapping, else the stored product of its barcode (the least id, if
    several), else the product that the first such item of its barcode makes, else one of its own. A new product's id is the
    chain and the sku of its maker, so a run that is repeated makes the same products. Shelf prices are those of each
    product's first baseline item (a null flag is one) and are written where they differ from the newest stored one.
    An empty run resolves nothing; its report holds zeros.
    """
    coded = items.withColumn("barcode", normalize_barcode(F.col("barcode")))
    sound = F.coalesce(F.col("sku").isNotNull() & (F.length(F.trim("name")) > 0) & is_price(F.col("price")), F.lit(False))
    if need_barcode:
        sound = sound & F.col("barcode").isNotNull()
    valid = coded.where(sound)
    first = valid.groupBy("sku").agg(F.min(F.struct("pos", "barcode", "name", "brand")).alias("i")).select("sku", "i.*")
    by_sku = mappings.groupBy("sku").agg(F.min("product_id").alias("_mapped"))
    by_code = products.where(F.col("barcode").isNotNull()).groupBy("barcode").agg(F.min("product_id").alias("_coded"))
    found = first.join(by_sku, "sku", "left").join(by_code, "barcode", "left")
    # a new sku without a barcode stands alone, so the makers' table is keyed by barcode only
    unknown = found.where(F.col("_mapped").isNull() & F.col("_coded").isNull() & F.col("barcode").isNotNull())
    makers = unknown.groupBy("barcode").agg(F.min_by("sku", F.struct("pos", "sku")).alias("_maker"))
    maker = F.coalesce("_maker", "sku")
    via = (
        F.when(F.col("_mapped").isNotNull(), "sku").when(F.col("_coded").isNotNull(), "barcode")
        .when(maker != F.col("sku"), "run").otherwise("created")
    )
    resolved = found.join(makers, "barcode", "left").select(
        "sku", "pos", "barcode", "name", "brand", F.coalesce("_mapped", "_coded", F.concat(F.lit(f"{chain}/"), maker)).alias("product_id"), via.alias("via"),
    )
    made = resolved.where("via = 'created'").select("product_id", F.trim("name").alias("name"), "barcode", F.trim("brand").alias("brand"), F.lit(chain).alias("chain"))
    wanted = valid.where(F.coalesce("baseline", F.lit(True))).join(resolved.select("sku", "product_id"), "sku")
    wanted = wanted.groupBy("product_id").agg(F.min_by("price", F.struct("pos", "sku", "price")).alias("price"))
    snapshots = snapshot_on_change(shelf, wanted, ["product_id"], "price")
    count = lambda rows, name: rows.select(F.lit(name).alias("measure"), F.lit(1).alias("n"))
    zeros = items.sparkSession.range(1).select(F.explode(F.array(*(F.lit(m) for m in ("total", "skipped", "created", "mapped", "snapshots")))).alias("measure"), F.lit(0).alias("n"))
    counted = zeros.union(count(items, "total")).union(count(coded.where(~sound), "skipped")).union(count(made, "created"))
    counted = counted.union(count(resolved.where("via IN ('barcode', 'run')"), "mapped")).union(count(snapshots, "snapshots"))
    report = counted.groupBy("measure").agg(F.sum("n").alias("n"))
    return CatalogRun(resolved, made, resolved.where("via <> 'sku'").select("sku", "product_id"), snapshots.select("product_id", "price", "before"), report)
