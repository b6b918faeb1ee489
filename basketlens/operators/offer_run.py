"""One ingest run of a seller's offers: match, classify, upsert, snapshot, queue, deactivate, alert, log. Tables in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.num import is_price, normalize_barcode, percent_off
from basketlens.functions.taxonomy import DEFAULT, Rules, classify
from basketlens.functions.validate import offer_type
from basketlens.operators.compare import waterfall
from basketlens.operators.ingest import snapshot_on_change, upsert

KEY = ["chain", "source", "sku"]


@dataclass(frozen=True)
class Catalog:
    """What items are matched by: mappings (sku, product_id) of the chain, barcodes (barcode, product_id), names (name, product_id)."""

    mappings: DataFrame
    barcodes: DataFrame
    names: DataFrame


@dataclass(frozen=True)
class Run:
    offers: DataFrame
    snapshots: DataFrame
    pending: DataFrame
    alertable: DataFrame
    log: DataFrame


def run_offers(items: DataFrame, stored: DataFrame, catalog: Catalog, chain: str, source: str, now: Column, rules: Rules = DEFAULT, partial: bool = False, least: float = 0.5, small: int = 20) -> Run:
    """Items are (pos, sku, barcode, name, price, original, kind, native); stored offers have the columns of `Run.offers`.

    Items without a sku, a name or a sound price are left out; of several with one sku the last wins. The first item of the
    run that matches a product owns it; later ones keep their row without the link. Rows that the run does not see again
    become inactive, unless the run is partial, empty, or has less than `least` of more than `small` active rows.
    """
    sound = items.where(F.col("sku").isNotNull() & (F.length(F.trim("name")) > 0) & is_price(F.col("price")))
    last = sound.withColumn("_rn", F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("pos")))).where("_rn = 1").drop("_rn")
    coded = last.withColumn("barcode", normalize_barcode(F.col("barcode")))
    matched = waterfall(coded, [("sku", catalog.mappings, "sku"), ("barcode", catalog.barcodes, "barcode"), ("name", catalog.names, "name")])
    owner = F.row_number().over(Window.partitionBy("product_id").orderBy("pos")) == 1
    dept = classify(F.lit(chain), F.col("name"), F.col("native"), rules)
    rows = matched.select(
        F.lit(chain).alias("chain"), F.lit(source).alias("source"), "sku", "name", "price",
        F.when(F.col("original") > F.col("price"), F.col("original")).alias("original"), percent_off(F.col("price"), F.col("original")).alias("percent"),
        offer_type(F.col("kind"), F.col("original")).alias("kind"), dept["dept"].alias("category"), "via",
        F.when(owner, F.col("product_id")).alias("product_id"), F.lit(True).alias("active"), now.alias("updated_at"),
    )
    mine = stored.where((F.col("chain") == chain) & (F.col("source") == source))
    merged = upsert(stored, rows, KEY, "updated_at")
    active, scraped = mine.where("active").count(), rows.count()
    healthy = not partial and scraped > 0 and not (active > small and scraped < least * active)
    stale = (F.col("chain") == chain) & (F.col("source") == source) & (F.col("updated_at") < now)
    offers = merged.withColumn("active", F.col("active") & ~stale) if healthy else merged
    before = mine.select(*KEY, F.col("price").alias("before"))
    alertable = rows.join(before, KEY, "left").where(F.col("before").isNull() | (F.col("price") < F.col("before"))).drop("before")
    log = items.sparkSession.range(1).select(
        F.lit(chain).alias("chain"), F.lit(source).alias("source"), now.alias("finished_at"), F.lit(scraped).alias("scraped"), F.lit(healthy).alias("healthy"),
    )
    return Run(offers, snapshot_on_change(mine, rows, KEY, "price"), rows.where(F.col("via").isNull()).select("chain", "name", "price"), alertable, log)
