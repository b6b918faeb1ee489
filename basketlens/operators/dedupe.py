"""Dedupe of offers that depends on their order: first place, cheapest row, comparable names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.similarity import comparable


def collapse_comparable(df: DataFrame, keys: Sequence[str], order: str, id_: str, name: str, price: str) -> DataFrame:
    """Rows of one product in order: a row joins the first kept row with a comparable name and takes its place if cheaper.

    Adds nothing; keeps the columns (keys, slot, id, name, price), slot being the order of the place. Rows with a null
    key are kept as they are. A product's offers in a chain are few, so a fold over their array holds them.
    """
    cost = lambda r: F.coalesce(r["price"], F.lit(float("inf")))
    shape = F.struct(F.col(order).cast("long").alias("slot"), F.col(id_).cast("string").alias("id"), F.col(name).alias("name"), F.col(price).cast("double").alias("price"))
    groups = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.sort_array(F.collect_list(shape)).alias("rows"))

    def step(kept: Column, row: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: comparable(k["name"], row["name"])), True)
        replaced = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (cost(row) < cost(k)), F.struct(k["slot"].alias("slot"), row["id"].alias("id"), row["name"].alias("name"), row["price"].alias("price"))).otherwise(k))
        return F.when(at > 0, replaced).otherwise(F.concat(kept, F.array(row)))

    kind = "array<struct<slot:bigint,id:string,name:string,price:double>>"
    folded = groups.select(*keys, F.explode(F.aggregate("rows", F.array().cast(kind), step)).alias("r")).select(*keys, "r.*")
    loose = df.where(F.concat(*(F.col(k).cast("string") for k in keys)).isNull()).select(*keys, shape.alias("r")).select(*keys, "r.*")
    return folded.unionByName(loose)


def dedupe_offers(df: DataFrame, cross_chain: bool = False, product: str = "product_id", chain: str = "chain", order: str = "pos", id_: str = "offer_id", name: str = "product_name", price: str = "price") -> DataFrame:
    """By product and chain, then by name and chain; with cross_chain also by product, then by name, over all chains.

    Columns: product, chain, slot, id, name, price; each kept row stands at the place of the first it stands for.
    """

    def by_name(rows: DataFrame, keys: list[str]) -> DataFrame:
        label = F.when(F.length("name") > 0, F.lower(F.trim("name"))).otherwise(F.concat(F.lit("\x00"), F.col("id")))
        at = F.struct(F.coalesce("price", F.lit(float("inf"))), "slot")
        best = rows.withColumn("_name", label).groupBy("_name", *keys).agg(F.min("slot").alias("slot"), F.min_by(F.struct(product, chain, "id", "name", "price"), at).alias("r"))
        return best.select(f"r.{product}", f"r.{chain}", "slot", "r.id", "r.name", "r.price")

    rows = collapse_comparable(df, [product, chain], order, id_, name, price)
    rows = by_name(rows, [chain])
    if not cross_chain:
        return rows
    # the second pass keeps each row's chain by carrying it inside the id
    carried = rows.withColumn("id", F.concat_ws("\x1f", "id", chain))
    merged = collapse_comparable(carried, [product], "slot", "id", "name", "price")
    back = merged.withColumn(chain, F.element_at(F.split("id", "\x1f"), 2)).withColumn("id", F.element_at(F.split("id", "\x1f"), 1))
    return by_name(back.select(product, chain, "slot", "id", "name", "price"), [])
