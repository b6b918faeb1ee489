"""Resolution of raw names to products: by tokens without a model, and by checking the verdicts of any scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.packs import pack_count
from basketlens.functions.taxonomy import brands_agree
from basketlens.functions.text import tokens
from basketlens.operators.compare import top_overlaps
from basketlens.operators.ranking import best_per_key


def name_reject(raw: Column, name: Column) -> Column:
    """Why a product's name does not stand for a raw name: another brand, another pack; null if it does."""
    return F.when(~brands_agree(raw, name), "brand").when(pack_count(raw) != pack_count(name), "pack")


def resolve_by_tokens(raw: DataFrame, catalog: DataFrame, k: int = 10, least: int = 3) -> DataFrame:
    """Rows (raw_id, product_id, reject_reason) for raw names (raw_id, raw) over a catalog (product_id, product_name).

    Of the k products that share most tokens, the best that holds all tokens of a raw name with `least` or more, in its
    brand and pack, is accepted; other raw names stay for review with the reason that the best candidate gives. A raw name
    without tokens, or that is null, has no candidate. raw_id and product_id are unique.
    """
    named = raw.select("raw_id", "raw", tokens(F.col("raw")).alias("tokens"))
    known = catalog.select("product_id", "product_name", tokens(F.col("product_name")).alias("tokens"))
    best = top_overlaps(named, known, "raw_id", "product_id", k).join(known.select("product_id", "product_name"), "product_id")
    best = best.join(named.select("raw_id", "raw", F.size("tokens").alias("n")), "raw_id")
    reason = F.when(F.col("n") < least, "short").when(F.col("score") < F.col("n"), "tokens").otherwise(name_reject(F.col("raw"), F.col("product_name")))
    top = best_per_key(best.withColumn("reason", reason), ["raw_id"], [F.col("reason").isNotNull().cast("int"), F.desc("score"), F.asc("product_id")])
    found = raw.select("raw_id").join(top.select("raw_id", "product_id", "reason"), "raw_id", "left")
    accepted = F.when(F.col("reason").isNull(), F.col("product_id"))
    return found.select("raw_id", accepted.alias("product_id"), F.coalesce("reason", F.when(F.col("product_id").isNull(), "no candidate")).alias("reject_reason"))


def checked_verdicts(verdicts: DataFrame, candidates: DataFrame, least: int = 90) -> DataFrame:
    """Rows (raw_id, product_id, reject_reason) for a scorer's verdicts (raw_id, raw, suggestion, confidence).

    A verdict counts with a confidence of `least` or more whose suggestion is one of the candidates (raw_id, product_id,
    product_name) and has the raw name's brand and pack. A missing confidence is none; a repeated candidate counts once.
    """
    offered = candidates.groupBy("raw_id", F.col("product_id").alias("suggestion")).agg(F.min("product_name").alias("_name"), F.lit(True).alias("_known"))
    rows = verdicts.join(offered, ["raw_id", "suggestion"], "left")
    reason = (
        F.when(F.coalesce(F.col("confidence"), F.lit(0)) < least, "low confidence").when(F.col("_known").isNull(), "no candidate")
        .otherwise(name_reject(F.col("raw"), F.col("_name")))
    )
    return rows.withColumn("_reason", reason).select("raw_id", F.when(F.col("_reason").isNull(), F.col("suggestion")).alias("product_id"), F.col("_reason").alias("reject_reason"))
