"""Standing keyword alerts over offers: keywords meet names through their rarest letters, not alert by alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.scores import alert_fold

#: Letters of the stretches that names are indexed by; shorter keywords are looked up by all of theirs.
GRAM = 3
#: Slices for each doubling of a price, by which the prices that one watch sees are dealt over tasks.
STEPS = 16


def _grams(text: Column, n: Column) -> Column:
    """Distinct stretches of n letters; none if the text is shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def keyword_hits(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """Pairs (keyword, name) of folded keywords (`keyword`) and names (`name`, `folded`) that hold them; empty keywords have none.

    Each name is indexed once by its stretches of up to GRAM letters. A keyword is looked up by the one of its stretches that
    fewest names have, so a common one is read only by keywords made of common ones; a keyword of which a stretch is in no
    name meets none. The work follows the names and the hits, not the number of alerts.
    """
    words = keywords.select("keyword").where(F.length("keyword") > 0).distinct().withColumn("n", F.least(F.length("keyword"), F.lit(GRAM)))
    sizes = F.array(*(F.lit(i) for i in range(1, GRAM + 1)))
    index = names.select("name", "folded", F.explode(F.flatten(F.transform(sizes, lambda n: F.when(F.length("folded") >= n, _grams(F.col("folded"), n)).otherwise(F.array().cast("array<string>"))))).alias("gram"))
    frequency = index.groupBy("gram").agg(F.count("*").alias("df"))
    wanted = words.select("keyword", F.explode(_grams(F.col("keyword"), F.col("n"))).alias("gram"))
    rarest = wanted.join(frequency, "gram", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r"))
    probes = rarest.where("r.df > 0").select("keyword", F.col("r.gram").alias("gram"))
    return index.join(probes, "gram").where(F.col("folded").contains(F.col("keyword"))).select("keyword", "name")


def alert_offers(offers: DataFrame, alerts: DataFrame, name: str = "product_name") -> DataFrame:
    """Pairs of alerts (alert, word, chains, cat, top) and offers (`name`, chain, category, price), with all columns of the offers.

    An empty list of chains, a null or empty category and a null price mean any; a word has a letter at least. Names are
    matched once each, however many offers have them.
    """
    names = offers.select(F.col(name).alias("name")).dropna().distinct().withColumn("folded", alert_fold(F.col("name")))
    keyed = alerts.withColumn("keyword", alert_fold(F.col("word")))
    hits = keyed.join(keyword_hits(names, keyed), "keyword").select("alert", "chains", F.nullif("cat", F.lit("")).alias("cat"), "top", F.col("name").alias("_name"))
    pairs = offers.join(hits, F.col(name) == F.col("_name"))
    any_chain = (F.size("chains") == 0) | F.array_contains("chains", F.col("chain"))
    passed = any_chain & (F.col("cat").isNull() | (F.col("cat") == F.col("category"))) & (F.col("top").isNull() | (F.col("price") <= F.col("top").cast("double")))
    return pairs.where(passed).select("alert", *(F.col(f"`{c}`") for c in offers.columns))


def _price_slice(price: Column) -> Column:
    """Grows with the price; one slice for what is not above 0, one for infinity and NaN."""
    return F.when(price <= 0, -20_000).when(price < float("inf"), F.floor(F.log2(price) * STEPS).cast("int")).otherwise(20_000)


def alert_counts(offers: DataFrame, alerts: DataFrame, name: str = "product_name") -> DataFrame:
    """(alert, hits): how many offers each alert finds, of `alert_offers`' rules, without a pair of alert and offer; alerts without any are left out.

    Alerts of one keyword, chains and category are one watch and differ by their price only: a watch counts its offers up to
    each price once. Offers are counted by name, chain, category and price, and meet the watches that hold them; the prices of
    a watch are summed in slices, with one total for each slice before them. The work follows the offers and the alerts apart.
    """
    groups = offers.groupBy(F.col(name).alias("_name"), "chain", "category", F.col("price").cast("double").alias("_price")).agg(F.count("*").alias("_n"))
    names = groups.select(F.col("_name").alias("name")).dropna().distinct().withColumn("folded", alert_fold(F.col("name")))
    keyed = alerts.select("alert", "chains", F.nullif("cat", F.lit("")).alias("cat"), F.col("top").cast("double").alias("top"), alert_fold(F.col("word")).alias("keyword"))
    keyed = keyed.where("chains is not null").withColumn("watch", F.sha2(F.to_json(F.struct("keyword", F.array_sort("chains").alias("chains"), "cat")), 256))
    watches = keyed.groupBy("watch").agg(F.first("keyword").alias("keyword"), F.first("chains").alias("chains"), F.first("cat").alias("cat"))
    hits = watches.join(keyword_hits(names, keyed), "keyword").select("watch", "chains", "cat", F.col("name").alias("_name"))
    sides = [hits.where("cat is null").drop("cat"), hits.where("cat is not null").withColumnRenamed("cat", "category")]
    any_chain = (F.size("chains") == 0) | F.array_contains("chains", F.col("chain"))
    seen = [groups.join(side, [c for c in ("_name", "category") if c in side.columns]).where(any_chain).select("watch", "_price", "_n") for side in sides]
    counted = seen[0].unionByName(seen[1]).groupBy("watch", "_price").agg(F.sum("_n").alias("_n"))

    dear = F.col("_price").isNotNull()
    whole = counted.groupBy("watch").agg(F.sum("_n").alias("_whole"))
    tops = keyed.where("top is not null").select("watch", F.col("top").alias("_price")).distinct()
    both = counted.where(dear).withColumn("_asked", F.lit(False)).unionByName(tops.withColumn("_n", F.lit(0).cast("long")).withColumn("_asked", F.lit(True)))
    both = both.withColumn("_slice", _price_slice(F.col("_price")))
    before = Window.partitionBy("watch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = both.groupBy("watch", "_slice").agg(F.sum("_n").alias("_all")).select("watch", "_slice", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("watch", "_slice").orderBy("_price", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = both.withColumn("_in", F.sum("_n").over(within)).where("_asked").join(offsets, ["watch", "_slice"]).select("watch", F.col("_price").alias("top"), (F.col("_in") + F.col("_before")).alias("hits"))
    priced = keyed.where("top is not null").select("alert", "watch", "top").join(upto, ["watch", "top"]).select("alert", "hits")
    free = keyed.where("top is null").select("alert", "watch").join(whole, "watch").select("alert", F.col("_whole").alias("hits"))
    return priced.unionByName(free).groupBy("alert").agg(F.sum("hits").alias("hits")).where("hits > 0")
