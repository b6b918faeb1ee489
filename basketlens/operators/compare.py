"""Joins that match rows: token overlaps, name guards, prioritised lookups, alternatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.num import half_up
from basketlens.functions.packs import pack_count, quantities, quantities_apart
from basketlens.functions.similarity import BAND, FLOOR, salient_tokens, token_similarity, variant_families
from basketlens.functions.text import let


#: Postings for each of its k matches that the rarest tokens of a row may read before its k-th score bounds the rest.
PROBE = 20
#: Distinct tokens of left rows that are sent to every task; with more of them, tokens are shuffled.
SENT = 200_000
#: Parts by which tokens are numbered.
PARTS = 4096


class _Overlaps:
    """Both sides of an overlap join. Right rows with the same token list (by its SHA-256) are one set; a row's tokens stand by rarity on the right.

    `ranked` has a row for each distinct token of a left row that occurs on the right: `_upto`, the postings of it and of the
    rarer tokens, `_place` among them, and `_rest`, how much it and the commoner ones can add to a score. A set that shares none of the rarer tokens
    scores `_rest` at most.
    """

    def __init__(self, left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: int | None = None):
        """With `least` only the first so many right rows of each set, cut before they are shuffled."""
        self.left_id, self.right_id = left_id, right_id
        counted = left.select(F.col(left_id), F.explode("tokens").alias("_t")).groupBy(left_id, "_t").agg(F.count("*").alias("_n"))
        self.sent = F.broadcast if counted.count() <= SENT else lambda df: df
        # tokens that no left row has decide nothing; the others go by number, so that long rows are short lists to shuffle
        part = F.pmod(F.xxhash64("_t"), F.lit(PARTS)).cast("int")
        words = counted.select("_t").distinct().withColumn("_part", part)
        words = words.select("_t", (F.col("_part") + PARTS * (F.row_number().over(Window.partitionBy("_part").orderBy("_t")) - 1)).alias("_code"))
        counted = counted.join(self.sent(words), "_t").select(left_id, F.col("_code").alias("_t"), "_n")
        whole = F.unhex(F.sha2(F.to_json("tokens"), 256))
        held = right.where(F.size("tokens") > 0).select(right_id, F.size("tokens").alias("_size"), whole.alias("_whole"), F.explode(F.array_distinct("tokens")).alias("_t"))
        named = held.join(self.sent(words), "_t").groupBy(right_id, "_size", "_whole").agg(F.sort_array(F.collect_set("_code")).alias("_all"))
        equal = Window.partitionBy("_whole")
        if least is not None:
            named = named.withColumn("_place", F.row_number().over(equal.orderBy(right_id))).where(F.col("_place") <= least).drop("_place")
        # read five times below; blocks of a lost executor are made again, and clearCache() gives the room back
        named = named.withColumn("_set", F.min(right_id).over(equal)).persist(StorageLevel.MEMORY_AND_DISK)
        self.members = named.select(right_id, "_set")
        self.sets = named.where(F.col(right_id) == F.col("_set")).select("_set", "_size", F.col("_all").alias("_tokens"))
        self.postings = self.sets.select("_set", "_size", F.explode("_tokens").alias("_t"))
        self.weights = counted.groupBy(left_id).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_n"))).alias("_weights"), F.sum("_n").alias("_total"))
        rarity = Window.partitionBy(left_id).orderBy("_df", "_t")
        upto = F.sum("_df").over(rarity.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rest = F.sum("_n").over(rarity.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        frequency = self.postings.groupBy("_t").agg(F.count("*").alias("_df"))
        ranked = counted.join(frequency, "_t").select(left_id, "_t", upto.alias("_upto"), F.row_number().over(rarity).alias("_place"), rest.alias("_rest"))
        self.ranked = self.sent(ranked)

    def scored(self, hits: DataFrame) -> DataFrame:
        """The exact score of each (left row, set) once, from whole token lists."""
        pairs = hits.select(self.left_id, "_set").distinct().join(self.weights, self.left_id).join(self.sets, "_set")
        shared = F.array_intersect(F.map_keys("_weights"), "_tokens")
        score = F.aggregate(shared, F.lit(0).cast("long"), lambda s, t: s + F.col("_weights")[t])
        return pairs.select(self.left_id, "_set", "_size", "_total", score.alias("score"))


def top_overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int) -> DataFrame:
    """The k right rows that share most tokens with each left row, by score, then right id; a left token counts as often as it stands there.

    Exact, by prefixes: the rarest tokens of a left row give candidates, whose k-th score is a bound; a right row that shares
    none of them can only reach it if it shares a token whose `_rest` does, so commoner tokens are looked up as far as that.
    Pairs that share common tokens alone are never made unless they can be among the k. Rows of equal token lists are scored once.
    """
    sides = _Overlaps(left, right, left_id, right_id, k)
    place = F.row_number().over(Window.partitionBy(left_id).orderBy(F.desc("score"), F.asc(right_id)))

    def best(scored: DataFrame) -> DataFrame:
        return scored.select(left_id, "_set", "score").join(sides.members, "_set").select(left_id, right_id, "score").withColumn("_rn", place).where(F.col("_rn") <= k).drop("_rn")

    rare = (F.col("_upto") <= PROBE * k) | (F.col("_place") == 1)
    first = sides.scored(sides.ranked.where(rare).join(sides.postings, "_t"))
    bound = best(first).groupBy(left_id).agg(F.when(F.count("*") == k, F.min("score")).alias("_bound"))
    open_ = sides.sent(sides.ranked.where(~rare).join(bound, left_id, "left").where(F.col("_rest") >= F.coalesce("_bound", F.lit(1))))
    more = sides.scored(open_.join(sides.postings, "_t").select(left_id, "_set").join(first.select(left_id, "_set"), [left_id, "_set"], "left_anti"))
    return best(first.unionByName(more))


def overlaps_of(left: DataFrame, right: DataFrame, left_id: str, right_id: str, floor: float) -> DataFrame:
    """Pairs that share at least `floor` of the shorter side's tokens (left tokens counted as often as they stand there), with that share.

    The rarest token that a pair shares leaves enough to reach the floor with it and commoner ones; other hits are dropped before pairs are made.
    """
    if not floor > 0:
        raise ValueError("a floor of 0 lets every pair pass")
    sides = _Overlaps(left, right, left_id, right_id)
    ranked = sides.sent(sides.ranked.join(sides.weights.select(left_id, "_total"), left_id))
    shorter = F.least("_total", "_size")
    hits = ranked.join(sides.postings, "_t").where(F.col("_rest") / shorter >= floor)
    pairs = sides.scored(hits).withColumn("share", F.col("score") / shorter).where(F.col("share") >= floor)
    return pairs.join(sides.members, "_set").select(left_id, right_id, "share")


def comparable_pairs(names: DataFrame, group: str, name: str) -> DataFrame:
    """Pairs of names of one group (a < b) that the guards let through; repeated names count once.

    No two names meet unless the guards may let them: their variant families are equal (a join key), their numbers n and m
    of salient tokens allow the similarity (both are keys), and they share one of the rarest tokens. Of n tokens a pair
    needs (n + m) * FLOOR / (1 + FLOOR) in common, so two names that pass share one of the n - needed + 1 rarest of one and
    of the m - needed + 1 rarest of the other. Tokens count as equal here if they may be equal or one begin with the other:
    those with digits by themselves, others by their first two letters (none is shorter), numbered where they repeat.
    Quantities are tokens, too; whether they are apart is tested, like the rest, on the pairs that are left.
    """
    rows = names.select(F.col(group).alias("_group"), F.col(name).alias("_name")).dropna().distinct()
    rows = rows.select("_group", "_name", salient_tokens(F.col("_name")).alias("tokens"), variant_families(F.col("_name")).alias("families"), quantities(F.col("_name")).alias("q"))
    stem = lambda t: F.when(t.rlike("[0-9]"), t).otherwise(F.substring(t, 1, 2))
    numbered = lambda ks: F.transform(ks, lambda x, i: F.concat_ws("#", x, F.size(F.filter(F.slice(ks, 1, i + 1), lambda y: y == x)).cast("string")))
    keyed = rows.where(F.size("tokens") > 0).select("_group", "_name", "families", F.explode(let(F.transform("tokens", stem), numbered)).alias("key"))
    frequency = keyed.groupBy("_group", "key").agg(F.count("*").alias("df"))
    ranked = keyed.join(frequency, ["_group", "key"]).groupBy("_group", "_name", "families").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    n = F.size("keys")
    sizes = F.sequence(F.ceil(n * FLOOR).cast("int"), F.floor(n / FLOOR).cast("int"))
    index = ranked.select("_group", "_name", "families", "keys", n.alias("n"), F.explode(sizes).alias("m"))
    needed = F.ceil((F.col("n") + F.col("m")) * (FLOOR / (1 + FLOOR)) - 1e-9).cast("int")
    index = index.select("_group", "families", "n", "m", F.explode(F.slice("keys", F.lit(1), F.greatest(F.col("n") - needed + 1, F.lit(0)))["key"]).alias("key"), "_name")
    a, b = index.withColumnRenamed("_name", "a"), index.select("_group", "families", F.col("m").alias("n"), F.col("n").alias("m"), "key", F.col("_name").alias("b"))
    pairs = a.join(b, ["_group", "families", "n", "m", "key"]).where("a < b").select("_group", "a", "b").distinct()
    side = lambda x: rows.select("_group", F.col("_name").alias(x), F.col("tokens").alias(f"t_{x}"), F.col("q").alias(f"q_{x}"))
    known = pairs.join(side("a"), ["_group", "a"]).join(side("b"), ["_group", "b"])
    passed = known.where(~quantities_apart(F.col("q_a"), F.col("q_b")) & (token_similarity(F.col("t_a"), F.col("t_b")) >= FLOOR))
    return passed.select(F.col("_group").alias(group), "a", "b")


def waterfall(rows: DataFrame, steps: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Look rows up in several tables (name, table of key and product_id, key); the first that has the key wins.

    A key that a table repeats stands for its least product_id, so no row is multiplied.
    """
    out, found, via = rows, [], F.lit(None).cast("string")
    for i, (name, known, key) in enumerate(steps):
        side = known.groupBy(F.col(key).alias(f"_k{i}")).agg(F.min("product_id").alias(f"_p{i}"))
        out = out.join(side, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_p{i}")
    for i, (name, _, _) in reversed(list(enumerate(steps))):
        via = F.when(F.col(f"_p{i}").isNotNull(), F.lit(name)).otherwise(via)
    return out.select(*rows.columns, F.coalesce(*found).alias("product_id"), via.alias("via"))


def like_for_like(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Pairs (group, a, b, score) of a group's distinct names, each with itself and in both orders, that are the same goods:
    equal packs and variant families (join keys), no quantities apart, and similar enough. What a name states is read once a name."""
    of = F.col("_name")
    stated = rows.select(F.col(name).alias("_name")).dropna().distinct()
    stated = stated.select("_name", pack_count(of).alias("_pack"), variant_families(of).alias("_families"), quantities(of).alias("_q"), salient_tokens(of).alias("_tokens"))
    named = rows.select(F.col(group).alias("_group"), F.col(name).alias("_name")).dropna().distinct().join(stated, "_name")
    a, b = (named.select("_group", "_pack", "_families", F.col("_name").alias(x), F.col("_q").alias(f"_q_{x}"), F.col("_tokens").alias(f"_t_{x}")) for x in "ab")
    pairs = a.join(b, ["_group", "_pack", "_families"]).where(~quantities_apart(F.col("_q_a"), F.col("_q_b")))
    return pairs.select(F.col("_group").alias(group), "a", "b", token_similarity(F.col("_t_a"), F.col("_t_b")).alias("score")).where(F.col("score") >= FLOOR)


def cheaper_alternatives(sources: DataFrame, rows: DataFrame, least: float = 0.10, name: str = "product_name") -> DataFrame:
    """For each source offer the cheapest offer of the same goods in another chain that saves `least` or more.

    Of a chain's offers that save enough only those of the names most like the source's count (within BAND). The best offer of
    each product, name and chain is made first, so a source meets one row a name and chain, not all offers.
    """
    best = rows.groupBy("product_id", F.col(name).alias("b"), F.col("chain").alias("other_chain")).agg(F.min(F.struct("price", "offer_id")).alias("o"))
    named = rows if sources is rows else sources.select("product_id", name).union(rows.select("product_id", name))
    near = like_for_like(named, "product_id", name)
    hits = sources.select("offer_id", "product_id", "chain", "price", F.col(name).alias("a")).join(near, ["product_id", "a"]).join(best, ["product_id", "b"])
    hits = hits.where((F.col("chain") != F.col("other_chain")) & (F.col("price") - F.col("o.price") >= least))
    by_chain = hits.groupBy("offer_id", "price", "other_chain").agg(F.collect_list(F.struct("score", "o")).alias("os"))  # one row a name
    top = F.array_max(F.transform("os", lambda x: x["score"]))
    kept = F.array_min(F.transform(F.filter("os", lambda x: x["score"] >= F.col("top") - BAND), lambda x: x["o"]))
    picks = by_chain.withColumn("top", top).select("offer_id", "price", "other_chain", kept.alias("o"))
    pick = picks.groupBy("offer_id", "price").agg(F.min(F.struct("o", "other_chain")).alias("x"))
    return pick.select("offer_id", F.col("x.o.offer_id").alias("other"), F.col("x.other_chain").alias("chain"), half_up(F.col("price") - F.col("x.o.price"), 2).alias("saving"))


def comparison_chains(offers: DataFrame, shelf: DataFrame, name: str = "product_name", cap: int = 8) -> DataFrame:
    """offer_id, chains: in how many other chains an offer can be compared.

    By offers of the same goods (of each chain only those of the names most like its own, within BAND; the `cap` cheapest of
    all), and by a shelf price (product_id, chain) in chains without any offer of the product. Sources of one product, name
    and chain share one list of the cheapest `cap` + 1; whether a source is its chain's only offer of its name decides what is
    most like it there, so that is part of the key. No offers meet offers.
    """
    per = offers.groupBy("product_id", F.col(name).alias("b"), F.col("chain").alias("other")).agg(F.count("*").alias("n"))
    near = like_for_like(offers, "product_id", name)
    kinds = per.select("product_id", F.col("b").alias("a"), F.col("other").alias("chain"), (F.col("n") == 1).alias("lone"))
    meets = kinds.join(near, ["product_id", "a"]).join(per.drop("n"), ["product_id", "b"])
    meets = meets.where(~(F.col("lone") & (F.col("a") == F.col("b")) & (F.col("chain") == F.col("other"))))
    best = F.max("score").over(Window.partitionBy("product_id", "a", "chain", "other"))
    meets = meets.withColumn("best", best).where(F.col("score") >= F.col("best") - BAND).select("product_id", "a", "chain", "b", "other")
    cheapest = F.row_number().over(Window.partitionBy("product_id", "b", "other").orderBy("price", "offer_id"))
    few = offers.select("product_id", F.col(name).alias("b"), F.col("chain").alias("other"), "price", "offer_id").withColumn("rn", cheapest).where(F.col("rn") <= cap + 1).drop("rn")
    place = F.row_number().over(Window.partitionBy("product_id", "a", "chain").orderBy("price", "offer_id"))
    listed = meets.join(few, ["product_id", "b", "other"]).withColumn("rn", place).where(F.col("rn") <= cap + 1)
    lists = listed.groupBy("product_id", "a", "chain").agg(F.sort_array(F.collect_list(F.struct("price", "offer_id", "other"))).alias("found"))
    on_offer = offers.select("product_id", "chain").distinct()
    shelves = shelf.select("product_id", "chain").distinct().join(on_offer, ["product_id", "chain"], "left_anti").groupBy("product_id").agg(F.count("*").alias("shelves"))
    rows = offers.select("offer_id", "product_id", "chain", F.col(name).alias("a")).join(lists, ["product_id", "a", "chain"], "left").join(shelves, "product_id", "left")
    others = F.slice(F.filter("found", lambda x: x["offer_id"] != F.col("offer_id")), 1, cap)
    chains = F.size(F.array_remove(F.array_distinct(others["other"]), F.col("chain")))
    return rows.select("offer_id", (F.coalesce(F.when(F.col("found").isNotNull(), chains), F.lit(0)) + F.coalesce("shelves", F.lit(0))).alias("chains"))
