"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Semantics (`mix`)
    Size of a document: number of maximal runs of characters other than space and the controls 9 to 13; 0 for null.
    Sources are ordered by code point, null last, and weigh `weights`, repeating. Their targets share `share` times the
    sum of all sizes by weight; no target exceeds `cap` times its source's size, and the excess is shared anew by weight
    among the others until none is above. If every source is capped, all targets are at their caps.
    Each document is taken whole, 0 to `cap` times (a whole number). A source's documents stand in a fixed pseudo-random
    order, which is gone through `cap` times, and its demand is its target; a copy is taken if the schedule (below) reaches
    its middle within training, that is if the words before its middle are within the demand. So a source's taken words differ from its target by at most half of one
    document. Documents without words are taken as often as their place in that order says. Null doc_ids, repeated rows
    and ties in the order are kept: rows that tie are ordered by size. An empty table gives an empty result.

Curriculum
    The weight of a source over training time t in [0, 1] is w * (start + (end - start) * t), where `ramp` gives (start,
    end) for its weight class. Its integral, scaled to 1 at t = 1, is the source's share of tokens consumed by time t;
    the inverse at a copy's cumulative share of its source's taken words is that copy's training position.
    `mix` range-partitions and sorts documents by the position of their first copy (those not taken last); `training_order`
    does so with a row for each copy.

Plan: one pass over the texts makes (id, source, size). One total per source is aggregated before any shuffle. Running sums
are made in slices (`prefix_sums`), so a source with a third of all rows is spread over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.shared import BROADCAST_ROWS, free_name, prefix_sums, stored

WEIGHTS = (3.0, 1.0, 2.0)
#: Relative weight at the start and at the end of training, by weight class: the heaviest sources come early.
RAMP = {3.0: (1.5, 0.5), 1.0: (0.5, 1.5), 2.0: (1.0, 1.0)}
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of the sources of totals (source, source_size): weight, source_size, target.

    Sources fill to their caps in the order of cap / weight. With C_k the caps of the first k and W_k the weights of the
    rest, the level if exactly those k are capped is (total - C_k) / W_k; the largest k whose level passes the k-th cap's
    ratio is the fixed point of sharing the excess anew. These windows run over one row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    up_to, everything = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = weighed.withColumn("cap", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("capped_before", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)))
    t = t.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("weight_left"))
    # the first source that is not capped at the level of its place sets the level; all capped: no level
    t = t.withColumn("place", F.row_number().over(ordered))
    t = t.withColumn("set_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("set_level") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 11, keep_row: bool = False, plan: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position (of the first copy; null if it is not taken).

    With plan, the result has `before` (the words before a row in its source's order) and `weight` instead of position.
    With keep_row, it has all columns of documents and, last, a struct `_mix` of size, source_size, target, copies,
    before and weight.
    """
    if keep_row:
        name = free_name(documents, "_row")
        sized = documents.select("doc_id", F.col("source").alias("source"), word_count(F.col("text")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias(name))
    else:
        name = None
        sized = stored(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    totals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    t = totals.select(F.col("source").alias("_source"), "source_size", "weight", "target")
    ordered = prefix_sums(sized, ["source"], ["doc_id", "size"], {"before": "size"}, seed)
    rows = ordered.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    middle = lambda k: F.col("before") + k * F.col("source_size") + F.col("size") / 2
    reached = lambda k: (F.col("target") > 0) & (reach(middle(k), F.col("target"), F.col("weight")) <= 1)
    rows = rows.withColumn("copies", F.size(F.filter(F.sequence(F.lit(0), F.lit(int(cap) - 1)), reached)))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    if keep_row:
        return rows.select(f"{name}.*", F.struct("size", "source_size", "target", "copies", "before", "weight").alias(free_name(documents, "_mix")))
    if plan:
        return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "before", "weight")
    p = F.when(F.col("copies") > 0, position(F.col("before"), F.col("target"), F.col("weight")))
    placed = rows.select("doc_id", "size", "source_size", "target", "taken", "copies", p.alias("position"))
    keys = [F.col("position").asc_nulls_last(), F.xxhash64("doc_id"), F.col("size")]
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def reach(words_before: Column, target: Column, weight: Column, ramp: dict[float, tuple[float, float]] = RAMP) -> Column:
    """`position`, but 2 for demand that training does not reach."""
    return F.when(words_before <= target, position(words_before, target, weight, ramp)).otherwise(2.0)


def position(words_before: Column, target: Column, weight: Column, ramp: dict[float, tuple[float, float]] = RAMP) -> Column:
    """Training time at which a source has consumed words_before of its target: the inverse of its integrated schedule.

    With start a and end b, the share consumed by t is (a*t + (b - a)*t*t/2) / ((a + b)/2); its inverse is the root of a
    quadratic, written so that it also holds where a equals b.
    """
    start, end = F.lit(1.0), F.lit(1.0)
    for w, (a, b) in ramp.items():
        start, end = F.when(weight == w, F.lit(a)).otherwise(start), F.when(weight == w, F.lit(b)).otherwise(end)
    part = F.when(target > 0, F.least(F.lit(1.0), words_before / target)).otherwise(0.0)
    need = part * (start + end) / 2
    return F.least(F.lit(1.0), 2 * need / (start + F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * (end - start) * need))))


def training_order(documents: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """Rows of documents once for each copy taken, range-partitioned and sorted by training position; columns as they were.

    Where doc_id is unique, the mix is made of ids and sizes and joined to the rows (broadcast up to an eighth of BROADCAST_ROWS
    rows, as they are wide, else shuffled); where it repeats, rows go through the mix whole. The result is the same.
    """
    at, id_, n = free_name(documents, "_mix"), free_name(documents, "_mix_id"), documents.select("doc_id")
    if n.groupBy("doc_id").count().where("count > 1").isEmpty():
        small = stored(mix(documents, plan=True, **options).where("copies > 0"), "mix")
        side = small.select(F.col("doc_id").alias(id_), F.struct("size", "source_size", "target", "copies", "before", "weight").alias(at))
        mixed = documents.join(F.broadcast(side) if small.count() <= BROADCAST_ROWS // 8 else side, F.col("doc_id").eqNullSafe(F.col(id_))).drop(id_)
    else:
        mixed = mix(documents, keep_row=True, **options)
        mixed = mixed.withColumnRenamed(mixed.columns[-1], at).where(F.col(at)["copies"] > 0)
    pos, copy, m = free_name(mixed, "_position"), free_name(mixed, "_copy"), F.col(at)
    copies = mixed.withColumn(copy, F.explode(F.sequence(F.lit(0), m["copies"] - 1)))
    placed = copies.withColumn(pos, position(m["before"] + F.col(copy) * m["source_size"], m["target"], m["weight"]))
    keys = [F.col(pos), F.xxhash64("doc_id", F.col(copy))]
    ranged = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys).select(*(f"`{c}`" for c in documents.columns))
