"""Sharding by balanced label propagation: linked documents move towards their neighbours' shard under capacity quotas.

Semantics (`shards`)
    Size of a row: UTF-8 bytes of its text (null: none) plus 1. The law is `rows`: at the end, the shards' row counts are
    at most one apart. Rows are linked if their `link` values are equal (by default: equal texts); rows with a null link
    are linked with nothing. `slot` numbers the rows of a shard from 0 without gaps. `text_crc32` is unsigned and null for
    a null text. Repeated rows, ties and null doc_ids are rows like any other; an empty table gives an empty result.

Method
    Rows start on the shard of a hash of their id. In each round every link group votes (pre-aggregated counts of its rows
    by shard), and its rows outside the leading shard ask to move there. A quota for each target is found so that the linked
    rows of no shard pass its capacity, a mean share of all rows (unlinked rows make room later), and whole groups are let
    through by a hash in that proportion, so a group moves together. Rounds end when nothing asks to move or when as many
    rows ask as before. Then rows over an exact quota move to shards under it, rows without links first, then whole groups
    (in pieces of about PIECE rows, where they are larger). Only a group that no shard can hold is split beforehand, into
    parts that vote apart.

The driver sees only the counts by pair of shards. Nothing but (id, size, crc, link, shard) is shuffled, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.shared import checkpointed, prefix_sums, sent_if_few, unsigned_crc32

SHARDS = 8
#: Rows of one group that are numbered together when rows over the quota move.
PIECE = 100_000


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _quotas(counts: list[int], flows: dict[tuple[int, int], int], capacity: float) -> list[float]:
    """For each target the share of requests to let in so that no shard passes its capacity (fixed point over outflows)."""
    k = len(counts)
    into = [sum(n for (_, t), n in flows.items() if t == x) for x in range(k)]
    share = [1.0] * k
    for _ in range(4 * k):
        leaving = [sum(n * share[t] for (s, t), n in flows.items() if s == x) for x in range(k)]
        share = [min(1.0, max(0.0, (capacity - counts[x] + leaving[x]) / into[x])) if into[x] else 1.0 for x in range(k)]
    return share


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index + 1)


def propagate(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows with columns h (a hash of the row), link and shard, their shards improved by label propagation; adds part and piece."""
    total = rows.count()
    limit = max(1, total // shards)
    groups = rows.where("link is not null").groupBy("link").agg(F.count("*").alias("n")).where("n > 1")
    groups = sent_if_few(groups.select("link", F.ceil(F.col("n") / limit).cast("int").alias("parts"), F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")))
    of = lambda seed, n: F.when(F.col(n).isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "h"), F.col(n)).cast("int"))
    rows = rows.join(groups, "link", "left").withColumn("part", of(3, "parts")).withColumn("piece", F.xxhash64("link", "part", of(4, "pieces"))).drop("parts", "pieces")
    rows = checkpointed(rows)
    r, asked = 0, total + 1
    while True:
        linked = rows.where("part is not null")
        votes = linked.groupBy("link", "part", "shard").agg(F.count("*").alias("n"))
        lead = votes.groupBy("link", "part").agg(F.max(F.struct("n", F.xxhash64("link", "shard").alias("tie"), "shard")).alias("top"), F.sum("n").alias("size"))
        moving = lead.where("top.n < size").select("link", "part", F.col("top.shard").alias("to"))
        asking = checkpointed(votes.join(moving, ["link", "part"]).where("shard <> to").groupBy("shard", "to").agg(F.sum("n").alias("n")))
        flows = {(x["shard"], x["to"]): x["n"] for x in asking.collect()}
        if not flows or sum(flows.values()) >= asked:
            break
        r, asked = r + 1, sum(flows.values())
        have = {x["shard"]: x["count"] for x in linked.groupBy("shard").count().collect()}
        share = _quotas([have.get(s, 0) for s in range(shards)], flows, total / shards)
        chance = F.pmod(F.xxhash64(F.lit(r), "link", "part"), F.lit(1_000_000)) / 1e6
        let_in = sent_if_few(moving.where(chance < _pick(share, F.col("to"))))
        after = rows.join(let_in, ["link", "part"], "left").withColumn("shard", F.coalesce("to", "shard")).select(*rows.columns)
        rows = checkpointed(after)
    return rows


def balanced(rows: DataFrame, shards: int) -> DataFrame:
    """Move as few rows as possible, unlinked rows first, so that the counts of all shards are at most one apart."""
    rows = rows.withColumn("held", F.col("part").isNotNull().cast("int")).withColumn("one", F.lit(1).cast("long"))
    have = {(x["shard"], x["held"]): x["count"] for x in rows.groupBy("shard", "held").count().collect()}
    counts = [have.get((s, 0), 0) + have.get((s, 1), 0) for s in range(shards)]
    total = sum(counts)
    # the shards that hold most get the remainder, so that fewer rows move
    larger = set(sorted(range(shards), key=lambda s: (-counts[s], s))[: total % shards])
    quota = [total // shards + (s in larger) for s in range(shards)]
    excess = [max(0, c - q) for c, q in zip(counts, quota, strict=True)]
    if not any(excess):
        return rows.drop("held", "one")
    rows = rows.withColumn("together", F.when(F.col("held") == 1, F.col("piece")).otherwise(F.col("h")))
    ranked = prefix_sums(rows, ["shard", "held"], ["together", "doc_id", "h"], {"rank": "one"}, seed=5, by=["together"])
    rank = F.col("rank") + F.when(F.col("held") == 1, _pick([have.get((s, 0), 0) for s in range(shards)], F.col("shard"))).otherwise(0)
    mover = F.when(rank < _pick(excess, F.col("shard")), rank + _pick([sum(excess[:s]) for s in range(shards)], F.col("shard")))
    to, filled = F.lit(None).cast("int"), 0
    places = []
    for s in range(shards):
        room = max(0, quota[s] - counts[s])
        if room:
            places.append((filled + room, s))
            filled += room
    for end, s in reversed(places):
        to = F.when(mover < end, F.lit(s)).otherwise(to)
    return ranked.withColumn("shard", F.coalesce(to, "shard")).drop("held", "one", "rank", "together")


def shards(documents: DataFrame, count: int = SHARDS, link: Column | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; see the module's text for the semantics."""
    text = F.col(text_col)
    rows = documents.select("doc_id", byte_size(text).alias("size"), unsigned_crc32(text).alias("text_crc32"), (F.md5(text.cast("binary")) if link is None else link).alias("link"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(count)).cast("int"))
    placed = checkpointed(balanced(propagate(checkpointed(rows), count), count).withColumn("one", F.lit(1).cast("long")))
    slotted = prefix_sums(placed, ["shard"], ["doc_id", "h"], {"slot": "one"}, seed=9)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
