"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Semantics (`decontaminate`)
    Words are maximal runs of ASCII letters, ASCII digits and code points beyond ASCII, A-Z lower-cased. A window is
    `window` consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Every
    document word inside any occurrence of a window is hit. Null and empty texts have no words; the windows of an item
    without an id hit words, but name no item; items with equal texts all count. An empty benchmark hits nothing; an empty table gives an empty result.
    Each row is judged on its own, so repeated rows get equal results; other columns pass through.

Method
    Patterns are grouped by length. For each length m, a block of B words (2, or 1 where m is 1) that ends j words before
    the end of a pattern shifts the scan by j; a block that is in no pattern shifts by m - B + 1, and a word that is in
    no pattern by m, which skips most of a clean text. Where the shift is 0, the block selects a bucket of patterns with
    that suffix, and each is compared with the text directly. Hits of overlapping windows are merged.

Pairs of a window and its item are made and counted in Spark. Up to PATTERN_BLOCK pairs are one table, sent to every task.
More are dealt by a hash into blocks of about PATTERN_BLOCK pairs (a window of many items lies in several), and the blocks are
searched one after the other: of each, only the texts with hits are written (their SHA-256, spans and items), its table is
given up before the next is sent, and the last pass joins what was found to the rows by the SHA-256 of their texts. So the
driver and each worker hold one table at a time, and the texts themselves are read once a block and never written.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm.shared import free_name, sent_if_few, stored
from basketlens.llm.text_hash import released

WINDOW = 10
PATTERN_BLOCK = 200_000

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_SPLIT).split() if text else []


def windows(text: bytes | None, window: int = WINDOW) -> list[bytes]:
    """The windows of one benchmark text, each as its words joined by a space."""
    w = words(text)
    return [b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)]


class WuManber:
    """Shift tables and suffix buckets of a set of word sequences."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[tuple[int, ...], list[str]]]] = defaultdict(list)
        for p, items in patterns.items():
            by_length[len(p)].append((tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in p), items))
        self.radix = len(self.ids) + 1
        self.tables = []
        for m, group in sorted(by_length.items()):
            block = min(2, m)
            shift: dict[int, int] = {}
            buckets: dict[int, list[tuple[tuple[int, ...], list[str]]]] = defaultdict(list)
            for p, items in group:
                for end in range(block, m + 1):
                    key = self._key(p, end, block)
                    shift[key] = min(shift.get(key, m), m - end)
                buckets[self._key(p, m, block)].append((p, items))
            self.tables.append((m, block, shift, dict(buckets)))

    def _key(self, ids, end: int, block: int) -> int:
        return ids[end - 1] if block == 1 else ids[end - 2] * self.radix + ids[end - 1]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences, and the items that they belong to."""
        get, radix, n = self.ids.get, self.radix, len(text)
        seq = [get(w, 0) for w in text]
        spans, items = [], set()
        for m, block, shift, buckets in self.tables:
            skip, end = m - block + 1, m
            while end <= n:
                last = seq[end - 1]
                if not last:
                    end += m
                    continue
                key = last if block == 1 else seq[end - 2] * radix + last
                move = shift.get(key, skip)
                if move:
                    end += move
                    continue
                for pattern, own in buckets[key]:
                    if tuple(seq[end - m : end]) == pattern:
                        spans.append((end - m, end))
                        items.update(own)
                end += 1
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searcher(shared: Broadcast):
    """The search for one table of patterns, as a column function."""

    @F.arrow_udf(_HITS)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wu = WuManber(shared.value)
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])
        for batch in released(texts):
            rows = []
            for t in batch:
                w = words(t.as_py())
                spans, items = wu.search(w)
                rows.append({"n_words": len(w), "spans": [{"a": a, "b": b} for a, b in merged(spans)], "items": sorted(items)})
            yield pa.array(rows, kind)

    return search


def _hit_words(spans: Column) -> Column:
    """Words under the union of spans (structs of a, b): the blocks' spans in order, each counted beyond the last end."""
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"))
    return F.aggregate(F.sort_array(spans), begin, add, lambda acc: acc["n"])


def _window_pairs(benchmark: DataFrame, window: int) -> DataFrame:
    """The distinct pairs (item, w) of benchmark items and their windows."""

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(texts):
            yield pa.array([windows(t.as_py(), window) for t in batch], pa.list_(pa.binary()))

    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.explode(cut(F.col("text").cast("binary"))).alias("w")).distinct()


def _patterns(pairs: DataFrame) -> Broadcast:
    """One block's windows with the items that hold each, on every executor."""
    found: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for item, w in pairs.collect():
        found[tuple(bytes(w).split(b" "))] += [] if item is None else [item]
    return pairs.sparkSession.sparkContext.broadcast(dict(found))


def _earlier_hits(text: Column, documents: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(key, spans, items) of the distinct texts that hold a window of any of the blocks; key is the SHA-256 of the text."""
    found = []
    for pairs in blocks:
        shared = _patterns(pairs)
        hits = documents.select(F.sha2(text, 256).alias("key"), _searcher(shared)(text).alias("hit")).where(F.size("hit.spans") > 0)
        found.append(stored(hits.select("key", "hit.spans", "hit.items").dropDuplicates(["key"]), "hits"))
        shared.unpersist()
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> tuple[DataFrame, Column]:
    """The documents with one struct column more, and that column: n_words, n_hit, n_items, items_sha256, contaminated."""
    name = free_name(documents, "_hits")
    text = F.col(text_col).cast("binary")
    pairs = stored(_window_pairs(benchmark, window), "windows")
    n = max(1, -(-pairs.count() // PATTERN_BLOCK))
    blocks = [pairs.where(F.pmod(F.xxhash64("w", "item"), F.lit(n)) == i) for i in range(n)] if n > 1 else [pairs]
    out = documents.withColumn(name, _searcher(_patterns(blocks[-1]))(text))
    hit = F.col(name)
    spans, items = hit["spans"], hit["items"]
    if n > 1:
        key, other = free_name(documents, "_key"), free_name(documents, "_earlier")
        earlier = _earlier_hits(text, documents, blocks[:-1]).select(F.col("key").alias(key), F.struct("spans", "items").alias(other))
        out = out.withColumn(key, F.sha2(text, 256)).join(sent_if_few(earlier), key, "left")
        both = lambda a, part: F.concat(a, F.coalesce(F.col(other)[part], F.slice(a, 1, 0)))
        spans, items = both(spans, "spans"), both(items, "items")
    n_hit, items = _hit_words(spans), F.array_sort(F.array_distinct(items))
    digest = F.sha2(F.array_join(items, ","), 256)
    result = F.struct(hit["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    return out.select(*(F.col(f"`{c}`") for c in documents.columns), result.alias(name)), F.col(name)


def sql_word_pattern() -> str:
    """The same words as a regular expression, for SQL."""
    return re.sub(r"\s", "", r"[^\x00-\x2F \x3A-\x60 \x7B-\x7F]+")
