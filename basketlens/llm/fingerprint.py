"""Document fingerprints by locally consistent parsing.

Semantics (`Parser`, `fingerprints`)
    A text is parsed in levels. The symbols of level 0 are its code points; on each level runs of one symbol become one
    symbol, deterministic coin tossing labels every symbol by the lowest bit in which it differs from the symbol before it
    (twice, which leaves few labels), and a phrase begins at each local maximum of the labels. The name of a phrase, a
    hash of its symbols, is a symbol of the next level. Labels depend on a few neighbours only, so equal substrings get
    equal names inside, at any offset. Parsing ends when one symbol is left.
    The fingerprint holds the KEEP least names (32 bits, mixed with their level) of the phrases of level FIRST and up and of the
    last symbol, in hexadecimal; texts of every length choose from the same levels, and equal texts have equal fingerprints.
    The likeness of two fingerprints is the share of the least KEEP names of their union that both hold, an estimate of the resemblance of the sets of phrases; two
    empty texts have likeness 1, an empty text and another 0. A null text is empty. Repeated rows and ties in doc_id are
    ordered by their compressed texts; rows with a null doc_id come first. A single row is followed by itself.

`with_next` gives every row the row that follows in the order of doc_id without a global sort: cut points of doc_id (a
few quantiles) split the rows into ranges, a range is sorted inside a task, and the first row of each range is also sent
to the range before it. Texts are shuffled once, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.text_hash import mix, released

KEEP = 64
#: Short texts have few phrases, so they count from level 1; texts of every length do, so that all are comparable.
FIRST = 1
#: Rows of a range of doc_ids, about.
RANGE_ROWS = 1_000
CHUNK = 1 << 17
_U = np.uint64
_M1, _M2 = _U(0x9FB21C651E98DF25), _U(0xC2B2AE3D27D4EB4F)


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of non-zero 64-bit numbers."""
    low = x & (~x + _U(1))
    return (low.astype(np.float64).view(np.uint64) >> _U(52)) - _U(1023)


def _toss(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Label of each symbol against the one before it, from which it differs: 2 * (lowest differing bit) + its value there."""
    bit = _lowest_bit(x ^ before)
    return _U(2) * bit + ((x >> bit) & _U(1))


class Parser:
    """Parses many texts at once; the texts are apart: no phrase or label reaches over a border."""

    @staticmethod
    def _collapse(x: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of one symbol to one symbol that also names the length of the run."""
        new = np.ones(x.size, dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        if at.size == x.size:
            return x, text
        n = np.diff(np.append(at, x.size)).astype(np.uint64)
        return np.where(n == 1, x[at], mix(x[at] * _M1 + n)), text[at]

    @staticmethod
    def _starts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """True where a phrase begins: at the first symbol of a text and at local maxima of the labels."""
        label = x
        for _ in range(2):
            before = np.empty_like(label)
            before[1:] = label[:-1]
            # before a text's first symbol stands one that differs from it in the lowest bit
            before[first] = label[first] ^ _U(1)
            label = _toss(label, before)
        # neighbours have different labels, so a maximum is above both; nothing stands after a text's last symbol
        left, right = np.zeros_like(label), np.zeros_like(label)
        left[1:], right[:-1] = label[:-1], label[1:]
        right[first[1:] - 1] = 0
        start = (label > left) & (label >= right)
        # never two starts in a row, so that every level is shorter than the one before
        start[first] = False
        second = first + 1
        start[second[second < x.size]] = False
        start[first] = True
        return start

    def names(self, symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names that fingerprints choose from, and the text of each."""
        found, owner = [], []
        x, level = mix(symbols.astype(np.uint64) + _U(1)), 0
        while x.size:
            x, text = self._collapse(x, text)
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            count = np.diff(np.append(first, x.size))
            salt = _U(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
            done = np.repeat(count == 1, count)
            take = np.ones(x.size, dtype=bool) if level >= FIRST else done
            found.append(mix(x[take] + salt))
            owner.append(text[take])
            if done.any():  # the last symbol stands for the whole text
                x, text = x[~done], text[~done]
                if not x.size:
                    break
                first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            at = np.flatnonzero(self._starts(x, first))
            x, text = self._phrase_names(x, at), text[at]
            level += 1
        return (np.concatenate(found), np.concatenate(owner)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    @staticmethod
    def _phrase_names(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order-sensitive hash of the symbols of each phrase: symbols are weighed by their place in it."""
        n = np.diff(np.append(at, x.size))
        place = np.arange(x.size) - np.repeat(at, n)
        weighed = mix(x * _M1 + place.astype(np.uint64) * _M2)
        return mix(np.add.reduceat(weighed, at) + n.astype(np.uint64))

    def sketches(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The KEEP least distinct names of each text (arrays of code points), sorted."""
        sizes = [t.size for t in texts]
        if not sum(sizes):
            return [np.zeros(0, np.uint32)] * len(texts)
        names, owner = self.names(np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes))
        names = (names >> _U(32)).astype(np.uint32)
        # names are evenly spread, so the least KEEP of m are nearly always among those under 4 * KEEP / m of the range
        limit = np.minimum(2.0**32, 2.0**32 * 4 * KEEP / np.maximum(np.bincount(owner, minlength=len(texts)), 1))
        under = names < limit[owner]
        out = self._least(names[under], owner[under], len(texts))
        for i in range(len(texts)):
            if out[i].size < KEEP and limit[i] < 2.0**32:
                out[i] = np.unique(names[owner == i])[:KEEP]
        return out

    @staticmethod
    def _least(names: np.ndarray, owner: np.ndarray, n_texts: int) -> list[np.ndarray]:
        packed = np.unique((owner.astype(np.uint64) << _U(32)) | names)
        names = (packed & _U(0xFFFFFFFF)).astype(np.uint32)
        bounds = np.searchsorted(packed >> _U(32), np.arange(n_texts + 1, dtype=np.uint64))
        return [names[a : min(b, a + KEEP)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the KEEP least names of the union that are in both; 1 for two empty sketches."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    union = np.union1d(a, b)[:KEEP]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def code_points(text: bytes | None) -> np.ndarray:
    """The code points of UTF-8 bytes."""
    if not text:
        return np.zeros(0, np.uint32)
    if text.isascii():
        return np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def _utf8(points: np.ndarray) -> bytes:
    return points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")


def edited(points: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The last half (rounded down) replaced by the first as many code points, or all, of the text after it."""
    half = points.size // 2
    return np.concatenate([points[: points.size - half], after[:half]])


def _cuts(ids: DataFrame, n_rows: int) -> list[int]:
    """Distinct upper bounds (inclusive) of the ranges but the last, by approximate quantiles."""
    parts = min(10_000, -(-n_rows // RANGE_ROWS))
    if parts < 2:
        return []
    at = ids.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(20 * parts)).alias("q")).first()["q"]
    return sorted({int(x) for x in at or ()})


def _ranges(cuts: list[int], ids: list[int | None]) -> np.ndarray:
    return np.searchsorted(np.array(cuts, dtype=np.int64), np.array([-(2**63) if i is None else i for i in ids], dtype=np.int64), side="left")


def _spans(cuts: list[int]):
    """mapInArrow over (doc_id): the least id and the number of nulls of each range that a batch has rows of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids = batch.column(0).to_pylist()
            low: dict[int, list] = {}
            for r, i in zip(_ranges(cuts, ids).tolist(), ids, strict=True):
                own = low.setdefault(r, [None, 0])
                if i is None:
                    own[1] += 1
                elif own[0] is None or i < own[0]:
                    own[0] = i
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array([v[0] for v in low.values()], pa.int64()), pa.array([v[1] for v in low.values()], pa.int64())], ["range", "low", "nulls"])

    return run


def _route(cuts: list[int], firsts: dict[int | None, int]):
    """mapInArrow over (doc_id, text): each row to its range, the first ids of ranges also to the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in released(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            where = _ranges(cuts, ids).tolist()
            packed = [pack(t or b"") for t in texts]
            out = [(w, 0, i, p) for w, i, p in zip(where, ids, packed, strict=True)]
            out += [(firsts[i], 1, i, p) for i, p in zip(ids, packed, strict=True) if i in firsts]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["range", "tail", "doc_id", "packed"])

    return run


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (range, tail, doc_id, packed text) so that within a range, sorted, each row is followed by its next row.

    Rows with tail 1 close a range: they are rows of the next range that hold its first id (for the last range, the first
    of all), and only the least of them is the next row of the range's last row.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ids = docs.select("doc_id")
    cuts = _cuts(ids.where("doc_id is not null"), ids.count())
    spans = ids.mapInArrow(_spans(cuts), "range int, low long, nulls long")
    low = {r["range"]: r for r in spans.groupBy("range").agg(F.min("low").alias("low"), F.sum("nulls").alias("nulls")).collect()}
    held = sorted(low)
    first_id = lambda r: None if low[r]["nulls"] else low[r]["low"]
    firsts = {first_id(r): held[k - 1] for k, r in enumerate(held)}
    routed = docs.mapInArrow(_route(cuts, firsts), "range int, tail int, doc_id long, packed binary")
    return routed.repartition(F.col("range")).sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "packed")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int | None, bytes]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in released(batches):
        for r, tail, i, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield r, tail, i, unpack(p)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, bytes]]:
    """(doc_id, text, next row's text) for every row of the ranges in one partition."""
    last = None
    for row in _rows(batches):
        if last is not None and not last[1] and last[0] == row[0]:
            yield last[2], last[3], row[3]
        last = row


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser = Parser()
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def flush(held: list[tuple[int | None, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        changed = [edited(p, q) for _, p, q in held]
        # the next text of a row is the text of the row after it, unless that row is of the next range or batch
        order, texts = {}, []
        for t in (x for _, p, q in held for x in (p, q)):
            if id(t) not in order:
                order[id(t)] = len(texts)
                texts.append(t)
        sketches = parser.sketches(texts + changed)
        rows = []
        for k, (i, p, q) in enumerate(held):
            own, after, new = sketches[order[id(p)]], sketches[order[id(q)]], sketches[len(texts) + k]
            rows.append((i, p.size, hashlib.sha256(_utf8(changed[k])).hexdigest(), _hex(own), _hex(new), likeness(own, new), likeness(own, after)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    held, size, before = [], 0, (None, None)
    for i, text, after in _pairs(batches):
        p = before[1] if before[0] is text else code_points(text)
        q = code_points(after)
        before = (after, q)
        held.append((i, p, q))
        size += p.size
        if size > CHUNK:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see the module's text for the semantics."""
    return with_next(documents).mapInArrow(_describe, _OUT)
