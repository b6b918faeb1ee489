"""Periodic runs of words: in-document k-gram masking, then Main-Lorentz on the stretches that are left.

Semantics (`periodic_runs`)
    The words of a text are its maximal stretches of bytes other than space and the controls 9 to 13. A run is a stretch of
    words with smallest period q (words q apart are identical) of at least max(min_length, exponent * q) words that no
    neighbouring word extends keeping period q. `runs` lists every run of a text (start: the number of its first word,
    length, period) by start, then period; `collapsed` is the text without the words that lie in some run behind that run's
    first q words, the others joined by one space. A null or empty text, or one of white space, has no words, no runs and an
    empty `collapsed`. Rows are taken on their own, so repeated rows agree; other columns pass through, whatever their
    names; an empty table gives an empty result.

Masking
    A run of length n and period q repeats its first n - q words q words on, and max(min_length, exponent * q) - q is at least
    k (`overlap`; 16 words for 24 and 3) for every q. As exponent is 2 or more, the first n - q words and their copy cover the
    run. So each word of a run lies in a k-gram that occurs twice in its text; words outside such k-grams join no run and are
    masked. K-grams are compared by 64-bit hashes: two that collide by chance leave a stretch too many, never one too few.

Main-Lorentz
    Stretches of min_length words and more that are left are put behind one another with a mark of its own between any two,
    and halved again and again. A run lies within a half or crosses the middle, where for each period the common extensions to
    both sides of two places one period apart give its ends. The middles of one level are handled at once: equality of
    stretches of 1, 2, 4 ... words is looked up in exact names (the name of a stretch is the rank of the pair of names of its
    halves), so extensions take a logarithmic number of vectorised steps. Where a run of period p around a middle is known,
    multiples of p whose window it covers would give the same run and are skipped. A task holds a few arrays over CHUNK bytes
    of texts, or over one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.shared import free_name
from basketlens.llm.text_hash import mix, released

MIN_LENGTH, EXPONENT = 24, 3
CHUNK = 4 << 20
#: Names are kept for stretches of up to 2**LEVELS words; longer extensions take several steps of that size.
LEVELS = 12

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def overlap(min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> int:
    """Words that any run shares at least with its own copy one period on."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def repeated(ids: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs at least twice in the same text."""
    n = len(ids) - k + 1
    covered = np.zeros(len(ids), dtype=bool)
    if n < 2:
        return covered
    words, grams = mix(ids.astype(_U) + _U(1)), np.zeros(n, dtype=_U)
    for j in range(k):
        grams = grams * _STEP + words[j : j + n]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + k <= offsets[1:][text])
    grams = mix(grams[at] + mix(text[at].astype(_U)))
    order = np.argsort(grams)
    same = np.flatnonzero(grams[order][1:] == grams[order][:-1])
    twice = np.zeros(len(ids) + 1, dtype=np.int32)
    starts = np.unique(at[order[np.concatenate([same, same + 1])]])
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + k, -1)
    return np.cumsum(twice[:-1]) > 0


class Names:
    """Exact names of all stretches of a power of two of words, and common extensions found with them."""

    def __init__(self, words: np.ndarray, longest: int):
        self.of, n = [words.astype(np.int64)], len(words)
        while len(self.of) <= min(LEVELS, max(longest, 1).bit_length() - 1):
            half, size = self.of[-1], 1 << len(self.of)
            name = -1 - np.arange(n)  # a stretch over the end is like no other
            if n >= size:
                pairs = half[: n - size + 1] * (n + 1) + half[size // 2 : n - size // 2 + 1]
                name[: n - size + 1] = np.unique(pairs, return_inverse=True)[1]
            self.of.append(name)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same; i < j."""
        n, live, top = np.zeros(len(i), dtype=np.int64), np.arange(len(i)), len(self.of) - 1
        while live.size:
            live = live[self.of[top][i[live] + n[live]] == self.of[top][j[live] + n[live]]]
            n[live] += 1 << top
        for k in range(top - 1, -1, -1):
            n[self.of[k][i + n] == self.of[k][j + n]] += 1 << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are the same; i < j."""
        n, live, top = np.zeros(len(i), dtype=np.int64), np.arange(len(i)), len(self.of) - 1

        def same(k: int, of: np.ndarray | slice) -> np.ndarray:
            at = i[of] - n[of] - (1 << k)
            return (at >= 0) & (self.of[k][np.maximum(at, 0)] == self.of[k][np.maximum(at, 0) + (j - i)[of]])

        while live.size:
            live = live[same(top, live)]
            n[live] += 1 << top
        for k in range(top - 1, -1, -1):
            n[same(k, slice(None))] += 1 << k
        return n


def main_lorentz(words: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run. begin, end: the limits of each word's stretch; equal for the marks between stretches, which are like no other word."""
    n, room = len(words), end - begin
    near = (overlap(min_length, exponent) + 1) // 2  # a run's extensions from a middle have that many words on one side
    w = 1 << (near.bit_length() - 1)
    names = Names(words, int(room.max(initial=0)))
    gram = names.of[min(w.bit_length() - 1, len(names.of) - 1)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    half = 1 << ((min_length - 1).bit_length() - 1)  # shorter than any run
    while half < n:
        mids = np.arange(half, n, 2 * half)
        mids = mids[(begin[mids] < mids) & (mids < end[mids])]
        most = np.minimum(2 * half, room[mids]) // exponent
        known = {"ratio": np.zeros(len(mids)), "period": np.ones(len(mids), np.int64), "start": np.full(len(mids), n), "end": np.zeros(len(mids), np.int64)}
        low = 1
        while low <= most.max(initial=0):
            for side in (0, 1):  # the window of one period behind the middle, or before it
                limit = np.minimum(most, (end[mids] - mids, mids - begin[mids])[side])
                count = np.maximum(np.minimum(limit, 2 * low - 1) - low + 1, 0)
                of = np.repeat(np.arange(len(mids)), count)
                q = low + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                i = mids[of] - side * q
                before = np.maximum(i - w, 0)
                likely = (gram[i] == gram[i + q]) | (gram[before] == gram[before + q])
                likely &= (q % known["period"][of] != 0) | (known["start"][of] > i) | (known["end"][of] < i + q)
                of, q, i = of[likely], q[likely], i[likely]
                back = names.backward(i, i + q)
                length = names.forward(i, i + q) + back + q
                run = length >= np.maximum(min_length, exponent * q)
                of, q, start, length = of[run], q[run], (i - back)[run], length[run]
                found.append((start, length, q))
                order = np.argsort(length / q, kind="stable")
                order = order[(length / q)[order] > known["ratio"][of[order]]]
                for name, values in (("ratio", length / q), ("period", q), ("start", start), ("end", start + length)):
                    known[name][of[order]] = values[order]
            low *= 2
        half *= 2
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, start))  # the same stretch with its smallest period first
    first = np.ones(len(order), dtype=bool)
    first[1:] = (start[order][1:] != start[order][:-1]) | (length[order][1:] != length[order][:-1])
    order = order[first]
    return start[order], length[order], period[order]


def find_runs(ids: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ids), length and period of every run of several texts, by start, then period. Text t has the words ids[offsets[t]:offsets[t + 1]]."""
    covered = repeated(ids, offsets, overlap(min_length, exponent))
    edge = np.ones(len(ids) + 1, dtype=bool)
    edge[1:-1] = covered[1:] != covered[:-1]
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    begin, size = edges[:-1], np.diff(edges)
    kept = covered[begin] & (size >= min_length) if len(begin) else np.zeros(0, dtype=bool)
    begin, size = begin[kept], size[kept]
    if not len(begin):
        return begin, begin, begin
    # one mark before each stretch and one at the end
    at = np.cumsum(size + 1) - size
    total = int(at[-1] + size[-1] + 1)
    within = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    origin = np.zeros(total, dtype=np.int64)
    origin[within] = np.repeat(begin - at, size) + within
    marks = np.append(at - 1, total - 1)
    words = np.zeros(total, dtype=np.int64)
    words[within] = np.unique(ids[origin[within]], return_inverse=True)[1]
    words[marks] = words.max() + 1 + np.arange(len(marks))
    low, high = np.arange(total), np.arange(total)
    low[within], high[within] = np.repeat(at, size), np.repeat(at + size, size)
    start, length, period = main_lorentz(words, low, high, min_length, exponent)
    order = np.lexsort((period, start))
    return origin[start][order], length[order], period[order]


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and all words (binary) behind one another."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, b"").cast(pa.large_binary()).view(pa.large_string()))
    values = lists.flatten()
    full = pc.greater(pc.binary_length(values), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return upto[offsets - offsets[0]], values.filter(full).view(pa.large_binary())


def runs_of(texts: pa.Array, min_length: int, exponent: int) -> pa.StructArray:
    """Runs and collapsed text of every text."""
    offsets, values = split_words(texts)
    ids = pc.dictionary_encode(values).indices.to_numpy()
    start, length, period = find_runs(ids, offsets, min_length, exponent)
    gone = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    stay = np.cumsum(gone[:-1]) == 0
    kept = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stay)])[offsets]), values.filter(pa.array(stay)))
    text = np.searchsorted(offsets, start, side="right") - 1
    ends = np.searchsorted(start, offsets)
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - offsets[text], length, period)], ["start", "length", "period"])
    collapsed = pc.binary_join(kept, pa.scalar(b" ", pa.large_binary())).cast(pa.binary()).view(pa.string())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), collapsed], ["runs", "collapsed"])


_RESULT = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, about CHUNK bytes at a time."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    begin = 0
    while begin < len(texts):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + CHUNK, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def periodic_runs(documents: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Every row with two more columns: `runs` and `collapsed` (with a `_` behind where the name is taken)."""
    if exponent < 2 or min_length < 2:
        raise ValueError("runs repeat at least once and have at least two words")

    @F.arrow_udf(_RESULT)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in released(texts):
            yield pa.concat_arrays([runs_of(x, min_length, exponent) for x in _parts(t)]) if len(t) else runs_of(t, min_length, exponent)

    out, runs, collapsed = (free_name(documents, x) for x in ("_runs", "runs", "collapsed"))
    found = documents.withColumn(out, find(F.col(f"`{text}`").cast("binary")))
    return found.select(*(f"`{c}`" for c in documents.columns), F.col(out)["runs"].alias(runs), F.col(out)["collapsed"].alias(collapsed))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first by start, then period. Null without runs."""
    better = lambda a, b: (b["length"] * a["period"]) > (a["length"] * b["period"])
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def looped(documents: DataFrame) -> DataFrame:
    """doc_id and text after the query's damage: for a tenth of the ids, the words behind one of them repeat with a period. Null ids and texts without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = documents.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), words.alias("words"))
    n = F.size("words").cast("long")
    a = F.when(n > 0, F.col("g") % n)
    rows = rows.select("doc_id", "text", "words", n.alias("n"), a.cast("int").alias("a"), (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8))).cast("int").alias("p"))
    rest = (F.col("n") - F.col("a")).cast("int")
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    cycled = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    damaged = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), cycled), " ")
    return rows.select("doc_id", F.coalesce(damaged, "text").alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and digests of `periodic_runs`."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = found.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("_best")[x].alias(x) for x in ("start", "length", "period")),
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
