"""Document quality by a linear-chain conditional random field over lines.

Semantics (`train`, `Model.scores`)
    A text is cut at line feeds; every line is labelled good or bad. A line's features are shares of its bytes and words
    and those of the lines before and after it. The score of a text is the mean of its lines' forward-backward marginals
    of good, weighted by bytes plus 1, so an empty text is one empty line and a null text is an empty one; whole texts are
    read, of any length. Labelled rows with a null id or label are not used; if labels repeat an id, the lower label
    wins. Without labelled rows every score is 0.5 (predicted 1: nothing is rejected without evidence). Rows are scored on
    their own: repeated rows agree, other columns pass through, an empty table gives an empty result. Only texts are
    inputs of a score.

Training
    Lines take their document's label. The field is fitted by gradient ascent on the conditional likelihood to a bounded sample: the
    texts of TRAIN_DOCS labelled documents at most, first by a hash of their id, in chains of CHAIN lines at most (features
    are of the whole text), of which TRAIN_CHAINS at most are taken, first by a hash, too. So 60 MB of features at most come to the
    driver, no texts, and a step of the fit is CHAIN steps over all chains at once, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.shared import BROADCAST_ROWS
from basketlens.llm.text_hash import chunks, released, word_hashes

TRAIN_DOCS = 4_000
CHAIN = 64
TRAIN_CHAINS = 6_000
STEPS = 150
CHUNK = 1 << 19

_CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "bar", "wide")
_CLASS = np.full(256, 5, dtype=np.uint8)  # other marks
for _i, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 11, 12, 13, 32), map(ord, ".,;:'?-()"))):
    _CLASS[list(_set)] = _i
_CLASS[ord("|")] = 6
_CLASS[128:] = 7
#: Bytes of the second byte of two-byte capitals in the Latin-1 block (after 0xC3).
_WIDE_UPPER = np.zeros(256, dtype=bool)
_WIDE_UPPER[0x80:0x9F] = True
N_OWN = 12


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (a row each, with a constant and the neighbours' features), their weights, lines of each text."""
    data = b"\n".join(t or b"" for t in texts)
    buf = np.frombuffer(data + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = ends - starts
    counts = np.empty((ends.size, len(_CLASSES)))
    kinds = _CLASS[buf]
    kinds[ends] = 255
    for c in range(len(_CLASSES)):
        counts[:, c] = np.add.reduceat((kinds == c).view(np.uint8), starts, dtype=np.int64)
    wide_upper = (buf[:-1] == 0xC3) & _WIDE_UPPER[buf[1:]]
    upper = counts[:, 1] + 2 * np.add.reduceat(np.append(wide_upper, False).view(np.uint8), starts, dtype=np.int64)
    lines = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    hashes, first = word_hashes(lines)
    n_words = np.diff(first)
    same = np.zeros(hashes.size + 1)
    if hashes.size > 1:
        repeated = hashes[1:] == hashes[:-1]
        inner = np.ones(hashes.size, dtype=bool)
        inner[first[:-1][first[:-1] < hashes.size]] = False
        same[2:] = np.cumsum(repeated & inner[1:])
    again = same[first[1:]] - same[first[:-1]]
    inverse, words = 1 / np.maximum(length, 1), np.maximum(n_words, 1)
    own = np.column_stack([
        counts[:, 0] * inverse, np.minimum(1, upper * inverse), counts[:, 2] * inverse, counts[:, 3] * inverse, counts[:, 4] * inverse,
        np.minimum(1, 4 * counts[:, 5] * inverse), np.minimum(1, 8 * counts[:, 6] * inverse), counts[:, 7] * inverse,
        again / words, np.minimum(2, length / words / 10), np.log1p(n_words) / 6, length == 0,
    ])
    n_lines = np.fromiter(((t or b"").count(b"\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(n_lines) - n_lines
    before, after = np.vstack([np.zeros(N_OWN), own[:-1]]), np.vstack([own[1:], np.zeros(N_OWN)])
    before[begin] = 0
    after[begin + n_lines - 1] = 0
    return np.column_stack([np.ones(own.shape[0]), own, before, after]), (length + 1).astype(float), n_lines


@dataclass
class Model:
    """Weights of a line's features for good against bad, and of the steps between the two labels (bad 0, good 1)."""

    weights: np.ndarray
    steps: np.ndarray
    trained: bool = True

    def marginals(self, x: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each line the probability of good, log-normaliser of each text, and expected label pairs over all lines.

        Texts go in step, longest first, so step t handles the t-th lines of all texts that have one at once.
        """
        score = x @ self.weights
        order = np.argsort(-n_lines, kind="stable")
        lens, begin = n_lines[order], (np.cumsum(n_lines) - n_lines)[order]
        longest = int(lens[0])
        active = np.searchsorted(-lens, -np.arange(1, longest + 1), side="right")
        forward = np.zeros((x.shape[0], 2))
        backward = np.zeros((x.shape[0], 2))
        unary = np.column_stack([np.zeros_like(score), score])
        for t in range(longest):
            at = begin[: active[t]] + t
            if t == 0:
                forward[at] = unary[at]
            else:
                a = forward[at - 1]
                forward[at, 0] = np.logaddexp(a[:, 0] + self.steps[0, 0], a[:, 1] + self.steps[1, 0]) + unary[at, 0]
                forward[at, 1] = np.logaddexp(a[:, 0] + self.steps[0, 1], a[:, 1] + self.steps[1, 1]) + unary[at, 1]
        for t in range(longest - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            b = backward[at + 1] + unary[at + 1]
            backward[at, 0] = np.logaddexp(b[:, 0] + self.steps[0, 0], b[:, 1] + self.steps[0, 1])
            backward[at, 1] = np.logaddexp(b[:, 0] + self.steps[1, 0], b[:, 1] + self.steps[1, 1])
        both = forward + backward
        last = np.cumsum(n_lines) - 1
        z = np.logaddexp(forward[last, 0], forward[last, 1])
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        inner = np.ones(x.shape[0], dtype=bool)
        inner[np.cumsum(n_lines) - n_lines] = False
        at = np.flatnonzero(inner)
        zs = np.repeat(z, n_lines)[at]
        pairs = np.empty((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = np.exp(forward[at - 1, i] + self.steps[i, j] + unary[at, j] + backward[at, j] - zs).sum()
        return good, z, pairs

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not self.trained:
            return out
        for a, b in chunks(texts, CHUNK):
            x, w, n = line_features(texts[a:b])
            good, _, _ = self.marginals(x, n)
            begin = np.cumsum(n) - n
            out[a:b] = np.add.reduceat(good * w, begin) / np.add.reduceat(w, begin)
        return out


def fit(x: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Adam ascent on the mean conditional log-likelihood of the lines' labels, with a little ridge."""
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    y = np.repeat(labels, n_lines).astype(float)
    inner = np.ones(y.size, dtype=bool)
    inner[np.cumsum(n_lines) - n_lines] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    m = v = np.zeros(x.shape[1] + 4)
    for i in range(1, steps + 1):
        good, _, pairs = model.marginals(x, n_lines)
        g = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / n_lines.size
        w = np.concatenate([model.weights, model.steps.ravel()])
        g -= 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        model = Model(w[:-4], w[-4:].reshape(2, 2))
    return model


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, quality) to (doc_id, chain, quality, n_lines, features of its lines)."""
    for batch in released(batches):
        for i, t in enumerate(batch.column(1).to_pylist()):
            x = line_features([t])[0].astype(np.float32)
            for k, begin in enumerate(range(0, x.shape[0], CHAIN)):
                part = x[begin : begin + CHAIN]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([k]), batch.column(2).slice(i, 1), pa.array([part.shape[0]]), pa.array([part.tobytes()], pa.binary())], ["doc_id", "chain", "quality", "n_lines", "x"])


def train(documents: DataFrame, labels: DataFrame, fold: Column, limit: int = TRAIN_DOCS) -> Model:
    """Fit to the first `limit` labelled documents, by a hash of their id, for which the condition `fold` over doc_id holds."""
    wanted = labels.where("doc_id is not null and quality is not null").where(fold).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # some labelled ids may be absent from this table (an earlier stage dropped them), so the bound is taken after the join
    side = F.broadcast(wanted) if labels.count() <= BROADCAST_ROWS else wanted
    present = documents.select("doc_id").join(side, "doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(limit)
    sample = documents.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(present), "doc_id").select("id", "text", "quality")
    chains = sample.mapInArrow(_chains, "doc_id string, chain long, quality int, n_lines long, x binary")
    rows = chains.orderBy(F.xxhash64("doc_id", "chain"), "x").limit(TRAIN_CHAINS).toArrow()
    if not rows.num_rows:
        return Model(np.zeros(1), np.zeros((2, 2)), trained=False)
    # in an order of their own, so that the sums of a fit do not depend on which task came first
    own = sorted(zip(rows.column("n_lines").to_pylist(), rows.column("quality").to_pylist(), rows.column("x").to_pylist(), strict=True))
    n_lines, marks = np.array([r[0] for r in own]), np.array([r[1] for r in own])
    x = np.frombuffer(b"".join(r[2] for r in own), dtype=np.float32).reshape(int(n_lines.sum()), -1).astype(float)
    return fit(x, n_lines, marks)


def score_udf(documents: DataFrame, model: Model):
    """Column function over a binary text: its quality from 0 to 1."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in released(texts):
            yield pa.array(sent.value.scores(t.to_pylist()))

    return score


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text modulo the divisor; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor)).cast("int")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose remainder modulo 3 is 1 are held out of training."""
    model = train(documents, labels, remainder(F.col("doc_id"), 3) != 1)
    scored = documents.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score_udf(documents, model)(F.col("text").cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
