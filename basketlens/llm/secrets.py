"""Secret scans: fixed patterns plus character Markov models of random strings and ordinary identifiers; DataFrame functions only.

Semantics (`secret_spans`)
    Base spans, leftmost and non-overlapping within each kind: `assign` is a keyword, a separator and a value of 8 or more
    characters; `access` is AKIA and capitals or digits, 16 or more in all; `hex` is 32 or more of 0-9a-f. A match that is
    too short is consumed and dropped. The Markov span kind, `markov`, covers the best stretches of what base spans leave of
    a run of CANDIDATE characters: stretches of LEAST characters or more whose sum of log-likelihood ratios a transition,
    random against ordinary, is the greatest that their beginning reaches, and at least SCORE. A stretch begins where the
    sum of what is before it would not help it, and is closed once the sum has fallen by DROP, so words around a random
    string in one run do not hide it, and one run may hold several; its ends are widened to the joints (JOINTS) around
    it, never over another one.
    Positions are code points, end exclusive. A null text is empty and has no span. Every row is judged on its own:
    repeated rows agree, other columns pass through, an empty table gives an empty result.

Models
    One transition table for each class, estimated from labelled samples, each row backed off to the class's characters
    with the weight of BACKOFF counts, so that a pair of letters which the samples lack is not taken for random: `random` (digests written
    in several alphabets, made by rule from a counter) and `ordinary` (identifiers of the words of a bounded table of
    prose in snake, kebab, camel and plain joins). The tables have one cell for each pair of the fixed alphabet, so what
    reaches the driver, and then every task as a literal, is of constant size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.shared import free_name

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A match of these two is a maximal run, so asking for its least length at once drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Kind: pattern, group whose length counts, least length. A short `assign` match is consumed before it is dropped.
BASE = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
#: Characters of a reported stretch at least; its least sum of log-likelihood ratios; the fall of the sum that closes it.
LEAST, SCORE, DROP = 16, 8.0, 25.0
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: What joins words in a run; stretches are widened up to these. They are the last characters of the alphabet.
JOINTS = "_=-"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
BACKOFF = 500
#: Labelled samples of each class at most.
SAMPLES = 5_000


def labelled_samples(prose: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(token, is_random): n random strings by rule, and n identifiers at most of the words of `prose.text`."""
    spark = prose.sparkSession
    d = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    forms = [d, F.upper(F.substring(d, 1, 40)), F.base64(F.unhex(d)), F.translate(F.base64(F.unhex(d)), "+/=", "-_"), F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(d)), "[^A-Za-z0-9]", "")), 1, 16))]
    pick = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        pick = F.when(F.pmod(F.col("id"), F.lit(len(forms))) == i, f).otherwise(pick)
    random = spark.range(n).select(pick.alias("token"), F.lit(1).alias("is_random"))
    words = F.filter(F.transform(F.split(F.lower("text"), r"[^a-zA-Z]+"), lambda w: w), lambda w: F.length(w) > 1)
    runs = prose.select(words.alias("w")).where(F.size("w") > 3).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.slice(F.col("w"), i + 1, 3))).alias("w"))
    joins = [F.array_join("w", "_"), F.array_join("w", "-"), F.array_join(F.transform("w", F.initcap), ""), F.array_join("w", ""), F.upper(F.array_join("w", "_"))]
    one = F.lit(None).cast("string")
    for i, j in enumerate(joins):
        one = F.when(F.pmod(F.xxhash64("w"), F.lit(len(joins))) == i, j).otherwise(one)
    ordinary = runs.distinct().orderBy(F.xxhash64("w")).limit(n).select(one.alias("token"), F.lit(0).alias("is_random"))
    return random.union(ordinary)


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios by pair code, first * (|alphabet| + 1) + second, with 0 for what is outside the alphabet."""
    k = len(ALPHABET) + 1
    at = samples.where(F.length("token") > 1).select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, 2))).alias("pair"))
    coded = at.select("is_random", _code(F.substring("pair", 1, 1)).alias("a"), _code(F.substring("pair", 2, 1)).alias("b"))
    n = [[[0] * k for _ in range(k)] for _ in range(2)]
    for r in coded.groupBy("is_random", "a", "b").count().collect():
        n[r["is_random"]][r["a"]][r["b"]] += r["count"]
    seconds = [[0.5 + sum(row[b] for row in of) for b in range(k)] for of in n]
    log = lambda c, a, b: math.log((n[c][a][b] + BACKOFF * seconds[c][b] / sum(seconds[c])) / (sum(n[c][a]) + BACKOFF))
    return [log(1, a, b) - log(0, a, b) for a in range(k) for b in range(k)]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column) -> Column:
    """For each number the sum of those before it.

    A fold that appends copies what it has, so it runs over blocks of about the root of the length, and the blocks'
    sums are added.
    """

    def blocks(a: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1), lambda i: F.slice(a, i * width + 1, width))

    def walk(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    total = lambda a: F.aggregate(a, F.lit(0), lambda x, n: x + n)
    before = lambda sums: F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda i: total(F.slice(sums, 1, i)))
    walked = lambda bs: F.flatten(F.zip_with(bs, _let(F.transform(bs, total), before), walk))
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(_let(blocks(sizes), walked))


def _matched(text: Column, pattern: str, group: int) -> Column:
    """array of (gap, match, own): each match with the text before it and the length of its group."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    rows = F.zip_with(matches, sized, lambda m, g: F.struct(m.alias("match"), F.length(g).alias("own")))
    each = F.zip_with(rows, between, lambda r, gap: F.struct(gap.alias("gap"), r["match"].alias("match"), r["own"].alias("own")))
    return F.filter(each, lambda r: r["match"].isNotNull())  # without the text after the last match


def matched(text: Column, pattern: str, group: int) -> Column:
    """struct(rows, rest): the matches as `_matched` has them and the text after the last; null without any match.

    Kept as a column of its own, so that positions and blanked text come from one match.
    """
    rest = F.element_at(F.split(text, pattern, -1), -1)
    return F.when(text.rlike(pattern), F.struct(_matched(text, pattern, group).alias("rows"), rest.alias("rest")))


def located(found: Column, least: int, kind: int) -> Column:
    """array of (start, kind, end, token) of the matches whose group has `least` characters or more, by running sums of lengths."""
    kept = F.struct(F.lit(0).alias("start"), F.lit(kind).alias("kind"), F.lit(0).alias("end"), F.lit("").alias("token"), F.lit(0).alias("own"))
    none = F.filter(F.array(kept), lambda x: F.lit(False))

    def placed(rows: Column) -> Column:
        before = running(F.transform(rows, lambda r: F.length(r["gap"]) + F.length(r["match"])))

        def one(r: Column, at: Column) -> Column:
            start = at + F.length(r["gap"])
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(r["match"])).alias("end"), r["match"].alias("token"), r["own"].alias("own"))

        return F.filter(F.zip_with(rows, before, one), lambda x: x["own"] >= least)

    return F.when(found.isNotNull(), _let(found["rows"], placed)).otherwise(none)


def blanked(text: Column, found: Column, least: int) -> Column:
    """The text with blanks for the matches that `located` keeps, as long as it was."""
    pieces = F.transform(found["rows"], lambda r: F.concat(r["gap"], F.when(r["own"] >= least, F.repeat(F.lit(" "), F.length(r["match"]))).otherwise(r["match"])))
    return F.when(found.isNotNull(), F.concat(F.array_join(pieces, ""), found["rest"])).otherwise(text)


def stretches(token: Column, table: list[float]) -> Column:
    """array of (start, end) in the token: its stretches of greatest sum of ratios that reach LEAST and SCORE, in one pass.

    The pass holds where the part between joints that it is in began (`edge`), the current stretch and its sum, and the
    greatest sum so far with its end, which moves on (`open`) to the next joint. A stretch
    is appended to the result only where it is closed, so the work grows with the token's length.
    """
    cells, k, plain = F.lit(table), len(ALPHABET) + 1, sum(c not in JOINTS for c in ALPHABET)
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), _code)
    step_of = lambda a, b: F.struct(F.get(cells, a * k + b).alias("ratio"), (b <= plain).alias("plain"))
    pairs = lambda codes: F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), step_of)
    whole = lambda *names: [F.lit(0).alias(n) for n in names]
    none = F.filter(F.array(F.struct(*whole("start", "end"))), lambda x: F.lit(False))
    begin = F.struct(*whole("at", "edge", "start", "end"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"), F.lit(False).alias("open"), none.alias("out"))
    good = lambda s: (s["top"] >= SCORE) & (s["end"] - s["start"] >= LEAST)
    closed = lambda s: F.when(good(s), F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        total, at = s["sum"] + x["ratio"], s["at"] + 1  # at: the place of the pair's second character
        over, rises, goes_on = (total <= 0) | (total < s["top"] - DROP), total > s["top"], s["open"] & x["plain"]
        edge = F.when(x["plain"], s["edge"]).otherwise(at + 1)
        return F.struct(
            at.alias("at"),
            edge.alias("edge"),
            F.when(over, F.when(good(s), F.greatest(at, edge)).otherwise(F.greatest(edge, F.coalesce(F.get(s["out"], F.size(s["out"]) - 1)["end"], F.lit(0))))).otherwise(s["start"]).alias("start"),
            F.when(~over & (rises | goes_on), at + 1).when(over, at).otherwise(s["end"]).alias("end"),
            F.when(over, 0.0).otherwise(total).alias("sum"),
            F.when(over, 0.0).when(rises, total).otherwise(s["top"]).alias("top"),
            (~over & (rises | goes_on)).alias("open"),
            F.when(over, closed(s)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(_let(codes, pairs), begin, step, closed)


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(x) for x in (*BASE, "markov")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(documents: DataFrame, table: list[float], text_col: str = "text") -> tuple[DataFrame, str, str]:
    """The documents with two columns more, whose names are returned: base spans, and base and Markov spans together,
    each an array of (start, kind, end) by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, every = free_name(documents, "_base"), free_name(documents, "_spans")
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    patterns = list(BASE.values())
    out, own, left = documents, [], []
    for k, (pattern, group, _) in enumerate(patterns):
        own.append(free_name(out, f"_found_{k}"))
        out = out.withColumn(own[-1], matched(text, pattern, group))
    rest, same = text, F.lit(True)
    for k, (pattern, group, least) in enumerate(patterns):
        # what no kind before has blanked is matched already
        found = F.when(same, F.col(own[k])).otherwise(matched(rest, pattern, group)) if k else F.col(own[k])
        left += [free_name(out, f"_left_{k}"), free_name(out, f"_rest_{k}")]
        out = out.withColumn(left[-2], found)
        out = out.withColumn(left[-1], blanked(rest, F.col(left[-2]), least))
        rest, same = F.col(left[-1]), same & F.col(left[-2]).isNull()
    runs = free_name(out, "_runs")
    out = out.withColumn(base, F.sort_array(bare(F.concat(*(located(F.col(c), n, k) for k, (c, (_, _, n)) in enumerate(zip(own, patterns, strict=True)))))))
    out = out.withColumn(runs, matched(rest, CANDIDATE, 0))
    random = lambda t: F.transform(stretches(t["token"], table), lambda s: F.struct((t["start"] + s["start"]).alias("start"), t["kind"].alias("kind"), (t["start"] + s["end"]).alias("end")))
    likely = F.flatten(F.transform(located(F.col(runs), LEAST, len(BASE)), random))
    return out.withColumn(every, F.sort_array(F.concat(F.col(base), likely))).drop(*own, *left, runs), base, every


def scan(documents: DataFrame, prose: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans, trained on labelled samples from prose."""
    rows, base, every = secret_spans(documents.select("doc_id", "text"), train(labelled_samples(prose)))
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)), F.sha2(written(F.col(base)), 256).alias("base_sha256"), written(F.col(every)).alias("spans"))
