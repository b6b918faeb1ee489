import base64
import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from basketlens.llm.queries import op9_secrets
from basketlens.llm.secrets import ALPHABET, DROP, JOINTS, LEAST, SCORE, labelled_samples, running, scan, secret_spans, stretches, train

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = [("assign", ASSIGN, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def base(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(KINDS) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


def verify(rows, docs):
    texts = dict(docs)
    for r in rows:
        want = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("markov")] == want


def run(spark, docs, tiny):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, _base int")
    return scan(df, spark.read.parquet(f"{tiny}/benchmark.parquet")).collect()


def test_against_python(spark, tiny):
    h = hashlib.sha256(b"x").hexdigest()
    texts = [
        f"é token = \"{h[:40]}\" end {h}", "password: short", 'token=secret"=abcdefghij', "TOKEN='abcdefgh' API_KEY : 12345678 apikey=abcdefg.", "AKIA1234567890ABCD AKIAAKIA AKIAKIA12345678901", h + h.upper() + h[:31] + " " + h[:32],
        None, "", "passwd=" + "z" * 100_000, "secret" * 5 + "=x" * 9, "token = = aaaaaaaaaaaa", "passwordpassword=aaaaaaaa\npassword \n= aaaaaaaa", "𝒳" * 3 + h,
    ]
    docs = list(enumerate(texts))
    verify(run(spark, docs, tiny), docs)
    assert run(spark, [], tiny) == []


def test_markov_spans(spark, tiny):
    random = [base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()[:40] for i in range(200, 260)]
    plain = ["ordinary_identifier_of_some_words", "anotherLongIdentifierInCamelCase", "verylongordinarywordwithoutanybreaks", "the-quick-brown-fox-jumps-over"]
    rows = {r.doc_id: r.spans for r in run(spark, [(i, f"key {t} end") for i, t in enumerate(random + plain)], tiny)}
    hits = [rows[i] == f"markov:4:{4 + len(t)}" for i, t in enumerate(random)]
    assert sum(hits) >= 0.9 * len(hits)
    assert not any(rows[len(random) + i] for i in range(len(plain)))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = op9_secrets(spark, sf).collect()
    verify(rows, docs)
    assert sum(r.n_assign for r in rows) > 0


def random_string(n):
    return "".join(base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()[:40] for i in range(n))


def test_running_sums(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 100, 1000):
        a = rng.integers(0, 50, n).tolist()
        df = spark.createDataFrame([(a,)], "a array<int>")
        assert df.select(running(F.col("a"))).first()[0] == [sum(a[:i]) for i in range(n)]


def test_thirty_two_thousand_matches_and_a_long_run(spark, tiny):
    """Time grows with the matches and the run's length: seconds (by the square it took most of a minute)."""
    n = 32_000
    one = "token = abcdefgh1 x"
    texts = [one * n, random_string(22_500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = train(labelled_samples(spark.read.parquet(f"{tiny}/benchmark.parquet")))
    begin = time.perf_counter()
    found, base_spans, every = secret_spans(docs, table)
    got = {r.doc_id: (r[base_spans], r[every]) for r in found.collect()}
    assert time.perf_counter() - begin < 40
    assert [(x.start, x.end) for x in got[0][0]] == [(i * len(one), i * len(one) + len(one) - 2) for i in range(n)]
    assert [(x.start, x.end) for x in got[1][1]] == [(0, 900_000)]


def test_a_run_is_judged_by_what_base_spans_leave(spark, tiny):
    run = random_string(1)[:20]
    docs = spark.createDataFrame([(1, f"{'0a' * 20}-{run}{run}"), (2, f"api_key={run} {run}")], "doc_id long, text string")
    table = train(labelled_samples(spark.read.parquet(f"{tiny}/benchmark.parquet")))
    found, base_spans, every = secret_spans(docs, table)
    got = {r.doc_id: [(x.start, x.kind, x.end) for x in r[every]] for r in found.collect()}
    assert got[1] == [(0, 2, 40), (40, 3, 81)] and got[2] == [(0, 0, 28), (29, 3, 49)]


ALPHABETS = {"base64": ALPHABET[:64], "hex": "0123456789abcdef", "capitals": ALPHABET[26:62], "small": ALPHABET[:26] + ALPHABET[52:62], "letters": ALPHABET[:62]}


def plain_stretches(token, table):
    """The closed stretches by a loop over characters, with all sums of a stretch at hand."""
    k, codes = len(ALPHABET) + 1, [ALPHABET.find(c) + 1 for c in token]
    edge = start = 0
    sums, out, i = [], [], 0

    def close():
        """The stretch of these sums if it is good: its end is that of the first greatest sum, moved on to the next joint."""
        top = max(sums, default=0)
        if top >= SCORE:
            at = first + sums.index(top) + 1
            end = at + 1
            while end < i + 1 and token[end] not in JOINTS:
                end += 1
            if end - start >= LEAST:
                out.append((start, end))
                return True
        return False

    first = 0
    for i in range(len(token) - 1):
        total = (sums[-1] if sums else 0) + table[codes[i] * k + codes[i + 1]]
        edge = edge if token[i + 1] not in JOINTS else i + 2
        if total <= 0 or total < max(sums, default=0) - DROP:
            last = out[-1][1] if out else 0
            start = max(i + 1, edge) if close() else max(edge, last)
            sums, first = [], i + 1
        else:
            sums.append(total)
    i = len(token) - 1
    close()
    return out


def mixed_runs(n, seed):
    """(run, begin, length, alphabet): a random string between words, as one run."""
    rng = np.random.default_rng(seed)
    words = ["retail", "basket", "discount", "produce", "organic", "customer", "history", "weekly", "ordinary", "signal"]
    pick = lambda: "_".join(rng.choice(words, rng.integers(1, 5)))
    out = []
    for i in range(n):
        name, chars = list(ALPHABETS.items())[i % len(ALPHABETS)]
        size, before = (16, 20, 24, 32, 40)[i // len(ALPHABETS) % 5], pick() + "_"
        out.append((before + "".join(rng.choice(list(chars), size)) + "_" + pick(), len(before), size, name))
    return out


def test_stretches_against_a_plain_loop(spark, tiny):
    table = train(labelled_samples(spark.read.parquet(f"{tiny}/benchmark.parquet")))
    a, b = mixed_runs(150, 1), mixed_runs(150, 2)
    tokens = [x[0] + j + y[0] for x, y, j in zip(a, b, ["_", "", "+/"] * 50, strict=True)] + ["-" * 20, "=" + a[0][0], "a" * 3000, "Zq9" * 500]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", stretches(F.col("t"), table).alias("s"))
    rows = [(r.t, [tuple(x) for x in r.s]) for r in df.collect()]
    assert all(got == plain_stretches(t, table) for t, got in rows)
    assert any(len(got) > 1 for _, got in rows)


def test_recall_in_mixed_runs_and_words_left_alone(spark, tiny):
    """Random strings of 20 characters and more within runs of words: 0.9 of each alphabet at least; plain joins of words: under 1 %."""
    table = train(labelled_samples(spark.read.parquet(f"{tiny}/benchmark.parquet")))
    runs = mixed_runs(2000, 3)
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(runs)], "i long, t string").select("i", stretches(F.col("t"), table).alias("s"))
    hit = {name: [] for name in ALPHABETS}
    for r in df.collect():
        _, a, n, name = runs[r.i]
        if n >= 20:
            hit[name].append(any(min(x.end, a + n) - max(x.start, a) >= 0.8 * n for x in r.s))
    assert all(sum(h) >= 0.9 * len(h) for h in hit.values())
    words = spark.read.parquet(f"{tiny}/documents.parquet").select(F.slice(F.split("text", r"[^A-Za-z]+"), 2, 400).alias("w")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.slice("w", i * 5 + 1, 4))).alias("w"))
    plain = words.select(F.array_join("w", "_").alias("t")).union(words.select(F.array_join("w", "").alias("t"))).where(F.length("t") >= LEAST).distinct()
    n, found = plain.select(F.count("*"), F.count_if(F.size(stretches(F.col("t"), table)) > 0)).first()
    assert n > 300 and found < 0.01 * n
