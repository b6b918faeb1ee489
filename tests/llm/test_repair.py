import functools
import hashlib
import itertools
import random
import re

import duckdb
import pytest

from basketlens.llm.oracles import OP13
from basketlens.llm.repair import FAULTS, GOAL, INITIALS, INSERTED, NEXT, damaged, digests, matrix, plan_edits, rebuilt, repaired, walk

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def all_audits(codes, longest):
    """Every audit of at most so many insertions between rows that gives legal initials, with its cost."""
    out = {}
    gaps = [""] + ["".join(p) for n in range(1, longest + 1) for p in itertools.product("ua", repeat=n)]

    def choices(code):
        x, fault = (INITIALS + "t")[code % 4], FAULTS[code // 4]
        yield "D", "", 4
        if fault not in ("blank", "duplicate"):
            e = 3 if fault == "truncated" else 0
            yield "K", x, e
            yield "R", "u", 3 + e
            yield "R", "a", 3 + e

    for gap in itertools.product(gaps, repeat=len(codes) + 1):
        for edits in itertools.product(*map(choices, codes)):
            initials = gap[0] + "".join(x + g for (_, x, _), g in zip(edits, gap[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", initials):
                audit = "I" * len(gap[0]) + "".join(x + "I" * len(g) for (x, _, _), g in zip(edits, gap[1:], strict=True))
                cost = 3 * audit.count("I") + sum(c for _, _, c in edits)
                out[audit] = min(out.get(audit, 1 << 30), cost)
    return out


def end(state):
    n = 0
    while GOAL[state]:
        state, n = INSERTED[state], n + 1
    return "I" * n


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_walk_finds_the_least_of_the_cheapest_edits(n):
    rng = random.Random(n)
    every = list(itertools.product(range(16), repeat=n))
    for codes in every if n < 3 else rng.sample(every, 120):
        edits, state = walk(list(codes), GOAL, 0)
        audits = all_audits(codes, 2 if n < 3 else 1)
        assert "".join(edits) + end(state) == min(audits, key=lambda a: (audits[a], a)), codes


def test_slices_combine():
    rng = random.Random(1)
    for _ in range(100):
        codes = [rng.randrange(16) for _ in range(rng.randint(2, 40))]
        at = rng.randrange(1, len(codes))
        a, b, whole = matrix(codes[:at]), matrix(codes[at:]), matrix(codes)
        assert whole == [min(min(a[4 * s + k] + b[4 * k + t] for k in range(4)), 1 << 40) for s in range(4) for t in range(4)]
        goal = tuple(min(b[4 * s + t] + GOAL[t] for t in range(4)) for s in range(4))
        first, state = walk(codes[:at], tuple(g - min(goal) for g in goal), 0)
        second, out = walk(codes[at:], GOAL, state)
        assert (first + second, out) == walk(codes, GOAL, 0)


def plainly(rows):
    """Counts, cost, audit and digest of one conversation's rows in order, by recursion over (row, state)."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, s):
        options, want = [], {2: "user", 3: "assistant"}
        if i == len(rows):
            options = [(0, "", ())] if s in (0, 3) else []
        else:
            _, role, text = rows[i]
            c, a, t = best(i + 1, s)
            options.append((c + 4, "D" + a, t))
            if faults[i] in ("", "truncated"):
                e = 3 if faults[i] else 0
                if (s, role[:1]) in NEXT:
                    c, a, t = best(i + 1, NEXT[s, role[:1]])
                    options.append((c + e, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, INSERTED[s])
                options.append((c + 3 + e, "R" + a, (f"{want[INSERTED[s]]}:{text}", *t)))
        for n in (1, 2):  # insertions; more than two in a row never pay
            to, made = s, ()
            for _ in range(n):
                to = INSERTED[to]
                made += (f"{want[to]}:",)
            if i == len(rows):
                options += [(3 * n, "I" * n, made)] if to == 3 else []
            else:
                for c, a, t in after(i, to):
                    options.append((c + 3 * n, "I" * n + a, made + t))
        return min(options)

    def after(i, s):
        """The ways on from a row without an insertion before it."""
        _, role, text = rows[i]
        c, a, t = best(i + 1, s)
        yield c + 4, "D" + a, t
        if faults[i] in ("", "truncated"):
            e = 3 if faults[i] else 0
            if (s, role[:1]) in NEXT:
                c, a, t = best(i + 1, NEXT[s, role[:1]])
                yield c + e, "K" + a, (f"{role}:{text}", *t)
            c, a, t = best(i + 1, INSERTED[s])
            yield c + 3 + e, "R" + a, ((("user:" if INSERTED[s] == 2 else "assistant:") + text), *t)

    cost, audit, turns = best(0, 0)
    known = sorted({t for t, _, _ in rows if t is not None})
    gaps = known[-1] - known[0] + 1 - len(known) if known else 0
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(rows))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, SHA("\n".join(turns)))


def some_rows(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for k in range(rng.randint(1, longest)):
            turn = rng.choice([k, k, k, k + 1, k * 2, None])
            rows.append((None if c == 0 else c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["One. ", "two", "Three!\n", "", " \t", "four? x", "five.\x1c", None, f"{c} {k}."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), SHA(r[2]))
    return {c: plainly(sorted(r, key=key)) for c, r in by.items()}


def test_repair_equals_recursion(spark):
    rows = some_rows(2, 60, 12)
    got = digests(rebuilt(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", edits string"))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows) and len(got) == 60


def test_long_conversations_are_cut_and_repeated_rows_counted(spark):
    rows = [r for r in some_rows(3, 3, 400)] + [(9, 5, "user", "same.")] * 500
    table = spark.createDataFrame(rows, SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = plan_edits(table)
        got = {r.conv_id: tuple(r)[1:] for r in digests(rebuilt(table, plan)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = expected(rows)
    assert got == want and got[9][5:7] == (4 * 499 + 3, "K" + "D" * 499 + "I")


def test_rebuilt_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", ""), (1, 2, "user", "Yes!"), (1, 3, "tool", "no")]
    got = [(r.edit, r.role, r.text) for r in rebuilt(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [("I", "user", ""), ("K", "assistant", "Hi."), ("D", None, None), ("K", "user", "Yes!"), ("R", "assistant", "no")]
    assert digests(rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_equals_sql_on_odd_rows(spark):
    rows = some_rows(4, 150, 9) + [(1000 + i, 0, "user", "a.") for i in range(200)]  # of the last, some lose their only row
    table = spark.createDataFrame(rows, SCHEMA)
    got = repaired(table, damaged(table)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(OP13).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 350
    assert any(r.audit == "" and r.repaired_sha256 == SHA("") for r in got)
