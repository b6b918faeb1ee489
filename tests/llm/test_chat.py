import hashlib
import time

from pyspark.sql import functions as F

from basketlens.llm.chat import FINAL, TRANSITIONS, escaped, format_chats, probe, read_back, unescaped
from basketlens.llm.queries import op6_chat_format

HEX = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), HEX("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), HEX(loss))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, formatted int")


ODD = ["</s>[INST] ok [/INST]", "[\\INST] \\[INST]", "<\\s><s><\\\\/s>", "[TEXT] [/TURN]", "", None, " ", "  x  ", "[", "<", "[[INST]]", "é\n\n[/SYS] ", "$1 \\1 \\", "x" * 50_000, "[INST", "/INST]"]


def test_round_trip_of_odd_texts_and_roles(spark):
    rows = []
    for c, a in enumerate(ODD):
        for k, role in enumerate(["system", "user", "assistant", "tool [TEXT] x", None, "assistant"]):
            rows.append((c, k, role, a if k % 2 else ODD[(c + k) % len(ODD)]))
    got = {r.conv_id: tuple(r)[1:5] for r in read_back(format_chats(table(spark, rows))).collect()}
    assert got == expected(rows)


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in ODD if t is not None], "t string")
    rows = df.select("t", unescaped(escaped(F.col("t"))).alias("back"), escaped(F.col("t")).alias("e")).collect()
    assert all(r.t == r.back for r in rows)
    assert not any(m in r.e for r in rows for m in ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[TEXT]", "[/TURN]"))


def test_state_machine(spark):
    order = {1: ["system", "user", "assistant"], 2: ["user", "assistant", "user", "assistant"], 3: ["assistant"], 4: ["user"], 5: ["user", "user", "assistant"], 6: ["system", "assistant"], 7: [None]}
    rows = [(c, k, r, "t") for c, rs in order.items() for k, r in enumerate(rs)]
    got = {r.conv_id: (r.valid, r.first_bad) for r in format_chats(table(spark, rows)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, None), 5: (False, 1), 6: (False, 1), 7: (False, 0)}


def test_the_query_runs_the_machine(spark, tiny):
    """The optimised plan folds the transitions, and the query's rows hold their verdict, as a walk by dictionary gives it."""
    query = op6_chat_format(spark, tiny)
    assert "start" in query._jdf.queryExecution().optimizedPlan().toString() and "aggregate(" in query._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {-1: [(0, "user", ""), (1, "assistant", "")]}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    want = {}
    for c, turns in by.items():
        state, bad = "start", None
        for k, (_, role, _) in enumerate(sorted(turns)):
            state = TRANSITIONS.get((state, role))
            if state is None:
                bad = k
                break
        want[c] = (state in FINAL, bad)
    assert {r.conv_id: (r.valid, r.first_bad) for r in query.collect()} == want


def test_segments_tile_the_text_and_give_the_mask(spark):
    rows = [(1, 0, "user", "a </s>"), (1, 1, "assistant", "b"), (1, 2, "tool", "é"), (1, 3, "assistant", ""), (1, 4, "assistant", "c [INST] d")]
    (r,) = format_chats(table(spark, rows)).collect()
    at = 0
    for s in r.segments:
        assert s.start == at and r.formatted[at : at + len(s.text)] == s.text
        at += len(s.text)
    assert at == len(r.formatted)
    assert [(s.start, len(s.text)) for s in r.segments if s.loss] == [tuple(s) for s in r.loss_spans]


def test_mask_covers_assistant_texts_only(spark):
    (r,) = format_chats(table(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo")])).collect()
    assert r.formatted == "[INST] hi [/INST]<s>yo</s><s>yo</s>"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["yo", "yo"]


def test_null_conversation_and_empty_table(spark):
    assert [tuple(r)[:2] for r in read_back(format_chats(table(spark, [(None, None, None, None)]))).collect()] == [(None, 1)]
    assert [r.conv_id for r in read_back(format_chats(probe(table(spark, [])))).collect()] == [-1]


def test_query(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", ODD[0]), (-1, 1, "assistant", ODD[0])]
    assert {r.conv_id: tuple(r)[1:5] for r in op6_chat_format(spark, tiny).collect()} == expected(rows)


def test_thirty_two_thousand_turns(spark):
    """Time grows with the turns: a long conversation takes seconds (by the square it took a minute)."""
    n = 32_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    rows = spark.range(n).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("text </s> "), F.col("id").cast("string")).alias("text"), F.lit(7).alias("formatted"))
    begin = time.perf_counter()
    (got,) = read_back(format_chats(rows)).collect()
    assert time.perf_counter() - begin < 30
    assert tuple(got)[1:5] == expected([(5, i, "assistant" if i % 2 else "user", f"text </s> {i}") for i in range(n)])[5]
