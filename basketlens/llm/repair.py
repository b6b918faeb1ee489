"""Repair of conversation structure: cheapest edits by a backward cost-to-go over turns and grammar states.

Semantics (`plan_edits`, `rebuilt`)
    Rows of one conv_id are a conversation, ordered by turn (nulls first), then role, then the SHA-256 of the text; rows that
    agree in all of these lie side by side. A null role or text is one space; a null conv_id is a conversation like any
    other; other columns are not read, whatever their names; an empty table gives an empty result.

    Each row's first fault counts: `blank` (no character but space and the controls 9 to 13), `duplicate` (role and text seen
    earlier in the conversation), `truncated` (the last other character is none of `.!?`). A role counts by its initial; an
    empty role has none, so it can only be given another or be deleted.

    Edits: K keeps a turn for 0; R gives it the role user or assistant for 3; D deletes it for 4; I inserts a turn without
    text, of user or assistant, anywhere for 3. Blank and duplicate rows are deleted; a truncated row that is not deleted
    costs 3 more. The edits are the cheapest after which the initials read `(s?(ua)+)?`; of equally cheap ones those whose
    letters are ASCII-least. Which role R and I mean follows from the state.

Method
    STATES of the grammar are: nothing yet, after system, after user, after assistant. `before` gives the cost-to-go of every
    state before a row from the one behind it; the walk forward takes in each state the ASCII-least edit whose cost and
    cost-to-go add up (every edit leads to one state, and no cheapest audit is the beginning of another, so the walk is right).

    Rows without their texts are range-partitioned in order, so a conversation of very many rows is cut into slices of
    different partitions. For such conversations a slice is first a 4 x 4 matrix of costs from state to state, which
    combine by (min, +); the goals behind each slice and then the state before it follow from one short row a slice. Every
    slice is walked on its own. Rows that agree entirely are one row here: all but the first are deleted.

    Texts are shuffled once, to their conversation, and stream in order past their edits (`rebuilt`, `digests`): a task holds
    one batch. That a conversation streams through one task is inherent in its digest, which reads its turns in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm.shared import stored

#: Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; where initials lead, and the state after an insertion.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERTED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
INITIALS = "sua"
FAULTS = ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Cost-to-go behind the last row: the insertions that complete a pair.
GOAL = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40

_SPACE = r"\x20\x09-\x0D"


def _with_insertions(cost: list[int]) -> tuple[int, ...]:
    for s in (2, 3, 0, 1):
        cost[s] = min(cost[s], cost[INSERTED[s]] + INSERT)
    return tuple(cost)


def _choices(code: int, after: tuple[int, ...], s: int) -> list[tuple[str, int, int]]:
    """Edits of a row in state s, but insertions, ASCII-least first: edit, cost with the cost-to-go, next state."""
    initial, fault = INITIALS[code % 4 : code % 4 + 1], FAULTS[code // 4]
    out = [("D", DELETE + after[s], s)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if (s, initial) in NEXT:
            out.append(("K", KEEP + more + after[NEXT[s, initial]], NEXT[s, initial]))
        out.append(("R", REROLE + more + after[INSERTED[s]], INSERTED[s]))
    return out


@lru_cache(1 << 16)
def before(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Cost-to-go of every state before a row, less their least, and that least; few different ones occur."""
    cost = _with_insertions([min(c for _, c, _ in _choices(code, after, s)) for s in range(4)])
    least = min(cost)
    return tuple(c - least if c < FAR // 2 else FAR for c in cost), least


@lru_cache(1 << 18)
def step(code: int, after: tuple[int, ...], s: int) -> tuple[str, int]:
    """The edits of the walk at one row, insertions before it first, and the state behind it."""
    cost, least = before(code, after)
    edits = ""
    while True:
        insertion = ("I", INSERT + cost[INSERTED[s]] + least, INSERTED[s])
        edit, _, to = next(x for x in sorted([insertion, *_choices(code, after, s)]) if x[1] == cost[s] + least)
        edits, s = edits + edit, to
        if edit != "I":
            return edits, s


def costs(codes: list[int], goal: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int]:
    """Cost-to-go behind each row, the first one's before first and last one's last, each less a constant; the constant of the first."""
    found, total = [goal], 0
    for code in reversed(codes):
        cost, least = before(code, found[-1])
        found.append(cost)
        total += least
    return found[::-1], total


def matrix(codes: list[int]) -> list[int]:
    """Least costs from each state before the rows to each state behind them, row by row."""
    columns = []
    for t in range(4):
        found, total = costs(codes, tuple(0 if s == t else FAR for s in range(4)))
        columns.append([min(c + total, FAR) for c in found[0]])
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(codes: list[int], goal: tuple[int, ...], s: int) -> tuple[list[str], int]:
    """The edits at each row and the state behind the last."""
    found, edits = costs(codes, goal)[0], []
    for i, code in enumerate(codes):
        edit, s = step(code, found[i + 1], s)
        edits.append(edit)
    return edits, s


def _scaled(goal: list[int]) -> tuple[int, ...]:
    least = min(goal)
    return tuple(c - least for c in goal)


def _by_slice(name: str, kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("slice", T.LongType()), T.StructField(name, kind)]))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _matrix(codes: pa.Array) -> pa.Array:
    return pa.array([matrix(c) for c in codes.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(_by_slice("goal", T.ArrayType(T.LongType())))
def _goals(slices: pa.Array) -> pa.Array:
    """From a conversation's slices and matrices in order: the cost-to-go behind each slice."""
    out = []
    for conversation in slices.to_pylist():
        goal, found = list(GOAL), []
        for x in reversed(conversation):
            found.append({"slice": x["slice"], "goal": list(_scaled(goal))})
            m = x["matrix"]
            goal = [min(m[4 * s + t] + goal[t] for t in range(4)) for s in range(4)]
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("slice", pa.int64()), ("goal", pa.list_(pa.int64()))])))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _exits(codes: pa.Array, goals: pa.Array) -> pa.Array:
    """The state behind a slice for each state before it."""
    return pa.array([[walk(c, tuple(g), s)[1] for s in range(4)] for c, g in zip(codes.to_pylist(), goals.to_pylist(), strict=True)], pa.list_(pa.int32()))


@F.arrow_udf(_by_slice("entry", T.IntegerType()))
def _entries(slices: pa.Array) -> pa.Array:
    out = []
    for conversation in slices.to_pylist():
        s, found = 0, []
        for x in conversation:
            found.append({"slice": x["slice"], "entry": s})
            s = x["exits"][s]
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("slice", pa.int64()), ("entry", pa.int32())])))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _walk(codes: pa.Array, goals: pa.Array, entries: pa.Array) -> pa.Array:
    return pa.array([walk(c, tuple(g), s)[0] for c, g, s in zip(codes.to_pylist(), goals.to_pylist(), entries.to_pylist(), strict=True)], pa.list_(pa.string()))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest of every row, nulls replaced."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ("conv_id", "turn", "role", "digest")


def _numbered(rows: DataFrame) -> DataFrame:
    """Different rows without texts, in order: `at` grows with it, `part` names the partition."""
    text = F.col("text")
    blank, complete = ~text.rlike(f"[^{_SPACE}]"), text.rlike(rf"[.!?][{_SPACE}]*\z")
    narrow = rows.select(*ORDER, blank.alias("blank"), complete.alias("complete")).groupBy(*ORDER).agg(F.max("blank").alias("blank"), F.max("complete").alias("complete"))
    ordered = narrow.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return stored(ordered.select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "turns")


def _coded(numbered: DataFrame) -> DataFrame:
    """conv_id, part, at and a code: the initial's place and 4 times that of the fault."""
    firsts = numbered.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(~F.col("complete"), 3).otherwise(0)
    return numbered.join(firsts, "at", "left").select("conv_id", "part", "at", (place + 4 * fault).alias("code"))


def plan_edits(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, fault, edits of every different row."""
    numbered = _numbered(turns(conversations))
    slices = _coded(numbered).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"))
    slices = slices.select("conv_id", "rows", F.col("rows")[0]["at"].alias("slice"), F.col("rows")["code"].alias("codes"))
    slices = stored(slices.withColumn("slices", F.count("*").over(Window.partitionBy("conv_id"))), "slices")
    goal = F.array(*(F.lit(c).cast("long") for c in GOAL))
    whole = slices.where("slices = 1").select("rows", "codes", goal.alias("goal"), F.lit(0).alias("entry"))
    cut = slices.where("slices > 1")

    def by_conversation(df: DataFrame, value: str, found, unpack: str) -> DataFrame:
        each = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", value))).alias("all"))
        return each.select(F.inline(found(F.col("all")))).select("slice", unpack)

    goals = by_conversation(cut.select("conv_id", "slice", _matrix("codes").alias("matrix")), "matrix", _goals, "goal")
    aimed = stored(cut.drop("slices").join(goals, "slice"), "aimed")
    entries = by_conversation(aimed.select("conv_id", "slice", _exits("codes", "goal").alias("exits")), "exits", _entries, "entry")
    walked = whole.unionByName(aimed.join(entries, "slice").select("rows", "codes", "goal", "entry"))
    edits = walked.select("rows", _walk("codes", "goal", "entry").alias("edits")).select(F.inline(F.arrays_zip("rows", "edits"))).select("rows.at", "rows.code", "edits")
    fault = F.element_at(F.array(*map(F.lit, FAULTS)), (F.col("code") / 4).cast("int") + 1)
    return numbered.join(edits, "at").select(*ORDER, fault.alias("fault"), "edits")


_REBUILT = "turn bigint, was string, fault string, edit string, role string, text string"


def rebuilt(conversations: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The edited conversations in order, a row for each edit: conv_id, turn, was, fault (of the row edited), edit, role and text (of the turn that is left; null for D).

    The rows of a conversation lie behind one another in one partition.
    """
    rows = turns(conversations)
    plan = plan_edits(conversations) if plan is None else plan
    none = F.lit(None).cast("string")
    both = plan.select(*ORDER, F.lit(0).alias("kind"), none.alias("text"), "fault", "edits").unionByName(rows.select(*ORDER, F.lit(1).alias("kind"), "text", none.alias("fault"), none.alias("edits")))
    ordered = both.repartition("conv_id").sortWithinPartitions(*ORDER, "kind").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "kind", "text", "fault", "edits")
    conv_type = ordered.schema["conv_id"].dataType.simpleString()

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, state, fault, edits = False, None, 0, "", None
        out: list[tuple] = []

        def close() -> None:
            nonlocal state
            while open_ and GOAL[state]:
                state = INSERTED[state]
                out.append((conv, None, None, None, "I", ROLE[state], ""))

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), ("turn", pa.int64()), *((c, pa.string()) for c in ("was", "fault", "edit", "role", "text"))])
            for c, turn, role, kind, text, f, e in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if not open_ or c != conv:
                    close()
                    open_, conv, state = True, c, 0
                if kind == 0:
                    fault, edits = f, e
                    continue
                if edits is None:  # another row like the one before
                    out.append((c, turn, role, "blank" if fault == "blank" else "duplicate", "D", None, None))
                    continue
                for x in edits[:-1]:
                    state = INSERTED[state]
                    out.append((c, None, None, None, x, ROLE[state], ""))
                x, edits = edits[-1], None
                if x == "D":
                    out.append((c, turn, role, fault, x, None, None))
                else:
                    state = NEXT[state, role[0]] if x == "K" else INSERTED[state]
                    out.append((c, turn, role, fault, x, role if x == "K" else ROLE[state], text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return ordered.mapInArrow(edit, f"conv_id {conv_type}, {_REBUILT}")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Digest:
    """Counts and digest of one conversation, turn by turn."""

    def __init__(self, conv):
        self.conv, self.n, self.audit, self.sha = conv, dict.fromkeys(_COUNTS, 0), [], hashlib.sha256()
        self.initial = self.low = self.high = None
        self.distinct, self.any = 0, False

    def add(self, turn: int | None, was: str | None, fault: str | None, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.n["cost"] += _COST[edit]
        if edit != "I":
            if fault:
                self.n[fault] += 1
            if fault == "truncated" and edit != "D":
                self.n["cost"] += TRUNCATED
            if self.initial is not None and (self.initial, was[:1]) not in _LEGAL:
                self.n["illegal"] += 1
            self.initial = was[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        if edit != "D":
            self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.any = True

    def row(self) -> dict:
        if self.high is not None:
            self.n["gaps"] = self.high - self.low + 1 - self.distinct
        return {"conv_id": self.conv, **self.n, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def digests(edited: DataFrame) -> DataFrame:
    """One row for each conversation of `rebuilt`: counts of gaps, faults and illegal neighbours, cost, audit and a digest of the turns that are left."""
    conv_type = edited.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, schema = None, [], None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for c, *rest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if now is None or c != now.conv:
                    out += [now.row()] if now else []
                    now = _Digest(c)
                now.add(*rest)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return edited.mapInArrow(digest, f"conv_id {conv_type}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage, by a hash of conv_id and turn; nulls are one space in the hash, in roles and in texts."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("_copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "_copy")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """`digests` of the rows' repair for every conv_id of conversations; one without rows has zeros, no edits and the digest of nothing."""
    found = digests(rebuilt(rows))
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    nothing = {c: F.lit(0).cast("long") for c in _COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return joined.select(F.col("_id").alias("conv_id"), *(F.coalesce(F.col(c), x).alias(c) for c, x in nothing.items()))
