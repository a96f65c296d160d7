"""Conversation structure repair: the cheapest edits to ``(s?(ua)+)?``.

Rows are dealt out by conversation and sorted by turn, so a task sees one
conversation after the other as a stream; whatever it carries from row to row
is the state of a dynamic program of four cells, and lasts over the borders of
Arrow batches.  Three such streams follow one another:

1. forward: the cheapest cost of each cell, and for each row a byte per cell
   that tells where it came from.  These backpointers are spilled as rows of a
   written table, ``CHUNK`` turns a row;
2. backward over the spilled chunks, last one first: the edits;
3. forward again over rows and edits together: the repaired rows.

So a conversation of any length takes bounded memory in every stream; only the
result's ``audit`` holds a letter for each of its rows.  Equal costs are told
apart by the audit strings: of two paths, both ending with a row's edit, none
begins the other, so their order never changes again and a rank a cell is
enough to carry.

Edits: Keep 0; Rerole to user or assistant 1; Delete 2 (required for blank and
duplicate rows); Insert an empty user or assistant turn 5; a truncated row that
is not deleted adds 5.  Roles count by their first character; others than
s, u, a cannot be kept.

Null role and null text count as one space (so such a text is blank), a null
turn comes before all others, rows of one turn follow in order of role and
text; a null conversation id is an id like any other.  Repeated rows are
duplicates.  Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sondage.llm.base import bound_batches, cut, shuffle_width

#: Turns whose backpointers make one row.
CHUNK = 1 << 15
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Role initials that may stand next to each other.
LEGAL = {"su", "ua", "au"}
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
CUT_OFF = 5
#: Cells: nothing written yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LETTERS = "DKR"
FIRST = ((0, 0), None, None, None)


# --- the dynamic program ----------------------------------------------------------------


class Steps:
    """Steps of the program by (cells, kind of row); there are few different ones.

    A cell is (cost above the cheapest cell, rank of its audit) or None.
    """

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def __call__(self, cells: tuple, initial: str, fault: int) -> tuple[tuple, int, bytes]:
        """(cells after the row, cost added to all, a backpointer a cell; 255: not reached)."""
        key = (cells, initial, fault)
        if key not in self.known:
            self.known[key] = self._step(*key)
        return self.known[key]

    @staticmethod
    def _step(cells: tuple, initial: str, fault: int) -> tuple[tuple, int, bytes]:
        best: list[tuple | None] = [None] * 4
        for source, cell in enumerate(cells):
            if cell is None:
                continue
            at = source
            for inserted in range(3):  # a third one leads where the first one led
                at = NEXT[at] if inserted else at
                options = [("D", at)]
                if fault not in (BLANK, DUPLICATE):
                    if initial == "s" and at == START:
                        options.append(("K", SYSTEM))
                    if initial == {USER: "u", ASSISTANT: "a"}[NEXT[at]]:
                        options.append(("K", NEXT[at]))
                    options.append(("R", NEXT[at]))
                for letter, target in options:
                    cost = cell[0] + 5 * inserted + COSTS[letter] + CUT_OFF * (fault == TRUNCATED and letter != "D")
                    one = (cost, cell[1], "I" * inserted + letter, source + 4 * inserted + 12 * LETTERS.index(letter))
                    if best[target] is None or one < best[target]:
                        best[target] = one
        least = min(b[0] for b in best if b)
        ranks = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
        return tuple(b and (b[0] - least, ranks[b[1:3]]) for b in best), least, bytes(255 if b is None else b[3] for b in best)

    @staticmethod
    def end(cells: tuple) -> tuple[int, int, int]:
        """(cost added, last cell, turns inserted at the end)."""
        ends = [(cell[0] + 5 * more, cell[1], at, more) for at, more in ((START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0)) if (cell := cells[at])]
        cost, _, at, more = min(ends)
        return cost, at, more


def _back(pointer: int) -> tuple[int, str]:
    """(cell before, letters of the step)."""
    return pointer % 4, "I" * (pointer % 12 // 4) + LETTERS[pointer // 12]


def edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of one conversation's (initial, fault) rows, all in memory."""
    step, cells, total, backs = Steps(), FIRST, 0, []
    for initial, fault in rows:
        cells, more, back = step(cells, initial, fault)
        total += more
        backs.append(back)
    more, at, tail = step.end(cells)
    out = ["I" * tail]
    for back in reversed(backs):
        at, letters = _back(back[at])
        out.append(letters)
    return total + more, "".join(reversed(out))


# --- rows -------------------------------------------------------------------------------


def damage(talks: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the checksum of ``conv_id:turn``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return (talks.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
            .drop("_copy"))


def judged(rows: DataFrame) -> DataFrame:
    """Rows with ``initial`` and first ``fault``, dealt out by conversation (not yet sorted by turn).

    All columns that tell a duplicate begin with the conversation, so the
    window uses the partitioning that the streams need anyway.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    bound_batches(rows.sparkSession)
    dealt = (rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
             .repartition(shuffle_width(rows.sparkSession), "conv_id"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(last == "", BLANK).when(seen, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0))
    return dealt.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))


def _forward(rows: DataFrame) -> DataFrame:
    """``chunks``: backpointers of ``CHUNK`` rows each; a conversation's last one has its figures."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([
        T.StructField("conv_id", kinds["conv_id"]), T.StructField("turn", kinds["turn"]), T.StructField("chunk", T.LongType()),
        T.StructField("back", T.BinaryType()), T.StructField("cell", T.IntegerType()), T.StructField("tail", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, out, held = Steps(), [], 0
        conv, state = None, None  # state: what is carried from row to row

        def spill(end: bool) -> None:
            nonlocal held
            figures = [None] * 8
            if end:
                more, at, tail = step.end(state["cells"])
                gaps = 0 if state["low"] is None else state["turn"] - state["low"] + 1 - state["turns"]
                figures = [at, tail, gaps, *state["faults"][1:], state["illegal"], state["cost"] + more]
            out.append((conv, state["first"], state["chunk"], bytes(state["back"]), *figures))
            held += len(state["back"]) + 64
            state["chunk"] += 1
            state["back"] = bytearray()

        def packed() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out))
            out.clear()
            held = 0
            types = [ids, turns, pa.int64(), pa.binary(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

        for b in batches:
            ids, turns = b.schema.field("conv_id").type, b.schema.field("turn").type
            for c, turn, initial, fault in zip(*[b.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "fault")]):
                if state is None or c != conv:
                    if state is not None:
                        spill(True)
                    conv = c
                    state = {"cells": FIRST, "cost": 0, "back": bytearray(), "chunk": 0, "first": turn, "faults": [0] * 4,
                             "illegal": 0, "initial": None, "turn": None, "low": None, "turns": 0}
                elif len(state["back"]) >= 4 * CHUNK:
                    spill(False)
                if not state["back"]:
                    state["first"] = turn
                state["cells"], more, back = step(state["cells"], initial, fault)
                state["cost"] += more
                state["back"] += back
                state["faults"][fault] += 1
                state["illegal"] += state["initial"] is not None and state["initial"] + initial not in LEGAL
                state["initial"] = initial
                if turn is not None and turn != state["turn"]:  # turns rise
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["turn"], state["turns"] = turn, state["turns"] + 1
            if held > 1 << 20:
                yield packed()
        if state is not None:
            spill(True)
        if out:
            yield packed()

    # of equal rows the one that is no duplicate comes first
    ordered = rows.sortWithinPartitions("conv_id", "turn", "role", "text", F.col("fault") == DUPLICATE).select("conv_id", "turn", "initial", "fault")
    return ordered.mapInArrow(run, schema)


def _backward(chunks: DataFrame) -> DataFrame:
    """``conv_id, turn, chunk, audit``: the edits of each chunk's rows; the last chunk's end with what is inserted there."""
    schema = T.StructType([*chunks.schema.fields[:3], T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0  # carried from a chunk to the one before
        for b in batches:
            out = []
            for back, cell, tail in zip(*[b.column(n).to_pylist() for n in ("back", "cell", "tail")]):
                letters = []
                if cell is not None:
                    at = cell
                    letters.append("I" * tail)
                for k in range(len(back) - 4, -4, -4):
                    at, step = _back(back[k + at])
                    letters.append(step)
                out.append("".join(reversed(letters)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], schema.names)

    return (chunks.repartition(shuffle_width(chunks.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", F.col("chunk").desc())
            .select("conv_id", "turn", "chunk", "back", "cell", "tail").mapInArrow(run, schema))


def _repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text`` of the repaired turns, in order within partitions."""
    conv = rows.schema["conv_id"]
    schema = T.StructType([conv, T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    both = (rows.select("conv_id", "turn", F.lit(None).cast("long").alias("chunk"), "role", "text")
            .unionByName(audits.select("conv_id", "turn", "chunk", F.lit("").alias("role"), F.col("audit").alias("text"))))
    # the edits of a chunk come before the rows of its first turn, so never too late
    ordered = both.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "turn", F.col("chunk").asc_nulls_last(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, plan, at, place, cell = False, None, deque(), 0, 0, START
        out: list[tuple] = []

        def take() -> str:
            nonlocal at
            while plan and at == len(plan[0]):
                plan.popleft()
                at = 0
            if not plan:
                return ""
            at += 1
            return plan[0][at - 1]

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, cell
            out.append((conv, place, edit, role, text))
            place += 1
            cell = SYSTEM if cell == START and edit == "K" and role[:1] == "s" else NEXT[cell]

        def insert() -> None:
            put("I", "user" if NEXT[cell] == USER else "assistant", "")

        def packed(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], schema.names)

        kind = None
        for b in batches:
            kind = b.schema.field("conv_id").type
            for c, chunk, role, text in zip(*[b.column(n).to_pylist() for n in ("conv_id", "chunk", "role", "text")]):
                if not begun or c != conv:
                    while take():  # what is inserted at the end
                        insert()
                    begun, conv, at, place, cell = True, c, 0, 0, START
                if chunk is not None:
                    plan.append(text)
                    continue
                while (edit := take()) == "I":
                    insert()
                if edit == "K":
                    put("K", role, text)
                elif edit == "R":
                    put("R", "user" if NEXT[cell] == USER else "assistant", text)
            yield packed(kind)
        while take():
            insert()
        if out:
            yield packed(kind)

    return ordered.mapInArrow(run, schema)


def _digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``; reads a conversation's rows as the stream that they are."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, kind = None, None, None
        for b in batches:
            kind, done = b.schema.field("conv_id").type, []
            for c, place, role, text in zip(*[b.column(n).to_pylist() for n in ("conv_id", "place", "role", "text")]):
                if place == 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (kind, pa.string()))], schema.names)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], schema.names)

    return repaired.mapInArrow(run, schema)


def plan_edits(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(judged rows, spilled chunks, edits by chunk) of rows ``conv_id, turn, role, text``."""
    known = judged(rows)
    chunks = cut(_forward(known), "backpointers")
    return known, chunks, cut(_backward(chunks), "edits")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, role, text``."""
    known, _, audits = plan_edits(rows)
    return _repaired(known, audits)


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: faults, cost, audit and digest; ``ids`` may name ones that have no rows."""
    known, chunks, audits = plan_edits(rows)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    parts = [(ids if ids is not None else rows).select("conv_id").distinct(),
             chunks.filter("cell IS NOT NULL").select("conv_id", *counts),
             audits.groupBy("conv_id").agg(whole.alias("audit")), _digests(_repaired(known, audits))]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p, allowMissingColumns=True)
    return all_parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
