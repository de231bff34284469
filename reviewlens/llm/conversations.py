"""Repair of the turn structure of conversations by cheapest edits.

A conversation is well formed when the initials of its roles read `(s?(ua)+)?`. Its rows, in order,
are kept, get another role or are deleted, and rows without text are inserted; blank and repeated
rows must go. The states between two rows are four (nothing yet, after s, after u, after a) and in
each state only one role can be inserted, so an edit's initial tells all about it.

Costs of what is left are computed backwards. Only every sqrt(n)-th vector of four costs is stored;
walking forward, the vectors of one stretch after the other are made again from the checkpoint at
its end, and of the edits that reach the least cost the one with the least initial is taken. As
different edits lead on in different ways, this gives the ASCII-least of the cheapest audits.

Rows are dealt out in ranges of (conversation, order) of bounded size, so a conversation that holds
a third of all rows is many segments. Of a segment that is not alone, the costs from every state to
every state are a 4 x 4 matrix of least sums; chained backwards they give the costs at every border,
and the walks of a segment from its four possible states are chained forwards. Such a chain has a few
numbers per segment. Rows join by their place, which no two share. The audit of a conversation is one value of the
result, and the digest of its repaired text is taken in one pass over its rows in order: neither can be
spread, but no task holds more of a conversation than a segment and the audit.

Nulls are one space in every column that holds text, and in the key that damage goes by. The order is
by turn, nulls first; equal turns go by role and text (its first 64 characters, then its SHA-256).
Rows that are equal throughout are repeated rows, the later of which is a duplicate. An initial other than s, u
or a, or an empty role, cannot be kept. Conversations without rows have zeros, an empty audit and an empty text.
An empty table gives an empty result; a null conversation id is a conversation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ROWS_PER_RANGE, BYTES_PER_RANGE = 20_000, 32 << 20
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 3, 3, 4, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
FAR = math.inf
# What follows each state: the state after a role's initial, and the only role to insert.
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
FILLED = [USER, USER, ASSISTANT, USER]
INITIAL = {USER: "u", ASSISTANT: "a"}
ROLE = {"u": "user", "a": "assistant", ".": None}
# A row as one character: its initial or x; upper case must go; behind a mark it is truncated.
FINE, GONE, CUT = "suax", "SUAX", "1234"


# --- one segment ----------------------------------------------------------------------------


def _fill(costs: list[float]) -> list[float]:
    """Inserted rows before the next one."""
    u, a = min(costs[USER], costs[ASSISTANT] + INSERT), min(costs[ASSISTANT], costs[USER] + INSERT)
    return [min(costs[NOTHING], u + INSERT), min(costs[SYSTEM], u + INSERT), u, a]


END = _fill([0, FAR, FAR, 0])


def _row(code: str) -> tuple[str, float, float]:
    """Initial, and what it costs to keep the row or to give it another role."""
    if code in GONE:
        return code.lower(), FAR, FAR
    cut = KEEP_TRUNCATED if code in CUT else 0
    return (FINE[CUT.index(code)] if cut else code), cut, REROLE + cut


ROWS = {code: _row(code) for code in FINE + GONE + CUT}


def _before(code: str, after: list[float]) -> list[float]:
    """Costs before a row from those after it."""
    initial, keep, rerole = ROWS[code]
    costs = []
    for state in range(STATES):
        to = NEXT[state].get(initial)
        kept = FAR if to is None else keep + after[to]
        costs.append(min(DELETE + after[state], kept, rerole + after[FILLED[state]]))
    return _fill(costs)


def matrix(codes: str) -> list[list[float]]:
    """Least cost from every state before the rows to every state after them."""
    ends = [[0 if s == t else FAR for s in range(STATES)] for t in range(STATES)]
    for code in reversed(codes):
        ends = [_before(code, end) for end in ends]
    return [[ends[t][s] for t in range(STATES)] for s in range(STATES)]


def through(step: list[list[float]], after: list[float]) -> list[float]:
    return [min(step[s][t] + after[t] for t in range(STATES)) for s in range(STATES)]


def walk(codes: str, end: list[float], state: int, last: bool) -> tuple[str, str, int, float]:
    """The cheapest edits from a state on, ASCII-least; with each the initial of the role it sets, or a
    dot; the state after them; the cost of all that is left. Only the last rows may be followed by others."""
    n = len(codes)
    step = math.isqrt(n) + 1
    checkpoints, costs = {n: end}, end
    for i in range(n - 1, -1, -1):
        costs = _before(codes[i], costs)
        if i % step == 0:
            checkpoints[i] = costs
    total, edits, roles = costs[state], [], []
    for a in range(0, n, step):
        b = min(a + step, n)
        stretch = [checkpoints[b]]
        for i in range(b - 1, a - 1, -1):
            stretch.append(_before(codes[i], stretch[-1]))
        stretch.reverse()
        for i in range(a, b):
            initial, keep, rerole = ROWS[codes[i]]
            here, after = stretch[i - a], stretch[i - a + 1]
            while True:
                left, filled, to = here[state], FILLED[state], NEXT[state].get(initial)
                if left == DELETE + after[state]:
                    edits.append("D")
                    roles.append(".")
                elif left == INSERT + here[filled]:
                    edits.append("I")
                    roles.append(INITIAL[filled])
                    state = filled
                    continue
                elif to is not None and left == keep + after[to]:
                    edits.append("K")
                    roles.append(".")
                    state = to
                else:
                    edits.append("R")
                    roles.append(INITIAL[filled])
                    state = filled
                break
    while last and end[state] > 0:
        state = FILLED[state]
        edits.append("I")
        roles.append(INITIAL[state])
    return "".join(edits), "".join(roles), state, total


# --- rows -----------------------------------------------------------------------------------


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(df: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text)` with faults put in by the checksum of conversation and turn."""
    kind = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))) % 20
    text, role = _spaced("text"), _spaced("role")
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def ordered(rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE, bytes_per_range: int = BYTES_PER_RANGE) -> DataFrame:
    """The rows with their place `_at` in the order and the range `_part` they lie in, as a written table."""
    rows = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"))
    rows = rows.withColumns({"_digest": F.sha2("text", 256), "_start": F.substring("text", 1, 64)})
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    ranges = 1 + max(known["n"] // rows_per_range, (known["size"] or 0) // bytes_per_range)
    order = ["conv_id", "turn", "role", "_start", "_digest", "_copy"]
    # Equal rows may be more than a range holds.
    rows = rows.withColumn("_copy", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("_start", "_copy")
    # What stands in the upper bits of the running number is the range.
    return written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))


def faults(placed: DataFrame) -> DataFrame:
    """`(conv_id, turn, _part, _at, fault, initial)`: the first fault of every row, or null."""
    blank = ~F.col("text").rlike(WORD)
    ending = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    slim = placed.select(
        "conv_id", "turn", "role", "_digest", "_part", "_at", blank.alias("_blank"), (~ending.isin(".", "!", "?")).alias("_cut"),
    )
    # One row per different text, whose place no other row shares.
    firsts = slim.groupBy("conv_id", "role", "_digest").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("_first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated")
    return slim.join(firsts, "_at", "left").select("conv_id", "turn", "_part", "_at", fault.alias("fault"), initial.alias("initial"))


def segments(judged: DataFrame) -> DataFrame:
    """`(conv_id, _part, codes, places, _head, _tail, illegal, alone)`: the rows of a conversation in one range."""
    place = F.when(F.col("initial").isin("s", "u", "a"), F.instr(F.lit(FINE), F.col("initial"))).otherwise(4)
    alphabet = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(FINE)
    code = F.substring(alphabet, place, F.lit(1))
    listed = F.array_sort(F.collect_list(F.struct("_at", code.alias("code"), F.substring(F.lit(FINE), place, F.lit(1)).alias("initial"))))
    rows = judged.groupBy("conv_id", "_part").agg(listed.alias("_rows"))
    pairs = F.zip_with(
        F.slice("_rows", F.lit(1), F.size("_rows") - 1), F.slice("_rows", F.lit(2), F.size("_rows")),
        lambda a, b: (~F.concat(a["initial"], b["initial"]).isin("su", "ua", "au")).cast("long"),
    )
    rows = rows.select(
        "conv_id", "_part", F.array_join(F.transform("_rows", lambda r: r["code"]), "").alias("codes"),
        F.transform("_rows", lambda r: r["_at"]).alias("places"), F.get("_rows", F.lit(0))["initial"].alias("_head"),
        F.element_at("_rows", -1)["initial"].alias("_tail"), F.aggregate(pairs, F.lit(0).cast("long"), lambda a, b: a + b).alias("illegal"),
    )
    ends = rows.groupBy("conv_id").agg(F.min("_part").alias("_low"), F.max("_part").alias("_high"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    ends = ends.withColumnRenamed("conv_id", "_conv")
    return written(rows.join(ends, same).withColumn("alone", F.col("_low") == F.col("_high")).drop("_conv", "_low", "_high"), "segments")


# --- edits ----------------------------------------------------------------------------------


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        steps = [[float(x) for row in matrix(codes) for x in row] for codes in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("_part"), pa.array(steps, pa.list_(pa.float64()))], ["conv_id", "_part", "step"])


def _ends(group: pd.DataFrame) -> pd.DataFrame:
    """Costs after every segment of a conversation, from the last one back; a few numbers per segment."""
    group = group.sort_values("_part", ascending=False)
    after, ends = END, []
    for step in group["step"]:
        ends.append([float(x) for x in after])
        after = through(np.reshape(step, (STATES, STATES)).tolist(), after)
    return group[["conv_id", "_part"]].assign(end=ends, last=[i == 0 for i in range(len(group))])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a segment from each state before it."""
    for batch in batches:
        found = []
        for codes, end, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "end", "last")), strict=True):
            walks = [walk(codes, end, state, last) for state in range(STATES)]
            found.append([after for _, _, after, _ in walks])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("_part"), pa.array(found, pa.list_(pa.int32()))], ["conv_id", "_part", "exits"])


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("_part")
    state, states = NOTHING, []
    for exits in group["exits"]:
        states.append(state)
        state = int(exits[state])
    return group[["conv_id", "_part"]].assign(state=states)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for codes, end, state, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "end", "state", "last")), strict=True):
            out.append(walk(codes, end or END, state or NOTHING, last is not False))
        audits, roles, _, costs = zip(*out, strict=True) if out else [()] * 4
        made = [pa.array(audits, pa.string()), pa.array(roles, pa.string()), pa.array([int(c) for c in costs], pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "_part", "places")), *made], ["conv_id", "_part", "places", "audit", "roles", "cost"])


def edits(cut: DataFrame) -> DataFrame:
    """`(conv_id, _part, places, audit, roles, cost)` of every segment, as a written table. The cost is
    that of all edits from the segment on."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    cut = cut.select("conv_id", "_part", "codes", "places", "alone")
    long = cut.where(~F.col("alone"))
    keys = [F.col("conv_id").eqNullSafe(F.col("_conv")), F.col("_part") == F.col("_p")]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.withColumnsRenamed({"conv_id": "_conv", "_part": "_p"}), keys, "left").drop("_conv", "_p")

    steps = long.select("conv_id", "_part", "codes").mapInArrow(_steps, f"conv_id {kind}, _part long, step array<double>")
    ends = written(steps.groupBy("conv_id").applyInPandas(_ends, f"conv_id {kind}, _part long, end array<double>, last boolean"), "borders")
    exits = joined(long, ends).select("conv_id", "_part", "codes", "end", "last").mapInArrow(_exits, f"conv_id {kind}, _part long, exits array<int>")
    entries = written(exits.groupBy("conv_id").applyInPandas(_entries, f"conv_id {kind}, _part long, state int"), "entries")
    every = joined(joined(cut, ends), entries).select("conv_id", "_part", "codes", "places", "end", "last", "state")
    return written(every.mapInArrow(_edits, f"conv_id {kind}, _part long, places array<long>, audit string, roles string, cost long"), "edits")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the repaired conversation: those kept, and those put in before or after a row."""
    for batch in batches:
        source, at, sub, edit, role = [], [], [], [], []
        for i, (places, audit, roles) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("places", "audit", "roles")), strict=True)):
            row = put_in = 0
            for e, r in zip(audit, roles, strict=True):
                if e == "I":
                    put_in += 1
                    behind = row == len(places)
                    at.append(places[row - behind])
                    sub.append(put_in if behind else put_in - 100)
                elif e != "D":
                    at.append(places[row])
                    sub.append(0)
                if e != "D":
                    source.append(i)
                    edit.append(e)
                    role.append(ROLE[r])
                if e != "I":
                    row, put_in = row + 1, 0
        made = [pa.array(at, pa.int64()), pa.array(sub, pa.int32()), pa.array(edit, pa.string()), pa.array(role, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(source, pa.int64())), *made], ["conv_id", "_at", "_sub", "edit", "_role"])


def repaired(placed: DataFrame, changes: DataFrame) -> DataFrame:
    """`(conv_id, _at, _sub, edit, turn, role, text)`, in the order of conversation, `_at` and `_sub`."""
    kind = placed.schema["conv_id"].dataType.simpleString()
    rows = changes.select("conv_id", "places", "audit", "roles").mapInArrow(_placed, f"conv_id {kind}, _at long, _sub int, edit string, _role string")
    rows = rows.join(placed.select("_at", "turn", "role", "text"), "_at")
    put_in = F.col("edit") == "I"
    return rows.select(
        "conv_id", "_at", "_sub", "edit", F.when(~put_in, F.col("turn")).alias("turn"), F.coalesce("_role", "role").alias("role"),
        F.when(put_in, "").otherwise(F.col("text")).alias("text"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per conversation from rows that come in order; nothing but its state is kept."""
    names, current, digest, started = ["conv_id", "repaired_sha256"], None, None, False
    for batch in batches:
        ids, out = batch.column("conv_id"), []
        for i, (conv, line) in enumerate(zip(ids.to_pylist(), batch.column("line"), strict=True)):
            if not started or conv != current:
                if started:
                    out.append((current, digest.hexdigest()))
                current, digest, started = conv, hashlib.sha256(), True
            else:
                digest.update(b"\n")
            digest.update(line.as_py().encode())
        columns = zip(*out, strict=True) if out else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (ids.type, pa.string()), strict=True)], names)
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([current], ids.type), pa.array([digest.hexdigest()])], names)


def digests(rows: DataFrame) -> DataFrame:
    """`(conv_id, repaired_sha256)` of repaired rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    lines = rows.select("conv_id", "_at", "_sub", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "_at", "_sub").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


# --- results --------------------------------------------------------------------------------


def _counts(judged: DataFrame, cut: DataFrame) -> DataFrame:
    """`(conv_id, gaps, blank, duplicate, truncated, illegal)`."""
    kinds = ["blank", "duplicate", "truncated"]
    by_turn = judged.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")
    sums = by_turn.groupBy("conv_id").agg(F.coalesce(span.try_cast("long"), F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in kinds])
    # Pairs across the border of two segments.
    before = F.lag("_tail").over(Window.partitionBy("conv_id").orderBy("_part"))
    across = F.when(~F.concat(before, F.col("_head")).isin("su", "ua", "au"), 1).otherwise(0)
    illegal = cut.select("conv_id", (F.col("illegal") + across).alias("illegal")).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    return sums.join(illegal.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def repair(df: DataFrame, damaged: bool = True, **ranges: int) -> DataFrame:
    """`(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)` of every conversation."""
    df = df.select("conv_id", "turn", "role", "text")
    placed = ordered(damage(df) if damaged else df, **ranges)
    judged = written(faults(placed), "judged")
    cut = segments(judged)
    changes = edits(cut)
    parts = F.array_sort(F.collect_list(F.struct("_part", "audit")))
    audits = changes.groupBy("conv_id").agg(
        F.min_by("cost", "_part").alias("cost"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit")
    )
    out = df.select("conv_id").distinct()
    for more in (_counts(judged, cut), audits, digests(repaired(placed, changes))):
        out = out.join(more.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
