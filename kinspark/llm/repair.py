"""Structure repair of conversations: faults, the cheapest edits, and the least edit string among equals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinspark.session import through_table

# Rows of a conversation that one step of a task works on; longer ones are cut into blocks of so many.
BLOCK_ROWS = 4096
CHUNK_ROWS = 1 << 16
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
# States: nothing yet, after a system turn, after a user turn, after an assistant turn; a
# conversation may end in the first and the last.
STATES = 4
_NEXT = np.array([2, 2, 3, 2])
_FAR = np.int64(1 << 50)
_AT_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_CLOSING = [("", ""), ("II", "23"), ("I", "3"), ("", "")]
_LETTERS = "DIKR"
_SPACED = "[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Repair:
    """``report``: a row per conversation; ``edits``: a row per edit; ``turns``: the repaired conversations."""

    report: DataFrame
    edits: DataFrame
    turns: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of their key: dropped, emptied, without stops, repeated, or role user.

    Nulls count as one space in the key, the role and the text; ``conv_id`` and ``turn`` stay as they are.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    roll = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    text = F.when(roll == 1, "").when(roll == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    times = F.when(roll == 0, 0).when(roll == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(roll == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_"))
    return rows.drop("_")


def faulty_turns(rows: DataFrame) -> DataFrame:
    """Rows with their place ``seq`` in the conversation, their first ``fault`` and whether their roles' order is ``illegal``.

    Rows go by turn (null first), then role and text. ``conv`` names the conversation as text, one space for null.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(spaced("conv_id").alias("conv"), "turn", spaced("role").alias("role"), spaced("text").alias("text"))
    by_turn = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("seq", F.row_number().over(by_turn).cast("long"))
    again = F.row_number().over(W.partitionBy("conv", "role", "text").orderBy("seq")) > 1
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(W.partitionBy("conv").orderBy("seq"))
    last = F.regexp_extract("text", f"({_SPACED})[\\x20\\x09-\\x0D]*\\z", 1)
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    rows = rows.withColumns({"again": again, "before": before})
    illegal = F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    return rows.select("conv", "seq", "turn", "role", "text", fault.alias("fault"), illegal.alias("illegal"))


def coded_blocks(turns: DataFrame, block_rows: int) -> DataFrame:
    """``conv``, ``block`` and a letter per row: role's initial (s, u, a or another) and what its fault asks for."""
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int"), F.lit(0))
    weight = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    letter = F.char(65 + 4 * weight + kind)
    block = ((F.col("seq") - 1) / block_rows).cast("long")
    rows = turns.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", letter.alias("letter")))).alias("rows"))
    return rows.select("conv", "block", F.array_join("rows.letter", "").alias("codes"))


# --- one block: costs, arcs, ranks -----------------------------------------------------------------


def _padded(codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in codes])
    table = np.full((len(codes), lengths.max(initial=0)), -1, np.int8)
    for row, c in zip(table, codes):
        row[: len(c)] = np.frombuffer(c.encode(), np.uint8) - 65
    return table, lengths


def _row_arcs(code: np.ndarray, later: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cost and next state of deleting, keeping and changing the role of a row, from every state, before cost ``later``."""
    kind, weight = code % 4, code // 4
    more = np.where(weight == 2, _FAR, np.where(weight == 1, TRUNCATED, 0))[:, None]
    state = np.broadcast_to(np.arange(STATES), (len(code), STATES))
    kept = np.broadcast_to(kind[:, None], state.shape)
    fits = (kept == _NEXT[state]) | ((kept == 1) & (state == 0))
    turned = np.broadcast_to(_NEXT, state.shape)
    reach = lambda to: np.take_along_axis(later, to, 1)
    return [(DELETE + later, state), (np.where(fits, more + reach(kept), _FAR), kept), (REROLE + more + reach(turned), turned)]


def sweep(codes: list[str], ends: np.ndarray) -> np.ndarray:
    """Least cost from every row's front (and the end, on axis 1) and state to the end, where ``ends`` are the costs."""
    table, lengths = _padded(codes)
    n, width = table.shape
    costs = np.empty((n, width + 1, STATES), np.int64)
    costs[:, width] = ends
    for i in range(width - 1, -1, -1):
        later = costs[:, i + 1]
        best = np.minimum.reduce([c for c, _ in _row_arcs(np.maximum(table[:, i], 0), later)])
        for _ in range(2):
            best = np.minimum(best, INSERT + best[:, _NEXT])
        costs[:, i] = np.where((i < lengths)[:, None], np.minimum(best, _FAR), ends)
    return costs


def least_paths(codes: list[str], ends: np.ndarray) -> tuple[list[list[tuple[str, str]]], np.ndarray]:
    """For every block and entry state the ASCII-least of its cheapest edit strings, with the states they lead to, and the exit states.

    Nodes are the fronts of rows in each state; arcs are the edits of cheapest paths. Nodes
    are ranked by their least edit strings of 1, 2, 4... letters: a rank of twice the length
    orders pairs of ranks, the node's own and that of the node its pointer of this length
    leads to, and pointers double likewise. The ranks then choose among the arcs of a node, and
    the path is read off the doubled pointers, from both ends of every stretch at once.
    """
    table, lengths = _padded(codes)
    n, width = table.shape
    costs = sweep(codes, ends)
    size = (width + 1) * STATES
    node = np.arange(n * size).reshape(n, width + 1, STATES)
    final = np.arange(width + 1)[None, :] == lengths[:, None]
    arcs = [np.full((n, width + 1, STATES), -1, np.int64) for _ in _LETTERS]
    arcs[1] = np.where(~final[:, :, None] & (np.arange(width + 1)[None, :, None] < lengths[:, None, None]) & (costs == INSERT + costs[:, :, _NEXT]), node[:, :, _NEXT], -1)
    for i in range(width):
        for k, (cost, to) in zip((0, 2, 3), _row_arcs(np.maximum(table[:, i], 0), costs[:, i + 1])):
            good = (i < lengths)[:, None] & (cost == costs[:, i]) & (cost < _FAR)
            arcs[k][:, i] = np.where(good, np.take_along_axis(node[:, i + 1], to, 1), -1)
    choices = np.stack([a.reshape(-1) for a in arcs])
    has = choices >= 0
    letter = np.where(has.any(0), has.argmax(0), -1)
    self_ = np.arange(n * size)
    step = np.where(letter >= 0, np.take_along_axis(choices, np.maximum(letter, 0)[None], 0)[0], self_)
    rank, pointers = letter + 1, [step]
    while True:
        pair = rank.astype(np.int64) * (rank.max(initial=0) + 1) + rank[pointers[-1]]
        rank = np.unique(pair, return_inverse=True)[1]
        if np.array_equal(pointers[-1], pointers[-1][step]):
            break
        pointers.append(pointers[-1][pointers[-1]])
    # The least arc by its letter, then by the rank of what follows.
    order = np.where(has, np.arange(len(_LETTERS))[:, None] * (len(rank) + 1) + rank[np.maximum(choices, 0)], np.iinfo(np.int64).max)
    chosen = np.where(has.any(0), order.argmin(0), -1)
    step = np.where(chosen >= 0, np.take_along_axis(choices, np.maximum(chosen, 0)[None], 0)[0], self_)
    path = node[:, 0].reshape(-1, 1)
    for jump in reversed(pointers):
        path = np.stack([path, jump[path]], -1).reshape(len(path), -1)
    exits = (step[path[:, -1]] % STATES).reshape(n, STATES)
    letters = np.frombuffer(_LETTERS.encode(), np.uint8)
    found = []
    for row in path:
        row = row[chosen[row] >= 0]
        found.append((letters[chosen[row]].tobytes().decode(), (step[row] % STATES + 48).astype(np.uint8).tobytes().decode()))
    return [found[k : k + STATES] for k in range(0, len(found), STATES)], exits


def _chunks(lengths: list[int]) -> Iterator[np.ndarray]:
    """Rows of a batch in pieces of like length, so that padding and paths stay small."""
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (lengths[order[end]] + 1) <= CHUNK_ROWS:
            end += 1
        yield order[at:end]
        at = end


# --- tasks ------------------------------------------------------------------------------------------


def _crossing_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block the least cost from each entry to each exit state."""
    far = np.full((STATES, STATES), _FAR, np.int64)
    np.fill_diagonal(far, 0)
    for batch in batches:
        codes = batch.column(2).to_pylist()
        found = np.empty((len(codes), STATES, STATES), np.int64)
        for part in _chunks([len(c) for c in codes]):
            some = [codes[k] for k in part]
            for out in range(STATES):
                found[part, :, out] = sweep(some, np.broadcast_to(far[out], (len(some), STATES)))[:, 0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found.reshape(-1, STATES * STATES)), pa.list_(pa.int64()))], ["conv", "block", "codes", "crossing"])


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's last block to its first: the costs behind the block and before it."""
    conv, costs = None, _AT_END
    for batch in batches:
        behind, before = [], []
        for name, crossing in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if name != conv:
                conv, costs = name, _AT_END
            behind.append(costs.tolist())
            costs = np.minimum((np.array(crossing).reshape(STATES, STATES) + costs).min(1), _FAR)
            before.append(int(costs[0]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(behind, pa.list_(pa.int64())), pa.array(before, pa.int64())], ["conv", "block", "codes", "ends", "cost"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least path of every block from each entry state; from the first block only the start counts."""
    for batch in batches:
        blocks, codes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        ends = np.array(batch.column(3).to_pylist(), np.int64).reshape(-1, STATES)
        audits, exits = [None] * len(codes), [None] * len(codes)
        for part in _chunks([len(c) for c in codes]):
            paths, out = least_paths([codes[k] for k in part], ends[part])
            for k, found, leads in zip(part, paths, out.tolist()):
                audits[k] = [f"{a}/{b}" for a, b in (found if blocks[k] else found[:1])]
                exits[k] = leads
        arrays = [batch.column(0), batch.column(1), batch.column(4), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["conv", "block", "cost", "audits", "exits"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's first block to its last: the path from the state in which the one before ended."""
    pending, state, at = None, 0, 0
    names = ["conv", "block", "cost", "first", "audit", "states"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def closed(row: list, end: int) -> list:
        return [*row[:4], row[4] + _CLOSING[end][0], row[5] + _CLOSING[end][1]]

    for batch in batches:
        done = []
        for conv, block, cost, audits, exits in zip(*(c.to_pylist() for c in batch.columns)):
            if pending is not None and pending[0] == conv:
                done.append(pending)
            else:
                if pending is not None:
                    done.append(closed(pending, state))
                state, at = 0, 0
            audit, states = audits[state].split("/")
            pending = [conv, block, cost if block == 0 else 0, at, audit, states]
            state, at = exits[state], at + len(audit)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
    if pending is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(closed(pending, state), kinds)], names)


def _edit_rows(block_rows: int):
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, block, first, audit, states in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))):
                if audit:
                    letters = np.frombuffer(audit.encode(), np.uint8)
                    taken = letters != ord("I")
                    seq = np.where(taken, block * block_rows + np.cumsum(taken), 0)
                    roles = [{"2": "user", "3": "assistant"}[s] if x in "IR" else None for x, s in zip(audit, states)]
                    arrays = [pa.array([conv] * len(audit), pa.string()), pa.array(first + np.arange(len(audit)), pa.int64()), pa.array(seq, pa.int64(), mask=~taken), pa.array(list(audit), pa.string()), pa.array(roles, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["conv", "pos", "seq", "edit", "new_role"])

    return exploded


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Repair:
    """The cheapest edits that give every conversation the roles of ``(s?(ua)+)?``, by initials.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``. Keeping a row costs 0, changing its role to user
    or assistant 3, deleting it 4, inserting an empty turn anywhere 3; blank and duplicate rows must
    go; truncated rows that stay add 3. ``report``: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost`` and ``audit``, the letters K, R, D and I of the edits in order, ASCII-least among the cheapest. ``edits``: ``conv``,
    ``pos``, ``seq`` (the row's place, null for inserts), ``edit``, ``new_role``. ``turns``: ``conv``, ``pos``, ``role``, ``text``.

    Nulls count as one space (a turn as null), so a null text is blank and a null role never
    kept; rows alike are duplicates. A role of no letter is of no kind. A conversation is cut into blocks of ``block_rows``
    rows, so one with a third of all rows takes no more memory than others: blocks give costs
    from entry to exit states, a pass over blocks back and one forth join them. It is sorted and passed through
    in one task, and its ``audit`` is one string, as the result asks for. No rows, no conversations.
    """
    turns = through_table(faulty_turns(rows), "turns")
    count = lambda condition: F.count(F.when(condition, 1))
    distinct = turns.select("conv", "turn").distinct().groupBy("conv").agg(F.count("turn").alias("_distinct"), F.max("turn").alias("_max"), F.min("turn").alias("_min"))
    gaps = F.coalesce(F.col("_max") - F.col("_min") + 1 - F.col("_distinct"), F.lit(0)).cast("long")
    faults = turns.groupBy("conv").agg(*(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(F.col("illegal")).alias("illegal"))
    blocks = coded_blocks(turns, block_rows).mapInArrow(_crossing_costs, "conv string, block long, codes string, crossing array<long>")
    back = blocks.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    ends = back.mapInArrow(_costs_behind, "conv string, block long, codes string, ends array<long>, cost long")
    forth = ends.mapInArrow(_audits, "conv string, block long, cost long, audits array<string>, exits array<int>").sortWithinPartitions("conv", "block")
    chosen = through_table(forth.mapInArrow(_chosen, "conv string, block long, cost long, first long, audit string, states string"), "audits")
    audits = chosen.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("audit"))
    report = faults.join(distinct, "conv").join(audits, "conv").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = chosen.mapInArrow(_edit_rows(block_rows), "conv string, pos long, seq long, edit string, new_role string")
    texts = turns.select("conv", "seq", "role", "text")
    repaired = edits.where("edit <> 'D'").join(texts, ["conv", "seq"], "left")
    repaired = repaired.select("conv", "pos", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return Repair(report, edits, repaired)
