"""Chat formatting with minimum-cost role repair.

The legal sequences are: at most one system turn, first; then user and assistant in turn, from user to
assistant. For every turn dynamic programming over the automaton of the last role chooses, at least
total cost: keep it, MERGE it into the turn before of its role, RELABEL it (also before a merge), or INSERT
one empty turn ahead of it; at the end empty turns complete the sequence. Of the repairs of least cost that one is
taken whose options, compared from the first turn on, come first in ``_options``.

Turns are range-partitioned by conversation and turn, so a conversation of any length lies over many tasks. A turn's
place in its conversation is its place in the partition plus the turns in partitions before, which only the
conversations that lie over several partitions need; every ``BLOCK`` places form a block. A block's costs between all
pairs of automaton states form a small matrix, with the order of the ways from each state. The matrices of a
conversation (one for every ``BLOCK`` turns) are chained to give each block its states at both ends, and each block
is then repaired by itself. Order decides between ways of equal cost in the matrices, the chain and the blocks
alike, so the result does not depend on blocks or partitions.

The result has a row for each turn and for each insertion, in the order of (conv_id, block, seq); the pieces of a
conversation, joined in this order, are its rendered text: a header line for a new turn, then
the text and a line feed. No conversation is ever gathered into one row.

Edge cases: null or unknown roles cost a relabel; null texts are empty; turns are ordered by turn (nulls first),
role and text, and repeated rows stay as turns of their own; rows with a null conv_id form one
conversation; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.common import column, stored

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
BLOCK = 1024
BROADCAST_ROWS = 100_000
_START, _FINAL = 3, 2
#: Roles that may follow a state; states are the last role, or 3 before the first turn.
_NEXT = {_START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
_FAR = 1 << 40


def _options(state: int, role: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(cost, action, new roles) of taking a turn of ``role`` (-1: none known) after ``state``; no new
    roles for a merge; the last new role is the turn's own."""
    out = [(0 if x == role else RELABEL, "keep" if x == role else "relabel", (x,)) for x in _NEXT[state]]
    if state != _START:
        out.append((MERGE + (0 if state == role else RELABEL), "merge" if state == role else "relabel+merge", ()))
    for y in _NEXT[state]:
        out += [(INSERT + (0 if x == role else RELABEL), "keep" if x == role else "relabel", (y, x)) for x in _NEXT[y]]
    return sorted(out, key=lambda o: o[0])


#: For each role (-1 as 3) and state: the best option for each following state, and its place in the list.
_STEPS = [[{} for _ in range(4)] for _ in range(4)]
_COSTS = np.full((4, 4, 4), _FAR, np.int64)
_PLACES = np.zeros((4, 4, 4), np.int64)
for _role in range(4):
    for _state in range(4):
        for _place, _option in enumerate(_options(_state, _role if _role < 3 else -1)):
            _to = _option[2][-1] if _option[2] else _state
            if _to not in _STEPS[_role][_state]:
                _STEPS[_role][_state][_to] = _option
                _COSTS[_role, _state, _to], _PLACES[_role, _state, _to] = _option[0], _place


def ending(state: int) -> tuple[int, ...]:
    """Empty turns that complete a sequence ending in ``state``; none for one without turns."""
    return {0: (1, 2), 1: (2,)}.get(state, ())


class Ways:
    """Of each of some starts the best way to each state: its cost, and its order among those of the start."""

    def __init__(self, cost: np.ndarray, order: np.ndarray):
        self.cost, self.order = cost, order

    @classmethod
    def none(cls) -> Ways:
        """From each state to itself, without a turn."""
        return cls(np.where(np.eye(4, dtype=bool), 0, _FAR), np.where(np.eye(4, dtype=bool), 0, 1 + np.arange(4)[None]))

    def then(self, cost: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Go on by steps (source, target); returns the source of the way to each target, by start."""
        total = np.minimum(self.cost[:, :, None] + cost[None], _FAR)
        source = (total * 16 + self.order[:, :, None]).argmin(axis=1)
        starts, targets = np.arange(len(source))[:, None], np.arange(4)[None]
        self.cost = total[starts, source, targets]
        key = self.order[starts, source] * 64 + order[source, targets] * 4 + targets + (self.cost >= _FAR) * 4096
        self.order = key.argsort(axis=1).argsort(axis=1)
        return source


def chained(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states before and after each block on the best way through all."""
    ways = Ways(np.array([[_FAR, _FAR, _FAR, 0]]), np.array([[1, 2, 3, 0]]))
    back = [ways.then(m[0], m[1])[0] for m in matrices]
    final = ways.cost[0] + np.array([INSERT * len(ending(s)) for s in range(4)])
    state = int((final * 16 + ways.order[0]).argmin())
    out = []
    for choice in reversed(back):
        before = int(choice[state])
        out.append((before, state))
        state = before
    return out[::-1]


def block_matrix(roles: list[int]) -> np.ndarray:
    """Costs and orders of the best ways between all states."""
    ways = Ways.none()
    for role in roles:
        ways.then(_COSTS[role], _PLACES[role])
    return np.stack([ways.cost, ways.order])


def repaired(roles: list[int], before: int, after: int) -> list[tuple[str, tuple[int, ...], int]]:
    """(action, new roles, role of the turn) for each turn on the best way between the states."""
    start = Ways.none()
    ways = Ways(start.cost[before : before + 1], start.order[before : before + 1])
    back = [ways.then(_COSTS[role], _PLACES[role])[0] for role in roles]
    out, state = [], after
    for role, choice in zip(reversed(roles), reversed(back), strict=True):
        source = int(choice[state])
        _, action, new = _STEPS[role][source][state]
        out.append((action, new, state))
        state = source
    return out[::-1]


def _number(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else 3


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, seq, turn, role, action, piece); turn is null for an insertion."""
    text = F.coalesce(column("text").cast("string"), F.lit(""))
    rows = turns.select(column("conv_id").cast("bigint").alias("conv_id"), column("turn").cast("bigint").alias("turn"), F.lower(F.trim(column("role").cast("string"))).alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place = object(), 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                conv, place = c, place + 1 if c == conv else 0
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    numbered = stored(ranged.mapInArrow(number, "conv_id bigint, turn bigint, role string, text string, part int, place bigint"), "chat")
    parts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = stored(parts.withColumn("ahead", ahead).filter("ahead IS NOT NULL").select(F.col("conv_id").alias("of"), F.col("part").alias("at"), "ahead"), "chat-ahead")
    if ahead.count() <= BROADCAST_ROWS:  # a row for each partition that goes on with a conversation
        ahead = F.broadcast(ahead)
    placed = numbered.join(ahead, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")), "left")
    place = F.col("place") + F.coalesce("ahead", F.lit(0))
    placed = placed.select("conv_id", "turn", "role", "text", F.floor(place / block).cast("bigint").alias("block"), (place % block).cast("int").alias("place"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, roles = None, []
        for batch in batches:
            out = []
            for c, b, role in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (c, b) != key:
                    if roles:
                        out.append((*key, block_matrix(roles).ravel().tolist()))
                    key, roles = (c, b), []
                roles.append(_number(role))
            if out:
                yield of_blocks(out)
        if roles:
            yield of_blocks([(*key, block_matrix(roles).ravel().tolist())])

    def of_blocks(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["conv_id", "block", "matrix"])

    roles = placed.select("conv_id", "block", "role", "place").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").drop("place")
    blocks = roles.mapInArrow(matrices, "conv_id bigint, block bigint, matrix array<bigint>")
    chains = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("chain"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, chain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                states = chained([np.array(x["matrix"]).reshape(2, 4, 4) for x in chain])
                out += [(conv, x["block"], s, t, x is chain[-1]) for x, (s, t) in zip(chain, states, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["of", "number", "before", "after", "last"])

    states = chains.mapInArrow(solve, "of bigint, number bigint, before int, after int, last boolean")
    both = placed.join(states, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("number"))).drop("of", "number")
    dealt = both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv_id"], row["block"]) != (held[0]["conv_id"], held[0]["block"]):
                    out += written(held)
                    held = []
                held.append(row)
                if len(out) >= 5000:
                    yield batched(out)
                    out = []
        if held:
            out += written(held)
        if out:
            yield batched(out)

    def written(held: list[dict]) -> list[tuple]:
        out: list[tuple] = []

        def add(turn, role: int, action: str, piece: str) -> None:
            out.append((held[0]["conv_id"], held[0]["block"], len(out), turn, ROLES[role], action, piece))

        for row, (action, new, role) in zip(held, repaired([_number(r["role"]) for r in held], held[0]["before"], held[0]["after"]), strict=True):
            for y in new[:-1]:
                add(None, y, "insert", f"<|{ROLES[y]}|>\n\n")
            add(row["turn"], role, action, (f"<|{ROLES[role]}|>\n" if new else "") + row["text"] + "\n")
        for y in ending(held[0]["after"]) if held[0]["last"] else ():
            add(None, y, "insert", f"<|{ROLES[y]}|>\n\n")
        return out

    def batched(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "block", "seq", "turn", "role", "action", "piece"])

    return dealt.mapInArrow(write, "conv_id bigint, block bigint, seq int, turn bigint, role string, action string, piece string")
