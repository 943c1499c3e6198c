"""Minimum-cost repair of conversation roles, and rendering.

Legal turns are an automaton: an optional system turn, then user and assistant by turns, ending with the assistant. Each
given turn is kept, relabelled, or merged into the turn before it, and empty turns may be inserted. The cheapest choice
is a shortest path; a turn is a small matrix of costs from state to state, and matrices combine by (min, +). So a long
conversation is cut into blocks of turns: blocks combine their turns' matrices where they lie, only the blocks' matrices
of a conversation come together to fix the state at each border, and each block is then solved on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.llm.common import materialize, pieces

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 3, 1, 4
BLOCK_TURNS = 4096
#: Turns to insert on the way from a state to a turn of each role; none leads from a later state back to the system turn.
_BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
_AT_END: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
NEVER = 1 << 40


def role_number(role: str | None) -> int:
    """1 to 3, or 0 for a role that isn't known."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def choices(role: int, state: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, new state, action, inserted) of each way to take a turn, best first for each new state."""
    out = []
    for new in (SYSTEM, USER, ASSISTANT):
        change = 0 if new == role else RELABEL_UNKNOWN if role == 0 else RELABEL
        kind = "keep" if new == role else "relabel"
        ways = []
        if new == state:
            ways.append((change + MERGE, new, "merge" if new == role else "relabel_merge", ()))
        if (state, new) in _BETWEEN:
            inserted = _BETWEEN[state, new]
            ways.append((change + INSERT * len(inserted), new, kind, inserted))
        if ways:
            out.append(min(ways, key=lambda w: w[0]))
    return out


CHOICES = [[choices(role, state) for state in range(4)] for role in range(4)]
MATRICES = np.full((4, 4, 4), NEVER, np.int64)
for _role in range(4):
    for _state in range(4):
        for _cost, _new, _, _ in CHOICES[_role][_state]:
            MATRICES[_role, _state, _new] = _cost
END_COST = np.array([INSERT * len(_AT_END[s]) for s in range(4)], np.int64)


def product(roles: Iterable[int]) -> np.ndarray:
    """The (min, +) product of the turns' matrices."""
    out = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for r in roles:
        out = np.minimum((out[:, :, None] + MATRICES[r][None]).min(axis=1), NEVER)
    return out


def solve(roles: list[int], entry: int, leave: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, action, inserted before) for each turn on a cheapest way from state ``entry`` to ``leave``; ties go to the lower state."""
    costs = [NEVER] * 4
    costs[entry] = 0
    back: list[list[tuple[int, str, tuple[int, ...]] | None]] = []
    for r in roles:
        new_costs: list[int] = [NEVER] * 4
        came: list[tuple[int, str, tuple[int, ...]] | None] = [None] * 4
        for state in range(4):
            if costs[state] >= NEVER:
                continue
            for cost, new, action, inserted in CHOICES[r][state]:
                if costs[state] + cost < new_costs[new]:
                    new_costs[new], came[new] = costs[state] + cost, (state, action, inserted)
        costs = new_costs
        back.append(came)
    out, state = [], leave
    for came in reversed(back):
        before, action, inserted = came[state]
        out.append((state, action, inserted))
        state = before
    return out[::-1]


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The state before each block and after the last, on a cheapest way to a legal end."""
    forward = [np.array([0, NEVER, NEVER, NEVER])]
    for m in matrices:
        forward.append(np.minimum((forward[-1][:, None] + m).min(axis=0), NEVER))
    states = [int(np.argmin(forward[-1] + END_COST))]
    for f, m in zip(reversed(forward[:-1]), reversed(matrices), strict=True):
        states.append(int(np.argmin(f + m[:, states[-1]])))
    return states[::-1]


OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def empty(role: int) -> str:
    return OPEN.format(ROLES[role]) + CLOSE


def render(text: str, role: int, action: str, inserted: tuple[int, ...], first: bool, last: bool) -> str:
    """A turn's part of the rendered conversation. Parts in order are the whole: a turn is closed by what follows it."""
    out = "\n" + text if action.endswith("merge") else ("" if first else CLOSE) + "".join(map(empty, inserted)) + OPEN.format(ROLES[role]) + text
    return out + CLOSE + "".join(map(empty, _AT_END[role])) if last else out


def repair(conversations: DataFrame) -> DataFrame:
    """Per turn of ``conversations`` (conv_id, turn, role, text), in a row each: conv_id, turn, position, role, role_out,
    action (keep, relabel, merge, relabel_merge), inserted (roles of empty turns before it) and piece.

    A conversation's pieces in the order of ``position`` are its rendered text; it stays in rows as a conversation may
    be larger than a task's memory. Turns are ordered by turn (null first), role and text; null roles are unknown; null
    texts are empty; rows without a conv_id are one conversation. A conv_id may be of any type. Ranges are cut between
    conversations and turns, so no text is sampled for their bounds; equal turns lie in one range and are sorted there.
    """
    id_kind = conversations.schema["conv_id"].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    given = conversations.select(key.alias("k"), "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    by = ["k", F.col("turn").asc_nulls_first()]
    order = [*by, F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    kind = f"k string, conv_id {id_kind}, turn bigint, role string, text string, part int, block int, at int, matrix array<bigint>"
    names = ["k", "conv_id", "turn", "role", "text"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, block, at = TaskContext.get().partitionId(), None, 0, 0
        held: list[pa.RecordBatch] = []
        roles: list[int] = []

        def flush() -> pa.RecordBatch:
            n = len(roles)
            table = pa.Table.from_batches(held).combine_chunks()
            matrix = [product(roles).ravel().tolist()] + [None] * (n - 1)
            cols = [table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0) for c in names]
            return pa.RecordBatch.from_arrays([*cols, pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(matrix, pa.list_(pa.int64()))], names=[*names, "part", "block", "at", "matrix"])

        for batch in batches:
            keys, given_roles, start = batch.column("k").to_pylist(), batch.column("role").to_pylist(), 0
            for i, (k, r) in enumerate(zip(keys, given_roles, strict=True)):
                if k != last and last is not None or at >= BLOCK_TURNS:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if roles:
                        yield flush()
                    held, roles, start, at = [], [], i, 0
                    block = block + 1 if k == last else 0
                last = k
                roles.append(role_number(r))
                at += 1
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if roles:
            yield flush()

    def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a conversation's blocks in order, to the states at their borders."""
        held: list[tuple[str, int, int, list[int]]] = []

        def settle() -> pa.RecordBatch:
            states = borders([np.array(m, np.int64).reshape(4, 4) for *_, m in held])
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held]), pa.array([h[1] for h in held], pa.int32()), pa.array([h[2] for h in held], pa.int32()), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()), pa.array([i == n - 1 for i in range(n)])],
                names=["k", "part", "block", "entry", "leave", "final"],
            )

        for piece in pieces(batches, 1024):
            for row in zip(*(piece.column(c).to_pylist() for c in ("k", "part", "block", "matrix")), strict=True):
                if held and held[0][0] != row[0]:
                    yield settle()
                    held.clear()
                held.append(row)
        if held:
            yield settle()

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        id_type = pa.null()

        def settle() -> pa.RecordBatch:
            h = held[0]
            way = solve([role_number(r["role"]) for r in held], h["entry"], h["leave"])
            out: dict[str, list] = {c: [] for c in ("conv_id", "turn", "position", "role", "role_out", "action", "inserted", "piece")}
            for i, (r, (role, action, inserted)) in enumerate(zip(held, way, strict=True)):
                first, last = i == 0 and h["entry"] == START, i == len(held) - 1 and h["final"]
                values = (r["conv_id"], r["turn"], (r["part"] << 40) + (r["block"] << 13) + r["at"], r["role"], ROLES[role], action, [ROLES[x] for x in inserted], render(r["text"] or "", role, action, inserted, first, last))
                for column, v in zip(out.values(), values, strict=True):
                    column.append(v)
            kinds = (id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

        for piece in pieces(batches, 1024):
            id_type = piece.schema.field("conv_id").type
            for row in piece.to_pylist():
                if held and (held[0]["k"], held[0]["part"], held[0]["block"]) != (row["k"], row["part"], row["block"]):
                    yield settle()
                    held.clear()
                held.append(row)
        if held:
            yield settle()

    turns = materialize(given.repartitionByRange(*by).sortWithinPartitions(*order).mapInArrow(cut, kind), "turns")
    blocks = turns.filter("matrix is not null").select("k", "part", "block", "matrix").repartition("k").sortWithinPartitions("k", "part", "block")
    states = blocks.mapInArrow(plan, "k string, part int, block int, entry int, leave int, final boolean")
    rows = turns.drop("matrix").join(states, ["k", "part", "block"]).repartition("k", "part", "block").sortWithinPartitions("k", "part", "block", "at")
    return rows.mapInArrow(finish, f"conv_id {id_kind}, turn bigint, position bigint, role string, role_out string, action string, inserted array<string>, piece string")
