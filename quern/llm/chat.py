"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, ending with the assistant. Turns keep their order and text; each
may keep its role, be relabelled, or be merged into the turn before, and empty turns may be
inserted. The cheapest repair is found by dynamic programming over the automaton.

One step of it is a 4 x 4 matrix over (min, +), so stretches of a conversation
combine: rows are dealt by ranges of (conv_id, turn), each partition finds the
matrices of the conversations that its ends cut, the driver combines those (two
for each partition at most), and each partition then traces its rows back from
known states. A conversation with a third of all rows is thus spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.shared import shared_dir

ROLES = ("system", "user", "assistant")
#: Other names of the roles; what is in neither is unknown.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}
MERGE, RELABEL, NAME, INSERT = 2, 3, 1, 4  # costs; NAME is for giving an unknown role a name
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: (_SYSTEM, _USER), _SYSTEM: (_USER,), _USER: (_ASSISTANT,), _ASSISTANT: (_USER,)}
_FAR = 1 << 40


def _insertions() -> list[list[tuple[int, ...] | None]]:
    """The shortest runs of empty turns that lead from a state to another."""
    out: list[list[tuple[int, ...] | None]] = [[None] * 4 for _ in range(4)]
    for s in range(4):
        front = [(s, ())]
        for t, path in front:
            if out[s][t] is None:
                out[s][t] = path
                front += [(u, (*path, u)) for u in _NEXT[t]]
    return out


_INSERT = _insertions()


def _steps() -> list[list[list[tuple[int, str, int] | None]]]:
    """By role (3: unknown), from, to: the cheapest (cost, action, state that inserted turns lead to)."""
    out = []
    for role in range(4):
        table: list[list[tuple[int, str, int] | None]] = [[None] * 4 for _ in range(4)]
        for s in range(4):
            for via in range(4):
                if _INSERT[s][via] is None:
                    continue
                base = INSERT * len(_INSERT[s][via])
                for to, merged in [(q, False) for q in _NEXT[via]] + ([(via, True)] if via and via == s else []):
                    other = 0 if role == to - 1 else NAME if role == 3 else RELABEL
                    action = ("merge" if merged else "keep") if not other else "merge_relabel" if merged else "relabel"
                    new = (base + other + MERGE * merged, action, via)
                    if table[s][to] is None or new[0] < table[s][to][0]:
                        table[s][to] = new
        out.append(table)
    return out


_STEP = _steps()
_COST = [[[c[0] if c else _FAR for c in row] for row in table] for table in _STEP]
_END = [INSERT * len(p) if (p := _INSERT[s][_ASSISTANT]) is not None else _FAR for s in range(4)]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def _forward(costs: list[int], roles: list[int]) -> list[list[int]]:
    """The least cost of each state before the first and after each turn."""
    out = [costs]
    for r in roles:
        m = _COST[r]
        costs = [min(costs[s] + m[s][t] for s in range(4)) for t in range(4)]
        out.append(costs)
    return out


def _trace(table: list[list[int]], roles: list[int], state: int) -> list[int]:
    """The states of a cheapest way to `state`, from before the first turn on; ties go to the earlier state."""
    out = [state]
    for costs, r in zip(table[-2::-1], roles[::-1], strict=True):
        m = _COST[r]
        state = min(range(4), key=lambda s: (costs[s] + m[s][state], s))  # noqa: B023
        out.append(state)
    return out[::-1]


def _last(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + _END[s], s))


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, str, tuple[str, ...]]], tuple[str, ...]]:
    """The cost, (role, action, roles inserted before) for each turn, and the roles inserted at the end."""
    numbers = [role_number(r) for r in roles]
    table = _forward([0, _FAR, _FAR, _FAR], numbers)
    last = _last(table[-1])
    states = _trace(table, numbers, last)
    return table[-1][last] + _END[last], [_told(r, s, t) for r, s, t in zip(numbers, states[:-1], states[1:], strict=True)], tuple(ROLES[q - 1] for q in _INSERT[last][_ASSISTANT])


def _told(role: int, s: int, t: int) -> tuple[str, str, tuple[str, ...]]:
    _, action, via = _STEP[role][s][t]
    return ROLES[t - 1], action, tuple(ROLES[q - 1] for q in _INSERT[s][via])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of rows of one conversation (conv_id first), as they follow one another in a partition."""
    kept: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at = 0
        for conv, run in groupby(columns[0]):
            to = at + sum(1 for _ in run)
            part = [c[at:to] for c in columns]
            if kept and kept[0][0] == conv:
                for have, more in zip(kept, part, strict=True):
                    have += more
            else:
                if kept:
                    yield kept
                kept = part
            at = to
    if kept:
        yield kept


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _escape(text: str) -> str:
    return text.replace("<|im_", "< |im_")


def format_chats(turns: DataFrame) -> DataFrame:
    """For each row of turns (conv_id, turn, role, text): (conv_id, turn, role, action, inserted, rendered, cost).

    role is the repaired role; action is keep, relabel, merge or merge_relabel; inserted names the
    empty turns put before it; the rendered pieces of a conversation, in order of turn, are
    its text, with the markers of turns that end or are inserted in the piece after;
    the last piece has what is inserted at the end as well. cost is the least cost up to and with the turn
    on the chosen way. Marker strings inside texts are broken by a space.

    Turns with the same number stand by role and text, null first; rows equal in all are
    separate turns. A null role is unknown, a null text empty, rows without a conv_id
    are one conversation. Text of any length is one turn's. No rows, no rows. Other columns are not looked at.
    """
    shared_dir(turns.sparkSession)
    rows = turns.select("conv_id", F.col("turn").cast("long"), "role", "text")
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.checkpoint()  # ranges are drawn from a sample: all passes must see the same

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The matrices of a partition's first and last conversation."""
        at, first, last = TaskContext.get().partitionId(), None, None
        n = 0
        for convs, roles in _stretches(batches):
            last = (n, convs[0], [role_number(r) for r in roles])
            first = first or last
            n += 1
        found = [first, last][: min(n, 2)]
        m = [[c for s in range(4) for c in _forward([0 if t == s else _FAR for t in range(4)], roles)[-1]] for _, _, roles in found]
        rows = ((at, k, None if conv is None else str(conv), x) for (k, conv, _), x in zip(found, m, strict=True))
        yield from _batches(rows, pa.schema([("part", pa.int32()), ("k", pa.int32()), ("conv", pa.string()), ("m", pa.list_(pa.int64()))]))

    cut = sorted(rows.select("conv_id", "role").mapInArrow(ends, "part int, k int, conv string, m array<long>").collect(), key=lambda r: (r["part"], r["k"]))
    runs: list[list] = []  # stretches of one conversation over partitions
    for r in cut:
        if runs and runs[-1][-1]["conv"] == r["conv"] and runs[-1][-1]["part"] != r["part"]:
            runs[-1].append(r)
        else:
            runs.append([r])
    enter: dict[tuple[int, int], list[int]] = {}
    leave: dict[tuple[int, int], int] = {}
    follows: set[tuple[int, int]] = set()  # stretches that another one follows
    for run in runs:
        costs, table = [0, _FAR, _FAR, _FAR], []
        for r in run:
            enter[r["part"], r["k"]] = costs
            table.append(costs)
            costs = [min(costs[s] + r["m"][4 * s + t] for s in range(4)) for t in range(4)]
        follows |= {(r["part"], r["k"]) for r in run[:-1]}
    todo = [run for run in runs if len(run) > 1]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of stretches that are part of a run: the state before them for each state after them."""
        at = TaskContext.get().partitionId()

        def ways() -> Iterator[tuple]:
            for k, (_, names) in enumerate(_stretches(batches)):
                if (at, k) in wanted:
                    roles = [role_number(r) for r in names]
                    table = _forward(enter[at, k], roles)
                    yield at, k, [_trace(table, roles, t)[0] for t in range(4)], table[-1]

        yield from _batches(ways(), pa.schema([("part", pa.int32()), ("k", pa.int32()), ("to", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64()))]))

    wanted = {(r["part"], r["k"]) for run in todo for r in run}
    if todo:
        ways = {(r["part"], r["k"]): r for r in rows.select("conv_id", "role").mapInArrow(back, "part int, k int, to array<int>, costs array<long>").collect()}
        for run in todo:
            state = _last(ways[run[-1]["part"], run[-1]["k"]]["costs"])
            for r in reversed(run):
                leave[r["part"], r["k"]] = state
                state = ways[r["part"], r["k"]]["to"][state]

    shape = rows.schema["conv_id"].dataType

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()

        def told() -> Iterator[tuple]:
            for k, (convs, numbers, names, texts) in enumerate(_stretches(batches)):
                roles = [role_number(r) for r in names]
                table = _forward(enter.get((at, k), [0, _FAR, _FAR, _FAR]), roles)
                last = leave.get((at, k), _last(table[-1]))
                states = _trace(table, roles, last)
                for i, (r, text) in enumerate(zip(roles, texts, strict=True)):
                    role, action, inserted = _told(r, states[i], states[i + 1])
                    text = "" if text is None else _escape(text)
                    if action.startswith("merge"):
                        piece = "\n" + text
                    else:
                        piece = "".join(OPEN.format(x) + CLOSE for x in inserted) + OPEN.format(role) + text
                        if states[i] != _START:
                            piece = CLOSE + piece
                    if i == len(roles) - 1 and (at, k) not in follows:
                        piece += CLOSE + "".join(OPEN.format(ROLES[q - 1]) + CLOSE for q in _INSERT[last][_ASSISTANT])
                    yield convs[i], numbers[i], role, action, ",".join(inserted), piece, table[i + 1][states[i + 1]]

        names = ["role", "action", "inserted", "rendered"]
        yield from _batches(told(), pa.schema([("conv_id", to_arrow_type(shape)), ("turn", pa.int64()), *((n, pa.string()) for n in names), ("cost", pa.int64())]))

    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(render, f"conv_id {kind}, turn long, role string, action string, inserted string, rendered string, cost long")
