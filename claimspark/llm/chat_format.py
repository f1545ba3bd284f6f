"""Chat formatting with minimum-cost role repair.

A legal conversation may open with one system turn; then user and assistant alternate, the user
first and the assistant last. Dynamic programming over this automaton's states finds the cheapest
way to make a conversation legal by keeping turns, relabelling them, merging them into the message
before, or inserting empty messages (``COSTS``); then the repaired conversation is rendered, a row
for each fragment, so that a conversation of any length is never one value.

*Scale.* Turns are range-partitioned by conversation and turn, so that a long conversation runs
through many partitions. What a partition can do to the state of the conversation that it begins
or ends with is a 4 x 4 matrix of costs; Spark chains these for each conversation that was cut, in two
steps, and joins to each partition the states at its borders, between which it repairs on its own.

Defined cases: a null or unknown role may be relabelled or merged cheaply; a null text is empty, and
an empty turn merges for little; equal turn numbers go by role, then a hash of the text, nulls first; repeated
rows are turns like others; turns of null conversations form one; null turn numbers come last; an
empty table gives an empty result; other columns are not looked at. Of equally cheap repairs the
one with the earlier action in ``ACTIONS`` at the latest turn where they differ is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BLANKS, materialise, table

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "bot": 2, "gpt": 2, "model": 2}
UNKNOWN = 3
ACTIONS = ("keep", "merge", "relabel", "insert", "close")
#: Fixed values. Merging is into the same role or another one; an unknown role is told cheaply.
COSTS = {"keep": 0, "insert": 2, "relabel": 5, "relabel unknown": 1, "merge same": 1, "merge other": 4, "merge unknown": 2, "merge empty same": 0, "merge empty": 1}
#: After: nothing, the system turn, a user turn, an assistant turn. What may follow, and where that leads.
LEGAL = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
FINAL, STATES, FAR = 3, 4, 10**9
ROWS, BYTES = 50_000, 1 << 25
#: How a message opens and closes, what joins merged turns, and what "<|" in a text becomes.
OPEN, CLOSE, JOIN, GUARD = "<|{}|>\n", "<|end|>\n", "\n\n", "<\u200b|"


def role_code(role: str | None) -> int:
    return ALIASES.get((role or "").strip(BLANKS).lower(), UNKNOWN)


def inserts(state: int) -> dict[int, list[int]]:
    """The states that empty messages lead to from ``state``, with the shortest list of their roles."""
    out, todo = {state: []}, [state]
    for here in todo:
        for role, there in LEGAL[here].items():
            if there not in out:
                out[there] = [*out[here], role]
                todo.append(there)
    return out


def steps(role: int, empty: bool) -> dict[tuple[int, int], tuple[int, int, str, list[int], int]]:
    """(state before, after) -> the cheapest way to take a turn: cost, preference, action, roles inserted before it, its role."""
    out: dict = {}

    def offer(before: int, after: int, cost: int, action: str, roles: list[int], as_role: int) -> None:
        new = (cost, ACTIONS.index(action), action, roles, as_role)
        if (before, after) not in out or new < out[before, after]:
            out[before, after] = new

    for before in range(STATES):
        if before:
            own = before - 1
            if empty:
                cost = COSTS["merge empty same" if own == role else "merge empty"]
            else:
                cost = COSTS["merge same" if own == role else "merge unknown" if role == UNKNOWN else "merge other"]
            offer(before, before, cost, "merge", [], own)
        for middle, roles in inserts(before).items():
            for as_role, after in LEGAL[middle].items():
                if as_role == role:
                    offer(before, after, len(roles) * COSTS["insert"], "keep", roles, as_role)
                else:
                    offer(before, after, len(roles) * COSTS["insert"] + COSTS["relabel unknown" if role == UNKNOWN else "relabel"], "relabel", roles, as_role)
    return out


STEPS = [steps(role, empty) for role in range(4) for empty in (False, True)]
#: For each kind of turn: (before, after, cost) in order of preference.
MOVES = [sorted(((b, a, w[0]) for (b, a), w in kind.items()), key=lambda m, kind=kind: (m[1], kind[m[0], m[1]][1], m[0])) for kind in STEPS]
ENDING = [len(inserts(s)[FINAL]) * COSTS["insert"] for s in range(STATES)]


def kind_of(role: int, empty: bool) -> int:
    return 2 * role + empty


def matrix(kinds: list[int]) -> np.ndarray:
    """Cheapest cost from each state before these turns to each state after them."""
    out = np.full((STATES, STATES), FAR, np.int64)
    for start in range(STATES):
        costs = [FAR] * STATES
        costs[start] = 0
        for kind in kinds:
            costs = advance(costs, kind)[0]
        out[start] = costs
    return out


def advance(costs: list[int], kind: int) -> tuple[list[int], list[int]]:
    new, came = [FAR] * STATES, [0] * STATES
    for before, after, cost in MOVES[kind]:
        if costs[before] + cost < new[after]:
            new[after], came[after] = costs[before] + cost, before
    return new, came


def repair(kinds: list[int], start: int = 0, stop: int | None = None) -> list[tuple[int, int]]:
    """(state before, after) each turn on the cheapest way from ``start`` to ``stop``, or to a legal end."""
    costs, trail = [FAR] * STATES, []
    costs[start] = 0
    for kind in kinds:
        costs, came = advance(costs, kind)
        trail.append(came)
    if stop is None:
        stop = min(range(STATES), key=lambda s: (costs[s] + ENDING[s], -s))
    out = []
    for came in reversed(trail):
        out.append((came[stop], stop))
        stop = came[stop]
    return out[::-1]


FRAGMENTS = "conv_id long, turn long, place long, sub int, action string, role string, cost long, rendered string"


def render(kinds: list[int], texts: list, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, str, str | None, int, str]]:
    """Fragments of a run of turns: number of the turn, number within it, action, role, cost, rendered."""

    def opening(state: int, role: int) -> str:
        return (CLOSE if state else "") + OPEN.format(ROLES[role])

    way, sub = repair(kinds, start, stop), 0
    for i, (kind, text, (before, after)) in enumerate(zip(kinds, texts, way, strict=True)):
        cost, _, action, roles, role = STEPS[kind][before, after]
        state = before
        for sub, extra in enumerate(roles):
            yield i, sub, "insert", ROLES[extra], COSTS["insert"], opening(state, extra)
            state = LEGAL[state][extra]
        sub, body = len(roles), (text or "").replace("<|", GUARD)
        if action == "merge":
            rendered = JOIN + body if body.strip(BLANKS) else ""
        else:
            rendered = opening(state, role) + body
        yield i, sub, action, ROLES[role], cost - len(roles) * COSTS["insert"], rendered
    if stop is None:
        state = way[-1][1]
        for extra in inserts(state)[FINAL]:
            sub += 1
            yield len(kinds) - 1, sub, "insert", ROLES[extra], COSTS["insert"], opening(state, extra)
            state = LEGAL[state][extra]
        yield len(kinds) - 1, sub + 1, "close", None, 0, CLOSE


def runs(convs: list) -> list[tuple[int, int]]:
    cuts = [i for i in range(len(convs)) if not i or convs[i] != convs[i - 1]]
    return list(zip(cuts, [*cuts[1:], len(convs)], strict=True))


def chain(matrices: list[np.ndarray], start: np.ndarray, stop: int | None) -> list[int]:
    """The states after each of some runs of turns on the cheapest way through them.

    ``start``: costs of the states before; ``stop``: the state after all, or None for the cheapest to end in.
    """
    costs, trail = start, []
    for m in matrices:
        through = costs[:, None] + m
        trail.append(through.argmin(axis=0))
        costs = np.minimum(through.min(axis=0), FAR)
    state = min(range(STATES), key=lambda s: (costs[s] + ENDING[s], -s)) if stop is None else stop
    out = [state]
    for came in reversed(trail[1:]):
        out.append(int(came[out[-1]]))
    return out[::-1]


def only(state: int) -> np.ndarray:
    costs = np.full(STATES, FAR, np.int64)
    costs[state] = 0
    return costs


PIECES = "conv_id long, part int, matrix array<long>"
SPANS = "conv_id long, block int, matrix array<long>"
STATES_AT = "conv_id long, block int, arrive int, leave int"
BORDERS = "part int, arrive int, leave int"


def border_states(pieces: DataFrame, count: int) -> DataFrame:
    """part, arrive, leave: the states in which a partition's first conversation arrives and its last one leaves, if these are cut.

    ``pieces``: for each partition its first and its last conversation (once, if they are one run)
    with the matrix of that run. Costs along a conversation are chained in two steps, blocks of
    about sqrt(``count``) partitions and then the partitions of each block, so that no task and
    not the driver holds a row for each partition.
    """
    width = max(2, math.isqrt(count))
    cut = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("cut_id"))
    pieces = pieces.join(cut, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left_semi").withColumn("block", F.floor(F.col("part") / width).cast("int"))

    def squares(of: pa.Table) -> list[np.ndarray]:
        return list(of.column("matrix").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, STATES, STATES))

    def product(key: tuple, of: pa.Table) -> pa.Table:
        whole = np.where(np.eye(STATES, dtype=bool), 0, FAR)
        for m in squares(of.sort_by("part")):
            whole = np.minimum((whole[:, :, None] + m[None]).min(axis=1), FAR)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([whole.ravel().tolist()], pa.list_(pa.int64()))], names=["conv_id", "block", "matrix"])

    def outer(key: tuple, of: pa.Table) -> pa.Table:
        of = of.sort_by("block")
        after = chain(squares(of), only(0), None)
        return pa.table([of.column("conv_id"), of.column("block"), pa.array([0, *after[:-1]], pa.int32()), pa.array(after, pa.int32())], names=["conv_id", "block", "arrive", "leave"])

    def inner(key: tuple, of: pa.Table, at: pa.Table) -> pa.Table:
        of = of.sort_by("part")
        arrive, leave = at.column("arrive")[0].as_py(), at.column("leave")[0].as_py()
        after = chain(squares(of), only(arrive), leave)
        first, last = of.column("first").to_pylist(), of.column("last").to_pylist()
        before = [arrive, *after[:-1]]
        return pa.table([of.column("part"), pa.array([None if f else x for f, x in zip(first, before, strict=True)], pa.int32()), pa.array([None if f else x for f, x in zip(last, after, strict=True)], pa.int32())], names=["part", "arrive", "leave"])

    # A conversation's first piece arrives from nowhere and its last one leaves to nowhere: no border.
    ends = pieces.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).withColumnRenamed("conv_id", "end_id")
    pieces = pieces.join(ends, F.col("conv_id").eqNullSafe(F.col("end_id"))).select("conv_id", "block", "part", "matrix", (F.col("part") == F.col("low")).alias("first"), (F.col("part") == F.col("high")).alias("last"))
    blocks = pieces.groupBy("conv_id", "block").applyInArrow(product, SPANS).groupBy("conv_id").applyInArrow(outer, STATES_AT)
    states = pieces.groupBy("conv_id", "block").cogroup(blocks.groupBy("conv_id", "block")).applyInArrow(inner, BORDERS)
    return states.groupBy("part").agg(F.max("arrive").alias("arrive"), F.max("leave").alias("leave"))


def format_chats(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Fragments of the repaired conversations: those of one, ordered by place and sub, are its rendering."""
    spark = chats.sparkSession
    picked = chats.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    size = picked.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    count = max(1, -(-size.rows // ROWS), -(-(size.bytes or 0) // BYTES))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first(), "row"]
    dealt = picked.repartitionByRange(count, *order[:4], "row").sortWithinPartitions(*order)
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    dealt = materialise(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id(), "blank": blank}).drop("row"), "chat-turns")

    def read(of: pa.Table) -> tuple[pa.Table, list, list[int]]:
        of = of.sort_by("place")
        return of, of.column("conv_id").to_pylist(), [kind_of(role_code(r), b) for r, b in zip(of.column("role").to_pylist(), of.column("blank").to_pylist(), strict=True)]

    def borders(key: tuple, of: pa.Table) -> pa.Table:
        _, convs, kinds = read(of)
        every = runs(convs)
        rows = [{"conv_id": convs[a], "part": key[0].as_py(), "matrix": matrix(kinds[a:b]).ravel().tolist()} for a, b in ([every[0]] if len(every) == 1 else [every[0], every[-1]])]
        return pa.Table.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("matrix", pa.list_(pa.int64()))]))

    pieces = materialise(dealt.select("part", "place", "conv_id", "role", "blank").groupBy("part").applyInArrow(borders, PIECES), "chat-borders")
    states = border_states(pieces, count)

    def write(key: tuple, of: pa.Table, at: pa.Table) -> pa.Table:
        of, convs, kinds = read(of)
        turns, places, bodies = of.column("turn").to_pylist(), of.column("place").to_pylist(), of.column("text").to_pylist()
        arrive, leave = (at.column(c)[0].as_py() if at.num_rows else None for c in ("arrive", "leave"))
        rows = []
        for a, b in runs(convs):
            start = arrive if not a and arrive is not None else 0
            stop = leave if b == len(convs) else None
            for i, sub, action, role_, cost, rendered in render(kinds[a:b], bodies[a:b], start, stop):
                rows.append((convs[a], turns[a + i], places[a + i], sub, action, role_, cost, rendered))
        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_, strict=True)], names=["conv_id", "turn", "place", "sub", "action", "role", "cost", "rendered"])

    return dealt.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(write, FRAGMENTS)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
