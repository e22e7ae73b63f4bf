"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant.  Dynamic
programming over that automaton's states chooses for every turn whether it keeps its role or gets another, and whether
it opens a turn or is merged into the one before, and where empty turns are inserted, at the least total cost.

A step of the program is a min-plus matrix over the states, and these can be composed; so a long conversation is worked
on in blocks: matrices of blocks, the best states at the borders, then the choices inside each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

ROLES = ("system", "user", "assistant")
#: States: what the last turn so far is.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs.  An unknown or null role may become any; a system turn is dearer to turn into something else.
MERGE, INSERT, RELABEL, RELABEL_SYSTEM, NAME_UNKNOWN = 2, 6, 5, 7, 1
NEVER = 1 << 40
#: Turns of a conversation that one task looks at together.
BLOCK_BITS = 12

_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


@lru_cache
def _gap(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns that make `role` legal after `state`; None if nothing does."""
    paths: list[tuple[int, ...]] = [()]
    for _ in range(4):
        for path in paths:
            if ((path or (state,))[-1], role) in _LEGAL:
                return path
        paths = [(*p, r) for p in paths for r in (USER, ASSISTANT) if ((p or (state,))[-1], r) in _LEGAL]
    return None


def _relabel(given: int, role: int) -> int:
    """Cost of giving a turn `role`; `given` is 0 for an unknown role."""
    if given == 0:
        return NAME_UNKNOWN
    return 0 if given == role else RELABEL_SYSTEM if SYSTEM in (given, role) else RELABEL


@lru_cache
def _moves(given: int) -> tuple[tuple[int, int, int, bool, tuple[int, ...]], ...]:
    """(from, to, cost, merged, inserted before) of everything a turn can do; of equals the first is preferred."""
    out = []
    for state in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            gap = _gap(state, role)
            if gap is not None:
                out.append((state, role, _relabel(given, role) + INSERT * len(gap), False, gap))
            if state == role:
                out.append((state, role, _relabel(given, role) + MERGE, True, ()))
    return tuple(sorted(out, key=lambda m: (m[2], m[3], m[0], m[1])))


@lru_cache
def _ending(state: int) -> tuple[int, ...]:
    """Empty turns that end a conversation legally."""
    return () if state in (START, ASSISTANT) else (*(_gap(state, ASSISTANT) or ()), ASSISTANT)


def _forward(given: list[int], begin: np.ndarray | list[int]) -> list[list[int]]:
    """Least costs of each state after each turn, from the costs before the first."""
    out = [list(begin)]
    for g in given:
        cost = [NEVER] * 4
        for a, b, c, _, _ in _moves(g):
            cost[b] = min(cost[b], out[-1][a] + c)
        out.append(cost)
    return out


def block_matrix(given: list[int]) -> list[int]:
    """[4 * from + to]: the least cost of leading the states through these turns."""
    return [c for s in range(4) for c in _forward(given, [0 if t == s else NEVER for t in range(4)])[-1]]


def border_states(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(state before, state after) every block on the cheapest way through a whole conversation."""
    costs = [[0, NEVER, NEVER, NEVER]]
    for m in matrices:
        costs.append([min(costs[-1][a] + m[4 * a + b] for a in range(4)) for b in range(4)])
    state = min(range(4), key=lambda s: (costs[-1][s] + INSERT * len(_ending(s)), s))
    out = []
    for before, m in zip(costs[-2::-1], matrices[::-1]):
        first = min(range(4), key=lambda a: (before[a] + m[4 * a + state], a))
        out.append((first, state))
        state = first
    return out[::-1]


def block_choices(given: list[int], first: int, last: int) -> list[tuple[int, bool, tuple[int, ...]]]:
    """(role, merged, inserted before) of each turn on the cheapest way from state `first` to `last`."""
    costs = _forward(given, [0 if s == first else NEVER for s in range(4)])
    out, state = [], last
    for before, after, g in zip(costs[-2::-1], costs[:0:-1], given[::-1]):
        a, b, _, merged, gap = next(m for m in _moves(g) if m[1] == state and before[m[0]] + m[2] == after[state])
        out.append((b, merged, gap))
        state = a
    return out[::-1]


def repair(roles: list[str | None]) -> list[tuple[int | None, str, bool]]:
    """(place of the turn or None if inserted, role, merged) of a whole conversation, in one piece."""
    given = [ROLES.index(r) + 1 if r in ROLES else 0 for r in roles]
    if not given:
        return []
    (first, last), = border_states([block_matrix(given)])
    out: list[tuple[int | None, str, bool]] = []
    for i, (role, merged, gap) in enumerate(block_choices(given, first, last)):
        out += [(None, ROLES[g - 1], False) for g in gap] + [(i, ROLES[role - 1], merged)]
    return out + [(None, ROLES[g - 1], False) for g in _ending(last)]


def repaired_turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """The repaired conversations: one row for each turn of `df` and each inserted one.

    Returns the conversation, out_turn (from 0), part (place inside a merged turn), role, given_role, given_turn, action
    (keep, relabel, merge, relabel+merge, insert), text and rendered.  Joining `rendered` in the order of out_turn and
    part gives the formatted conversation; no task ever holds a whole long one.  Turns are ordered by `turn` (null
    last), then role and text; repeated rows stay.  Roles are compared without case or outer blanks; a null text is
    empty; "<|" in a text is set apart, so that no text can open a turn.  A null conversation is one of its own.
    """
    spark = df.sparkSession
    clean = F.lower(F.trim(role))
    code = F.coalesce(*[F.when(clean == r, F.lit(i + 1)) for i, r in enumerate(ROLES)], F.lit(0))
    key = F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("n"))
    rows = df.select(F.col(conversation).alias("conv"), key.alias("key"), F.col(turn).alias("turn"), F.col(role).alias("given_role"), code.alias("code"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("key"), F.col("turn").asc_nulls_last(), F.col("given_role").asc_nulls_last(), F.xxhash64("text"), F.col("tie")]
    placed = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    rows = materialise(placed.withColumn("at", F.monotonically_increasing_id()).drop("tie"))  # `at`: the place in that order

    gathered = rows.groupBy("key", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("at", "code"))).alias("turns"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([block_matrix(c) for c in b.column("codes").to_pylist()], pa.list_(pa.int64()))], names=[*b.schema.names, "matrix"])

    blocks = gathered.select("key", "block", "conv", F.col("turns.at").alias("ats"), F.col("turns.code").alias("codes"))
    kind = dict(blocks.dtypes)["conv"]
    blocks = materialise(blocks.mapInArrow(summarise, f"key string, block long, conv {kind}, ats array<long>, codes array<int>, matrix array<long>"))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, firsts, lasts, ends = [], [], [], [], []
            for k, parts in zip(b.column("key").to_pylist(), b.column("parts").to_pylist()):
                for i, (p, (first, last)) in enumerate(zip(parts, border_states([p["matrix"] for p in parts]))):
                    keys.append(k), ids.append(p["block"]), firsts.append(first), lasts.append(last), ends.append(i == len(parts) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(ends, pa.bool_())], names=["key", "block", "first", "last", "ends"])

    ways = blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("parts")).mapInArrow(borders, "key string, block long, first int, last int, ends boolean")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps, opened, first_merged = [], [], []
            for ats, codes, first, last, ends in zip(*(b.column(c).to_pylist() for c in ("ats", "codes", "first", "last", "ends"))):
                own = []
                for at, (r, merged, gap) in zip(ats, block_choices(codes, first, last)):
                    own += [(None, g, False) for g in gap] + [(at, r, merged)]
                own += [(None, g, False) for g in _ending(last)] if ends else []
                steps.append([{"at": a, "role": r, "merged": m} for a, r, m in own])
                opened.append(sum(not m for _, _, m in own))
                first_merged.append(own[0][2])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("block"), b.column("conv"), pa.array(steps, pa.list_(pa.struct([("at", pa.int64()), ("role", pa.int32()), ("merged", pa.bool_())]))), pa.array(opened, pa.int64()), pa.array(first_merged, pa.bool_())], names=["key", "block", "conv", "steps", "opened", "first_merged"])

    chosen = blocks.join(ways, ["key", "block"]).select("key", "block", "conv", "ats", "codes", "first", "last", "ends").mapInArrow(
        choose, f"key string, block long, conv {kind}, steps array<struct<at: long, role: int, merged: boolean>>, opened long, first_merged boolean")
    by_block = Window.partitionBy("key").orderBy("block")
    chosen = chosen.withColumns({"before": F.coalesce(F.sum("opened").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "next_merged": F.coalesce(F.lead("first_merged").over(by_block), F.lit(False))})
    # out_turn: opened before this step, in earlier blocks and in this one; runs of merged steps are parts of one turn
    step = F.posexplode(F.col("steps")).alias("i", "step")
    turns = chosen.select("conv", "block", "before", "next_merged", "steps", step).select(
        "conv", F.col("step.at").alias("at"), F.col("step.role").alias("code"), F.col("step.merged").alias("merged"), "i", "block", "before",
        F.coalesce(F.get(F.col("steps.merged"), F.col("i") + 1), F.col("next_merged")).alias("goes_on"))
    in_block = Window.partitionBy("conv", "block", "before").orderBy("i")
    turns = turns.withColumn("out_turn", F.col("before") + F.sum((~F.col("merged")).cast("long")).over(in_block) - 1)
    # the place inside a merged turn: its rows' own order
    joined = turns.join(rows.select("at", "turn", "given_role", "text"), "at", "left")
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("code"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|", "< |")
    same = F.coalesce(F.lower(F.trim("given_role")) == name, F.lit(False))
    action = F.when(F.col("at").isNull(), "insert").when(F.col("merged"), F.when(same, "merge").otherwise("relabel+merge")).otherwise(F.when(same, "keep").otherwise("relabel"))
    rendered = F.concat(F.when(F.col("merged"), "\n").otherwise(F.concat(F.lit("<|im_start|>"), name, F.lit("\n"))), body, F.when(F.col("goes_on"), "").otherwise("<|im_end|>\n"))
    return joined.select(F.col("conv").alias(conversation), "out_turn", F.when(F.col("merged"), F.col("at")).otherwise(F.lit(-1)).alias("part"), name.alias("role"), "given_role", F.col("turn").alias("given_turn"), action.alias("action"), F.coalesce("text", F.lit("")).alias("text"), rendered.alias("rendered"))
