"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton.

A legal conversation is an optional system message, then user and assistant messages in turn, the last by the assistant.
Each given turn is kept or relabelled, and starts a message, joins the message before it, or follows empty messages that are
inserted to make it legal; the sum of the costs is the least possible. The step from one turn to the next is a
(min, +) matrix over the automaton's states, and these products are associative: a long conversation is cut into
blocks of `BLOCK` turn numbers, each block becomes one small matrix, the blocks' first and last states are found from
the matrices, and each block is then traced back by itself. A block with more than `BLOCK` turns (of equal numbers) or `BLOCK_BYTES` of text
is cut further, by turn, role and, in their order, by ranges of text hashes, so that no task holds more text than one block or one turn.
Up to `BLOCK` blocks make a stretch, whose matrix is their product: a conversation comes together as a row of stretches, a millionth of its turns.

Result: one row for each given turn and each inserted message, with its part of the rendered conversation. The parts of a
conversation, joined in the order of (turn, turn_role, turn_mark, step), are the rendering; a part closes the message before it. turn_role and
turn_mark, the role and text hash of the turn that a part belongs to, only matter where turns have one number.

Defined results: a null or unknown role can become any role for `RELABEL`; a null text is empty; turns with the same
number are ordered by role and a hash of their text, exact repeats count once; rows without a
conversation or a turn number have no place, so they come back with action `unplaced` and nothing rendered; marks of
the format inside a text are broken up by a blank, so that they can't open or close a message; an empty table gives an empty table; columns
of other names take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, join_small, stored, table

BLOCK, BLOCK_BYTES = 1024, 8 << 20
MERGE, INSERT, RELABEL = 1, 2, 4
ROLES = ("system", "user", "assistant")
START, FAR = 0, 1 << 30
#: Messages that a message of a role may follow; states are 0 (nothing yet) and the role of the last message (1 to 3).
AFTER = {(0, 1): (), (0, 2): (), (1, 2): (), (2, 3): (), (3, 2): (), (0, 3): (2,), (1, 3): (2,), (2, 2): (3,), (3, 3): (2,)}
#: What an end in a state needs: inserted roles.
CLOSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def choices(role: int, state: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, next state, action, inserted roles) of a turn; role 0 is unknown. The first of the cheapest is taken."""
    out = []
    for to in (1, 2, 3):
        changed = RELABEL * (to != role)
        named = "relabel" if changed else "keep"
        if to == state:
            out.append((changed + MERGE, to, "merge" if not changed else "relabel+merge", ()))
        if (state, to) in AFTER:
            missing = AFTER[state, to]
            out.append((changed + INSERT * len(missing), to, named, missing))
    return sorted(out, key=lambda c: (c[0], len(c[3]), c[1]))


STEPS = {(r, s): choices(r, s) for r, s in product(range(4), range(4))}


def forward(roles: list[int], start: list[int]) -> list[list[int]]:
    """Least costs of each state before the first turn and after each turn."""
    costs = [start]
    for r in roles:
        now, then = costs[-1], [FAR] * 4
        for s in range(4):
            if now[s] < FAR:
                for c, to, _, _ in STEPS[r, s]:
                    then[to] = min(then[to], now[s] + c)
        costs.append(then)
    return costs


def only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def matrix(roles: list[int]) -> list[int]:
    """The block's (min, +) matrix, row by row."""
    return [c for s in range(4) for c in forward(roles, only(s))[-1]]


def applied(costs: list[int], m: list[int]) -> list[int]:
    """Least costs of each state after a block, from those before it."""
    return [min(min(costs[s] + m[4 * s + t], FAR) for s in range(4)) for t in range(4)]


def product(blocks: list[list[int]]) -> list[int]:
    """The (min, +) product of matrices."""
    out = []
    for s in range(4):
        costs = only(s)
        for m in blocks:
            costs = applied(costs, m)
        out += costs
    return out


def route(blocks: list[list[int]], first: int, last: int) -> list[tuple[int, int]]:
    """(first, last) state of each block on a least way between two states."""
    costs = [only(first)]
    for m in blocks:
        costs.append(applied(costs[-1], m))
    state, path = last, []
    for m, before in zip(reversed(blocks), reversed(costs[:-1]), strict=True):
        come = min(range(4), key=lambda s: (min(FAR, before[s] + m[4 * s + state]), s))
        path.append((come, state))
        state = come
    return path[::-1]


def join_blocks(blocks: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of a conversation, with its end, and (first, last) state of each block."""
    costs = only(START)
    for m in blocks:
        costs = applied(costs, m)
    ends = [min(FAR, costs[s] + INSERT * len(CLOSING[s])) for s in range(4)]
    state = min(range(4), key=lambda s: (ends[s], s))
    return ends[state], route(blocks, START, state)


def trace(roles: list[int], first: int, last: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """The choice made for each turn of a block between two states."""
    costs, state, out = forward(roles, only(first)), last, []
    for i in range(len(roles) - 1, -1, -1):
        state, choice = min(((s, c) for s in range(4) if costs[i][s] < FAR for c in STEPS[roles[i], s] if c[1] == state and costs[i][s] + c[0] == costs[i + 1][state]), key=lambda x: (x[1][0], len(x[1][3]), x[0]))
        out.append(choice)
    return out[::-1]


def safe(text: str) -> str:
    return text.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")


def fragments(turns: list[dict], first: int, last: int, final: bool) -> Iterator[dict]:
    """Rows of one block."""
    roles = [ROLES.index(t["role"]) + 1 if t["role"] in ROLES else 0 for t in turns]
    state = first
    opened = lambda r: (CLOSE if state else "") + OPEN.format(ROLES[r - 1])
    for turn, (cost, to, action, missing) in zip(turns, trace(roles, first, last), strict=True):
        step = 0
        place = {"turn": turn["turn"], "turn_role": turn["role"], "turn_mark": turn["mark"]}
        row = place | {"given_role": turn["role"]}
        for r in missing:
            yield row | {"step": step, "given_role": None, "role": ROLES[r - 1], "action": "insert", "cost": INSERT, "rendered": opened(r)}
            state, step, cost = r, step + 1, cost - INSERT
        text = safe(turn["text"] or "")
        rendered = "\n" + text if action.endswith("merge") else opened(to) + text
        yield row | {"step": step, "role": ROLES[to - 1], "action": action, "cost": cost, "rendered": rendered}
        state = to
    if final:
        for step, r in enumerate(CLOSING[state], 1_000_000):
            yield place | {"step": step, "given_role": None, "role": ROLES[r - 1], "action": "insert", "cost": INSERT, "rendered": opened(r)}
            state = r
        yield place | {"step": 1_000_009, "given_role": None, "role": None, "action": "end", "cost": 0, "rendered": CLOSE}


def matrices(roles: pd.Series) -> pd.Series:
    return pd.Series([matrix([ROLES.index(x) + 1 if x in ROLES else 0 for x in r]) for r in roles])


def products(stretches: pd.Series) -> pd.Series:
    return pd.Series([product([[int(x) for x in m] for m in given]) for given in stretches])


def bounds(conversations: pd.Series) -> pd.Series:
    """The first and last state of every stretch of a conversation, and whether it is the last."""
    out = []
    for given in conversations:
        _, path = join_blocks([[int(x) for x in m] for m in given])
        out.append([{"first": f, "last": t, "final": i == len(path) - 1} for i, (f, t) in enumerate(path)])
    return pd.Series(out)


def routes(stretches: pd.Series, first: pd.Series, last: pd.Series, final: pd.Series) -> pd.Series:
    """The same of every block of a stretch."""
    out = []
    for given, f, t, end in zip(stretches, first, last, final, strict=True):
        path = route([[int(x) for x in m] for m in given], int(f), int(t))
        out.append([{"first": a, "last": b, "final": bool(end) and i == len(path) - 1} for i, (a, b) in enumerate(path)])
    return pd.Series(out)


PART = "turn:bigint,turn_role:string,turn_mark:bigint,step:int,given_role:string,role:string,action:string,cost:int,rendered:string"


def parts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for turns, first, last, final in batches:
        yield pd.Series([list(fragments([dict(x) if isinstance(x, dict) else x.asDict() for x in t], int(f), int(z), bool(e))) for t, f, z, e in zip(turns, first, last, final, strict=True)])


def in_blocks(placed: DataFrame) -> DataFrame:
    """`placed` (conv, turn, role, text, mark) with `at`, the block of each turn, and `stretch`, that of the block; both are in the order of turns."""
    placed = placed.withColumn("block", F.floor(F.col("turn") / BLOCK).cast("bigint"))
    loads = placed.groupBy("conv", "block").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    crowded = stored(loads.filter((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("conv", "block", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("bigint").alias("ranges")))
    wide = F.floor(F.col("block") / BLOCK).cast("bigint")
    if crowded.isEmpty():
        return placed.withColumns({"at": F.struct("block"), "stretch": F.struct(wide.alias("wide"))})
    # where a block is cut, all blocks of its stretch are stretches of their own, and a cut block is as many as its ranges need
    beside = stored(crowded.select("conv", wide.alias("wide"), F.lit(True).alias("alone")).distinct())
    placed = join_small(placed, crowded, ["conv", "block"], "mark").withColumn("wide", wide)
    placed = join_small(placed, beside, ["conv", "wide"], "mark")
    bucket = F.floor((F.col("mark") / F.lit(2.0**64) + 0.5) * F.col("ranges"))  # keeps the order of the marks
    cut = F.col("ranges").isNotNull()
    inner = [F.when(cut, F.col("turn")).alias("turn"), F.when(cut, F.col("role")).alias("role")]
    at = F.struct("block", *inner, F.when(cut, bucket).alias("bucket"))
    return placed.withColumns({"at": at, "stretch": F.struct("wide", F.when(F.col("alone"), F.col("block")).alias("block"), *inner, F.when(cut, F.floor(bucket / BLOCK)).alias("bucket"))})


def repair(chats: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired parts of every conversation; other columns of `chats` take no part."""
    ends = "array<struct<first:int,last:int,final:boolean>>"
    to_matrix, to_product, to_bounds, to_routes = F.pandas_udf(matrices, "array<int>"), F.pandas_udf(products, "array<int>"), F.pandas_udf(bounds, ends), F.pandas_udf(routes, ends)
    to_parts = F.pandas_udf(parts, f"array<struct<{PART}>>")
    given = Rows(chats)
    clean: Column = F.lower(F.trim(given.col(role)))
    rows = given.df.select(given.col(conversation).alias("conv"), given.col(turn).cast("bigint").alias("turn"), clean.alias("role"), given.col(text).alias("text"))
    known = rows.filter("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = in_blocks(known.withColumn("mark", F.xxhash64("text")))
    # sets fold copies before the shuffle; the narrow set has a text's hash, so both hold the same turns in one order
    narrow = placed.groupBy("conv", "stretch", "at").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "mark"))).alias("t"))
    states = narrow.select("conv", "stretch", "at", to_matrix(F.transform("t", lambda x: x["role"])).alias("m"))
    listed = lambda name: F.sort_array(F.collect_list(F.struct(name, "m"))).alias("parts")
    matrices_of = F.transform("parts", lambda x: x["m"])
    paired = lambda name, path: F.explode(F.transform("parts", lambda x, i: F.struct(x[name].alias(name), F.get(path, i).alias("b")))).alias("x")
    stretches = stored(states.groupBy("conv", "stretch").agg(listed("at")))
    whole = stretches.select("conv", "stretch", to_product(matrices_of).alias("m")).groupBy("conv").agg(listed("stretch"))
    ways = whole.select("conv", "parts", to_bounds(matrices_of).alias("path")).select("conv", paired("stretch", "path")).select("conv", "x.stretch", "x.b.*")
    inner = stretches.join(ways, ["conv", "stretch"]).select("conv", "parts", to_routes(matrices_of, "first", "last", "final").alias("path"))
    paths = inner.select("conv", paired("at", "path")).select("conv", "x.at", "x.b.*")
    full = placed.groupBy("conv", "at").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "mark", "text"))).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["turn"], x["role"], x["mark"], x["text"]))
    made = full.join(paths, ["conv", "at"]).select("conv", F.explode(to_parts(turns, "first", "last", "final")).alias("p")).select(F.col("conv").alias(conversation), "p.*")
    unplaced = rows.filter("conv IS NULL OR turn IS NULL").select(F.col("conv").alias(conversation), "turn", F.col("role").alias("turn_role"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("turn_mark"), F.lit(0).alias("step"), F.col("role").alias("given_role"), F.lit(None).cast("string").alias("role"), F.lit("unplaced").alias("action"), F.lit(0).alias("cost"), F.lit(None).cast("string").alias("rendered"))
    return made.unionByName(unplaced)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
