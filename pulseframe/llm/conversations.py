"""Conversation structure repair by square-root checkpointed dynamic programming.

The cheapest edits (keep, rerole, delete, insert) that give a conversation the role order (s?(ua)+)? come from a
recurrence over its turns with four states: nothing yet, after the system turn, after a user turn, after an assistant
turn. Backward vectors hold the cost to go of each state; only those at checkpoints, every square root of the turns,
are stored, and a block's other vectors are computed again when the forward walk comes to it. The walk takes, among the
edits that lie on a cheapest path, the one whose initial comes first, so the audit string is the ASCII-least.

A conversation of up to BLOCK turns is one row of one task. Longer ones, however long, are sorted by range and cut
into blocks of about the square root of their turns. A block's effect on the vectors is a 4 by 4 matrix of costs; the
matrices are chained backward to give every block its end vector, each block says in which state it leaves for each
state it is entered in, those are chained forward, and then all blocks are walked at once.

Turns go in order of (turn, role, text), nulls first. Defined cases: null role and text count as one space; a null
conv_id is a conversation of its own; repeated rows are duplicates of the first; a conversation without rows has no
edits; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, map_groups, parts, staged, table

#: Turns that are repaired in one piece; longer conversations are cut into blocks of at least so many.
BLOCK = 1024
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 50
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that must come next in each state, and the state after it.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost to go of each state when no turn is left: missing turns are inserted.
END = (0, 6, 3, 0)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3


class Block(NamedTuple):
    """Consecutive turns of one conversation: a symbol for each, and what their statistics are added up from."""

    symbols: str
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    low: int | None
    high: int | None
    turns: int


def block_of(rows: list[tuple[int | None, str, str, bool]]) -> Block:
    """rows: (turn, role, text, whether seen earlier). Symbols: D must go; else the role's initial (x: another), capital if truncated."""
    symbols, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text, seen in rows:
        body = text.rstrip(SPACE)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        fault = "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        symbols.append("D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
    initials = [role[:1] for _, role, _, _ in rows]
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return Block("".join(symbols), *counts.values(), illegal, initials[0], initials[-1], turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))


@lru_cache(maxsize=None)
def choices(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, state after) of the edits that use up a turn, in ASCII order. There are 9 symbols and 4 states."""
    out = [("D", DELETE, state)]
    if symbol != "D":
        more, role = TRUNCATED if symbol.isupper() else 0, symbol.lower()
        if role == NEXT_ROLE[state][0]:
            out.append(("K", more, NEXT[state]))
        elif role == "s" and state == START:
            out.append(("K", more, SYSTEM))
        out.append(("R", REROLE + more, NEXT[state]))
    return tuple(out)


@lru_cache(maxsize=100_000)
def back(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a turn, insertions before it included, from those after it."""
    used = [min(cost + after[to] for _, cost, to in choices(symbol, s)) for s in range(4)]
    return tuple(min(NEVER, used[s], INSERT + used[NEXT[s]], 2 * INSERT + used[NEXT[NEXT[s]]]) for s in range(4))


@lru_cache(maxsize=100_000)
def ahead(symbol: str, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits at a turn, and the state after it."""
    before, edits = back(symbol, after), ""
    while True:
        tight = {edit: to for edit, cost, to in choices(symbol, state) if cost + after[to] == before[state]}
        if "D" not in tight and INSERT + before[NEXT[state]] == before[state]:
            edits, state = edits + "I", NEXT[state]
        else:
            edit = min(tight)
            return edits + edit, tight[edit]


def level(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """costs with the least at 0, and that least: what back and ahead do is the same at every level."""
    least = min(costs)
    return tuple(c if c >= NEVER else c - least for c in costs), least


def costs_before(symbols: str, after: tuple[int, ...]) -> tuple[int, ...]:
    now, total = level(after)
    for symbol in reversed(symbols):
        now, more = level(back(symbol, now))
        total += more
    return tuple(c if c >= NEVER else c + total for c in now)


def walk(symbols: str, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The edits of a block entered in `state`, and the state it is left in. Stores 2 sqrt(n) vectors at a time."""
    step = max(1, math.isqrt(len(symbols)))
    marks = [level(after)[0]]
    cuts = range(0, len(symbols), step)
    for at in reversed(cuts):
        marks.append(level(costs_before(symbols[at : at + step], marks[-1]))[0])
    marks.pop()  # of the start
    edits = []
    for at in cuts:
        part, vectors = symbols[at : at + step], [marks.pop()]
        for symbol in reversed(part[1:]):
            vectors.append(level(back(symbol, vectors[-1]))[0])
        for symbol in part:
            edit, state = ahead(symbol, vectors.pop(), state)
            edits.append(edit)
    return "".join(edits), state


def closing(state: int) -> str:
    return "I" * (END[state] // INSERT)


def apply(edits: str, symbols: str, rows: list[tuple], state: int) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) that edits leave, and what the edits cost."""
    out, cost, at = [], 0, 0
    for edit in edits:
        if edit == "I":
            out.append((NEXT_ROLE[state], ""))
            state, cost = NEXT[state], cost + INSERT
            continue
        (_, role, text, *_), symbol = rows[at], symbols[at]
        at += 1
        for known, price, to in choices(symbol, state):
            if known == edit:
                if edit != "D":
                    out.append((role if edit == "K" else NEXT_ROLE[state], text))
                cost, state = cost + price, to
                break
    return out, cost


REPAIRED = "conv_id long, part int, seq int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, edits string, cost long, repaired array<struct<role:string,text:string>>"
REPAIRED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("edits", pa.string()), ("cost", pa.int64()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
])


def repaired_row(conv: int | None, part: int, seq: int, rows: list[tuple], block: Block, after: tuple[int, ...], state: int, last: bool) -> dict:
    edits, out_state = walk(block.symbols, after, state)
    edits += closing(out_state) if last else ""
    turns, cost = apply(edits, block.symbols, rows, state)
    own = block._asdict()
    own.pop("symbols")
    return {"conv_id": conv, "part": part, "seq": seq, **own, "edits": edits, "cost": cost, "repaired": [{"role": r, "text": t} for r, t in turns]}


def short_conversations(rows: DataFrame) -> DataFrame:
    """REPAIRED rows, one per conversation. rows: conv_id, turn, role, text, gone."""
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct("turn", "role", "text")))).alias("rows"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not own:
                    out.append({"conv_id": conv, "part": 0, "seq": 0, **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0), "edits": "", "repaired": []})
                    continue
                seen, turns = set(), []
                for r in own:
                    key = (r["role"], r["text"])
                    turns.append((r["turn"], *key, key in seen))
                    seen.add(key)
                out.append(repaired_row(conv, 0, 0, turns, block_of(turns), END, START, True))
            yield pa.RecordBatch.from_pylist(out, schema=REPAIRED_ARROW)

    return map_batches(grouped, repair, REPAIRED)


BLOCKS = "conv_id long, part int, seq int, rows array<struct<turn:long,role:string,text:string,seen:boolean>>, symbols string"


def cut_blocks(rows: DataFrame) -> DataFrame:
    """BLOCKS rows of long conversations: consecutive turns; (part, seq) is their order. rows: conv_id, n, turn, role, text."""
    digest = F.sha2("text", 256)
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), digest.alias("d")).agg(F.min(F.struct("turn")).alias("earliest"))
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("d")))
    met = met.select("conv_id", "turn", "role", "text", "n", (~F.col("turn").eqNullSafe(F.col("earliest.turn"))).alias("seen"))
    met = staged(met, "long-turns")  # the range partitioning samples it
    order = ["conv_id", "turn", "role", "text"]
    size = met.agg(F.sum(F.octet_length("text") + 50)).first()[0] or 0
    ordered = met.repartitionByRange(parts(rows.sparkSession, size), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, conv, last, held = TaskContext.get().partitionId(), 0, None, None, []

        def block() -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            names = ("turn", "role", "text", "seen")
            row = {"conv_id": conv, "part": task, "seq": seq, "rows": [dict(zip(names, h, strict=True)) for h in held], "symbols": block_of(held).symbols}
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS_ARROW)

        for batch in batches:
            for own, turn, role, text, n, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (own != conv or len(held) >= max(BLOCK, math.isqrt(n))):
                    yield block()
                    held = []
                # of identical rows, which lie side by side, all but the first were seen
                seen, last = seen or (own, turn, role, text) == last, (own, turn, role, text)
                conv = own
                held.append((turn, role, text, seen))
        if held:
            yield block()

    return staged(map_batches(ordered, cut, BLOCKS), "long-blocks")


BLOCKS_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()),
    ("rows", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("seen", pa.bool_())]))), ("symbols", pa.string()),
])


def long_conversations(rows: DataFrame) -> DataFrame:
    """REPAIRED rows, one per block. rows: conv_id, n, turn, role, text."""
    blocks = cut_blocks(rows)
    keys = ["conv_id", "part", "seq"]

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [tuple(zip(*[costs_before(s, tuple(0 if i == j else NEVER for i in range(4))) for j in range(4)], strict=True)) for s in batch.column(3).to_pylist()]
            flat = pa.array([[c for row in m for c in row] for m in columns], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], flat], names=[*keys, "costs"])

    def chain_back(frame: pd.DataFrame) -> pd.DataFrame:
        after, out = END, []
        for row in frame.sort_values(["part", "seq"], ascending=False).itertuples():
            out.append((row.conv_id, row.part, row.seq, list(after), after is END))
            m = row.costs
            after = level(tuple(min(NEVER, *(int(m[4 * s + j]) + after[j] for j in range(4))) for s in range(4)))[0]
        return pd.DataFrame(out, columns=[*keys, "after", "ends"])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [[walk(s, tuple(v), state)[1] for state in range(4)] for s, v in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(left, pa.list_(pa.int32()))], names=[*keys, "left"])

    def chain_forward(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for row in frame.sort_values(["part", "seq"]).itertuples():
            out.append((row.conv_id, row.part, row.seq, state))
            state = int(row.left[state])
        return pd.DataFrame(out, columns=[*keys, "state"])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, seq, own, after, ends, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = [(r["turn"], r["role"], r["text"], r["seen"]) for r in own]
                yield pa.RecordBatch.from_pylist([repaired_row(conv, part, seq, turns, block_of(turns), tuple(after), state, ends)], schema=REPAIRED_ARROW)

    # chains hold one small row per block; a conversation of n turns has about sqrt(n) blocks
    costs = map_batches(blocks.select(*keys, "symbols"), matrix, "conv_id long, part int, seq int, costs array<long>")
    after = staged(map_groups(costs, ["conv_id"], chain_back, "conv_id long, part int, seq int, after array<long>, ends boolean"), "long-after")
    met = blocks.drop("rows").join(after.withColumnRenamed("conv_id", "c"), ["part", "seq"])  # (part, seq) is one block
    left = map_batches(met.select(*keys, "symbols", "after"), exits, "conv_id long, part int, seq int, left array<int>")
    state = map_groups(left, ["conv_id"], chain_forward, "conv_id long, part int, seq int, state int")
    plan = after.join(state.drop("conv_id"), ["part", "seq"]).drop("conv_id")
    return map_batches(blocks.join(plan, ["part", "seq"]).select(*keys, "rows", "after", "ends", "state"), repair, REPAIRED)


def repair_blocks(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REPAIRED rows of short and of long conversations. turns: conv_id, turn, role, text, gone (rows that only name their conversation)."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text, F.coalesce("gone", F.lit(False)).alias("gone"))
    n = rows.where(~F.col("gone")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    n = staged(n.withColumnRenamed("conv_id", "long_id"), "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    # no row is dealt by conversation before it is known to be short
    long = rows.where(~F.col("gone")).join(n, same).select("conv_id", "n", "turn", "role", "text")
    return short_conversations(rows.join(n, same, "left_anti")), long_conversations(long)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, part, seq, place, role, text: the turns of every repaired conversation; their order is (part, seq, place)."""
    short, long = repair_blocks(turns)
    return short.unionByName(long).select("conv_id", "part", "seq", F.posexplode("repaired").alias("place", "turn")).select("conv_id", "part", "seq", "place", "turn.role", "turn.text")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")


def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """REPORT rows from REPAIRED rows that come conversation by conversation, blocks in order."""
    now, started = None, False

    def begin(row: dict) -> None:
        nonlocal now
        now = {"conv_id": row["conv_id"], **dict.fromkeys(SUMS, 0), "turns": 0, "low": None, "high": None, "last": None, "edits": [], "sha": hashlib.sha256(), "lines": 0}

    def add(row: dict) -> None:
        for c in SUMS:
            now[c] += row[c]
        if now["last"] is not None and row["first"] is not None:
            now["illegal"] += now["last"] + row["first"] not in ("su", "ua", "au")
        now["turns"] += row["turns"] - (row["low"] is not None and row["low"] == now["high"])
        now["low"] = row["low"] if now["low"] is None else now["low"]
        now["high"] = now["high"] if row["high"] is None else row["high"]
        now["last"] = now["last"] if row["last"] is None else row["last"]
        now["edits"].append(row["edits"])
        for t in row["repaired"]:
            now["sha"].update((("\n" if now["lines"] else "") + t["role"] + ":" + t["text"]).encode())
            now["lines"] += 1

    def done() -> list:
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        return [now["conv_id"], gaps, *(now[c] for c in SUMS), "".join(now["edits"]), now["sha"].hexdigest()]

    def batch_of(rows: list) -> pa.RecordBatch:
        names = ["conv_id", "gaps", *SUMS, "audit", "repaired_sha256"]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        out = []
        # a few rows at a time: a row may hold a block of BLOCK turns
        for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
            if started and row["conv_id"] != now["conv_id"]:
                out.append(done())
            if not started or row["conv_id"] != now["conv_id"]:
                begin(row)
                started = True
            add(row)
        if out:
            yield batch_of(out)
    if started:
        yield batch_of([done()])


def report(turns: DataFrame) -> DataFrame:
    """REPORT: one row per conversation. A long one's digest is taken over its blocks in order, as they stream by."""
    short, long = repair_blocks(turns)
    ordered = long.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return map_batches(short, summed, REPORT).unionByName(map_batches(ordered, summed, REPORT))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with the faults that the checksum of conv_id:turn names; `gone` marks the rows it drops."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.pmod(F.crc32(F.concat_ws(":", own[0], own[1]).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), own[2].alias("role"), own[3].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def op13_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damaged(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda y: ascii(y)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc
), hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)) FROM kinds)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed
), judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id
), paths AS (
  SELECT conv_id, n, 0 AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM stats
  UNION ALL
  SELECT conv_id, n, i, state, cost, audit, lines FROM (
    SELECT conv_id, n, i, state, cost, audit, lines, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
      SELECT p.conv_id, p.n, p.i + 1 AS i, CASE e.edit WHEN 'D' THEN p.state WHEN 'K' THEN CASE left(j.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE p.state WHEN 2 THEN 3 ELSE 2 END END AS state,
        p.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END AS cost, p.audit || e.edit AS audit,
        CASE e.edit WHEN 'D' THEN p.lines WHEN 'K' THEN list_append(p.lines, j.role || ':' || j.text) ELSE list_append(p.lines, CASE p.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || j.text) END AS lines
      FROM (
        SELECT conv_id, n, i, audit || repeat('I', k) AS audit, cost + 3 * k AS cost,
          CASE WHEN k = 0 THEN state WHEN (state = 2) = (k = 1) THEN 3 ELSE 2 END AS state,
          list_concat(lines, list_transform(range(k), lambda x: CASE WHEN (state = 2) = (x % 2 = 0) THEN 'assistant:' ELSE 'user:' END)) AS lines
        FROM (SELECT *, unnest(range(3)) AS k FROM paths)
      ) p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1, (VALUES ('D'), ('K'), ('R')) e(edit)
      WHERE e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR left(j.role, 1) = CASE p.state WHEN 2 THEN 'a' ELSE 'u' END OR left(j.role, 1) = 's' AND p.state = 0)
    )
  ) WHERE best = 1
), ended AS (
  SELECT conv_id, cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost, audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    list_concat(lines, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END) AS lines FROM paths WHERE i = n
), best AS (
  SELECT conv_id, cost, audit, lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS r FROM ended) WHERE r = 1
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""
