"""Packing into as few sequences as possible by the configuration linear program.

A configuration is a multiset of piece lengths within the limit. How often each is used is a linear program over the
length histogram, which has no more rows than the limit has tokens, however many pieces there are: Spark counts it, and
only it reaches the driver. Multiplicative weights solve the program: each length's weight (at first its share of a
sequence) falls exponentially in how far it is covered, a knapsack by dynamic programming prices the configurations,
and those within a small factor of the best are used as often as what is uncovered allows. While that stays above the bound
of the dual, lengths that ended in wasteful configurations weigh more in a further pass. The uses are rounded down
and the remaining pieces, fewer sequences of them than there are configurations, are filled one by one by subset sums.

Pieces then find their places without a sort: every task numbers its pieces of each length, running counts over the
tasks turn that into a number among all pieces of the length, and the plan, a few rows per configuration, says which
sequence and offset that number has.

Defined cases: null text counts as empty (its end id alone); repeated rows are packed as often as they occur; an empty
table gives an empty result; pieces must lie within the limit (an error otherwise); a null length counts as 0, and
pieces of length 0 go to a sequence of their own; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import free_name, map_batches, staged, table
from .packing import cut_documents
from .token_ids import word_encoder

#: How fast a length's weight falls with its covered share.
RATE = 4.0
#: Configurations priced within this factor of the best one count as best.
NEAR_BEST = 0.98
#: Configurations taken from one pricing, and most pricings in a pass.
COLUMNS, PRICINGS = 32, 2_000
#: Most passes, how much waste raises a weight between them, and the gap to the bound that ends them.
PASSES, DEARER, GAP = 5, 2.0, 0.001
END_ID = 0


class Use(NamedTuple):
    """`uses` sequences that each hold times[i] pieces of length lengths[i]."""

    lengths: tuple[int, ...]
    times: tuple[int, ...]
    uses: float


def knapsack(lengths: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the largest value within c tokens, lengths used any number of times; pick[c]: a length in it or -1."""
    best, pick = np.zeros(limit + 1), np.full(limit + 1, -1)
    ends = np.searchsorted(lengths, np.arange(limit + 1), side="right")
    for c in range(1, limit + 1):
        best[c] = best[c - 1]
        if k := ends[c]:
            value = values[:k] + best[c - lengths[:k]]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-12:
                best[c], pick[c] = value[j], j
    return best, pick


def traced(pick: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """The lengths, by index, of the best filling of room."""
    out = []
    while room > 0:
        if (j := pick[room]) < 0:
            room -= 1
        else:
            out.append(int(j))
            room -= lengths[j]
    return out


def one_pass(lengths: np.ndarray, counts: np.ndarray, limit: int, start: np.ndarray) -> tuple[list[Use], float, np.ndarray]:
    """Configurations with their fractional uses, the dual's bound, and the share of each length's sequences that is empty.

    start: the lengths' weights at first. No length is covered beyond its count.
    """
    uncovered, bound, uses, empty = counts.copy(), 0.0, {}, np.zeros(len(lengths))
    for _ in range(PRICINGS):
        live = np.flatnonzero(uncovered > 1e-9 * counts)
        if not len(live):
            break
        own, covered = lengths[live], 1 - uncovered[live] / counts[live]
        weights = start[live] * np.exp(-RATE * (covered - covered.mean()))
        best, pick = knapsack(own, weights, limit)
        # weights / best[limit] are feasible in the dual of what is live, the others weigh 0
        bound = max(bound, float((counts[live] * weights).sum() / best[limit]))
        near = np.flatnonzero(weights + best[limit - own] >= NEAR_BEST * best[limit])
        for first in near[np.argsort(covered[near] - own[near] / limit / 1000, kind="stable")][:COLUMNS]:
            kinds, times = np.unique([first, *traced(pick, own, limit - own[first])], return_counts=True)
            use = float((uncovered[live[kinds]] / times).min())
            if use > 0:
                uncovered[live[kinds]] -= use * times
                empty[live[kinds]] += use * times * (1 - (own[kinds] * times).sum() / limit)
                key = (tuple(own[kinds].tolist()), tuple(times.tolist()))
                uses[key] = uses.get(key, 0.0) + use
    return [Use(*key, use) for key, use in uses.items()], bound, empty / counts


def fractional(lengths: np.ndarray, counts: np.ndarray, limit: int) -> tuple[list[Use], float]:
    """The best pass's configurations with their uses, and a lower bound of the program by its dual."""
    counts, start, found, bound = counts.astype(float), lengths / limit, [], 0.0
    for _ in range(PASSES):
        uses, below, empty = one_pass(lengths, counts, limit, start)
        bound = max(bound, below)
        total = sum(u.uses for u in uses)
        if not found or total < sum(u.uses for u in found):
            found = uses
        if total <= (1 + GAP) * bound + 1:
            break
        start = start * np.exp(DEARER * empty)
        start /= start.max()
    return found, bound


def fullest(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Lengths out of left whose sum comes nearest to room from below: subset sums as bits, largest lengths first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room or not left[n]:
            continue
        many, size = min(left[n], room // n), 1
        while many:
            take = min(size, many)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            many, size = many - take, size * 2
            if reach >> room:
                many = 0
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, []
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            out += [n] * take
            at -= n * take
    return out


def whole_uses(lengths: np.ndarray, counts: np.ndarray, limit: int) -> tuple[list[Use], float]:
    """Configurations with whole uses that hold every piece once, and the program's lower bound."""
    uses, bound = fractional(lengths, counts, limit)
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    out = []
    for use in sorted(uses, key=lambda u: -u.uses):
        n = int(use.uses + 1e-6)
        n = min([n, *(left[a] // b for a, b in zip(use.lengths, use.times, strict=True))])
        if n:
            out.append(Use(use.lengths, use.times, n))
            for a, b in zip(use.lengths, use.times, strict=True):
                left[a] -= n * b
    order = sorted(left, reverse=True)
    for longest in order:
        while left[longest]:
            left[longest] -= 1
            rest = fullest(order, left, limit - longest)
            for a in rest:
                left[a] -= 1
            kinds, times = np.unique([longest, *rest], return_counts=True)
            # as often as the pieces allow: what is left of one length may be any number
            again = min([left[a] // b for a, b in zip(kinds.tolist(), times.tolist(), strict=True)])
            for a, b in zip(kinds.tolist(), times.tolist(), strict=True):
                left[a] -= again * b
            out.append(Use(tuple(kinds.tolist()), tuple(times.tolist()), 1 + again))
    return out, bound


class Plan:
    """For each length, runs of piece numbers: where a run starts, its first sequence, pieces a sequence, first offset."""

    def __init__(self, uses: list[Use]):
        runs, taken, sequence = {}, {}, 0
        for use in uses:
            offset = 0
            for n, times in zip(use.lengths, use.times, strict=True):
                at = taken.get(n, 0)
                runs.setdefault(n, []).append((at, sequence, times, offset))
                taken[n] = at + times * int(use.uses)
                offset += n * times
            sequence += int(use.uses)
        self.runs = {n: np.array(r, dtype=np.int64).T for n, r in runs.items()}
        self.sequences = sequence

    def places(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the numbers[i]-th piece of length lengths[i]."""
        sequence, offset = np.full(len(lengths), self.sequences, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for n in np.unique(lengths[lengths > 0]):
            here = np.flatnonzero(lengths == n)
            start, first, times, at = self.runs[int(n)]
            run = np.searchsorted(start, numbers[here], side="right") - 1
            whole, part = np.divmod(numbers[here] - start[run], times[run])
            sequence[here], offset[here] = first[run] + whole, at[run] + part * n
        return sequence, offset


def numbered(pieces: DataFrame, limit: int, length: str, part: str, nth: str) -> DataFrame:
    """pieces with the task they were in and their number among that task's pieces of the same length."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, dtype=np.int64)
        for batch in batches:
            n = batch.column(names.index(length)).to_numpy(zero_copy_only=False)
            if len(n) and (n.max() > limit or n.min() < 0):
                raise ValueError(f"a piece of {n.max()} or {n.min()} tokens, limit {limit}")
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order])
            own = np.empty(len(n), dtype=np.int64)
            own[order] = np.arange(len(n)) - first + seen[n[order]]
            seen += np.bincount(n, minlength=limit + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task), pa.int32()), pa.array(own)], names=[*names, part, nth])

    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(nth, T.LongType())])
    return staged(map_batches(pieces, number, schema), "numbered")


def pack_lengths(pieces: DataFrame, limit: int, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: every piece in one sequence of at most limit tokens, in few sequences."""
    part, nth, upto = (free_name(pieces, n) for n in ("part", "nth", "upto"))
    pieces = pieces.withColumn(length, F.coalesce(F.col(length).cast("long"), F.lit(0)))
    rows = numbered(pieces, limit, length, part, nth)
    counts = rows.groupBy(length, part).agg(F.count(F.lit(1)).alias(upto))
    counts = staged(counts.withColumn(upto, F.sum(upto).over(W.partitionBy(length).orderBy(part)) - F.col(upto)), "length-starts")
    histogram = rows.where(F.col(length) > 0).groupBy(length).count().orderBy(length).collect()  # at most `limit` rows
    plan = Plan(whole_uses(np.array([r[0] for r in histogram], dtype=np.int64), np.array([r[1] for r in histogram], dtype=np.int64), limit)[0])
    met = rows.join(counts, [length, part]).withColumn(nth, F.col(nth) + F.col(upto)).select(*pieces.columns, nth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (names.index(length), len(names)))
            sequence, offset = plan.places(n, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_batches(met, place, schema)


def pack_documents(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset. path: the vocabulary's file."""
    pieces = cut_documents(docs, limit, word_encoder, path, END_ID)
    return pack_lengths(pieces.withColumn("piece", (F.col("start") / limit).cast("int")), limit)


def op11_config_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
