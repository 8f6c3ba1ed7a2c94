"""Resampling with replacement on counts by score, for groups of any size.

A resample of k of a group's n rows is wanted only as counts by score. A group of up to LEAF rows draws them one by one,
which SQL can repeat. A larger one is cut into leaves, ranges of scores with about LEAF rows, and k is split down the
binary tree over them: of the draws of a node, the left child gets Binomial(draws, its share of the node's rows). Every
task walks from the root to its own leaf with random numbers that belong to the tree's nodes, so the tasks agree without
meeting. A single score with more than LEAF rows takes its share as it is. Python gets leaves of about PACK_DRAWS draws
together, so that small groups cost little more than their draws, and large leaves one by one: at a time it holds those
leaves' distinct scores and at most LEAF row numbers, whatever n is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..shipping import ship
from ..sources.paths import written

#: Rows of a leaf, drawn one by one; iterations that share a random stream in each node of the tree.
LEAF, CHUNK = 65_536, 50
#: Draws of a unit of work (one leaf, some iterations), about; the modulus of the draws' generator, 2 ** 31 - 1, a prime.
TASK_DRAWS, PRIME = 4_000_000, 2_147_483_647
#: Draws of the units that are handed to Python together; the least that a unit counts for; numbers that stay in a core's cache.
PACK_DRAWS, UNIT_DRAWS, CACHED = 8_000_000, 400_000, 32_768


def _fold(v: np.ndarray, spare: np.ndarray) -> None:
    """v mod PRIME up to a multiple of PRIME, in place: 2 ** 31 is 1 there, so the high bits are added to the low 31."""
    np.right_shift(v, np.uint64(31), out=spare)
    np.bitwise_and(v, np.uint64(PRIME), out=v)
    np.add(v, spare, out=v)


def _below(v: np.ndarray, spare: np.ndarray) -> None:
    """v mod PRIME of v < 2 * PRIME, in place: a difference below zero wraps around to a large number."""
    np.subtract(v, np.uint64(PRIME), out=spare)
    np.minimum(v, spare, out=v)


def draw_rows(seeds: np.ndarray, first: int, count: int, n: int) -> np.ndarray:
    """(iterations, count): the row numbers 0..n-1 of the draws from `first` on; seeds: three numbers a, b, c an iteration.

    Draw j is ((a * j + b) ** 5 + c) mod PRIME mod n, which SQL can repeat; n is a leaf's, j below 2 ** 31.
    """
    a, b, c = (seeds[:, i : i + 1].astype(np.uint64) for i in range(3))
    x = a * np.arange(first, first + count, dtype=np.uint64)
    x += b
    y = np.empty_like(x)
    _fold(x, y)
    _below(x, y)
    y, spare = x * x, y
    _fold(y, spare)  # below 2 ** 32
    np.multiply(y, y, out=y)
    _fold(y, spare)
    _fold(y, spare)  # below 2 ** 31 + 8
    np.multiply(y, x, out=y)
    y += c
    _fold(y, spare)
    _fold(y, spare)
    _below(y, spare)
    rows = y.astype(np.uint32)
    whole = rows // np.uint32(n)
    whole *= np.uint32(n)
    rows -= whole
    return rows


@lru_cache(maxsize=64)
def _endings(iterations: range) -> list[bytes]:
    return [b":%d" % i for i in iterations]


def seeds_of(text: str, iterations: range) -> np.ndarray:
    start, md5 = text.encode(), hashlib.md5
    digests = b"".join([md5(start + i).digest() for i in _endings(iterations)])
    return np.frombuffer(digests, dtype=">u4").reshape(-1, 4)[:, :3].astype(np.int64) % PRIME


def binomial(key: str, draws: np.ndarray, share: float) -> np.ndarray:
    """Binomial(draws[i], share), the same wherever the key is asked for."""
    stream = np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.md5(key.encode()).digest(), "big")))
    return stream.binomial(draws, min(max(share, 0.0), 1.0))


def single_draws(sizes: np.ndarray, seeds: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(iterations, cells): how many of draws[i] row numbers fall into each cell of sizes[c] rows."""
    cells, n, most = len(sizes), int(sizes.sum()), int(draws.max(initial=0))
    cell_of = np.repeat(np.arange(cells), sizes)
    counts = np.zeros((len(seeds), cells), dtype=np.int64)
    deep = max(1, min(most, CACHED))
    wide = max(1, CACHED // deep)
    for at in range(0, len(seeds), wide):
        own, left, into = seeds[at : at + wide], draws[at : at + wide, None], counts[at : at + wide]
        shift = (np.arange(len(own)) * cells)[:, None]
        for first in range(0, most, deep):
            count = min(deep, most - first)
            drawn = np.take(cell_of, draw_rows(own, first + 1, count, n))
            drawn += shift
            drawn = drawn.ravel() if left.min() >= first + count else drawn[np.arange(first, first + count) < left]
            into += np.bincount(drawn, minlength=into.size).reshape(into.shape)
    return counts


def cell_counts(sizes: np.ndarray, text: str, iterations: range, draws: np.ndarray) -> np.ndarray:
    """(iterations, cells): draws[i] rows dealt to cells of sizes[c] rows; cells of many rows by splitting."""
    n = int(sizes.sum())
    if len(sizes) == 1:
        return draws[:, None]
    if n <= LEAF:
        return single_draws(sizes, seeds_of(text, iterations), draws)
    upto = np.cumsum(sizes)
    cut = min(max(int(np.searchsorted(upto, n / 2)), 1), len(sizes) - 1)
    left = binomial(f"{text}:{iterations.start}", draws, upto[cut - 1] / n)
    return np.concatenate((cell_counts(sizes[:cut], text + "<", iterations, left), cell_counts(sizes[cut:], text + ">", iterations, draws - left)), axis=1)


def by_label(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Rows by score and label, in that order."""
    sizes = np.empty(2 * len(pos), dtype=np.int64)
    sizes[0::2], sizes[1::2] = neg, pos
    return sizes


def resampled(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray, seeds: np.ndarray, frac: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(iterations, drawn positives, drawn negatives by score): round(frac * n) single draws, some iterations at a time."""
    sizes = by_label(pos, neg)
    for at in range(0, len(seeds), CHUNK):
        own = seeds[at : at + CHUNK]
        counts = single_draws(sizes, own, np.full(len(own), round(frac * int(sizes.sum()))))
        yield slice(at, at + len(own)), counts[:, 1::2], counts[:, 0::2]


def paths(leaves: DataFrame, by: list[str]) -> DataFrame:
    """by, leaf, path: the nodes from the root to each leaf, as (level, n, left), level falling. leaves: by, leaf, n.

    Node v of a level holds the leaves l with l >> level = v. One row per leaf and level: log2 of the leaves.
    """
    tops = leaves.groupBy(*by).agg(F.max("leaf").alias("_last"))
    levels = leaves.join(tops, by).withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin("_last")))))
    nodes = written(levels.groupBy(*by, "level", F.expr("shiftright(leaf, level)").alias("node")).agg(F.sum("n").alias("n")), "tree-nodes")
    lefts = nodes.where("node % 2 = 0").select(*by, (F.col("level") + 1).alias("level"), F.expr("shiftright(node, 1)").alias("node"), F.col("n").alias("left"))
    steps = levels.where("level > 0").select(*by, "leaf", "level", F.expr("shiftright(leaf, level)").alias("node"))
    met = steps.join(nodes.join(lefts, [*by, "level", "node"]), [*by, "level", "node"])
    return met.groupBy(*by, "leaf").agg(F.sort_array(F.collect_list(F.struct("level", "n", "left")), asc=False).alias("path"))


def units_of(rows: pa.Table, keys: list[str], score: str) -> tuple[np.ndarray, np.ndarray]:
    """(the order of the rows by keys and score, the places in it where the keys change, and its end)."""
    codes = [rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in keys]
    order = np.lexsort((rows.column(score).to_numpy(), *codes))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in codes:
        new[1:] |= np.diff(c[order]) != 0
    return order, np.append(np.flatnonzero(new), len(order))


def resample(hist: DataFrame, by: list[str], measure: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, frac: float, iterations: int, seed: int, alone: tuple[Callable, str] | None = None) -> tuple[DataFrame, bool]:
    """(by, leaf, iteration, and what measure gives; whether any group has more than one leaf).

    hist: by, y_score, pos, neg. measure(scores, drawn positives, drawn negatives), the last two (iterations, scores),
    gives columns, as in `schema`, and `at`, the place of each row's iteration. Small leaves go to Python many at a time.
    alone: measure and schema for when no group has more than one leaf.
    """
    from .metrics import running

    ship(hist.sparkSession)
    hist = written(hist.where("y_score is not null"), "score-counts")
    sizes = hist.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).cast("long").alias("_n"))
    most, work = sizes.agg(F.max("_n"), F.sum(F.greatest(F.col("_n") * (frac * iterations), F.lit(float(UNIT_DRAWS))))).first()
    tall, packs = (most or 0) > LEAF, min(max(1, math.ceil((work or 0) / PACK_DRAWS)), 1 << 30)
    if alone and not tall:
        measure, schema = alone
    if tall:
        begin = running(hist, by, "y_score", ["pos", "neg"])
        hist = written(begin.withColumn("leaf", F.floor((F.col("before_pos") + F.col("before_neg")) / LEAF)).drop("before_pos", "before_neg"), "score-leaves")
    else:
        hist = hist.withColumn("leaf", F.lit(0).cast("long"))
    leaves = hist.groupBy(*by, "leaf").agg(F.sum(F.col("pos") + F.col("neg")).cast("long").alias("n"))
    steps = "array<struct<level:int,n:bigint,left:bigint>>"
    plan = leaves.join(paths(leaves, by), [*by, "leaf"], "left") if tall else leaves.withColumn("path", F.array().cast(steps))
    chunks = -(-iterations // CHUNK)
    # a score of many rows is not drawn row by row
    blocks = F.greatest(F.lit(1), F.least(F.lit(chunks), F.ceil(frac * iterations * F.least("n", F.lit(2 * LEAF)) / TASK_DRAWS))).cast("int")
    group = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    plan = plan.join(sizes, by).select(*by, "leaf", "_n", "path", blocks.alias("_blocks"), group.alias("_group")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    held = hist.join(plan, [*by, "leaf"]).withColumn("_pack", F.pmod(F.xxhash64(*by, "leaf", "_block"), F.lit(packs)))
    names = [f.name for f in StructType.fromDDL(schema)]

    def unit(text: str, leaf: int, path: list[dict], n: int, turns: range, scores: np.ndarray, sizes: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """What measure gives for the chunks `turns` of one leaf of a group of n rows, with `iteration`."""
        k, many = round(frac * n), 1
        if n <= LEAF and turns == range(chunks):  # no tree, so that chunks may be taken together
            many = max(1, 1_000_000 // (CHUNK * len(sizes)))
        for chunk in turns[::many]:
            mine = range(chunk * CHUNK, min((chunk + many) * CHUNK, iterations))
            draws = np.full(len(mine), k)
            for step in path:
                level = step["level"]
                share = binomial(f"{text}|{chunk}|{level}|{leaf >> level}", draws, step["left"] / step["n"])
                draws = draws - share if leaf >> (level - 1) & 1 else share
            counts = cell_counts(sizes, text if n <= LEAF else f"{text}/{leaf}", mine, draws)
            part = measure(scores, counts[:, 1::2], counts[:, 0::2])
            part["iteration"] = part.pop("at") + mine.start
            yield part

    def run(rows: pa.Table) -> pa.Table:
        order, cuts = units_of(rows, [*by, "leaf", "_block"], "y_score")
        heads = order[cuts[:-1]]
        scores, pos, neg = (rows.column(c).to_numpy()[order] for c in ("y_score", "pos", "neg"))
        pos, neg = pos.astype(np.int64), neg.astype(np.int64)
        heading = rows.select(["_group", "leaf", "path", "_n", "_block", "_blocks"]).take(pa.array(heads)).to_pylist()
        found, lengths = [], []
        for h, a, b in zip(heading, cuts[:-1], cuts[1:], strict=True):
            turns = range(chunks)[h["_block"] :: h["_blocks"]]
            parts = list(unit(h["_group"], h["leaf"], h["path"] or [], h["_n"], turns, scores[a:b], by_label(pos[a:b], neg[a:b])))
            found += parts
            lengths.append(sum(len(p["iteration"]) for p in parts))
        whose = pa.array(np.repeat(heads, lengths))
        made = {c: np.concatenate([p[c] for p in found]) for c in ("iteration", *names)}
        return pa.table({**{c: rows.column(c).take(whose) for c in (*by, "leaf")}, **made})

    types = ", ".join(f"`{c}` {dict(hist.dtypes)[c]}" for c in by)
    # a set number of partitions: the counts are small, the work on them is not
    tasks = max(int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")), hist.sparkSession.sparkContext.defaultParallelism)
    return held.repartition(tasks, "_pack").groupBy("_pack").applyInArrow(run, f"{types}, leaf long, iteration long, {schema}"), tall


def auc_parts(pos: np.ndarray, neg: np.ndarray) -> dict[str, np.ndarray]:
    """at, p, n, u: drawn rows of each class, and the pairs in order, ties as halves."""
    below = np.cumsum(neg, axis=1) - neg
    return {"at": np.arange(len(pos)), "p": pos.sum(axis=1), "n": neg.sum(axis=1), "u": (pos * (below + neg / 2)).sum(axis=1)}


def auc_moments(pos: np.ndarray, neg: np.ndarray) -> dict[str, np.ndarray]:
    """One row: how many of the iterations drew both classes, and their aucs' mean and sum of squared deviations."""
    parts = auc_parts(pos, neg)
    both = (parts["p"] > 0) & (parts["n"] > 0)
    auc = parts["u"][both] / (parts["p"][both].astype(float) * parts["n"][both])
    mean = auc.mean() if len(auc) else 0.0
    return {"at": np.arange(1), "count": np.array([len(auc)]), "mean": np.array([mean]), "m2": np.array([((auc - mean) ** 2).sum()])}


def joined_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """by, count, mean, m2 of all iterations from auc_moments of some (at most iterations / CHUNK rows a group)."""
    def join(a, b):
        n, off = a["count"] + b["count"], b["mean"] - a["mean"]
        return F.struct(n.alias("count"), (a["mean"] + off * b["count"] / n).alias("mean"), (a["m2"] + b["m2"] + off * off * a["count"] * b["count"] / n).alias("m2"))

    start = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    each = moments.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("iteration", "count", "mean", "m2"))).alias("_m"))
    return each.select(*by, F.aggregate(F.filter("_m", lambda x: x["count"] > 0), start, join).alias("_m")).select(*by, "_m.*")


def auc_by_iteration(parts: DataFrame, by: list[str], tall: bool) -> DataFrame:
    """by, iteration, auc (null where a class is absent) from auc_parts of leaves: negatives of lower leaves lie below."""
    if tall:
        lower = W.partitionBy(*by, "iteration").orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("u", F.col("u") + F.col("p") * F.coalesce(F.sum("n").over(lower), F.lit(0)))
        parts = parts.groupBy(*by, "iteration").agg(*[F.sum(c).alias(c) for c in ("p", "n", "u")])
    return parts.select(*by, "iteration", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p").cast("double") * F.col("n"))).alias("auc"))
