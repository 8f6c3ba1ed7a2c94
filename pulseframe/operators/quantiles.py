"""Exact quantiles of columns of any length, several at once, without gathering a column's values anywhere.

An order statistic is found by narrowing an open interval: an approximate percentile, whose sketch has a fixed size,
gives two values around the wanted rank, and exact counts below, at and between them say in which part the rank lies,
or that it is one of the two. Each round leaves about a thousandth of the rows; values are only gathered when KEEP or
fewer are left. Counts decide, so the result is exact whatever the sketch says; all targets share each round's two jobs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are gathered in the end; the margin around the wanted fraction, and the sketch's accuracy.
KEEP, MARGIN, ACCURACY = 4096, 0.0005, 10_000


@dataclass
class Target:
    """The rank-th smallest value of a column (from 0) among those in the open interval (low, high), of which there are n."""

    column: Column
    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        x = self.column
        out = x.isNotNull()
        out = out if self.low is None else out & (x > self.low)
        return out if self.high is None else out & (x < self.high)

    def narrow(self, low: float, high: float, counts: list[int]) -> None:
        """counts: inside below low, at low, between, at high (0 if low = high)."""
        rank = self.rank
        for size, found in zip(counts, ((self.low, low), low, (low, high), high), strict=True):
            if rank < size:
                break
            rank -= size
        else:
            size, found = self.n - sum(counts), (high, self.high)
        if isinstance(found, tuple):
            self.low, self.high = found
            self.rank, self.n = rank, size
        else:
            self.value = found


def order_statistics(df: DataFrame, targets: list[Target]) -> None:
    """Sets the targets' values."""
    while wide := [t for t in targets if t.value is None and t.n > KEEP]:
        around = [F.percentile_approx(F.when(t.inside(), t.column), [max(0.0, t.rank / t.n - MARGIN), min(1.0, t.rank / t.n + MARGIN)], ACCURACY) for t in wide]
        ends = list(df.agg(*[c.alias(f"e{i}") for i, c in enumerate(around)]).first())  # two numbers a target
        counts = []
        for t, (low, high) in zip(wide, ends, strict=True):
            x, within = t.column, t.inside()
            counts += [F.count(F.when(within & c, 1)) for c in (x < low, x == low, (x > low) & (x < high), (x == high) & F.lit(high > low))]
        found = list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first())
        for i, (t, (low, high)) in enumerate(zip(wide, ends, strict=True)):
            t.narrow(low, high, found[4 * i : 4 * i + 4])
    if last := [t for t in targets if t.value is None]:
        lists = df.agg(*[F.sort_array(F.collect_list(F.when(t.inside(), t.column))).alias(f"v{i}") for i, t in enumerate(last)]).first()  # KEEP values a target
        for t, values in zip(last, lists, strict=True):
            t.value = values[t.rank]


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float | None]]:
    """name -> the column's quantiles at the fractions, linear between neighbours as `percentile` has them; null without values.

    wanted: name -> (numeric column, fractions). df is read twice a round: write it first where it is dear.
    """
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, (c, _) in enumerate(wanted.values())]).first()
    targets: dict[tuple[str, int], Target] = {}
    for (name, (column, fractions)), n in zip(wanted.items(), sizes, strict=True):
        for f in fractions if n else []:
            for rank in (math.floor(f * (n - 1)), math.ceil(f * (n - 1))):
                targets.setdefault((name, rank), Target(column.cast("double"), rank, n))
    order_statistics(df, list(targets.values()))
    out = {}
    for (name, (_, fractions)), n in zip(wanted.items(), sizes, strict=True):
        out[name] = []
        for f in fractions:
            at = f * (n - 1)
            low, high = (targets[name, r].value if n else None for r in (math.floor(at), math.ceil(at)))
            out[name].append(low if not n or low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out
