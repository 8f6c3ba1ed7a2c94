"""Exact nearest rows in a metric partition: pairs of cells out of reach are neither shipped nor compared.

Rows of both sides belong to the cell of their nearest pivot. A first pass compares rows with the cell they lie in,
which gives each row a distance within which its k nearest must be. By the triangle inequality, a row needs a further
cell only if that distance reaches over the cell's ring (least to greatest distance of its rows from the pivot) and
over the plane between the two pivots; a second pass compares it with those cells alone. Left rows lie in units of
neighbouring cells, HELD rows at most; a task holds one unit, a cell of the right is sent once to each unit that has a
row in need of it, and its rows pass by. So however many cells are needed, the right is sent as often as there are units
at most, and no task holds more than a unit and a block. Equal vectors are compared once: of many equal rows only the
first k + 1 ids can be among anyone's k nearest, and equal rows have the same neighbours but for themselves.

Vectors spread evenly in many dimensions have no near cells, and then all pairs are compared, as any exact method must.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..hashing import hash_key
from ..shipping import ship
from ..sources.paths import written

#: Rows of one block: a matrix product has so many of either side at most.
BLOCK = 2048
#: Rows of the left that a task holds at most and at least (where there are more), about; pairs measured at once.
HELD, FEWEST, PIECE = 32_768, 1024, 500_000
#: Rows of a cell on average, and most pivots: what every task holds of them.
CELL, PIVOTS = 256, 1024


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - (a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-12)) @ (b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-12)).T


MEASURES = {"euclidean": euclidean, "cosine": cosine_distance}


class Space:
    """Where bounds are taken: rows as they are, or for cosine on the unit sphere (there 1 - cos is half the squared distance)."""

    def __init__(self, metric: str, pivots: np.ndarray):
        self.cosine = metric == "cosine"
        self.pivots = self.points(pivots)
        self.apart = euclidean(self.pivots, self.pivots)

    def points(self, v: np.ndarray) -> np.ndarray:
        return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12) if self.cosine else v

    def gaps(self, v: np.ndarray) -> np.ndarray:
        """(rows, pivots): distances from the pivots."""
        return euclidean(self.points(v), self.pivots)

    def reach(self, distance: np.ndarray) -> np.ndarray:
        """A distance of the measure as one of this space, a little more for rounding."""
        return (np.sqrt(2 * np.maximum(distance, 0)) if self.cosine else distance) * (1 + 1e-6) + 1e-6 * (1 + self.apart.max(initial=0))

    def needed(self, gaps: np.ndarray, own: np.ndarray, reach: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """(rows, pivots): cells that may hold a row within reach; inner and outer are the cells' rings."""
        ring = np.maximum(gaps - outer[None], inner[None] - gaps)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (gaps**2 - np.take_along_axis(gaps, own[:, None], 1) ** 2) / (2 * self.apart[own])
        out = np.maximum(ring, np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0)) <= reach[:, None]
        out[np.arange(len(own)), own] = False  # done in the first pass
        return out


def chained(v: np.ndarray) -> np.ndarray:
    """The rows so that each is followed by the nearest one left."""
    left, order = np.arange(1, len(v)), [0]
    while len(left):
        at = ((v[left] - v[order[-1]]) ** 2).sum(axis=1).argmin()
        order.append(int(left[at]))
        left = np.delete(left, at)
    return v[order]


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


class Near:
    """The k nearest rows so far of the left rows that a task holds; right rows pass by in pieces.

    A matrix product finds what may come within a row's bound, and those pairs alone are measured, by differences.
    """

    def __init__(self, metric: str, v: np.ndarray, k: int, bound: np.ndarray):
        self.cosine, self.v, self.k, self.bound, self.found, self.pooled = metric == "cosine", v, k, bound.copy(), [], 0
        self.size = (v * v).sum(1)
        self.x = self.unit(v) if self.cosine else np.concatenate((v, np.ones((len(v), 1))), axis=1)

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)

    def least(self, rows: np.ndarray, most: float) -> np.ndarray:
        """The products that pairs within the bound have at least, a little less for rounding; most: largest squared length on the right."""
        if self.cosine:
            return 1 - self.bound[rows] - 2e-9
        size = self.size[rows]
        return (size - (self.bound[rows] + 2e-9) ** 2) / 2 - 1e-12 * (1 + size + most)

    def measured(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.cosine:
            return np.round(1 - np.einsum("ij,ij->i", self.unit(a), self.unit(b)), 9)
        return np.round(np.sqrt(((a - b) ** 2).sum(axis=1)), 9)

    def meet(self, rows: np.ndarray, ids: np.ndarray, w: np.ndarray) -> None:
        """Compare left rows with right rows."""
        size = (w * w).sum(1)
        y, most = self.unit(w) if self.cosine else np.concatenate((w, -size[:, None] / 2), axis=1), size.max(initial=0)
        for at in range(0, len(rows), BLOCK):
            r = rows[at : at + BLOCK]
            product = self.x[r] @ y.T
            close = product >= self.least(r, most)[:, None]
            if len(ids) >= self.k and np.count_nonzero(close) > 4 * self.k * len(r):
                kth = np.partition(product, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                far = 1 - kth if self.cosine else np.sqrt(np.maximum(0, self.size[r] - 2 * kth) + 1e-12 * (1 + self.size[r] + most))
                self.bound[r] = np.minimum(self.bound[r], far + 2e-9)
                close = product >= self.least(r, most)[:, None]
            i, j = np.nonzero(close)
            for on in range(0, len(i), PIECE):  # of many ties only so many at a time
                a, b = r[i[on : on + PIECE]], j[on : on + PIECE]
                self.found.append((a, ids[b], self.measured(self.v[a], w[b])))
                self.pooled += len(a)
                if self.pooled > 4 * self.k * len(self.v) + PIECE:
                    self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, id, distance of the k nearest; ties to smaller ids."""
        row, other, d = (np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        order = np.lexsort((other, d, row))
        row, other, d = row[order], other[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.bound[row[last]] = np.minimum(self.bound[row[last]], d[last])
        keep = place < self.k
        self.found, self.pooled = [(row[keep], other[keep], d[keep])], int(keep.sum())
        return self.found[0]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a column of lists."""
    if len(column) and (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def compared(a: DataFrame, b: DataFrame, k: int, by: list[str], metric: str, tally: Accumulator | None, tasks: int, cells) -> DataFrame:
    """by, id, other, distance: the k nearest rows of b for each row of a, in the cells that it needs.

    a: by, unit, id, v, cell, kth (null: none yet); b: by, unit, id, v, cell, a row for each unit that it goes to. cells(v, cell, kth) are the (rows, cells) that rows of a need. A task holds the rows of a of one unit, and
    those of b pass by, cell by cell.
    """
    key = F.to_json(F.struct(*by, "unit")) if by else F.col("unit").cast("string")
    where = F.pmod(F.xxhash64("_key"), F.lit(tasks)).cast("int") if by else F.col("unit").cast("int")
    columns = [key.alias("_key"), F.col("unit"), *by, "id", "v", "cell"]
    both = a.select(*columns, "kth", F.lit(0).alias("_side")).unionByName(b.select(*columns, F.lit(None).cast("double").alias("kth"), F.lit(1).alias("_side")))
    both = both.withColumn("_task", where).repartitionById(tasks, F.col("_task")).sortWithinPartitions("_key", "_side", "cell").select("_key", "_side", *by, "id", "v", "cell", "kth")

    def run(batches):
        key, side, held, near = None, 0, [], None

        def results():
            row, other, d = near.merge()
            for at in range(0, len(row), PIECE):
                part = slice(at, at + PIECE)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row[part])).combine_chunks() for c in groups], pa.array(ids[row[part]]), pa.array(other[part]), pa.array(d[part])], [*by, "id", "other", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sides = batch.column("_key").to_numpy(zero_copy_only=False), batch.column("_side").to_numpy()
            own = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1]) | (sides[1:] == 1) & (own[1:] != own[:-1])) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(start, end - start)
                if keys[start] != key:
                    if near is not None:
                        yield from results()
                    key, held, near = keys[start], [], None
                if not sides[start]:
                    held.append(part)
                    continue
                if near is None:
                    if not held:  # no row asks
                        continue
                    left = pa.Table.from_batches(held)
                    ids, groups, kth = left.column("id").to_numpy(), [left.column(c) for c in by], left.column("kth").to_numpy()
                    width = len(left.column("v")[0])
                    v = np.concatenate([matrix(c, width) for c in left.column("v").chunks])
                    need = cells(v, left.column("cell").to_numpy(), kth)
                    near, held = Near(metric, v, k, np.nan_to_num(kth, nan=np.inf)), []
                rows = np.flatnonzero(need[:, own[start]])
                if tally is not None:
                    tally.add(len(rows) * (end - start))
                w, others = matrix(part.column("v"), width), part.column("id").to_numpy()
                for at in range(0, len(w), BLOCK):
                    near.meet(rows, others[at : at + BLOCK], w[at : at + BLOCK])
        if near is not None:
            yield from results()

    schema = T.StructType([a.schema[c] for c in by] + [T.StructField("id", T.LongType()), T.StructField("other", T.LongType()), T.StructField("distance", T.DoubleType())])
    return both.mapInArrow(run, schema)


def first_k(found: DataFrame, k: int, by: list[str], name: str = "_r") -> DataFrame:
    return found.withColumn(name, F.row_number().over(W.partitionBy(*by, "id").orderBy("distance", "other"))).where(F.col(name) <= k)


def nearest(left: DataFrame, right: DataFrame, k: int, key: str, vector: str, by: list[str] = (), metric: str = "euclidean", tally: Accumulator | None = None) -> DataFrame:
    """id, other, distance: the k nearest rows of right for each row of left, its own id left out, inside equal `by`.

    Distances are rounded to 9 places and ties go to smaller ids. Rows without a vector, with a component that
    is null or not finite, or with a null in `by`, have no neighbours and are none. tally counts the pairs that are compared.
    """
    spark, by = left.sparkSession, list(by)
    ship(spark)
    names = [f"_by{i}" for i in range(len(by))]
    rows = lambda df: df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(reduce(lambda a, c: a & F.col(c).isNotNull(), names, F.expr("forall(v, x -> x is not null and abs(x) < double('infinity'))")))
    group = [*names, "v"]
    # one row for equal vectors on the left, the first k + 1 ids on the right
    members = written(rows(left), "neighbors-left")
    a = members.groupBy(*group).agg(F.min("id").alias("id"))
    b = rows(right).distinct().withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    b = written(b, "neighbors-right")
    rows_right = b.count()
    many = max(1, min(PIVOTS, rows_right // CELL)) if rows_right > BLOCK else 1  # one block is one product
    sample = b.orderBy(hash_key(7, "id"), "id").select("v").limit(many).toPandas()  # PIVOTS rows
    if sample.empty:
        return spark.createDataFrame([], "id long, other long, distance double")
    space = Space(metric, chained(stacked(sample["v"])))

    def assign(frames):
        for f in frames:
            for at in range(0, len(f), BLOCK):
                part = f.iloc[at : at + BLOCK]
                gaps = space.gaps(stacked(part["v"]))
                yield part.assign(cell=gaps.argmin(axis=1).astype("int32"), gap=gaps.min(axis=1))

    placed = lambda df, name: written(df.mapInPandas(assign, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])), name)
    a, b = placed(a.select(*names, "id", "v"), "neighbors-cells-left"), placed(b.select(*names, "id", "v"), "neighbors-cells-right")
    # units: cells one after the other, cut where a task has its rows
    cores = spark.sparkContext.defaultParallelism
    rows_left = a.count()
    held = max(FEWEST, -(-rows_left // (cores * max(1, -(-rows_left // (cores * HELD))))))
    tasks = max(1, -(-rows_left // held)) if not by else max(cores, 2 * rows_left // held)
    spans = a.groupBy(*names, "cell").agg(F.count(F.lit(1)).alias("_n"))
    spans = spans.withColumn("_start", F.sum("_n").over(W.partitionBy(*(names or [F.lit(0)])).orderBy("cell")) - F.col("_n"))  # a row for each cell of a group, PIVOTS at most
    a = a.join(spans, [*names, "cell"]).withColumn("unit", F.floor((F.col("_start") + F.pmod(F.xxhash64("id"), F.col("_n"))) / held).cast("long")).drop("_n", "_start", "gap")

    def own_cell(v: np.ndarray, cell: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return cell[:, None] == np.arange(many)[None]

    sent = lambda routes: b.drop("gap").join(routes, [*names, "cell"])  # noqa: E731  to each unit that needs a cell
    own = compared(a.withColumn("kth", F.lit(None).cast("double")), sent(a.select(*names, "cell", "unit").distinct()), k + 1, names, metric, tally, tasks, own_cell)
    if many == 1:
        near = own
    else:
        own = first_k(written(own, "neighbors-own"), k + 1, names)
        rings = b.groupBy("cell").agg(F.min("gap").alias("inner"), F.max("gap").alias("outer"), F.count(F.lit(1)).alias("n")).toPandas()  # a row per pivot
        inner, outer, sizes = np.full(many, np.inf), np.full(many, -np.inf), np.zeros(many, dtype=np.int64)
        inner[rings["cell"]], outer[rings["cell"]], sizes[rings["cell"]] = rings["inner"], rings["outer"], rings["n"]
        grouped = bool(by)

        def further(v: np.ndarray, cell: np.ndarray, kth: np.ndarray) -> np.ndarray:
            out = np.zeros((len(v), many), dtype=bool)
            for at in range(0, len(v), BLOCK):
                part = slice(at, at + BLOCK)
                gaps, reach = space.gaps(v[part]), space.reach(np.nan_to_num(kth[part], nan=np.inf))
                few = np.flatnonzero(~np.isfinite(reach))
                if len(few) and not grouped:  # whole cells lie within gap + outer: those with k + 1 rows together
                    far = np.where(sizes > 0, gaps[few] + outer, np.inf)
                    order = np.argsort(far, axis=1)
                    enough = (np.cumsum(sizes[order], axis=1) > k).argmax(axis=1)
                    bound = np.take_along_axis(np.take_along_axis(far, order, 1), enough[:, None], 1)[:, 0]
                    # a zero vector is 1 from all others, whatever the sphere says
                    reach[few] = np.where(sizes.sum() > k, np.maximum(bound, 1.5 if space.cosine else 0) * (1 + 1e-6) + 1e-6, np.inf)
                out[part] = space.needed(gaps, cell[part], reach, inner, outer) & (sizes > 0)[None]
            return out

        def needs(frames):
            """unit, cell: what rows need, once for each of some rows' units."""
            for f in frames:
                need = further(stacked(f["v"]), f["cell"].to_numpy(), f["kth"].to_numpy(dtype=float, na_value=np.nan)) if len(f) else None
                for _, at in f.reset_index(drop=True).groupby([*names, "unit"], sort=False).indices.items():
                    to = np.flatnonzero(need[at].any(axis=0))
                    if len(to):
                        out = f.iloc[np.repeat(at[0], len(to))][[*names, "unit"]].reset_index(drop=True)
                        out["cell"] = to.astype("int32")
                        yield out

        kth = own.where(F.col("_r") == k + 1).select(*names, "id", F.col("distance").alias("kth"))
        a = written(a.join(kth, [*names, "id"], "left").select(*names, "unit", "id", "v", "cell", "kth"), "neighbors-bounds")
        routes = a.mapInPandas(needs, T.StructType([*[a.schema[c] for c in names], a.schema["unit"], a.schema["cell"]])).distinct()
        more = compared(a, sent(written(routes, "neighbors-routes")), k + 1, names, metric, tally, tasks, further)
        near = first_k(own.drop("_r").unionByName(more), k + 1, names).drop("_r")
    # back to all rows of the left, without themselves
    reps = a.select(*names, "v", F.col("id").alias("_rep"))
    met = members.join(reps, group).select(*names, F.col("id").alias("_id"), "_rep").join(near.withColumnRenamed("id", "_rep"), [*names, "_rep"])
    met = met.where("_id <> other").groupBy(F.col("_id").alias("id"), "other").agg(F.min("distance").alias("distance"))  # repeated rows count once
    return first_k(met, k, []).drop("_r")
