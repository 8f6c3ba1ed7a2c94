"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates a vector by rounds of random signs and fast Hadamard transforms and takes the nearest signed axis
as bucket. Vectors are dealt to shards of a bounded number by a hash of the id, and each shard, one task, keeps all
tables of its own vectors. Every query goes to every shard once, probes the buckets of its largest coordinates in every
table there, and what it meets is ranked by exact inner products in double precision; the best k of each shard are
then ranked together. Queries that meet fewer than k vectors in all shards are then compared with all, in blocks.

Vectors of unequal lengths get a further coordinate that makes their lengths equal, so that the largest inner
product is the nearest angle; scores stay those of the vectors as given.

Defined cases: vectors null, zero, with null or non-finite components or of another dimension than most take no part,
as queries or candidates; rows without an id neither; a repeated id is one candidate with its best score; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import map_batches, staged, table

#: Vectors that meet queries in one product, and vectors of a shard, about.
PART, SHARD = 2048, 65_536
#: Buckets that a query probes in each table, by the hashes of a bucket: recall 0.9 and more on evenly spread vectors.
PROBES = {1: 16, 2: 1600}


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


class CrossPolytope:
    """Bucket orders of unit vectors in several tables.

    A hash is an axis, or dim + axis for its negative; a bucket is one hash, or two of different rotations.
    """

    def __init__(self, dim: int, tables: int, hashes: int = 1, seed: int = 7, rounds: int = 3):
        self.dim = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice((-1.0, 1.0), size=(tables, hashes, rounds, self.dim))

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """(tables, rows, count): each row's buckets, those of the largest coordinates (or sums of two) first."""
        x = np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))
        out = []
        for table in self.signs:
            bucket, score = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
            for rounds in table:
                y = x
                for signs in rounds:
                    y = hadamard(y * signs)
                y = np.concatenate((y, -y), axis=1)
                axis, y = self._largest(np.broadcast_to(np.arange(y.shape[1]), y.shape), y, count)
                bucket = (bucket[:, :, None] * (2 * self.dim) + axis[:, None, :]).reshape(len(x), -1)
                score = (score[:, :, None] + y[:, None, :]).reshape(len(x), -1)
                bucket, score = self._largest(bucket, score, count)
            out.append(bucket)
        return np.stack(out)

    @staticmethod
    def _largest(items: np.ndarray, score: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.argpartition(-score, count - 1, axis=1)[:, :count] if count < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(score), 1))
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(score, at, axis=1), axis=1, kind="stable"), axis=1)
        return np.take_along_axis(items, at, axis=1), np.take_along_axis(score, at, axis=1)


class Shard:
    """A task's vectors, in buckets by each table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bucket: np.ndarray, buckets: int):
        """bucket: (tables, rows)."""
        self.ids, self.vectors = ids, vectors
        self.order = [np.argsort(b, kind="stable").astype(np.int32) for b in bucket]
        self.starts = [np.searchsorted(b[o], np.arange(buckets + 1)) for b, o in zip(bucket, self.order, strict=True)]
        self.most = int(np.unique(ids, return_counts=True)[1].max(initial=1))  # rows of one id

    def met(self, probes: np.ndarray | None, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, rows) that meet; probes (tables, queries, count), None: all of n queries meet all rows."""
        if probes is None:
            yield np.arange(n), np.arange(len(self.ids))
            return
        for order, starts, near in zip(self.order, self.starts, probes, strict=True):
            asked = np.argsort(near.ravel(), kind="stable")
            which = near.ravel()[asked]
            cuts = np.flatnonzero(np.diff(which, prepend=-1))
            for at, to in zip(cuts, [*cuts[1:], len(which)], strict=True):
                rows = order[starts[which[at]] : starts[which[at] + 1]]
                if len(rows):
                    yield asked[at:to] // near.shape[1], rows

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, probes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, ids, scores) of the k largest inner products that each query meets here, its own id left out; ties to smaller ids."""
        floor, found, pooled = np.full(len(queries), -np.inf), [], 0
        least = (k + 1) * self.most  # so many rows hold k ids besides the query's own
        below = lambda score: score - 1e-9 * np.maximum(1, np.abs(score))

        def merged():
            q, row, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
            ids = self.ids[row]
            order = np.lexsort((-score, ids, q))
            q, ids, row, score = q[order], ids[order], row[order], score[order]
            once = np.ones(len(q), dtype=bool)  # met in several tables, or a repeated id: the best score
            once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
            q, ids, row, score = q[once], ids[once], row[once], score[once]
            order = np.lexsort((ids, -score, q))
            q, row, score = q[order], row[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            floor[q[last]] = np.maximum(floor[q[last]], below(score[last]))
            return q[place < k], row[place < k], score[place < k]

        for asked, rows in self.met(probes, len(queries)):
            for at in range(0, len(rows), PART):
                part = rows[at : at + PART]
                vectors = self.vectors[part]
                for on in range(0, len(asked), 256):
                    q = asked[on : on + 256]
                    score = queries[q] @ vectors.T
                    good = score >= floor[q][:, None]
                    if len(part) >= least and np.count_nonzero(good) > 2 * least * len(q):
                        kth = np.partition(score, len(part) - least, axis=1)[:, len(part) - least]
                        floor[q] = np.maximum(floor[q], np.where(np.isfinite(kth), below(kth), -np.inf))
                        good = score >= floor[q][:, None]
                    i, j = np.nonzero(good & np.isfinite(score))
                    i, j = q[i], part[j]
                    other = query_ids[i] != self.ids[j]
                    i, j = i[other], j[other]
                    found.append((i, j, np.einsum("ij,ij->i", queries[i], self.vectors[j])))
                    pooled += len(i)
                    if pooled > 8 * k * len(queries) + 100_000:
                        found = [merged()]
                        pooled = len(found[0][0])
        q, row, score = merged()
        return query_ids[q], self.ids[row], score


FOUND = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = 20, tables: int = 8, probes: int | None = None, hashes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that is_query (a Column) marks.

    A bucket is one hash or two: two, which make 2 * dim times as many buckets, where one hash would leave more than
    PART vectors of a shard in a bucket on average. Two hashes need more probes for the same recall (PROBES).
    """
    if hashes not in (None, 1, 2):
        raise ValueError("a bucket is one hash or two")
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # half the bytes, the same numbers
    value = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    sound = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = staged(rows.where("vec_id is not null").where(F.coalesce(sound, F.lit(False))), "vectors")
    length = F.expr("sqrt(aggregate(v, 0d, (a, x) -> a + double(x) * double(x)))")
    # one row for each dimension that occurs
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"), F.min(length).alias("shortest")).orderBy(F.desc("n"), "d").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, longest = top["d"], top["longest"]
    lift = top["shortest"] < longest * (1 - 1e-4)
    rows = rows.where(F.size("v") == dim)
    machine_dim, axes = dim + lift, 2 << max(1, (dim + lift - 1).bit_length())
    hashes = hashes or (1 if min(top["n"], SHARD) <= axes * PART else 2)
    buckets = axes**hashes
    probes = min(probes or PROBES[hashes], buckets)
    shards = max(-(-top["n"] // SHARD), min(spark.sparkContext.defaultParallelism, top["n"] // PART + 1))
    step = 512 if hashes == 1 else 32  # rows hashed at once: two hashes order the sums of all pairs of axes

    def task(every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, held, shard = CrossPolytope(machine_dim, tables, hashes), [], None

            def unit(x: np.ndarray, asks: bool) -> np.ndarray:
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                if lift and asks:
                    return np.pad(x / norm, ((0, 0), (0, 1)))
                if lift:
                    return np.concatenate((x, np.sqrt(np.maximum(0, longest**2 - norm**2))), axis=1) / longest
                return x / norm

            def hashed(x: np.ndarray, asks: bool) -> np.ndarray:
                return np.concatenate([machine.probes(unit(x[at : at + step], asks), probes if asks else 1) for at in range(0, len(x), step)], axis=1)

            for b in batches:
                if not b.num_rows:
                    continue
                ids, asks = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)
                first = int(np.searchsorted(asks, True))  # vectors come before queries
                if first:
                    held.append((ids[:first], x[:first]))
                if first < len(ids) and held:
                    own, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
                    bucket = np.zeros((0, len(own)), dtype=np.int64) if every else hashed(vectors, False)[:, :, 0]
                    shard, held = Shard(own, vectors, bucket, buckets), []
                for at in range(first, len(ids) if shard else 0, 1024):
                    some = x[at : at + 1024]
                    found = shard.nearest(ids[at : at + 1024], some, k, None if every else hashed(some, True))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

        return run

    def meet(asked: DataFrame, every: bool) -> DataFrame:
        """FOUND rows: all vectors in shards, the queries in each of them."""
        shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
        both = rows.select(shard.alias("shard"), "vec_id", "v", F.lit(False).alias("is_query"))
        both = both.union(asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v", F.lit(True).alias("is_query")))
        spread = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("is_query")
        return map_batches(spread.select("vec_id", "v", "is_query"), task(every), FOUND)

    best = lambda d: d.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    asked = rows.where("is_query")
    found = staged(best(meet(asked, False)), "met")
    counts = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    short = staged(asked.select("vec_id").distinct().join(counts, "vec_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id"), "short")
    if not short.isEmpty():
        found = best(found.union(meet(asked.join(short, "vec_id").select("vec_id", "v"), True)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
