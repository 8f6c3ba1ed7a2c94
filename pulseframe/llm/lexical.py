"""Ranked lexical search, term at a time with limited accumulators.

One pass over the texts keeps, for each document, its length and how often it holds each of the queries' terms. Counts
by term give the terms' weights and an upper bound of what a term can add to any score. Then, in rounds, every query
creates accumulators (one per document that holds one of its terms) from its rarest terms only: a round adds up those
terms' shares for all documents, and the k-th best partial score so far is found. Once the bounds of all further terms
together are below it, no document without an accumulator can come among the first k, and the query creates no more;
until then the next round takes twice as many terms. The last pass drops accumulators that the bounds rule out and
adds the remaining terms to the others exactly.

A document's terms lie in one row, so accumulators never travel: each task keeps its first k of each query, and only
those are ranked over the tasks. Queries go in blocks of a bounded number of terms, which is what the driver and each
task hold of them; the number of documents bounds nothing.

Defined cases: null and empty texts have no terms and are never found; queries without terms, or whose terms no
document holds, find nothing; a repeated query row finds its documents again; repeated documents rank one by one;
documents without an id come after those with the same score; an empty table gives an empty result; further columns
are not read. Weights of terms that nearly all documents hold are 0, and scores of 0 are not found.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_batches, staged, table

#: ASCII that ends a term.
STOPS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII folded to lower case, and everything that ends a term to a space.
FOLD = bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Query terms that are searched together (a single query may have more).
BLOCK_TERMS = 500_000
#: Documents whose accumulators a task holds at once.
STEP_DOCS = 500


def terms(text: Column) -> Column:
    """The terms of a text, in order."""
    return F.filter(F.split(F.translate(text.cast("string"), UPPER, LOWER), f"[{STOPS}]+"), lambda t: t != "")


def index(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms in all), terms (ascending numbers in vocabulary), times: one row per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): i for i, t in enumerate(vocabulary)}
        known = number.keys()
        for batch in batches:
            sizes, ends, found, times = [], [0], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().translate(FOLD).split()
                held = Counter(filter(known.__contains__, words))
                own = sorted((number[w], n) for w, n in held.items())
                sizes.append(len(words))
                found += [a for a, _ in own]
                times += [b for _, b in own]
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), count, "doc_id long, n long, terms array<int>, times array<int>")


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Queries:
    """A block's queries as arrays: each query's terms rarest first, their weights, and the bounds of what they can add."""

    def __init__(self, asked: list[tuple[int, int, int]], stats: dict[int, tuple[int, int, int]], vocabulary: int, n_docs: int, n_terms: int):
        """asked: (query, term, times); stats: term -> (documents, most times, fewest terms of a document that holds it)."""
        self.n_docs, self.n_terms, self.vocabulary = n_docs, n_terms, vocabulary
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, (df, _, _) in stats.items()}
        rows = sorted((q, stats[t][0], t, times * weight[t]) for q, t, times in asked if weight.get(t, 0) > 0)
        self.query, self.df, self.term, self.weight = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 4))
        best = [impact(stats[t][1], self.slow(stats[t][2])) for _, _, t, _ in rows]
        self.count = int(max((q for q, _, _ in asked), default=-1)) + 1
        self.start = np.searchsorted(self.query, np.arange(self.count + 1))
        upto = np.concatenate(([0], np.cumsum(self.weight * np.array(best, dtype=np.int64))))
        self.before = upto[:-1] - upto[self.start[self.query]]  # bounds of the rarer terms
        self.total = upto[self.start[1:]] - upto[self.start[:-1]]

    def slow(self, n):
        """m of a document of n terms."""
        return 25 + (75 * n * self.n_docs) // self.n_terms

    def beyond(self, stop: np.ndarray) -> np.ndarray:
        """What the terms from place stop[q] on can add to a score of query q."""
        end = self.start[1:] - self.start[:-1]
        before = np.append(self.before, 0)[np.minimum(self.start[:-1] + stop, len(self.before))]
        return np.where(stop >= end, 0, self.total - before)

    def first_stop(self) -> np.ndarray:
        """The fewest terms after which a query can be done: their bounds are above those of the rest."""
        half = self.before * 2 >= self.total[self.query]
        more = np.bincount(self.query[half], minlength=self.count)
        end = self.start[1:] - self.start[:-1]
        return np.minimum(end, np.maximum(end - more, 1))


def first_of(keys: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group in the order of keys (the last one counts most)."""
    order = np.lexsort((*keys, group))
    own = group[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs starts[i], starts[i]+1, ... of counts[i]: the run and the value of each member."""
    run = np.repeat(np.arange(len(starts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[run]


def accumulate(documents: DataFrame, queries: Queries, stop: np.ndarray, k: int, least: np.ndarray | None = None) -> DataFrame:
    """query, score, doc_id: each task's first k accumulators of each query.

    Accumulators come from the first stop[q] terms of query q. Without `least` the scores are partial: those terms
    alone. With it, accumulators that cannot reach least[q] go, and the others get all terms.
    """
    end = queries.start[1:] - queries.start[:-1]
    place = np.arange(len(queries.query)) - queries.start[queries.query]
    makes = np.flatnonzero(place < stop[queries.query])
    makes = makes[np.argsort(queries.term[makes], kind="stable")]
    makes_at = np.searchsorted(queries.term[makes], np.arange(queries.vocabulary + 1))
    beyond = queries.beyond(stop)

    def scores(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row) of the accumulators of a few documents."""
        n, lists = part.column(1).to_numpy(zero_copy_only=False), part.column(2)
        rows = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy(zero_copy_only=False))
        term, times = lists.flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy().astype(np.int64)
        gain = impact(times, queries.slow(n)[rows]) if len(term) else times
        posting, use = spread(makes_at[term], makes_at[term + 1] - makes_at[term])
        use = makes[use]
        key = rows[posting] * queries.count + queries.query[use]
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        score = np.add.reduceat((queries.weight[use] * gain[posting])[order], first) if len(key) else key
        row, query = np.divmod(key, max(queries.count, 1))
        if least is not None:
            live = score + beyond[query] >= least[query]
            row, query, score = row[live], query[live], score[live]
            holder, use = spread(queries.start[query] + stop[query], end[query] - stop[query])
            held = rows * queries.vocabulary + term  # ascending
            want = row[holder] * queries.vocabulary + queries.term[use]
            at = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
            hit = held[at] == want if len(want) else np.zeros(0, dtype=bool)
            score = score.copy()
            np.add.at(score, holder[hit], queries.weight[use[hit]] * gain[at[hit]])
        return query, score, row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, dtype=np.int64)] * 4  # query, score, doc_id, whether it has none
        for batch in batches:
            ids = batch.column(0)
            absent = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, STEP_DOCS):
                query, score, row = scores(batch.slice(at, STEP_DOCS))
                best = [np.concatenate(x) for x in zip(best, (query, score, ids[at + row], absent[at + row]), strict=True)]
                first = first_of([best[2], best[3], -best[1]], best[0], k)
                best = [x[first] for x in best]
        doc = pa.array(best[2], pa.int64(), mask=best[3].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), doc], names=["query", "score", "doc_id"])

    return map_batches(documents, run, "query long, score long, doc_id long")


def search_block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """query_row, rank, doc_id, score for the queries of asked (query_row, term, times); None if nothing can be found."""
    spark = docs.sparkSession
    rows = asked.toPandas()  # BLOCK_TERMS rows, or one query's
    vocabulary = sorted(set(rows["term"]))
    number = {t: i for i, t in enumerate(vocabulary)}
    names = sorted(set(rows["query_row"]))
    place = {q: i for i, q in enumerate(names)}
    documents = staged(index(docs, vocabulary, id_col, text_col), "lexical-index")
    n_docs, n_terms = documents.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    held = documents.select("n", F.explode(F.arrays_zip("terms", "times")).alias("held")).select("n", "held.terms", "held.times")
    stats = {r[0]: tuple(r[1:]) for r in held.groupBy("terms").agg(F.count(F.lit(1)), F.max("times"), F.min("n")).collect()}
    queries = Queries([(place[q], number[t], int(c)) for q, t, c in zip(rows["query_row"], rows["term"], rows["times"], strict=True)], stats, len(vocabulary), n_docs, n_terms)
    ends, stop = queries.start[1:] - queries.start[:-1], queries.first_stop()
    least = np.ones(queries.count, dtype=np.int64)
    while True:
        found = accumulate(documents, queries, stop, k)
        order = W.partitionBy("query").orderBy(F.col("score").desc())
        kth = found.select("query", "score").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).where(F.col("place") == k).select("query", "score").collect()
        for q, score in kth:
            least[q] = max(least[q], score)
        open_ = (stop < ends) & (queries.beyond(stop) >= least)
        if not open_.any():
            break
        stop = np.where(open_, np.minimum(ends, 2 * stop), stop)
    found = accumulate(documents, queries, stop, k, least)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where("score > 0")
    keys = spark.createDataFrame([(i, int(q)) for i, q in enumerate(names)], "query long, query_row long")
    return found.join(keys, "query").select("query_row", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query id, rank, doc_id, score: the k best documents of every row of queries."""
    spark = docs.sparkSession
    rows = queries.select(F.monotonically_increasing_id().alias("query_row"), F.col(query_id).alias(query_id), terms(F.col(query_text)).alias("terms"))
    rows = staged(rows, "lexical-queries")
    asked = staged(rows.select("query_row", F.explode("terms").alias("term")).groupBy("query_row", "term").agg(F.count(F.lit(1)).alias("times")), "lexical-terms")
    blocks = -(-2 * asked.count() // BLOCK_TERMS) if asked.count() > BLOCK_TERMS else 1
    found = None
    for block in range(blocks):
        one = search_block(docs, asked.where(F.pmod(F.xxhash64("query_row"), F.lit(blocks)) == block), k, id_col, text_col)
        found = one if found is None else found if one is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "query_row long, rank int, doc_id long, score long")
    return found.join(rows.select("query_row", query_id), "query_row").select(query_id, "rank", "doc_id", "score")


def op12_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{STOPS}]+') AS t FROM documents
), c AS (SELECT count(*) AS big_n, sum(len(t)) AS big_l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^{STOPS}]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), s AS (
  SELECT item_id, doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""
