"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

A document is its set of 64-bit hashes of five-word shingles. Documents with equal sets are one class, and its
smallest id stands for it. Standing documents enter several independent trees: a node sends each of its documents to
the children named by minwise tokens at positions that the node selects, 1/similarity of them on average, until a
node is small. Small nodes are compared exhaustively on sketches; what looks similar forms loose clusters. Links are
then confirmed on full sets: within a loose cluster, or, for a cluster beyond the limits of a small node, within
each of its small nodes and then, between what is not joined yet, by an exact join on prefixes of the sets. A node
that no token parts is such a cluster. Only spanning edges leave a task, never all pairs.

Defined cases: a document without words has an empty set, no links and itself as component; with one to four words
its whole sequence is its one shingle; null text counts as empty; repeated rows are copies with one id; null ids are
left out of links (component null, not kept); ids are taken to be unique: rows with one id and different texts share
their links; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_BYTES, map_batches, mix64, parts, staged, table
from .graph import components

SKETCH = 64
CHUNK = 1 << 20
#: Most documents, and most shingles together, that a small node or loose cluster compares exhaustively.
NODE_DOCS, NODE_SHINGLES = 2000, 3_000_000
#: Levels below a root after which a node that is still large (documents that agree on nearly all tokens) is cut into
#: random blocks of about NODE_DOCS, others in each node and tree, which join what is dense; the rest of its links come
#: from the join on prefixes. Bounds a document's places by (1 / similarity) ** DEEPEST a tree.
DEEPEST = 12

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True


class Shingler:
    """Shingle sets of many texts at a time, on their bytes."""

    def __init__(self, words: int = 5):
        self.words, self.size = words, 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * CHUNK)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(self.size, _MULTIPLIER, dtype=np.uint64))
                self.down = np.cumprod(np.full(self.size, _INVERSE, dtype=np.uint64))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self._powers(len(data))
        lower = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
        blank = _IS_SPACE[data]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
        with np.errstate(over="ignore"):
            running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])))
            hashes = mix64((running[ends] - running[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
            offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
            first = np.searchsorted(starts, offsets[:-1])
            last = np.searchsorted(starts, offsets[1:])
            k = self.words
            joined = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
            for j in range(k):
                joined = mix64(joined + np.uint64(j + 1)) ^ hashes[j : j + len(joined)]
            joined = mix64(joined)
            out = []
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                if b - a >= k:
                    own = np.sort(joined[a : b - k + 1])
                    out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
                elif b > a:
                    one = np.uint64(b - a)
                    for h in hashes[a:b]:
                        one = mix64(np.array([one + np.uint64(7)]))[0] ^ h
                    out.append(mix64(np.array([one + np.uint64(0x5851F42D4C957F2D)])))
                else:
                    out.append(np.empty(0, dtype=np.uint64))
        return out

    def stream(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """(row, set) for rows whose last field is a text, a chunk of texts at a time."""
        held, size = [], 0
        for row in rows:
            data = (row[-1] or "").encode("utf-8", "surrogatepass")
            held.append((row, data))
            size += len(data) + 1
            if size >= CHUNK:
                yield from zip((r for r, _ in held), self.sets([d for _, d in held]), strict=True)
                held, size = [], 0
        if held:
            yield from zip((r for r, _ in held), self.sets([d for _, d in held]), strict=True)


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH minwise tokens of a non-empty sorted set: the least hash of each of SKETCH ranges; an empty range takes the next one's."""
    bins = (own >> np.uint64(64 - 6)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    filled, least = bins[at], own[at]
    places = np.arange(SKETCH)
    to = np.searchsorted(filled, places)
    far = np.where(to == len(filled), filled[0] + SKETCH, filled[np.minimum(to, len(filled) - 1)]) - places
    to[to == len(filled)] = 0
    with np.errstate(over="ignore"):
        return (mix64(least[to] + far.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def positions(node: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one or two sketch positions that each node selects, and which nodes select a second."""
    h = mix64(node ^ np.uint64(0xD6E8FEB86659FD93))
    second = (h >> np.uint64(32)).astype(np.float64) / 2.0**32 < 1 / similarity - 1
    return (h & np.uint64(63)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64(63)).astype(np.int64), second


def children(node: np.ndarray, tokens: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Child of each node by the token at a position. tokens: a row for each node."""
    with np.errstate(over="ignore"):
        return mix64(mix64(node + np.uint64(1)) ^ (tokens[np.arange(len(node)), position].astype(np.uint64) << np.uint64(6)) ^ position.astype(np.uint64))


def branch(node: np.ndarray, tokens: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Arrays (row, child) of all children."""
    one, two, second = positions(node, similarity)
    rows = np.arange(len(node))
    own = rows[second & (one != two)]
    return [np.concatenate((rows, own)), np.concatenate((children(node, tokens, one), children(node[own], tokens[own], two[own])))]


def describe(docs: DataFrame, words: int, trees: int, similarity: float) -> DataFrame:
    """doc_id, n_shingles, set_key, tokens (a sketch), roots (its nodes below the trees' roots) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, starts = Shingler(words), mix64(np.arange(1, trees + 1, dtype=np.uint64))
        names, types = ["doc_id", "n_shingles", "set_key", "tokens", "roots"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            rows = []
            for (doc, _), own in shingler.stream(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if len(own):
                    tokens = sketch(own)
                    roots = branch(starts, np.broadcast_to(tokens, (trees, SKETCH)), similarity)[1].view(np.int64).tolist()
                    rows.append((doc, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), tokens.tobytes(), roots))
                else:
                    rows.append((doc, 0, None, None, []))
            if rows:
                yield out(rows)

    return map_batches(docs, run, "doc_id long, n_shingles long, set_key binary, tokens binary, roots array<long>")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(held[-1].schema.names.index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


class Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def loose_edges(members: DataFrame, similarity: float) -> DataFrame:
    """Spanning edges (a, b) of what looks similar in each small node. members: node, doc_id, n_shingles, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for rows in runs(batches, "node"):
            ids = rows.column("doc_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, sizes = ids[order], rows.column("n_shingles").to_numpy()[order]
            tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), dtype=np.uint32).reshape(len(ids), SKETCH)[order]
            groups = Sets(len(ids))
            for i in range(len(ids) - 1):
                most = np.maximum(sizes[i], sizes[i + 1 :])
                alike = (tokens[i] == tokens[i + 1 :]).mean(axis=1)
                # four standard deviations below the threshold, as far as the sets' sizes allow to tell
                bar = similarity - 4 * np.sqrt(similarity * (1 - similarity) / np.minimum(SKETCH, most))
                close = np.minimum(sizes[i], sizes[i + 1 :]) >= similarity * most - 1e-9
                for j in np.flatnonzero(close & (alike >= bar)).tolist():
                    groups.join(i, i + 1 + j)
            found = {(int(ids[groups.find(i)]), int(ids[i])) for i in range(len(ids)) if groups.find(i) != i} - known
            known = known | found if len(known) < 1_000_000 else found
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_batches(members, run, "a long, b long")


def linked(sets: list[np.ndarray], percent: int) -> Sets:
    """Sets joined by every pair with 100 * intersection >= percent * union, each pair tried."""
    n = len(sets)
    groups, sizes = Sets(n), np.array([len(s) for s in sets], dtype=np.int64)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                if min(sizes[i], sizes[j]) * 100 >= percent * max(sizes[i], sizes[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        groups.join(i, j)
        return groups
    every, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    common = np.bincount(which, minlength=len(every)) > 1
    keep = common[which]
    column = (np.cumsum(common) - 1)[which[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), dtype=np.float32)
    width = 4096
    for at in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), dtype=np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        both += block @ block.T
    for i in range(1, n):
        for j in np.flatnonzero(100 * both[i, :i].astype(np.int64) >= percent * (sizes[i] + sizes[:i] - both[i, :i].astype(np.int64))).tolist():
            groups.join(i, j)
    return groups


def confirmed_edges(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning edges (a, b) of the exact links in each unit. members: unit, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for rows in runs(batches, "unit"):
            pairs = sorted(((d, s) for (d, _), s in shingler.stream(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True))), key=lambda x: x[0])
            ids = [d for d, _ in pairs]
            groups = linked([s for _, s in pairs], percent)
            found = [(ids[groups.find(i)], ids[i]) for i in range(len(ids)) if groups.find(i) != i]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_batches(members, run, "a long, b long")


def small_nodes(stands: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """node, doc_id of every node with 2 to NODE_DOCS documents, over all trees, and edges (a, b) that hold each node together that was cut into blocks, if any was.

    stands: doc_id, tokens, roots.
    """

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0).to_numpy().view(np.uint64)
            ids = b.column(1).to_numpy()
            tokens = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint32).reshape(len(ids), SKETCH)
            rows, child = branch(node, tokens, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[rows])], ["node", "doc_id"])

    nodes = stands.select(F.explode("roots").alias("node"), "doc_id")
    small: DataFrame | None = None
    whole: DataFrame | None = None
    for depth in range(DEEPEST):
        nodes = staged(nodes, "nodes")
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = staged(sizes, "node-sizes")
        last = depth == DEEPEST - 1
        leaves = nodes.join(sizes if last else sizes.where(F.col("n") <= NODE_DOCS), "node")
        block = F.pmod(F.xxhash64("node", "doc_id"), F.ceil(F.col("n") / NODE_DOCS))
        leaves = leaves.select(F.when(F.col("n") <= NODE_DOCS, F.col("node")).otherwise(F.xxhash64("node", block)).alias("node"), "doc_id")
        small = leaves if small is None else small.union(leaves)
        large = sizes.where(F.col("n") > NODE_DOCS)
        if large.isEmpty():
            break
        if last:
            held = nodes.join(large, "node")
            whole = held.groupBy("node").agg(F.min("doc_id").alias("a")).join(held.select("node", F.col("doc_id").alias("b")), "node").where("a != b").select("a", "b").distinct()
            break
        nodes = map_batches(nodes.join(large, "node").select("node", "doc_id").join(stands.select("doc_id", "tokens"), "doc_id").select("node", "doc_id", "tokens"), deeper, "node long, doc_id long")
    return small, whole


def shingle_rows(texts: DataFrame, words: int) -> DataFrame:
    """A row for each distinct shingle of each row of texts, n: how many there are. texts: component, doc_id, copy, joined, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for (*row, _), own in shingler.stream(rows):
                columns = [pa.array(np.full(len(own), v, dtype=np.int64)) for v in (*row, len(own))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own.view(np.int64))], ["component", "doc_id", "copy", "joined", "n", "shingle"])

    return map_batches(texts.select("component", "doc_id", "copy", "joined", "text"), run, "component long, doc_id long, copy long, joined long, n long, shingle long")


def prefix_units(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """unit, component, doc_id, copy such that two rows of one component, joined differently, share a unit if they are linked.

    Shingles of a component are ordered from rare to frequent. Of two linked sets of n or more, at least
    ceil(percent * n / 100) are common, so their prefixes without all but one of so many share a shingle. A shingle
    whose rows are beyond the limits of a small node becomes one unit for each two blocks of them, except for two
    blocks of those that are joined already. Shingles with the same rows count once.
    """
    shingles = staged(shingle_rows(texts, words), "cluster-shingles")
    often = shingles.groupBy("component", "shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    own = W.partitionBy("component", "doc_id", "copy")
    ranked = shingles.join(often, ["component", "shingle"]).withColumn("met", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("often", "shingle")))
    prefix = staged(ranked.where(F.col("rank") + F.ceil(F.col("n") * percent / 100) <= F.col("met") + 1).select("component", "shingle", "doc_id", "copy", "joined", "n"), "prefixes")
    by_joined = prefix.groupBy("component", "shingle", "joined").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("doc_id", "copy")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "copy", "doc_id")).alias("y"),
    )
    lists = by_joined.groupBy("component", "shingle").agg(
        F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("rows", "weight", "joined")).alias("most"),
    )
    lists = lists.where("kinds > 1").groupBy("component", "rows", "weight", "x", "y").agg(F.min(F.struct("shingle", "most")).alias("l"))
    blocks = lambda rows, weight: F.greatest(F.ceil(2 * rows / NODE_DOCS), F.ceil(2 * weight / NODE_SHINGLES)).cast("long")
    most = F.col("l.most")
    lists = lists.select(
        "component", F.col("l.shingle").alias("shingle"), most["joined"].alias("main"), ((F.col("rows") <= NODE_DOCS) & (F.col("weight") <= NODE_SHINGLES)).alias("fits"),
        blocks(most["rows"], most["weight"]).alias("k"), blocks(F.col("rows") - most["rows"], F.col("weight") - most["weight"]).alias("m"),
    )
    placed = prefix.join(staged(lists, "prefix-lists"), ["component", "shingle"])
    draw, is_main = F.xxhash64("doc_id"), F.col("joined") == F.col("main")
    placed = placed.withColumn("block", F.when(F.col("fits"), F.lit(0)).when(is_main, F.pmod(draw, F.col("k"))).otherwise(F.col("k") + F.pmod(draw, F.col("m"))).cast("long"))
    first = F.when(is_main, F.col("k")).otherwise(F.lit(0).cast("long"))
    others = F.when(F.col("fits"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, F.col("k") + F.col("m") - 1))
    placed = placed.withColumn("other", F.explode(others)).where("fits or other != block")
    return placed.select(F.xxhash64("component", "shingle", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "component", "doc_id", "copy")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, trees: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets.
    """
    spark, similarity = docs.sparkSession, percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = staged(describe(rows, words, trees, similarity), "shingles")
    sized = seen.where("set_key is not null and doc_id is not null")
    classes = staged(sized.groupBy("set_key").agg(F.min("doc_id").alias("stand")), "set-classes")
    stands = sized.join(classes.select(F.col("stand").alias("doc_id"), "set_key"), ["doc_id", "set_key"]).select("doc_id", "n_shingles", "tokens", "roots").dropDuplicates(["doc_id"])
    stands = staged(stands, "stands")
    nodes, whole_nodes = small_nodes(stands, similarity)
    nodes = staged(nodes, "small-nodes")
    tasks = parts(spark, nodes.count() * 5 * SKETCH)
    members = nodes.join(stands.select("doc_id", "n_shingles", "tokens"), "doc_id").select("node", "doc_id", "n_shingles", "tokens")
    loose = loose_edges(members.repartition(tasks, "node").sortWithinPartitions("node"), similarity)
    loose = staged(loose.union(whole_nodes) if whole_nodes is not None else loose, "loose-edges")
    clusters = staged(components(loose), "clusters")
    sizes = clusters.join(stands.select(F.col("doc_id").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    fits = (F.col("n") <= NODE_DOCS) & (F.col("shingles") <= NODE_SHINGLES)
    sizes = staged(sizes.withColumn("fits", fits), "cluster-sizes")
    whole = clusters.join(sizes.where("fits"), "component").select(F.col("component").alias("unit"), F.col("node").alias("doc_id"))
    cut = clusters.join(sizes.where("not fits"), "component").select(F.col("node").alias("doc_id"), "component").join(nodes, "doc_id").select(F.xxhash64("component", "node").alias("unit"), "doc_id")
    units = whole.union(cut)
    # a shingle stands for a word of about seven bytes; documents of large clusters are read in each of their nodes
    tasks = parts(spark, 7 * (units.join(stands.select("doc_id", "n_shingles"), "doc_id").agg(F.sum("n_shingles")).first()[0] or 0))
    texts = rows.join(units, "doc_id").select("unit", "doc_id", "text")
    edges = staged(confirmed_edges(texts.repartition(tasks, "unit").sortWithinPartitions("unit"), words, percent), "links")
    found = components(edges)
    beyond = sizes.where("not fits")
    if not beyond.isEmpty():
        found = staged(found, "joined")
        within = clusters.join(beyond.select("component"), "component").withColumnRenamed("node", "doc_id")
        within = within.join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("at")), "doc_id", "left").select("component", "doc_id", F.coalesce("at", "doc_id").alias("joined"))
        within = staged(within, "within")
        apart = within.groupBy("component").agg(F.min("joined").alias("a"), F.max("joined").alias("b")).where("a != b").select("component")
        copies = rows.join(within.join(apart, "component"), "doc_id").dropDuplicates(["doc_id", "text"])
        copies = staged(copies.withColumn("copy", F.xxhash64("text")), "cluster-texts")
        texts = copies.join(prefix_units(copies, words, percent), ["component", "doc_id", "copy"]).select("unit", "doc_id", "text")
        more = staged(confirmed_edges(texts.repartition(tasks, "unit").sortWithinPartitions("unit"), words, percent), "more-links")
        found = components(edges.union(more))
    by_class = classes.join(found.withColumnRenamed("node", "stand"), "stand", "left").select("set_key", F.coalesce("component", "stand").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, with the columns of docs; rows without an id stay."""
    gone = near_duplicates(docs, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)


OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = s.doc_id
"""
