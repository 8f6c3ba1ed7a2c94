"""Removal of repeated byte strings by a sparse, distributed suffix array.

Every string of `length` bytes holds anchor positions: among the seeds (shorter strings) inside it, the one of the
least hash, the leftmost on ties. Equal strings choose the same seed at the same place, so two copies always meet at
suffixes that start at their anchors, and only anchors, about one position in thirty, need to travel.

1. Seeds that occur once are dropped: each task counts its own first and sends one record for each seed.
2. Texts give the contexts of the anchors left: all strings that the anchor stands for, as one run of bytes. Equal
   contexts are merged in the task that reads them; later ones are removed there and then.
3. Suffixes at the anchors are range-partitioned by their leading bytes at splitters that Spark samples; splitters
   fall between different leading bytes, so no group crosses a boundary. Where one lead has very many contexts, the
   lead is extended by the bytes that their strings share, so that no bucket grows with a frequent passage. Each bucket
   merges equal contexts again and sorts the strings of the remaining ones by multikey quicksort, eight bytes at a
   time; equal neighbours, compared on all bytes, are repeats of the first among them by (document, start).

Of equal whole texts only the one with the smallest id enters step 2; the others go whole, if they are long enough.

Defined cases: null text is empty; texts shorter than `length` lose nothing; a repeated row (same id, same text) is
one document and gets one result each time; rows without an id lose nothing and are nobody's earlier copy, nor are
rows that share an id with another text of a smaller SHA-256; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, mix64, parts, staged, table
from .near_dedup import _INVERSE, _MULTIPLIER, runs

SEED = 40
CHUNK, SEGMENT = 1 << 20, 8 << 20
#: Anchors that a task holds before it sends their seeds, contexts that it merges at a time.
HELD_SEEDS, HELD_CONTEXTS = 500_000, 40_000
LEAD = 16
#: Contexts of one lead beyond which its strings are dealt by further bytes, and how many offsets go together then.
OFTEN, NARROW = 10_000, 8
#: One anchor of a document: its place, and how far before it the first and the last string start that it stands for.
PLACE = np.dtype([("at", "<u4"), ("first", "u1"), ("last", "u1")])


class Anchors:
    """Anchors of many texts at a time."""

    def __init__(self, length: int, seed: int = SEED):
        # a string starts at most 255 bytes before its anchor: PLACE keeps that in a byte
        self.length, self.seed = length, max(min(seed, length), length - 255)
        self.window = length - self.seed + 1
        self.size = 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * CHUNK)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(self.size, _MULTIPLIER, dtype=np.uint64))
                self.down = np.cumprod(np.full(self.size, _INVERSE, dtype=np.uint64))

    def find(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(seed hash, place, first string, last string) of the anchors in texts that lie one after the other in data."""
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])))
            count = len(data) - self.seed + 1
            hashes = mix64((running[self.seed :] - running[:-self.seed]) * self.down[:count])
        least = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(count, dtype=np.uint64)
        span = 1
        while 2 * span <= self.window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < self.window:
            least = np.minimum(least[: len(least) - (self.window - span)], least[self.window - span :])
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.flatnonzero(text_of[: len(data) - self.length + 1] == text_of[self.length - 1 :])
        place = (least[inside] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
        end = np.concatenate((new[1:], [len(place)])) - 1 if len(place) else new
        return hashes[place[new]], place[new], inside[new], inside[end]

    def stream(self, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(seed hashes, documents, places) of chunks of (document, bytes); long texts are cut with overlap."""
        held, size = [], 0
        for doc, data in rows:
            for base in range(0, max(1, len(data) - self.length + 1), SEGMENT):
                piece = data[base : base + SEGMENT + self.length - 1]
                if len(piece) >= self.length:
                    held.append((doc, base, piece))
                    size += len(piece)
                if size >= CHUNK:
                    yield self._chunk(held)
                    held, size = [], 0
        if held:
            yield self._chunk(held)

    def _chunk(self, held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for _, _, p in held])
        hashes, at, first, last = self.find(np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8), lengths)
        starts = np.cumsum(lengths) - lengths
        which = np.searchsorted(starts, at, side="right") - 1
        places = np.empty(len(at), dtype=PLACE)
        places["at"] = at - starts[which] + np.array([b for _, b, _ in held])[which]
        places["first"], places["last"] = at - first, at - last
        return hashes, np.array([d for d, _, _ in held], dtype=np.int64)[which], places


def count_seeds(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, data): for each seed of a task's documents one record, and every anchor whose seed it saw twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        rows = ((d, (t.as_py() or "").encode("utf-8", "surrogatepass")) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        held, size = [], 0

        def send():
            hashes, docs, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            again = np.concatenate((~new[1:], [False]))
            state = np.zeros(len(hashes), dtype=np.uint8)  # 0: seen once here, 1: first of several, 2: known to repeat
            state[order[new & again]] = 1
            state[order[~new]] = 2
            # mixed again, as an anchor's hash is the least of many. What is known to repeat needs no company: by
            # document, so that a frequent seed fills no bucket
            place = mix64(np.where(state == 2, docs.view(np.uint64), hashes))
            bucket = (place >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            ordered = bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            for k, own in zip(ordered[cuts].astype(np.int64).tolist(), np.split(order, cuts[1:]), strict=True):
                yield k, b"".join((len(own).to_bytes(8, "little"), docs[own].tobytes(), places["at"][own].tobytes(), places["first"][own].tobytes(), places["last"][own].tobytes(), state[own].tobytes(), hashes[own].tobytes()))

        def batch():
            ids, data = zip(*send(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

        for found in anchors.stream(rows):
            if not len(found[0]):
                continue
            held.append(found)
            size += len(found[0])
            if size >= HELD_SEEDS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return map_batches(docs, run, "bucket int, data binary")


def repeated_places(seeds: DataFrame, tasks: int) -> DataFrame:
    """(doc, place): the anchors whose seed occurs more than once; place is at, first and last in one number. Bucket k is task k, so that none holds several by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "bucket"):
            columns = [[], [], [], []]
            for data in rows.column("data").to_pylist():
                n = int.from_bytes(data[:8], "little")
                places = np.empty(n, dtype=PLACE)
                places["at"] = np.frombuffer(data, "<u4", n, 8 + 8 * n)
                places["first"], places["last"] = np.frombuffer(data, "u1", n, 8 + 12 * n), np.frombuffer(data, "u1", n, 8 + 13 * n)
                for c, x in zip(columns, (np.frombuffer(data, "<i8", n, 8), places, np.frombuffer(data, "u1", n, 8 + 14 * n), np.frombuffer(data, "<u8", n, 8 + 15 * n)), strict=True):
                    c.append(x)
            docs, places, state, hashes = (np.concatenate(c) for c in columns)
            known = state == 2
            rest = np.flatnonzero(~known)
            order = rest[np.argsort(hashes[rest], kind="stable")]
            h = hashes[order]
            same = h[1:] == h[:-1]
            known[order] = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (state[order] == 1)
            docs, places = docs[known], places[known]
            place = (places["at"].astype(np.int64) << 16) | (places["first"].astype(np.int64) << 8) | places["last"]
            for i in range(0, len(docs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 50_000]), pa.array(place[i : i + 50_000])], ["doc", "place"])

    spread = seeds.repartitionById(tasks, "bucket").sortWithinPartitions("bucket")
    return map_batches(spread, run, "doc long, place long")


class Spans:
    """Removed stretches of documents, merged for each document when they are sent."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def add(self, docs, starts, ends) -> None:
        self.docs.append(np.asarray(docs, dtype=np.int64))
        self.starts.append(np.asarray(starts, dtype=np.int64))
        self.ends.append(np.asarray(ends, dtype=np.int64))

    def rows(self) -> list[tuple[int, bytes]]:
        if not self.docs:
            return []
        docs, starts, ends = np.concatenate(self.docs), np.concatenate(self.starts), np.concatenate(self.ends)
        order = np.lexsort((starts, docs))
        docs, starts, ends = docs[order], starts[order], ends[order]
        cuts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else []
        return [(int(docs[a]), merged(starts[a:b], ends[a:b]).astype("<u4").tobytes()) for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=True)]


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the union; touching stretches are one. starts in order."""
    far = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > far[:-1]))
    return np.stack((starts[new], far[np.concatenate((new[1:], [True]))]), axis=1)


class Merger:
    """Equal contexts become one, that of the smallest (document, place); the others' strings are repeats."""

    def __init__(self, length: int):
        self.length, self.kept, self.spans, self.late = length, {}, Spans(), []

    def add(self, doc: int, at: int, first: int, last: int, context: bytes) -> None:
        now = (doc, at)
        before = self.kept.setdefault((context, first), now)
        if before != now:
            if now < before:
                self.kept[context, first] = now
                now = before
            self.late.append((now[0], now[1] - first, now[1] - last + self.length))

    def removed(self) -> list[tuple[int, bytes]]:
        if self.late:
            self.spans.add(*zip(*self.late, strict=True))
        return self.spans.rows()


CONTEXTS = "lead binary, context binary, doc long, at long, first int, last int"


def merged_rows(rows: Iterator[tuple], length: int, lead) -> Iterator[pa.RecordBatch]:
    """Rows of CONTEXTS of (doc, at, first, last, context) with equal contexts merged some at a time; lead(context, first)."""
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [x.split(" ")[0] for x in CONTEXTS.split(", ")]

    def send(merger: Merger):
        removed = [(data, None, doc, None, None, None) for doc, data in merger.removed()]
        kept = ((lead(c, f), c, doc, at, f, f - (len(c) - length)) for (c, f), (doc, at) in merger.kept.items())
        out = chain(removed, kept)
        while some := list(islice(out, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    merger = Merger(length)
    for doc, at, first, last, context in rows:
        merger.add(doc, at, first, last, context)
        if len(merger.kept) >= HELD_CONTEXTS or len(merger.late) >= 10 * HELD_CONTEXTS:
            yield from send(merger)
            merger = Merger(length)
    yield from send(merger)


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """Rows of CONTEXTS from (doc, text, places); where context is null, lead holds removed stretches of doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for doc, text, packed in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    for place in packed:
                        at, first, last = place >> 16, place >> 8 & 255, place & 255
                        yield doc, at, first, last, data[at - first : at - last + length]

        yield from merged_rows(rows(), length, lambda c, f: c[f : f + LEAD])

    return map_batches(texts, run, CONTEXTS)


def narrowed(found: DataFrame, length: int) -> DataFrame:
    """found (CONTEXTS) with the contexts of frequent leads cut by the offset of their strings, until none is frequent.

    Cut to NARROW offsets each, the contexts of a lead that is still frequent to half as many, and so on down to one:
    there a context is one string, and those of one lead are equal and merged, but for one from each task.
    """
    width, settled, names = NARROW, [], [x.split(" ")[0] for x in CONTEXTS.split(", ")]
    while True:
        own = F.col("context").isNotNull()
        often = staged(found.where(own).groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OFTEN).select("lead"), "frequent-leads")
        if often.isEmpty():
            break
        settled += [found.where(own).join(often, "lead", "left_anti").select(*names), found.where(~own)]
        found = staged(cut_by_offset(found.where(own).join(often, "lead", "left_semi").select(*names[1:]), length, width), "narrow-contexts")
        if width == 1:
            break
        width //= 2
    return reduce(DataFrame.unionByName, settled, found)


def cut_by_offset(found: DataFrame, length: int, width: int) -> DataFrame:
    """Rows of CONTEXTS: the contexts (context, doc, at, first, last) of found cut to `width` offsets each.

    Strings at offsets low..low + width - 1 before an anchor all hold the bytes from the first one's end back to the
    last one's start; those bytes and the offset join the lead, so that only contexts meet whose strings agree on nearly
    all bytes. Equal ones are merged where they are cut.
    """

    def lead(c: bytes, f: int) -> bytes:
        low = f - f % width
        return c[f : f + LEAD] + low.to_bytes(2, "big") + c[f - low : f - low - width + 1 + length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for context, doc, at, first, last in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    for low in range(last - last % width, first + 1, width):
                        f, e = min(first, low + width - 1), max(last, low)
                        yield doc, at, f, e, context[first - f : first - e + length]

        yield from merged_rows(rows(), length, lead)

    return map_batches(found, run, CONTEXTS)


def sort_strings(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): indices of the strings data[start:start + length] that have an equal, group by group.

    Multikey quicksort, eight bytes a key: strings equal so far are sorted by their next eight bytes. A group whose
    neighbours agree on all bytes is done.
    """
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    word = np.zeros(len(data) + 1, dtype=np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(word)]
    depths = [*range(0, length - 8, 8), length - 8] if length >= 8 else []
    order, group = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    done_order, done_group, groups = [], [], 0
    for depth in depths:
        key = word[starts[order] + depth]
        by = np.lexsort((key, group))
        order, group, key = order[by], group[by], key[by]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1]))) if len(order) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        size = np.bincount(group) if len(group) else np.empty(0, np.int64)
        keep = size[group] > 1
        order, group = order[keep], group[keep]
        if not len(order):
            break
        # neighbours equal on all bytes
        equal = group[1:] == group[:-1]
        for d in depths:
            if d > depth:
                equal &= word[starts[order[1:]] + d] == word[starts[order[:-1]] + d]
        inner = group[1:] == group[:-1]
        mixed = np.zeros(group[-1] + 1, dtype=bool)
        mixed[group[1:][inner & ~equal]] = True
        over = ~mixed[group]
        if over.any():
            ids = group[over]
            ids = np.cumsum(np.concatenate(([True], ids[1:] != ids[:-1]))) - 1
            done_order.append(order[over])
            done_group.append(ids + groups)
            groups += int(ids[-1]) + 1
            order, group = order[~over], group[~over]
    if not done_order:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(done_order), np.concatenate(done_group)


def bucket_repeats(rows: Iterator[tuple], length: int) -> list[tuple[int, bytes]]:
    """Removed stretches (doc, packed) found in one bucket of (context, doc, at, first, last)."""
    merger = Merger(length)
    for context, doc, at, first, last in rows:
        merger.add(doc, at, first, last, context)
    of_seed: dict[bytes, list] = {}
    for (context, first), (doc, at) in merger.kept.items():
        of_seed.setdefault(context[first : first + min(SEED, length)], []).append((context, doc, at - first))
    left = [x for group in of_seed.values() if len(group) > 1 for x in group]
    if left:
        sizes = np.array([len(c) for c, _, _ in left])
        data = np.frombuffer(b"".join(c for c, _, _ in left), dtype=np.uint8)
        count = sizes - length + 1
        which = np.repeat(np.arange(len(left)), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        starts = (np.cumsum(sizes) - sizes)[which] + inside
        order, group = sort_strings(data, starts, length)
        if len(order):
            docs = np.array([d for _, d, _ in left], dtype=np.int64)[which[order]]
            at = np.array([a for _, _, a in left], dtype=np.int64)[which[order]] + inside[order]
            by = np.lexsort((at, docs, group))
            docs, at, group = docs[by], at[by], group[by]
            first = np.searchsorted(group, group)
            later = (docs != docs[first]) | (at != at[first])
            merger.spans.add(docs[later], at[later], at[later] + length)
    return merger.removed()


def sorted_buckets(found: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc, spans) from rows of CONTEXTS, range-partitioned by their leading bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
        out = bucket_repeats(rows, length)
        if out:
            docs, spans = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(spans, pa.binary())], ["doc", "spans"])

    spread = found.repartitionByRange(buckets, "lead").select("context", "doc", "at", "first", "last")
    return map_batches(spread, run, "doc long, spans binary")


def cut_out(texts: DataFrame) -> DataFrame:
    """doc, n_removed, n_spans, kept_sha256 of (doc, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, packed in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = np.frombuffer(b"".join(packed), dtype="<u4").reshape(-1, 2).astype(np.int64)
                spans = merged(*spans[np.argsort(spans[:, 0], kind="stable")].T)
                kept, at = hashlib.sha256(), 0
                for a, e in spans.tolist():
                    kept.update(data[at:a])
                    at = e
                kept.update(data[at:])
                out.append((doc, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3])], ["doc", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(texts, run, "doc long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    ids = staged(rows.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("key")), "repeat-ids")
    size = ids.agg(F.sum("n_bytes")).first()[0] or 0
    valid = F.col("doc").isNotNull()
    long_enough = rows.where(valid & (F.octet_length("text") >= length))
    several = ids.where(valid).groupBy("doc").agg(F.min("key").alias("own"), F.max("key").alias("_k")).where("own != _k").select("doc", "own")
    if not several.isEmpty():  # one id, different texts
        long_enough = long_enough.join(several, "doc", "left").where(F.col("own").isNull() | (F.sha2("text", 256) == F.col("own")))
        ids = ids.join(several, "doc", "left").select("doc", "n_bytes", "key", F.coalesce(valid & (F.col("key") == F.coalesce("own", "key")), F.lit(False)).alias("valid"))
    else:
        ids = ids.withColumn("valid", valid)
    long_enough = long_enough.select("doc", "text")
    classes = staged(ids.where("valid").groupBy("key").agg(F.min("doc").alias("stand")), "repeat-classes")
    ids = staged(ids.join(classes, "key", "left").select("doc", "n_bytes", "key", "valid", (F.col("valid") & (F.col("doc") == F.col("stand"))).alias("first")), "repeat-ids")

    buckets = parts(spark, size, 16e6)
    seeds = count_seeds(long_enough, length, buckets)
    standing = ids.where(F.col("first") & (F.col("n_bytes") >= length)).select("doc").distinct()
    places = repeated_places(seeds, buckets).groupBy("doc").agg(F.collect_list("place").alias("places")).join(standing, "doc")  # a document's own
    met = long_enough.repartition(parts(spark, size), "doc").join(places, "doc")
    found = narrowed(staged(contexts(met, length), "contexts"), length)
    ends = found.where("context is not null")
    n_bytes = ends.agg(F.sum(F.octet_length("context") + 40)).first()[0] or 0
    spans = sorted_buckets(ends, length, parts(spark, n_bytes, 4e6)).union(found.where("context is null").select("doc", F.col("lead").alias("spans")))
    spans = staged(spans, "spans").groupBy("doc").agg(F.collect_list("spans").alias("spans"))
    changed = cut_out(long_enough.repartition(parts(spark, size), "doc").join(spans, "doc")).dropDuplicates(["doc"])
    gone = F.col("valid") & ~F.col("first") & (F.col("n_bytes") >= length)
    out = ids.join(changed, "doc", "left")
    return out.select(
        F.col("doc").alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).when(F.col("first"), F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(gone, 1).when(F.col("first"), F.coalesce("n_spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).when(F.col("first"), F.coalesce("kept_sha256", "key")).otherwise(F.col("key")).alias("kept_sha256"),
    )


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
e AS (SELECT doc_id, n, h, unnest(range(0, n, 200)) AS base FROM d),
b AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 598) AS c FROM e),
o AS (SELECT doc_id, n, base, c, unnest(range(0, least(200, n - base))) AS i FROM b),
w AS (SELECT doc_id, base + i AS p, CASE WHEN base + i + 100 <= n THEN md5(substr(c, 2 * i + 1, 200)) END AS k, substr(c, 2 * i + 1, 2) AS x FROM o),
f AS (SELECT doc_id, p, x, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM w),
c AS (SELECT doc_id, p, x, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
