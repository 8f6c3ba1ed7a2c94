"""Packing token sequences by vector bin packing with a dot-product heuristic.

Texts become ids once, in the tasks that read them; only lengths and checksums leave those tasks. Pieces go to
packing groups by hash, as many as their number asks for and no setting changes, so that each group is of a bounded
size. In a group the open sequence takes, again and again, the class of pieces with the largest dot product of demand
and room left (tokens, segments, loss tokens); what the groups leave half empty is then packed together.

Defined cases: null text counts as empty (its end id alone); a repeated row is packed as often as it occurs; a long
document is cut at multiples of the limit, whatever it is made of (a run of two million spaces too); the string of an
added token becomes that token's id, as the tokenizer has it; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, map_groups, staged, table
from .token_ids import byte_encoder

#: Pieces that one packing group holds on average.
GROUP_PIECES = 40_000
#: A sequence that uses less than this share of each limit is opened again when all groups are packed.
LOOSE = 0.98
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, limit: int, encoder: Callable = byte_encoder, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of each document's ids and its end id.

    encoder(path) gives the function from a text to its ids; path is the vocabulary's file, where not the usual one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * limit
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                rows += [(doc, at // 4, len(piece := ids[at : at + step]) // 4, zlib.crc32(piece), len(ids) // 4) for at in range(0, len(ids), step)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), cut, PIECES)


def fill(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each row of demand (tokens first), by the dot-product heuristic. Rows within limits.

    Rows of one demand are one kind. As long as every kind of a sequence has rows enough left, the next sequence takes
    the same kinds: such sequences are made at once.
    """
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)  # sorted by tokens
    kind_of = kind_of.reshape(-1)
    rows = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    at = np.cumsum(left) - left
    most = np.maximum(limits, 1).astype(float)
    share, tokens, others = kinds / most, kinds[:, 0].copy(), [np.ascontiguousarray(kinds[:, d]) for d in range(1, kinds.shape[1])]
    sequence, offset = np.empty(len(demand), dtype=np.int64), np.empty(len(demand), dtype=np.int64)
    now, todo, open_kinds = 0, len(demand), len(kinds)
    live = np.arange(len(kinds))  # kinds with rows left, now and then anew
    while todo:
        if (left[live] > 0).sum() < 0.8 * len(live):
            live = live[left[live] > 0]
        own_tokens, own_others, own_share, own_left = tokens[live], [o[live] for o in others], share[live], left[live].copy()
        room, taken = limits.astype(np.int64).copy(), []
        while True:
            end = int(np.searchsorted(own_tokens, room[0], side="right"))
            fits = own_left[:end] > 0
            for o, r in zip(own_others, room[1:], strict=True):
                fits &= o[:end] <= r
            score = np.where(fits, own_share[:end] @ (room / most), -1.0)
            if not end or score[best := int(score.argmax())] < 0:
                break
            taken.append(best)
            own_left[best] -= 1
            room = room - kinds[live[best]]
        picked, times = np.unique(live[taken], return_counts=True)
        again = int((left[picked] // times).min())
        places = np.cumsum([0, *tokens[live[taken]][:-1]])
        for place, kind in zip(places.tolist(), live[taken].tolist(), strict=True):
            row = rows[at[kind] : at[kind] + again]
            at[kind] += again
            sequence[row], offset[row] = now + np.arange(again), place
        left[picked] -= times * again
        now, todo = now + again, todo - again * len(taken)
    return sequence, offset


def fill_groups(pieces: DataFrame, limits: dict[str, int], first_group: int) -> DataFrame:
    """pieces with sequence_id and offset, packed in groups of about GROUP_PIECES by a hash of the whole row."""
    columns = list(limits)
    most = np.array([limits[c] for c in columns], dtype=np.int64)
    groups = max(1, -(-pieces.count() // GROUP_PIECES))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([c for c in frame.columns if c != "_group"], kind="stable", ignore_index=True)
        demand = np.minimum(frame[columns].fillna(0).to_numpy(dtype=np.int64), most)
        sequence, offset = fill(demand, most)
        frame["sequence_id"] = frame.pop("_group").to_numpy(dtype=np.int64) * (1 << 32) + sequence
        frame["offset"] = offset
        return frame

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    group = F.pmod(F.xxhash64(*pieces.columns), F.lit(groups)).cast("long") + first_group
    return map_groups(pieces.withColumn("_group", group), ["_group"], packed, schema)


def pack(pieces: DataFrame, limits: dict[str, int]) -> DataFrame:
    """pieces with sequence_id and offset; limits: column -> most in a sequence, the tokens' column first.

    Sequences that are left with room at the end of their groups are opened again and packed together. A piece beyond
    a limit on its own is put alone (tokens must be cut before). Null demands count as 0.
    """
    pieces = staged(pieces, "pieces")
    found = staged(fill_groups(pieces, limits, 0), "packed")
    fullest = F.greatest(*[F.coalesce(F.sum(c), F.lit(0)) / most for c, most in limits.items()]) if len(limits) > 1 else F.sum(next(iter(limits))) / next(iter(limits.values()))
    loose = staged(found.groupBy("sequence_id").agg(fullest.alias("_fullest")).where(F.col("_fullest") < LOOSE).select("sequence_id"), "loose")
    rest = staged(found.join(loose, "sequence_id").select(*pieces.columns), "loose-pieces")
    after = 1 + (found.agg(F.max("sequence_id")).first()[0] or 0) // (1 << 32)
    return found.join(loose, "sequence_id", "left_anti").select(*found.columns).unionByName(fill_groups(rest, limits, after))


def pack_documents(docs: DataFrame, limit: int = 2048, segments: int = 128) -> DataFrame:
    """Pieces of all documents in sequences of at most `limit` tokens and `segments` pieces.

    Every token bears loss but a document's first, which nothing before it predicts.
    """
    pieces = cut_documents(docs, limit).withColumn("segments", F.lit(1).cast("long")).withColumn("loss_tokens", F.col("length") - (F.col("start") == 0).cast("long"))
    return pack(pieces, {"length": limit, "segments": segments, "loss_tokens": limit})


def conversation_examples(turns: DataFrame, limits: tuple[int, int, int], answers: str = "assistant", path: str | None = None) -> DataFrame:
    """conv_id, turn, start, length, segments, loss_tokens: what is packed together. turns: conv_id, turn, role, text.

    A conversation within the limits (tokens, segments, loss tokens) is one example, with turn and start null and a
    segment for each turn; else each turn is, cut where it alone is beyond a limit. Tokens of the role `answers`, with
    the end id, bear loss. Null roles bear none; conversations without an id go turn by turn.
    """
    step = max(1, min(limits[0], limits[2]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(encode(text or "")) // 4 + 1
                rows += [(conv, turn, at, length := min(step, n - at), length if role == answers else 0) for at in range(0, n, step)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["conv_id", "turn", "start", "length", "loss_tokens"])

    kept = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    pieces = staged(map_batches(kept, cut, "conv_id long, turn long, start long, length long, loss_tokens long"), "turns")
    whole = pieces.where("conv_id is not null").groupBy("conv_id").agg(F.sum("length").alias("length"), F.sum((F.col("start") == 0).cast("long")).alias("segments"), F.sum("loss_tokens").alias("loss_tokens"))
    whole = staged(whole.where((F.col("length") <= limits[0]) & (F.col("segments") <= limits[1]) & (F.col("loss_tokens") <= limits[2])), "conversations")
    apart = pieces.join(whole.select("conv_id"), "conv_id", "left_anti").withColumn("segments", F.lit(1).cast("long"))
    none = F.lit(None).cast("long")
    return whole.select("conv_id", none.alias("turn"), none.alias("start"), "length", "segments", "loss_tokens").unionByName(apart)


def pack_conversations(turns: DataFrame, limit: int = 2048, segments: int = 16, loss_tokens: int = 1024) -> DataFrame:
    """conversation_examples with sequence_id and offset, under all three limits at once."""
    return pack(conversation_examples(turns, (limit, segments, loss_tokens)), {"length": limit, "segments": segments, "loss_tokens": loss_tokens})


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(table(spark, sf_dir, "documents"), limit=2048)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
