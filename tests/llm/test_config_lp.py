"""Packing by the configuration program: every piece once, within the limit, close to the lower bound."""

import itertools
import zlib

import numpy as np
import pytest

from pulseframe.llm import config_lp
from tests.llm.test_operators import docs_of, edge_rows, words


def fewest(lengths, limit):
    """The smallest number of bins, by trying all partitions of a few pieces."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= limit:
                put(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best


def held(uses):
    out = {}
    for u in uses:
        for n, k in zip(u.lengths, u.times):
            out[n] = out.get(n, 0) + k * int(u.uses)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_few_pieces_come_near_the_optimum(seed):
    r = np.random.default_rng(seed)
    pieces = sorted(r.integers(1, 40, r.integers(1, 10)).tolist(), reverse=True)
    lengths, counts = np.unique(pieces, return_counts=True)
    uses, bound = config_lp.whole_uses(lengths, counts, 40)
    best = fewest(pieces, 40)
    assert held(uses) == dict(zip(lengths.tolist(), counts.tolist())) and all(sum(a * b for a, b in zip(u.lengths, u.times)) <= 40 for u in uses)
    assert bound <= best + 1e-9 <= sum(u.uses for u in uses) + 1e-9 <= best + 1 + 1e-9


@pytest.mark.parametrize("counts", [10, 1_000, 10**9])
@pytest.mark.parametrize("lengths, gap", [(range(1, 300), 0.02), (range(1, 150), 0.005), ((97, 98, 150, 160), 0.12), ((151, 152, 200), 0.05)])
def test_many_pieces_come_near_the_bound(counts, lengths, gap):
    """The number of pieces costs nothing; also where large pieces force waste, the dual's bound is near."""
    lengths = np.array(lengths)
    n = np.random.default_rng(1).integers(1, counts + 1, len(lengths))
    uses, bound = config_lp.whole_uses(lengths, n, 300)
    assert held(uses) == dict(zip(lengths.tolist(), n.tolist()))
    assert bound - 1e-6 * bound <= sum(u.uses for u in uses) <= max((1 + gap) * bound, bound + 12)


def test_knapsack_equals_brute_force():
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths, values = np.unique(r.integers(1, 12, 4)), r.random(4)
        values = values[: len(lengths)]
        best, pick = config_lp.knapsack(lengths, values, 20)
        many = [range(20 // n + 1) for n in lengths]
        assert best[20] == pytest.approx(max(np.dot(t, values) for t in itertools.product(*many) if np.dot(t, lengths) <= 20))
        taken = config_lp.traced(pick, lengths, 20)
        assert sum(lengths[taken]) <= 20 and sum(values[taken]) == pytest.approx(best[20])


def test_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = edge_rows() + [(100 + i, words(i * 7, i), "s") for i in range(150)] + [(None, "no id", "s"), (400, "x " * 256 + "y", "s"), (401, "z " * 1_000_000, "s"), (402, " " * 2_000_000, "s")]
    found = config_lp.pack_documents(docs_of(spark, rows).repartition(3), limit=256).toPandas()
    used = found.groupby("sequence_id").length.sum()
    assert used.max() <= 256 and len(used) <= 1.002 * np.ceil(used.sum() / 256) + 1
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], g.length.cumsum().to_numpy()[:-1]))).all()
    want = {}
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 256)):
            key = (i, k, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], dtype="<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    have = {}
    for r in found.itertuples():
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        have[key] = have.get(key, 0) + 1
    assert have == want


def test_lengths_of_any_table(spark):
    odd = spark.createDataFrame([(None, 1, 7, 8), (0, 2, 7, 8), (5, 3, 7, 8), (10, None, 7, 8), (5, 3, 7, 8)], "length int, part int, nth int, upto int")
    found = sorted(tuple(r) for r in config_lp.pack_lengths(odd, 10).select("length", "sequence_id", "offset").collect())
    assert len(found) == 5 and {f[1] for f in found if f[0] == 0}.isdisjoint({f[1] for f in found if f[0]}) and len({f[1] for f in found if f[0]}) == 2
    assert config_lp.pack_lengths(odd.limit(0), 10).count() == 0
    with pytest.raises(Exception, match="limit"):
        config_lp.pack_lengths(odd, 9).count()
