"""Ranked search against a brute-force ranking of all documents."""

import collections
import math
import random
import re

import pytest

from pulseframe.llm import lexical
from tests.llm.test_operators import docs_of, edge_rows
from tests.oracle import check

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall((text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


def brute(docs, queries, k):
    held = [(i, collections.Counter(split(t)), len(split(t))) for i, t, *_ in docs]
    n_docs, n_terms = sum(1 for h in held if h[2]), sum(h[2] for h in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c, n in held:
            if n:
                m = 25 + (75 * n * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
                if s > 0:
                    scores.append((-s, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, docs, queries, k):
    asked = spark.createDataFrame([(*q, 1, 2, 3) for q in queries], "item_id long, text string, query_row int, rank int, score int")
    got = lexical.search(docs_of(spark, docs).repartition(3), asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def prose(n, seed):
    """Words by Zipf's law, so that queries have rare and common terms."""
    r = random.Random(seed)
    return " ".join("W%dé" % min(int(r.paretovariate(0.7)), 400) for _ in range(n))


@pytest.mark.parametrize("step", [500, 3])
def test_equals_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(lexical, "STEP_DOCS", step)
    docs = [(i, prose(random.Random(i).randrange(1, 60), i), "s") for i in range(300)]
    docs += [(1000 + i, docs[5][1], "s") for i in range(25)]  # ties beyond the k-th
    queries = [(i, prose(20, 1000 + i)) for i in range(15)] + [(50, docs[7][1] + " . " + docs[7][1]), (51, docs[5][1])]
    assert found(spark, docs, queries, 10) == brute(docs, queries, 10)
    assert found(spark, docs, queries, 1) == brute(docs, queries, 1)


def test_odd_rows(spark):
    docs = edge_rows() + [(None, "x only here", "s"), (None, "x only here", "s"), (30, "X\x00y", "s"), (31, "ＦＵＬＬ ünï 中文 x2", "s")]
    queries = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (None, "only"), (4, "no such term anywhere"), (5, "ＦＵＬＬ Ünï 中文!X2"), (6, "w1 w2 w3 end " * 50)]
    assert found(spark, docs, queries, 10) == brute(docs, queries, 10)
    assert found(spark, [], queries, 10) == [] and found(spark, docs, [], 10) == [] and found(spark, [(1, None, "s")], queries, 10) == []


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    docs, queries = [(i, prose(30, i), "s") for i in range(60)], [(i, prose(8, 100 + i)) for i in range(12)]
    assert found(spark, docs, queries, 5) == brute(docs, queries, 5)


def test_common_terms_create_no_accumulators(spark, monkeypatch):
    """The last pass starts from few accumulators where a rare term decides."""
    stops = []
    plain = lexical.accumulate
    monkeypatch.setattr(lexical, "accumulate", lambda d, q, stop, k, least=None: stops.append((stop.tolist(), least is not None)) or plain(d, q, stop, k, least))
    docs = [(i, "the of and in a to " * 5 + ("needle pin" if i < 4 else ""), "s") for i in range(200)]
    queries = [(0, "the needle of a pin in the")]
    assert found(spark, docs, queries, 3) == brute(docs, queries, 3)
    assert stops[-1][1] and stops[-1][0][0] <= 2


def test_sql(spark, sf):
    check(spark, "op12", lexical.op12_limited_accumulators, lexical.OP12_SQL, sf)
