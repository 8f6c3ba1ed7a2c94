"""The pipeline's stages against brute force, one after the other."""

import collections

import pytest

import corpus_pipeline
from pulseframe.llm.common import staged
from tests.llm.test_operators import brute_components, docs_of, edge_rows, words


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, sf), "step")
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1]) and len(corpus_pipeline.STAGES) == 5


def test_filters(spark, sf, steps):
    texts = [collections.OrderedDict((r["doc_id"], r["text"]) for r in s.select("doc_id", "text").collect()) for s in steps[:4]]
    assert set(texts[1]) <= set(texts[0]) and len(texts[1]) >= 0.8 * len(texts[0])
    last = {}
    for i, t in texts[1].items():
        last[t] = max(i, last.get(t, i))
    assert set(texts[2]) == set(last.values())
    found = brute_components(list(texts[2].items()), 80)
    assert set(texts[3]) == {i for i, (_, c) in found.items() if i == c}


def test_mix_and_pack(steps):
    before = {r["doc_id"]: r for r in steps[3].collect()}
    after = collections.Counter(r["doc_id"] for r in steps[4].select("doc_id").collect())
    assert set(after) <= set(before) and max(after.values()) <= 3
    pieces = steps[5].toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert pieces[pieces.start == 0].groupby("doc_id").size().to_dict() == dict(after)


@pytest.mark.parametrize("rows", [[], edge_rows() + [(None, "no id", "a"), (None, "no id", "a"), (None, None, None), (9, "copy of nine", "b"), (9, "copy of nine", "b")] + [(100 + i, words(40, i), "b") for i in range(20)]], ids=["empty", "odd"])
def test_stages_take_whatever_comes(spark, tmp_path, rows):
    """Empty tables, nulls, repeated rows and columns with names that the stages use themselves."""
    spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, out = docs_of(spark, rows), []
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, str(tmp_path)), "odd")
        out.append(docs.collect())
        if name != "packing":
            assert docs.columns == docs_of(spark, []).columns
    if not rows:
        assert not any(out)
        return
    texts = lambda got: [r["text"] or "" for r in got]
    assert len(out[0]) == len(rows)
    assert sorted(texts(out[1])) == sorted(set(texts(out[0])))
    assert {"", "no id", "same text here"} <= set(texts(out[2])) and len(out[2]) < len(out[1])  # the long text and that with a further word are near
    assert {r["doc_id"] for r in out[4]} == {r["doc_id"] for r in out[3]}
