"""Rows of shared ids, clashing names, much repeated rows, far vectors."""

import zlib

import numpy as np
import pytest

from lensframe.llm.jaccard import keep_one_of_each
from lensframe.llm.quality import keep_good
from lensframe.llm.sharding import SHARDS, sharded
from lensframe.llm.toxicity import keep_civil

A = "the quick brown fox jumps over the lazy dog again and again until night"
B = "a wholly different text about ships and harbours and the men who sail them"
Z = "the last of these texts speaks of mountains rivers lakes and of little else"


def test_near_copies_by_row(spark):
    """Unlike rows of a shared id stay, identical rows become one, a null id is last."""
    rows = [(1, A, "p"), (5, A, "p"), (5, B, "p"), (7, Z, "p"), (7, Z, "p"), (None, A, "q"), (None, None, "q"), (3, "", "q"), (3, "", "q"),
            (None, "one more text that only rows without an id hold at all here", "a"), (None, "one more text that only rows without an id hold at all here", "b")]
    schema = "doc_id long, text string, _key string"
    got = sorted(keep_one_of_each(spark.createDataFrame(rows, schema), k=5, percent=80).collect(), key=lambda r: (r.text or "", r.doc_id or 0))
    kept = [(r.doc_id, r.text) for r in got]
    assert [x for x in kept if x[1] == A] == [(1, A)] and [x for x in kept if x[1] == B] == [(5, B)] and [x for x in kept if x[1] == Z] == [(7, Z)]
    assert len([x for x in kept if x[1] == ""]) == 2 and len([x for x in kept if x[1] is None]) == 1
    assert len([x for x in kept if x[0] is None and x[1]]) == 1 and len(kept) == 7
    assert keep_one_of_each(spark.createDataFrame([], schema)).count() == 0


def test_user_columns_of_any_name_stay(spark):
    schema = "doc_id long, text string, _score double, _key string, _own int, _gone string, m map<string,int>, _Row int"
    docs = spark.createDataFrame([(i, f"{A} {i}" if i else A, 1.0, "k", 2, "g", {"a": i}, 3) for i in range(4)] + [(9, A, 4.0, "k", 2, "g", {"b": 1}, 3)], schema)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (keep_good(docs, labels), keep_civil(docs, labels), keep_one_of_each(docs, k=5, percent=80)):
        assert out.schema.fieldNames() == docs.schema.fieldNames()
        assert all(r._key == "k" and r._own == 2 and r._score in (1.0, 4.0) for r in out.collect())


@pytest.mark.parametrize("same_id", [True, False])
def test_a_much_repeated_row_is_spread(spark, same_id):
    rng = np.random.default_rng(0)
    docs = [(i, "".join(chr(97 + c) for c in rng.integers(0, 26, 200))) for i in range(300)] + [(1000 if same_id else 1000 + i, A * 3) for i in range(3000)]
    got = sharded(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == SHARDS and size.max() - size.min() <= 2 * got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sorted(zip(got.doc_id, got.text_crc32)) == sorted((i, zlib.crc32(t.encode())) for i, t in docs)


def test_sharding_balance_and_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharded(docs).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == SHARDS and size.max() - size.min() <= 2 * got["size"].max()
    from lensframe.llm.sharding import histogram_sort

    odd = spark.createDataFrame([(1, A, 5, 6, 7, 8)], "doc_id long, text string, _h int, _i int, _p int, _R int")
    assert histogram_sort(odd, 2).select("_h", "_i", "_p", "_R").first() == (5, 6, 7, 8)


def test_one_far_vector_leaves_the_bounds_tight(spark, monkeypatch):
    from lensframe.llm import topk

    rng = np.random.default_rng(6)
    plain = [(k, [float(x) for x in rng.normal(size=16) / 4]) for k in range(500)]
    sizes = {}
    keep = topk.materialise
    for name, rows in (("plain", plain), ("far", [*plain, (501, [4000.0] + [0.0] * 15)])):
        def counted(df, what, name=name):
            out = keep(df, what)
            if what == "va-candidates":
                sizes[name] = out.count()
            return out

        monkeypatch.setattr(topk, "materialise", counted)
        got = topk.top_k(topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id % 50 = 0").collect()
        whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
        for q in range(0, 500, 50):
            want = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:5]
            assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert sizes["far"] <= 1.5 * sizes["plain"]
    with pytest.raises(ValueError):
        topk.top_k(topk.whole_vectors(spark.createDataFrame([(0, [1e18]), (1, [1.0])], "vec_id long, embedding array<double>")), "true")
