"""The index of vectors against all products: sizes, ties, copies, additions, and the recall of probes."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from notelake import queries
from notelake.operators import neighbours, vectors
from notelake.operators.neighbours import VectorIndex

ODD = [(900, None), (901, [None] * 6), (902, [math.nan] * 6), (903, [1.0, 2.0]), (904, [-1.0, 0.5]), (905, [3.0, 1.0]), (None, [0.1] * 6), (906, [])]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    hubs = [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    near = [(i, [c + r.gauss(0, 0.2) for c in r.choice(hubs)]) for i in range(400)]
    return near + [(500 + i, hubs[0]) for i in range(200)] + ODD  # a third of all is one vector


def table(spark, rows):
    return spark.createDataFrame(rows, "note_id long, embedding array<double>")


def wanted(rows, chosen, k, threshold=-math.inf):
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for q, x in good:
        if chosen(q):
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(y) == len(x))
            out |= {(q, i): (n + 1, round(-s, 9)) for n, (s, i) in enumerate(found[:k]) if -s >= threshold}
    return out


def got(found):
    return {(r.query_id, r.note_id): (r["rank"], round(r.similarity, 9)) for r in found.collect()}


def test_exact_search_equals_all_products(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "PACK", 20)
    monkeypatch.setattr(neighbours, "ASKED", 7)
    index = VectorIndex(spark, f"{tmp_path}/v", table(spark, rows).repartition(3))
    asked = table(spark, rows).where("note_id % 5 = 0 OR note_id > 900").withColumnRenamed("note_id", "query_id")
    chosen = lambda q: q % 5 == 0 or q > 900
    for probes in (1, None):
        assert got(index.nearest(asked, 7, probes=probes)) == wanted(rows, chosen, 7)
    assert got(index.nearest(asked, None, 2.0)) == wanted(rows, chosen, None, 2.0)
    assert got(index.nearest(asked, 3, 2.0, probes=2)) == wanted(rows, chosen, 3, 2.0)
    more = [(2000 + i, [9.0 * math.cos(i + d) for d in range(6)]) for i in range(30)] + [(3000, [5.0, 5.0])]
    index.add(table(spark, more))
    assert got(index.nearest(asked, 7)) == wanted(rows + more, lambda q: chosen(q) and q < 2000, 7)
    again = VectorIndex(spark, f"{tmp_path}/v")
    assert got(again.nearest(asked, 7)) == wanted(rows + more, lambda q: chosen(q) and q < 2000, 7)
    assert index.nearest(asked.limit(0), 7).count() == 0
    assert max(len(r.ids) for r in index.lists.select("ids").collect()) <= 20
    with pytest.raises(ValueError):
        VectorIndex(spark, f"{tmp_path}/none")
    empty = VectorIndex(spark, f"{tmp_path}/empty", table(spark, rows).limit(0))
    assert empty.nearest(asked, 7).count() == 0


def test_probes_meet_most_neighbours(spark):
    """Recall at 10 of the probed lists, over all rows divisible by 20."""
    v = queries.vault_of(spark, "/root/testdata/sf0.1")
    asked = v.vectors.where("note_id % 20 = 0").withColumnRenamed("note_id", "query_id")
    true = {(r.query_id, r.note_id) for r in v.near.nearest(asked, 10).collect()}
    found = {(r.query_id, r.note_id) for r in v.near.nearest(asked, 10, exact=False).collect()}
    assert len(true & found) >= 0.9 * len(true)
    assert v.near.centres.probes[64] <= len(v.near.centres.of[64])


def test_filtered_similarity_serves_every_size(spark, rows):
    df = table(spark, rows)
    found = vectors.similar(df, df.where("note_id % 5 = 0 OR note_id > 900"), 4, -100.0)
    assert got(found) == wanted([x for x in rows if x[0] not in (902,)], lambda q: q % 5 == 0 or q > 900, 4)


def test_a_task_passes_on_what_may_be_nearest_alone():
    r = np.random.default_rng(4)
    x, q = r.normal(size=(4000, 8)), r.normal(size=(3, 8))
    x[3990:] = x[:10]  # ties
    rows = [{"size": 8, "list": 0, "ids": list(range(i, i + 200)), "x": x[i : i + 200].tobytes(), "queries": [5001, 5002, 5003], "q": q.tobytes(), "floors": [-9.0, -9.0, 1.0]} for i in range(0, 4000, 200)]
    got = pa.Table.from_batches(neighbours._met(10, False)(iter([pa.RecordBatch.from_pylist(rows)]))).to_pandas()
    assert len(got) < 300  # 600 without what the task has seen
    for i, floor in ((0, -9.0), (1, -9.0), (2, 1.0)):
        own = got[got.query_id == 5001 + i].sort_values(["similarity", "note_id"], ascending=[False, True]).note_id.tolist()[:10]
        exact = sum(x[:, d] * q[i, d] for d in range(8))
        assert own == [n for n in np.lexsort((np.arange(4000), -exact))[:10].tolist() if exact[n] >= floor]
