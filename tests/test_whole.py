"""Operators on inputs larger than the given tables' small ones."""

import math
import random

from notelake import queries
from notelake.operators import evaluation


def test_threshold_search_has_no_limit(spark, tmp_path):
    spark.range(1500).selectExpr("id AS vec_id", "array(1f, float(id % 7) / 100) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.queries()["knn_threshold"](spark, str(tmp_path)).where("query_id = 0").count() == 1499


def test_percentiles_gather_no_group(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "RANGE", 50)
    r = random.Random(4)
    rows = [("a", float(r.randrange(400))) for _ in range(1500)] + [("b", 7.0)] * 90 + [("b", 9.0), ("c", None), (None, 3.0), (None, 1.0), ("a", None)]
    got = evaluation.nearest_ranks(spark.createDataFrame(rows, "k string, x double"), "k", "x", {"low": 0.0, "p50": 0.5, "p99": 0.99, "top": 1.0})
    assert "collect_list" not in got._jdf.queryExecution().toString()
    for g in got.collect():
        s = sorted(x for k, x in rows if k == g.k and x is not None)
        assert tuple(g)[1:] == tuple(s[math.floor((len(s) - 1) * p + 0.5)] if s else 0 for p in (0, 0.5, 0.99, 1))
    assert got.count() == 4
