"""Ranking on a vault of a few notes whose scores are known."""

import datetime
import math

import pytest

from notelake.config import Ranking
from notelake.operators import lexical, ranking, vectors
from notelake.operators.ranking import Filters

NOW = datetime.datetime(2024, 1, 31)


class Small:
    """A vault of given rows."""

    def __init__(self, spark, notes, edges=(), cosines=(), tags=()):
        self.spark, self.now = spark, NOW
        old = NOW - datetime.timedelta(days=400)
        full = [{"status": "active", "domain": "ark", "kind": "note", "updated_at": NOW, "access_count": 0, "last_accessed": None, "title": n["body"][:5]} | n for n in notes]
        names = "note_id long, title string, domain string, kind string, status string, updated_at timestamp_ntz, access_count long, last_accessed timestamp_ntz, body string"
        heads = spark.createDataFrame([tuple(n.get(c.split()[0]) for c in names.split(", ")) for n in full], names)
        self.notes, self.bodies = heads.drop("body"), heads.select("note_id", "body")
        self.index = lexical.Index(heads.select("note_id", "title", "body"))
        self.edges = spark.createDataFrame([(*e, old) for e in edges], "src long, dst long, edge_type string, created_at timestamp_ntz")
        self.tags = spark.createDataFrame(list(tags), "note_id long, tag string")
        self.vectors = spark.createDataFrame([(i, [c, math.sqrt(1 - c * c)]) for i, c in cosines], "note_id long, embedding array<double>")


A, B, C, D, E, X = range(1, 7)


@pytest.fixture(scope="module")
def worked(spark):
    text = {A: "BLAKE3 hashing of objects BLAKE3 hashing", B: "BLAKE3 hashing throughput", C: "notes on BLAKE3 and hashing of many other unrelated things here", D: "vault layout", E: "registry design", X: "bread recipe"}
    more = [{"note_id": 100 + i, "body": f"filler {i}", "updated_at": NOW - datetime.timedelta(days=300)} for i in range(10)]
    return Small(spark, [{"note_id": k, "body": t} for k, t in text.items()] + more, [(A, D, "references"), (A, E, "references")], [(A, 0.92), (B, 0.88), (C, 0.65), (D, 0.71), (E, 0.45), (X, 0.0)])


def finals(found):
    return {r.note_id: r for r in found.collect()}


def test_worked_example(worked):
    cfg = Ranking(top_k=5)
    got = finals(ranking.search(worked, "BLAKE3 hashing", vector=[1.0, 0.0], cfg=cfg))
    assert X not in got and {A, B, C, D, E} <= set(got)
    assert got[D].graph > 0 and got[D].final > got[C].final
    a = got[A]
    assert abs(a.final - (0.5 * 0.92 + 0.25 * a.graph + 0.25 * a.engagement)) < 1e-9 and abs(a.engagement - 0.6) < 1e-9


def test_modes(worked):
    by_words = finals(ranking.search(worked, "BLAKE3 hashing", mode="bm25"))
    assert set(by_words) == {A, B, C}  # no neighbour of the graph
    graph = finals(ranking.search(worked, "BLAKE3 hashing"))
    assert D in graph and E in graph and graph[D].graph == graph[E].graph == 1.0
    near = finals(ranking.search(worked, "anything", mode="semantic", vector=[1.0, 0.0]))
    assert {A, B, D} <= set(near) and near[A].final > near[C].final
    with pytest.raises(ValueError):
        ranking.search(worked, "x", mode="semantic")
    assert not finals(ranking.search(worked, "c-file"))


def test_filters(spark):
    day = lambda n: NOW - datetime.timedelta(days=n)
    v = Small(spark, [{"note_id": 1, "body": "fox a", "updated_at": day(1), "domain": "x"}, {"note_id": 2, "body": "fox b", "updated_at": day(5)}, {"note_id": 3, "body": "fox c", "status": "retracted"}, {"note_id": 4, "body": "fox d", "status": None}], tags=[(1, "t"), (2, "t"), (2, "u")])
    ids = lambda **f: set(finals(ranking.search(v, "fox", filters=Filters(**f))))
    assert ids() == {1, 2} and ids(since=day(2)) == {1} and ids(before=day(2)) == {2} and ids(since=day(6), before=day(4)) == {2}
    assert ids(tags=("t",)) == {1, 2} and ids(tags=("t", "u")) == {2} and ids(tags=("t", "t")) == set() and ids(domain="x") == {1}
    with pytest.raises(ValueError):
        ranking.search(v, "", filters=Filters(since=day(2)))
    # without a query a note has to be read or fresh
    assert set(finals(ranking.search(v, filters=Filters(tags=("t",))))) == {1}


def test_graph_may_respect_the_domain(spark):
    v = Small(spark, [{"note_id": 1, "body": "fox", "domain": "x"}, {"note_id": 2, "body": "hen", "domain": "y"}, {"note_id": 3, "body": "cow", "domain": "x"}], [(1, 2, "references"), (1, 3, "references")])
    assert set(finals(ranking.search(v, "fox", filters=Filters(domain="x")))) == {1, 2, 3}
    assert set(finals(ranking.search(v, "fox", filters=Filters(domain="x"), cfg=Ranking(respect_domain=True)))) == {1, 3}


def test_superseded_notes(spark):
    v = Small(spark, [{"note_id": 1, "body": "old words"}, {"note_id": 2, "body": "new thing"}], [(2, 1, "supersedes")])
    assert set(finals(ranking.search(v, "old"))) == {1, 2} and set(finals(ranking.search(v, "thing"))) == {2}


def test_engagement(spark):
    rows = [{"note_id": 1, "body": "a"}, {"note_id": 2, "body": "b", "access_count": 20, "last_accessed": NOW}, {"note_id": 3, "body": "c", "updated_at": NOW - datetime.timedelta(days=30)}, {"note_id": 4, "body": "d", "updated_at": None}]
    v = Small(spark, rows)
    got = {r.note_id: r.e for r in v.notes.select("note_id", ranking.engagement(NOW, Ranking()).alias("e")).collect()}
    assert 0.5 < got[1] < 0.7 and got[2] > 0.85 and got[3] < 0.2 and 0.1 < got[4] < 0.25


def test_threshold_includes_its_value(spark):
    scored = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.05), (4, float("nan"))], "note_id long, final double")
    assert [r.note_id for r in ranking.cut(scored, Ranking()).collect()] == [1, 2]


def test_hits_and_briefing(worked):
    found = ranking.search(worked, "BLAKE3 hashing", vector=[1.0, 0.0])
    got = {r.note_id: r for r in ranking.hits(worked, found, "BLAKE3 hashing").collect()}
    assert got[B].snippet == "[BLAKE3] [hashing] throughput" and got[A].links_out == 2 and got[D].links_in == 1 and got[D].snippet == "vault layout"
    about = ranking.about(worked, "BLAKE3 hashing").collect()
    assert len(about) == 3 and all(r.body_preview for r in about)
    text = ranking.briefing(worked, "BLAKE3 hashing")
    assert text.startswith("# Vault Briefing: BLAKE3 hashing\n\n## Key Notes (5 most relevant)\n\n### ") and "notes updated in last 7 days\n" in text


def test_auto_edges_never_replace(spark):
    v = Small(spark, [{"note_id": i, "body": "x"} for i in (1, 2, 3)], [(1, 2, "references")], [(1, 1.0), (2, 0.99), (3, 0.98)])
    near = vectors.similar(v.vectors, v.vectors.where("note_id = 1"), 5, 0.7)
    assert [(r.src, r.dst, r.source_type) for r in vectors.auto_edges(near, v.edges).collect()] == [(1, 3, "auto")]


def test_similarity_against_all_pairs(spark, monkeypatch):
    """Blocks of queries give what all pairs give, ties and vectors of another size or without values included."""
    import random

    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, [1.0]), (None, rows[4][1])]
    df = spark.createDataFrame(rows, "note_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 4)
    got = {}
    for x in vectors.similar(df, df.where("note_id % 5 = 0"), 4).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.note_id))
    full = {i: v for i, v in rows if i is not None and v and len(v) == 8}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {q: [(k + 1, i) for k, i in enumerate(sorted((i for i in full if i != q), key=lambda i: (-dot(full[q], full[i]), i))[:4])] for q in full if q % 5 == 0}
    assert {q: sorted(v) for q, v in got.items()} == want
