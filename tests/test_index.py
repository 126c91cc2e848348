"""The stored index: appended to, deleted from, merged and found again, and best notes without scoring every block."""

import glob
import random
import shutil

import pyarrow as pa
import pytest

from notelake import queries
from notelake.config import FIELD_WEIGHTS
from notelake.operators import lexical, postings
from notelake.operators.lexical import Index
from notelake.operators.postings import Store
from notelake.plans.vault import Vault

FIELDS = ("title", "body")
QUERIES = ["fox", "the OR fox", "the NOT fox", '"the fox"', "ca* OR dog", "title:fox OR \"dog the fox\"", "the cat dog", "zebra OR (the NOT cat)", "title:the AND body:ca*"]


def text(r, n):
    return " ".join(r.choices(["the", "fox", "cat", "dog", "cart", "hen", "ox", "Élan"], [9, 1, 2, 2, 1, 1, 1, 1], k=n))


def table(spark, rows):
    return spark.createDataFrame([(i, *t) for i, t in rows.items()], "note_id long, title string, body string")


@pytest.fixture(scope="module")
def notes():
    r = random.Random(3)
    return {i: (text(r, 3), text(r, int(2 ** r.uniform(0, 9)))) for i in range(700)}


def scores(index, query, weights=None):
    return {r.note_id: round(r.bm25, 9) for r in index.bm25(query, weights).collect()}


def test_changes_give_what_a_new_index_gives(spark, notes, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    path, now = f"{tmp_path}/index", dict(notes)
    store = Store(spark, path, FIELDS)
    assert store.refresh(table(spark, now), "a") and not store.refresh(table(spark, now), "b") and store.stamp == "b"
    files = {s["path"] for s in store.segments}
    r = random.Random(4)
    for turn in range(3):
        for i in r.sample(sorted(now), 40):
            del now[i]
        for i in r.sample(sorted(now), 30):
            now[i] = (text(r, 3), text(r, 20))
        now |= {1000 * (turn + 1) + k: (text(r, 2), text(r, 30)) for k in range(20)}
        assert store.refresh(table(spark, now))
    assert files < {s["path"] for s in store.segments} and len(store.segments) == 4  # what stayed was not written again
    again, whole = Store(spark, path, FIELDS), Store(spark, f"{tmp_path}/whole", FIELDS)
    whole.refresh(table(spark, now))
    assert again.totals() == whole.totals() and again.totals()["_notes"] == len(now)
    for q in QUERIES:
        assert scores(Index(store=again), q) == scores(Index(store=whole), q)
    assert again.merge(many=2) and len(again.segments) == 1 and again.tombstones is None and again.totals() == whole.totals()
    for q in QUERIES[:4]:
        assert scores(Index(store=Store(spark, path, FIELDS)), q) == scores(Index(store=whole), q)
    assert not again.merge(many=2)
    assert store.version < again.version and scores(Index(store=store), "fox") == scores(Index(store=whole), "fox")  # readers of an earlier version
    with pytest.raises(Exception, match="already exists"):
        store.refresh(table(spark, {1: ("late", "writer")}))


@pytest.mark.parametrize(("first", "weights"), [(2, {"body": 1.0}), (24, None)])
def test_best_notes_equal_those_of_all(spark, notes, monkeypatch, first, weights):
    monkeypatch.setattr(postings, "BLOCK", 2)
    monkeypatch.setattr(lexical, "FIRST", first)
    index = Index(table(spark, notes))
    allowed = spark.range(0, 700, 3).withColumnRenamed("id", "note_id")
    for q in [x for x in QUERIES if weights is None or "title" not in x]:
        every = index.bm25(q, weights).orderBy("bm25", "note_id").collect()
        assert [tuple(r) for r in index.top(q, 15, weights).collect()] == [tuple(r) for r in every[:15]]
        assert [r.note_id for r in index.top(q, 2, weights, allowed).collect()] == [r.note_id for r in every if r.note_id % 3 == 0][:2]
    assert index.top("fox (", 5).count() == 0 and index.top("", 5).count() == 0 and index.top("zebra", 5).count() == 0


def test_bounds_hold(spark, notes):
    index = Index(table(spark, notes))
    for q in QUERIES[1:6]:
        asked = index.asked(q, FIELD_WEIGHTS)
        bound = {r.block: r.bound for r in asked.bounds().collect()}
        blocks = {r.note_id: r.block for r in index.store.notes().collect()}
        for r in index.bm25(q).collect():
            assert -r.bm25 <= bound[blocks[r.note_id]]


def test_a_common_word_is_read_in_part(spark):
    """Of a word that most notes have, blocks with the greatest bounds are scored and others aren't."""
    v = queries.vault_of(spark, "/root/testdata/sf0.1")
    asked = v.index.asked("the", {"body": 1.0})
    chosen = asked.chosen(10)
    there = asked.bounds().agg({"n": "sum"}).first()[0]
    read = sum(r.n for r in asked.bounds().collect() if r.block in chosen) if isinstance(chosen, list) else chosen.agg({"n": "sum"}).first()[0]
    assert there > 5000 and read < there / 3
    best = asked.index.bm25("the", {"body": 1.0}).orderBy("bm25", "note_id").limit(10)
    assert [tuple(r) for r in asked.top(10).collect()] == [tuple(r) for r in best.collect()]


def test_only_folders_of_the_terms_are_opened(spark, notes):
    store = Index(table(spark, notes)).store
    every = store._read(postings.POSTINGS, store._folders(range)).inputFiles()
    one = store.postings(["fox"]).inputFiles()
    assert one and len({f.rsplit("/", 2)[1] for f in one}) == 1 and len(one) < len(every) / 2
    assert not store.postings([]).inputFiles() and store.postings(["nowhere"]).count() == 0
    plan = store.postings(["fox"]).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "places" not in plan and "EqualTo(term,fox)" in plan.replace(" ", "")


def test_appended_documents_are_found_in_the_session_and_by_the_next(spark, tmp_path):
    for t in ("documents", "part", "labels", "events"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    first = queries.vault_of(spark, str(tmp_path))
    n = first.notes.count()
    assert first.index.top("zyzzyva", 5).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10**6, "Zyzzyva\nthe last word", "en", "src0", 21)], docs.schema).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    same = queries.vault_of(spark, str(tmp_path))
    assert [r.note_id for r in same.index.top("zyzzyva", 5).collect()] == [10**6] and same.notes.count() == n + 1
    segments = [s["path"] for s in same.index.store.segments]
    assert len(segments) == 2
    other = Vault(spark, str(tmp_path))  # what a later session starts with
    assert [s["path"] for s in other.index.store.segments] == segments and other.index.top("zyzzyva", 5).count() == 1
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert same.index.top("zyzzyva", 5).count() == 0 and same.index.totals["_notes"] == 0


def test_empty_and_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "fox"), (4, "fox " * 3000), (5, "fox"), (5, "fox cat")], "note_id long, body string")
    index = Index(rows)
    assert index.totals == {"_notes": 6, "body": 3003}
    assert {r.note_id for r in index.bm25("fox").collect()} == {4, 5} and index.bm25("fox").count() == 2  # notes of one id are one note
    assert Index(rows.limit(0)).bm25("fox").count() == 0


def test_what_a_cleared_folder_lost_is_built_again(spark, notes, tmp_path):
    store = Store(spark, f"{tmp_path}/index", FIELDS)
    store.refresh(table(spark, notes), "a")
    shutil.rmtree(store.segments[0]["path"])
    again = Store(spark, f"{tmp_path}/index", FIELDS)
    assert again.segments == [] and again.stamp is None and again.refresh(table(spark, notes), "a")
    assert Index(store=again).top("fox", 5).count() == 5 and again.totals()["_notes"] == len(notes)


def test_texts_are_inverted_in_slices_and_not_stored_between_steps(spark, notes, tmp_path, monkeypatch):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/texts-*"))
    store = Store(spark, f"{tmp_path}/index", FIELDS)
    store.refresh(table(spark, notes))
    assert set(glob.glob(f"{shared}/texts-*")) == before and store.totals()["_notes"] == len(notes)
    monkeypatch.setattr(postings, "SLICE", (1000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(["x" * 90 * (i % 5) for i in range(29)] + ["y" * 5000])], names=["note_id", "body"])
    parts = list(postings._slices(batch, 1))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(len(p) <= 8 and (len(p) == 1 or sum(map(len, p.column(1).to_pylist())) <= 1000) for p in parts)
