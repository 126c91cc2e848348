"""Counters kept by a stream's state, and notes taken in as they come."""

import datetime
import random

import pytest

from notelake.operators import graph
from notelake.operators.lexical import Index
from notelake.sources import markdown
from notelake.sources.providers import Hashing
from notelake.streaming import counters
from notelake.streaming.ingest import Ingest

NOTE = "---\ntitle: {title}\nauthor: me\ndomain: d\nintent: i\nkind: note\nstatus: {status}\ntags: [x]\n{more}---\n{body}\n"


def note(folder, name, title, body, status="active", more=""):
    (folder / f"{name}.md").write_text(NOTE.format(title=title, body=body, status=status, more=more))


def test_counters_in_three_batches(spark, tmp_path):
    """Equal to one grouping, over restarts, with late events and one note that has a third of them."""
    r, start = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = [(1 if r.random() < 0.33 else r.randrange(40), start + datetime.timedelta(minutes=r.randrange(10**5))) for _ in range(3000)] + [(None, start), (7, None)]
    r.shuffle(rows)
    (tmp_path / "in").mkdir()
    stream = counters.counters(counters.reads(spark.readStream.schema("note_id long, ts timestamp_ntz").parquet(str(tmp_path / "in"))))
    for i in range(3):
        spark.createDataFrame(rows[i::3], "note_id long, ts timestamp_ntz").write.mode("append").parquet(str(tmp_path / "in"))
        counters.stored(stream, str(tmp_path / "out"))
    want = {}
    for k, ts in rows:
        if k is not None:
            n, last = want.get(k, (0, None))
            want[k] = n + 1, max(filter(None, (last, ts)), default=None)
    got = {x.note_id: (x.access_count, x.last_accessed) for x in counters.latest(spark, str(tmp_path / "out")).selectExpr("note_id", "access_count", "CAST(last_accessed AS timestamp_ntz) AS last_accessed").collect()}
    assert got == want
    counters.stored(stream, str(tmp_path / "out"))  # nothing new
    assert counters.latest(spark, str(tmp_path / "out")).count() == len(want)


def test_counters_of_links_and_quiet_notes(spark, tmp_path):
    schema = "src long, dst long, n int"
    (tmp_path / "in").mkdir()
    stream = counters.counters(counters.links(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), idle_ms=1)
    for rows in ([(1, 2, 1), (1, 3, 1), (2, 2, 1), (None, 3, 1)], [(1, 3, -1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        counters.stored(stream, str(tmp_path / "out"))
    got = {x.note_id: x[1:] for x in counters.latest(spark, str(tmp_path / "out")).select("note_id", "links_out", "links_in", "access_count", "last_accessed", "quiet").collect()}
    assert {k: v[:4] for k, v in got.items()} == {1: (1, 0, 0, None), 2: (1, 2, 0, None), 3: (0, 1, 0, None)}
    assert got[2][4]  # not touched by the second run
    assert counters.latest(spark, str(tmp_path / "none")).count() == 0


def test_events_are_added_up_on_the_way(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1))] * 5000 + [(2, None)], "note_id long, ts timestamp_ntz").coalesce(1)
    got = counters.summed(counters.reads(rows)).collect()
    assert len(got) <= 4 and sum(x.reads for x in got) == 5001


def test_notes_are_taken_in_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    note(folder, "a", "Alpha", "see [[Beta]] and [[Gone]]")
    note(folder, "c", "Gamma", "plain words", more="links:\n  - target: alpha\n    rel: extends\n")
    (folder / "bad.md").write_text("nothing")
    note(folder, "odd", "Odd", "x", status="poem")
    take = Ingest(spark, str(tmp_path / "vault"), Hashing(8))
    stream = markdown.stream_notes(spark, str(folder), log=str(tmp_path / "log"))
    take.run(stream)
    names = lambda: {x.note_id: x.title for x in take.heads().collect()}
    edges = lambda: {(names()[e.src], names()[e.dst], e.edge_type) for e in take.edges().collect()}
    counts = lambda: {t: take.table(t).count() for t in ("versions", "contents", "links", "edges", "embeddings", "rejected")}
    found = lambda q: {names()[x.note_id] for x in Index(store=take.store).bm25(q).collect()}
    assert set(names().values()) == {"Alpha", "Gamma"} and edges() == {("Gamma", "Alpha", "extends")}
    assert sorted(x.error for x in take.table("rejected").collect()) == ["no frontmatter", "no such status: poem"]
    assert found("plain") == {"Gamma"} and take.vectors().count() == 2
    before = counts()
    take.run(stream)
    assert counts() == before
    note(folder, "c", "Gamma", "plain words", more="links: [{target: alpha, rel: extends}]\n")  # as it was, written otherwise
    take.run(stream)
    assert counts() == before
    note(folder, "b", "BETA", "a new one")  # makes a dead link of another note good
    take.run(stream)
    assert edges() == {("Gamma", "Alpha", "extends"), ("Alpha", "BETA", "references")} and found("new") == {"BETA"}
    after = counts()
    rows = markdown.read_notes(spark, str(folder / "b.md"))
    take.batch(rows, take.table("versions").selectExpr("max(batch)").first()[0])  # a batch that is repeated
    assert counts() == after and found("new") == {"BETA"} and take.store.totals()["_notes"] == 3
    note(folder, "a", "First", "no links, other words")  # a title that others named, and links, are gone
    take.run(stream)
    assert edges() == set() and found("words") == {"First", "Gamma"} and found("see") == set()
    head = take.heads().where("title = 'First'").first()
    assert (head.seq, head.prev) == (1, 0) and graph.degrees(take.edges(), take.heads()).where("links_out + links_in > 0").count() == 0
    note(folder, "c", "Gamma", "[[First]]")
    take.run(stream)
    assert edges() == {("Gamma", "First", "references")}
    note(folder, "a", "First", "no links, other words", status="retracted")
    take.run(stream)
    assert edges() == set()
    assert Ingest(spark, str(tmp_path / "vault")).heads().count() == 3  # another session


def test_empty_batch_and_clash(spark, tmp_path, monkeypatch):
    take = Ingest(spark, str(tmp_path / "vault"))
    take.batch(markdown.given_notes(spark, "x").limit(0), 0)
    assert take.heads().count() == take.edges().count() == take.store.totals()["_notes"] == 0
    rows = markdown.given_notes(spark, *[NOTE.format(title=t, body="b", status="active", more="") for t in ("one", "two")])
    take.batch(rows, 1)
    assert [x.title for x in take.heads().collect()] == ["two"]  # one file, the later of two
    from pyspark.sql import functions as F

    monkeypatch.setattr("notelake.streaming.ingest.F.xxhash64", lambda *c: F.lit(5).cast("long"))
    with pytest.raises(ValueError, match="two files share"):
        take.batch(rows.withColumn("file", F.concat("file", F.col("place").cast("string"))), 2)
