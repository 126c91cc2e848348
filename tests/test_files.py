"""Notes and results as Spark data sources, and what is written of an evaluation."""

import datetime
import json

import pytest
from pyspark.sql import Row

from notelake.operators import evaluation, ranking
from notelake.sources import files, markdown
from notelake.streaming import access

DOC = "---\ntitle: {}\n---\nbody of {}\n"


def tree(tmp_path):
    folder = tmp_path / "n"
    (folder / "x" / "y").mkdir(parents=True)
    for name in ("b.md", "a.md", "x/c.md", "x/y/d.md", "plain.txt", "x/.md"):
        (folder / name).write_text(DOC.format(name, name))
    return folder


def test_files_in_order_and_by_depth(spark, tmp_path, monkeypatch):
    folder = tree(tmp_path)
    names = lambda *paths, depth=None: [r.name for r in markdown.read_notes(spark, *map(str, paths), depth=depth).orderBy("place").collect()]
    assert names(folder) == ["a", "b", "c", "d"]
    assert [names(folder, depth=d) for d in (0, 1, 2, 3)] == [[], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]
    assert names(folder / "plain.txt", folder / "x", folder / "x" / "c.md") == ["plain", "c", "d", "c"]
    assert names(f"file://{folder}/x") == ["c", "d"]
    with pytest.raises(Exception, match="path not found"):
        names(folder, tmp_path / "none")
    with pytest.raises(Exception, match="depth is at least 0"):
        names(folder, depth=-1)
    rows = markdown.read_notes(spark, str(folder)).orderBy("place").collect()
    assert [(r.place, r.frontmatter, r.body, r.error) for r in rows[:2]] == [(0, "title: a.md", "body of a.md", None), (1, "title: b.md", "body of b.md", None)]
    assert [(r.file, r.body) for r in markdown.given_notes(spark, DOC.format(1, 2), "x").orderBy("place").collect()] == [("-", "body of 2"), ("-", None)]


def test_files_of_a_task(monkeypatch):
    monkeypatch.setattr(files, "TASK", 10)
    monkeypatch.setattr(files, "FILES", 3)
    sizes = [4, 4, 4, 30, 0, 0, 0, 0, 10]
    parts = files.dealt([(str(i), n, 0) for i, n in enumerate(sizes)], 5)
    assert [(p.first, len(p.files)) for p in parts] == [(5, 2), (7, 1), (8, 1), (9, 3), (12, 2)] and sum((p.files for p in parts), []) == list(map(str, range(9)))


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xff\xfe")
    (tmp_path / "b.md").write_text("")
    (tmp_path / "c.md").write_text("---\nt: 1\n---\n" + "word " * 2_000_000)
    got = markdown.read_notes(spark, str(tmp_path)).selectExpr("name", "error", "length(body) AS n").orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a", "not UTF-8", None), ("b", "no frontmatter", None), ("c", None, 9_999_999)]


def test_stream_goes_on_where_it_was(spark, tmp_path):
    folder, log = tree(tmp_path), str(tmp_path / "log")
    out = []

    def run(again=False):
        stream = markdown.stream_notes(spark, str(folder), log=log, depth=1)
        out.clear()
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda rows, _: out.extend(rows.select("name", "body", "place").collect())).start()
        q.awaitTermination()
        return sorted((r.name, r.body) for r in out)

    assert run() == [("a", "body of a.md"), ("b", "body of b.md")]
    assert run() == []
    (folder / "a.md").write_text(DOC.format("a", "another"))
    (folder / "e.md").write_text(DOC.format("e", "e"))
    assert run() == [("a", "body of another"), ("e", "body of e")] and sorted(r.place for r in out) == [2, 3]
    assert access.drained(markdown.stream_notes(spark, str(folder), log=log, depth=1)).count() == 4  # of another query: every entry
    with pytest.raises(Exception, match="log"):
        spark.readStream.format("notes").load(str(folder)).writeStream.format("noop").start().awaitTermination()


def result(task="ir", system="s", corpus="a/b", config="d", x=1.0):
    return Row(task=task, system=system, corpus=corpus, config=config, x=x)


def test_results(spark, tmp_path):
    place = tmp_path / "out"
    table = lambda *rows: spark.createDataFrame(list(rows), "task string, system string, corpus string, config string, x double").repartition(3)
    markdown.write_results(table(result(), result(system="t", x=float("nan"))), str(place))
    assert sorted(f.name for f in place.iterdir()) == ["ir-s-a_b-d.json", "ir-t-a_b-d.json"]
    assert json.loads((place / "ir-t-a_b-d.json").read_text())["x"] is None and (place / "ir-s-a_b-d.json").read_text().endswith("\n}\n")
    markdown.write_results(table(result(x=2.0)), str(place))
    assert json.loads((place / "ir-s-a_b-d.json").read_text())["x"] == 2.0 and len(list(place.iterdir())) == 2
    for wrong in ([result(x=3.0), result(x=4.0)], [result(x=3.0), result(system=None)]):
        with pytest.raises(Exception, match="results of one name|a result has no system"):
            markdown.write_results(table(*wrong), str(place))
        assert json.loads((place / "ir-s-a_b-d.json").read_text())["x"] == 2.0 and len(list(place.iterdir())) == 2  # nothing is left of it
    markdown.write_results(table(result(system="u")), str(place), mode="overwrite")
    assert [f.name for f in place.iterdir()] == ["ir-u-a_b-d.json"]
    with pytest.raises(Exception, match="need columns: system, corpus, config"):
        markdown.write_results(spark.createDataFrame([("ir",)], "task string"), str(place))


def test_result_of_an_evaluation(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, note_id long, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 13), (3, 14)], "query_id long, note_id long")
    queries = spark.createDataFrame([(1, "k"), (2, None), (3, "k")], "query_id long, class string")
    failed = spark.createDataFrame([(3, "search", "boom")], "query_id long, phase string, message string")
    took = spark.createDataFrame([("s", "search", n, 1, 2) for n in (30, 10, 20)] + [("s", "write", 7, 0, 0)], "system string, phase string, latency_us long, tokens_in long, tokens_out long")
    started = datetime.datetime(2024, 1, 2)
    args = ({"s": ranked, "none": ranked.limit(0)}, {"s": failed, "none": spark.createDataFrame([(i, "search", "x") for i in (1, 2, 3)], failed.schema)}, gold, queries.select("query_id"))
    rows = evaluation.results(*args, {"s": "1.2", "none": "0"}, "corpus", started, classes=queries, operations=took)
    markdown.write_results(rows, str(tmp_path))
    got = json.loads((tmp_path / "ir-s-corpus-default.json").read_text())
    assert (got["schema_version"], got["system_version"], got["run_started_at"], got["errors"]) == ("2", "1.2", "2024-01-02T00:00:00", [{"phase": "search:3", "message": "boom"}])
    assert (got["ir"]["queries"], got["ir"]["mrr"], got["ir"]["recall_at_1"], got["ir"]["recall_at_5"]) == (2, 0.25, 0.0, 0.5)
    assert set(got["ir_per_class"]) == {"k"} and got["ir_per_class"]["k"]["mrr"] == 0.5
    assert got["perf"]["search"] == {"latency_p50_us": 20, "latency_p99_us": 30, "llm_tokens_in_total": 3, "llm_tokens_out_total": 6} and got["perf"]["write"]["latency_p50_us"] == 7
    none = json.loads((tmp_path / "ir-none-corpus-default.json").read_text())
    assert none["ir"] == {"recall_at_1": 0.0, "recall_at_5": 0.0, "recall_at_10": 0.0, "mrr": 0.0, "ndcg_at_10": 0.0, "queries": 0} and none["ir_per_class"] == {} and len(none["errors"]) == 3 and none["perf"]["search"]["latency_p50_us"] == 0
    with pytest.raises(ValueError, match="known version"):
        evaluation.results(*args, {"s": "unknown"}, "corpus", started)


def test_hits_as_json(spark):
    hits = spark.createDataFrame([(1, "A", "d", "k", None, 0.5, 1, 2), (3, 'q"', "d", "k", "s", 0.9, 0, 0), (2, "B", "d", "k", "s", 0.9, 0, 0)], "note_id long, title string, domain string, kind string, snippet string, final double, links_in long, links_out long")
    got = json.loads(ranking.as_json(hits, "x", "d", "bm25").first().json)
    assert (got["query"], got["domain"], got["mode"], got["hits"], [r["id"] for r in got["results"]]) == ("x", "d", "bm25", 3, [2, 3, 1])
    assert got["results"][2] == {"id": 1, "title": "A", "domain": "d", "kind": "k", "snippet": None, "rank": 0.5, "links_in": 1, "links_out": 2}
    assert json.loads(ranking.as_json(hits.limit(0), "x").first().json) == {"query": "x", "domain": None, "mode": "normal", "hits": 0, "results": []}
    with pytest.raises(ValueError):
        ranking.as_json(hits, "x", mode="fast")
