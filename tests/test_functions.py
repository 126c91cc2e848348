import datetime

import pytest
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.operators import browse, evaluation, graph, lexical, mutations, versions
from notelake.sources import markdown
from notelake.sources.providers import Hashing
from notelake.streaming import access


def test_spans():
    now = datetime.datetime(2024, 3, 1)
    assert T.cutoff("3mo", now) == now - datetime.timedelta(days=90)
    for bad in ("1y", "abc", "", "1D", "d", "last tuesday", "2026-01-01"):
        with pytest.raises(ValueError):
            T.cutoff(bad, now)
    assert T.tag_checked("Red-2") == "red-2"
    for bad in ("", "a b", "é"):
        with pytest.raises(ValueError):
            T.tag_checked(bad)


def test_query_language():
    assert lexical.parse("x NOT y z").how == "NOT"
    assert lexical.parse("x NOT y AND z").how == "AND"
    for bad in ("c-file", "foo: bar", "NOT x", "", '"open', "(x", "."):
        with pytest.raises(ValueError):
            lexical.parse(bad)
    assert lexical.plain_query("the c-file is open?") == '"the" "c" "file" "is" "open"'


def test_texts_and_queries_fold_alike(spark):
    words = ["Škoda", "FAÇADE", "naïve", "ờ", "Ĳ", "été", "한국", "ﬁn", "plain"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.tokens(F.col("w")).alias("t")).collect()
    assert all(tuple(r.t) == T.words(r.w) for r in rows)
    notes = spark.createDataFrame([(1, "škoda car"), (2, "skoda two")], "note_id long, body string")
    assert {r.note_id for r in lexical.bm25(notes, "škoda", {"body": 1.0}).collect()} == {1, 2}


def test_bm25_by_hand(spark):
    notes = spark.createDataFrame([(1, "the quick fox fox"), (2, "lazy dogs"), (3, "façade of a fox"), (4, None)], "note_id long, body string")
    got = {r.note_id: r.bm25 for r in lexical.bm25(notes, "fox", {"body": 1.0}).collect()}
    assert set(got) == {1, 3} and got[1] < got[3] < 0
    assert [r.note_id for r in lexical.bm25(notes, "facade", {"body": 1.0}).collect()] == [3]
    assert lexical.bm25(notes, "c-file", {"body": 1.0}).count() == 0
    assert [r.note_id for r in lexical.bm25(notes, '"fox fox"', {"body": 1.0}).collect()] == [1]
    assert {r.note_id for r in lexical.bm25(notes, '"a fo*" OR "the quick fo"*', {"body": 1.0}).collect()} == {1}


def test_snippets():
    p = lambda q: lexical.scored_phrases(lexical.parse(q))
    assert lexical.snippet("the quick brown fox", p("fox")) == "the quick brown [fox]"
    assert lexical.snippet("Façade of façades", p("facade")) == "[Façade] of façades"
    long = " ".join(f"w{i}" for i in range(100))
    got = lexical.snippet(long, p("w50"))
    assert got.startswith("...") and got.endswith("...") and "[w50]" in got and len(got.split()) == 32
    assert lexical.snippet(long, p("none")) == " ".join(f"w{i}" for i in range(32)) + "..."
    sentence = long.replace("w45 ", "w45. ")
    assert lexical.snippet(sentence, p("w50")).startswith("...w46 ")
    assert lexical.snippet(None, p("x")) == "" and lexical.snippet("a b c d", p('"b c"')) == "a [b c] d"


def test_graph_counts_seed_pairs_twice(spark):
    edges = spark.createDataFrame([(1, 2, "references"), (1, 3, "supersedes"), (4, 1, "supersedes")], "src long, dst long, edge_type string")
    seeds = spark.createDataFrame([(1, 1.0), (2, 0.5)], "note_id long, seed double")
    got = {r.note_id: r.graph for r in graph.expand(seeds, edges).collect()}
    assert got == {2: 1.0, 1: 0.5, 4: 0.75}


def test_links(spark):
    notes = spark.createDataFrame([(1, "One", "active"), (2, "Two", "active"), (3, "two", "active"), (4, "Gone", "retracted")], "note_id long, title string, status string")
    texts = spark.createDataFrame([(1, "see [[TWO]] and [[2]]\n again [[TWO]] [[Gone]] [[One]] [[nowhere]]"), (2, None)], "note_id long, body string")
    links = graph.text_links(texts)
    assert [(r.target, r.context) for r in links.orderBy("pos").collect()][:2] == [("TWO", "see [[TWO]] and [[2]]"), ("2", "see [[TWO]] and [[2]]")]
    kept = spark.createDataFrame([(3, 1, "references", 1.0, "auto", None), (1, 2, "references", 1.0, "auto", None)], "src long, dst long, edge_type string, weight double, source_type string, context string")
    stated = graph.stated_links(spark.createDataFrame([(1, [("2", "depends-on")]), (2, [("One", "references")])], "note_id long, links array<struct<target:string,rel:string>>"))
    got = {(r.src, r.dst, r.edge_type, r.weight, r.source_type) for r in graph.synced(links.unionByName(stated), notes, kept).collect()}
    assert got == {(1, 2, "references", 1.0, "auto"), (3, 1, "references", 1.0, "auto"), (1, 2, "depends-on", 2.0, "frontmatter"), (2, 1, "references", 1.0, "frontmatter")}


def edit(spark, fm, body, ops):
    r = versions.edited(spark.createDataFrame([(1, fm, body)], "note_id long, frontmatter string, body string"), ops).first()
    return r.error or (r.frontmatter, r.body)


def test_edits(spark):
    fm, body = "title: T\n", "TODO one\nTODO two\n"
    assert edit(spark, fm, body, [{"op": "append", "text": "x"}]) == (fm, "TODO one\nTODO two\nx")
    assert edit(spark, fm, body, [{"op": "prepend", "text": "x"}]) == (fm, "x\n" + body)
    assert edit(spark, fm, body, [{"op": "replace", "old": "TODO", "new": "x"}]) == "2 places"
    assert edit(spark, fm, body, [{"op": "replace", "old": "TODO", "new": "x", "all": True}]) == (fm, "x one\nx two\n")
    assert edit(spark, fm, body, [{"op": "replace", "old": "TODO", "new": "x", "count": 2}]) == (fm, "x one\nx two\n")
    assert edit(spark, fm, body, [{"op": "replace", "old": "TODO", "new": "x", "count": 3}]) == "2 places"
    assert edit(spark, fm, body, [{"op": "append", "text": "y"}, {"op": "replace", "old": "gone", "new": ""}]) == "0 places"
    assert edit(spark, fm, body, [{"op": "set", "text": "---\ntitle: U\n---\nnew"}]) == ("title: U\n", "new")
    assert edit(spark, fm, body, [{"op": "set", "text": "no parts"}]) == "no frontmatter"
    assert edit(spark, fm, body, [{"op": "replace", "old": "title: T", "new": "title: V"}, {"op": "append", "text": "z"}])[0] == "title: V\n"


def test_line_diff():
    def least(a, b):
        best = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, best[0] = best[0], i
            for j, y in enumerate(b, 1):
                last, best[j] = best[j], last if x == y else 1 + min(best[j], best[j - 1])
        return best[-1]

    import random

    r = random.Random(2)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        script = versions.line_diff(a, b)
        assert [x for t, x in script if t != "+"] == a and [x for t, x in script if t != "-"] == b
        assert sum(t != " " for t, _ in script) == least(a, b)
    lines = [str(i) for i in range(20000)]
    assert sum(t != " " for t, _ in versions.line_diff(lines, lines[:10000] + ["x"] + lines[10001:])) == 2


def test_histories_and_differences(spark):
    rows = [(1, i, f"line {i}\nsame") for i in range(300)] + [(2, 0, None), (2, 1, "a\nb")]
    chain = spark.createDataFrame(rows, "note_id long, seq long, text string").withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    got = versions.history(chain, 1).orderBy("depth").collect()
    assert [r.seq for r in got] == list(range(299, -1, -1))
    assert {(r.note_id, r.seq): (r.added, r.deleted) for r in versions.diffs(chain).where("note_id = 2 OR seq < 2").collect()} == {(1, 1): (1, 1), (2, 1): (2, 1)}


def test_inserted_links(spark):
    at = lambda body, target, rel: spark.createDataFrame([(body, target, rel)], "b string, t string, r string").select(versions.linked_body(F.col("b"), F.col("t"), F.col("r"))).first()[0]
    assert at("text\n", "x", "depends-on") == "text\n\n## Depends On\n- [[x]]"
    assert at("text [[x]]", "x", "depends-on") == "text [[x]]"
    assert at("a\n## Extends\n- [[1]]\nb\n- [[2]]\nc\n## Other\n- [[3]]", "x", "extends") == "a\n## Extends\n- [[1]]\nb\n- [[2]]\n- [[x]]\nc\n## Other\n- [[3]]"
    assert at("## Extends\n## Other\n- [[3]]", "x", "extends") == "## Extends\n- [[x]]\n## Other\n- [[3]]"
    assert at("## Extends", "x", "extends") == "## Extends\n- [[x]]"


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", n, i + 1) for i, n in enumerate("abcde")], "query_id string, note_id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "e"), ("unanswered", "a")], "query_id string, note_id string")
    queries = spark.createDataFrame([("q",), ("unanswered",), ("nothing relevant",)], "query_id string")
    got = {r.query_id: r for r in evaluation.per_query(ranked, gold, queries).collect()}
    assert (got["q"].recall_at_1, got["q"].recall_at_5, got["q"].mrr) == (0.0, 1.0, 0.5)
    assert (got["unanswered"].recall_at_5, got["unanswered"].mrr, got["unanswered"].ndcg_at_10) == (0.0, 0.0, 0.0)
    assert (got["nothing relevant"].recall_at_1, got["nothing relevant"].ndcg_at_10) == (1.0, 1.0)
    worst = spark.createDataFrame([("q", n, i + 1) for i, n in enumerate("cdab")], "query_id string, note_id string, rank int")
    two = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, note_id string")
    assert round(evaluation.per_query(worst, two, queries.limit(1)).first().ndcg_at_10, 4) == 0.5706
    lat = spark.createDataFrame([("a", x) for x in range(10, 101, 10)], "k string, x long")
    assert evaluation.nearest_ranks(lat, "k", "x", {"p": 0.5}).first().p == 60
    assert evaluation.regressions({"recall_at_5": 0.9, "mrr": 1, "ndcg_at_10": 1, "queries": 10}, {"recall_at_5": 1, "mrr": 1, "ndcg_at_10": 1, "queries": 10}) == ["recall_at_5"]
    assert evaluation.regressions({}, None) == []
    failed = spark.createDataFrame([("q", "search", "lost")], "query_id string, phase string, message string")
    assert evaluation.answered(queries, failed).count() == 2
    with pytest.raises(ValueError):
        evaluation.known_version("unknown")


def test_tags_and_selections(spark):
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "note_id long, tag string")
    assert [r[0] for r in browse.with_all_tags(tags, ["a", "b"]).collect()] == [1]
    assert browse.with_all_tags(tags, ["a", "a"]).count() == 0
    notes = spark.createDataFrame([(1,), (2,), (12,)], "note_id long")
    assert browse.with_each_tag(notes, tags, ["a", "a"]).count() == 2
    with pytest.raises(ValueError):
        browse.bulk(None, None)
    assert browse.resolve(notes, "2") == 2
    for bad in ("1", "9"):
        with pytest.raises(ValueError):
            browse.resolve(notes, bad)
    with pytest.raises(ValueError):
        mutations.selected(notes, spark.createDataFrame([(1,), (7,)], "note_id long"), None)
    with pytest.raises(ValueError):
        mutations.selected(notes, notes, notes)
    now = datetime.datetime(2024, 1, 1)
    events = mutations.tag_events(notes.where("note_id < 3"), ["c"], ["a"], now)
    assert {(r.note_id, r.tag) for r in mutations.tags_after(tags, events).collect()} == {(1, "b"), (1, "c"), (2, "c")}
    with pytest.raises(ValueError):
        mutations.tag_events(notes, [], [], now)


def test_markdown(spark, tmp_path):
    (tmp_path / "notes" / "deep").mkdir(parents=True)
    (tmp_path / "notes" / "a.md").write_text("---\ntitle: \"A: b\"\nauthor: me\ndomain: d\nintent: i\nkind: note\nstatus: active\ntags:\n  - x\n  - y\nlinks:\n  - target: b\n    rel: extends\n---\n\n\tbody\n\n")
    (tmp_path / "notes" / "deep" / "b.md").write_text("no parts")
    (tmp_path / "notes" / "c.txt").write_text("---\ntitle: t\ntitle: u\n---\nx")
    got = {r.name: r for r in markdown.fields(markdown.read_notes(spark, str(tmp_path / "notes"))).collect()}
    assert set(got) == {"a", "b"} and got["b"].error == "no frontmatter" and got["b"].meta is None
    a = got["a"]
    assert (a.body, a.meta.title, a.meta.tags, a.meta.links[0].target, a.meta.problem) == ("body", "A: b", ["x", "y"], "b", None)
    assert markdown.read_notes(spark, str(tmp_path / "notes"), depth=1).count() == 1
    one = markdown.fields(markdown.read_notes(spark, str(tmp_path / "notes" / "c.txt"))).first()
    assert one.meta.problem == "repeated key: title"
    with pytest.raises(Exception, match="path not found"):
        markdown.read_notes(spark, str(tmp_path / "none")).count()
    (tmp_path / "q.jsonl").write_text('{"query_id":"1","query":"x","relevant":["a"]}\n\n{"query_id":"2","query":"y","relevant":[],"class":"c"}\n')
    assert [(r.query_id, r["class"]) for r in markdown.read_queries(spark, str(tmp_path / "q.jsonl")).orderBy("query_id").collect()] == [("1", None), ("2", "c")]
    cfg = markdown.ranking_of("[search]\nthreshold = 0.2\n[search.bm25]\nweight_title = 7\ntop_k = 9\n[search.weights]\nactivation = 0.5\n[search.graph]\nrespect_domain_filter = true\n")
    assert (cfg.threshold, cfg.fields["title"], cfg.fields["body"], cfg.top_k, cfg.engagement, cfg.cosine, cfg.respect_domain) == (0.2, 7, 1.0, 9, 0.5, 0.5, True)


def test_markdown_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("---\nt: 1\n---\nx")
    got = access.drained(markdown.stream_notes(spark, str(tmp_path / "in"), log=str(tmp_path / "log"))).collect()
    assert [(r.frontmatter, r.body) for r in got] == [("t: 1", "x")]


def test_facts(spark, tmp_path):
    from notelake.config import KINDS
    from notelake.plans import facts

    for _ in range(2):
        facts.created(spark, str(tmp_path))
        facts.seeded(spark, str(tmp_path))
    assert facts.fact(spark, str(tmp_path), "kinds").count() == len(KINDS)
    spark.createDataFrame([("h", "p")], facts.FACTS["contents"]).write.mode("append").parquet(f"{tmp_path}/contents")
    assert facts.reset(spark, str(tmp_path))["kinds"] == len(KINDS) == facts.reset(spark, str(tmp_path), confirm=True)["kinds"]
    assert facts.fact(spark, str(tmp_path), "kinds").count() == 0 and facts.fact(spark, str(tmp_path), "contents").count() == 1


def test_captures(spark):
    templates = spark.createDataFrame([(1, "d", "i", "spec", "draft", ["t"])], "note_id long, domain string, intent string, kind string, status string, tags array<string>")
    drafts = spark.createDataFrame([(1, "# Head\nx", None, None, None, None, None, None, 1), (2, " \n", None, "d", None, None, None, None, None), (3, "b", None, "d", None, "poem", None, ["u"], None), (4, "b", "T", "d", None, None, None, None, None), (5, "b", None, None, None, None, None, None, 9)],
                                   "draft_id long, body string, title string, domain string, intent string, kind string, status string, tags array<string>, template long")
    got = {r.draft_id: r for r in mutations.captured(drafts, templates).collect()}
    assert (got[1].title, got[1].domain, got[1].kind, got[1].status, got[1].tags, got[1].error) == ("Head", "d", "spec", "draft", ["t"], None)
    assert [got[i].error for i in (2, 3, 4, 5)] == ["empty body", "no such kind", None, "no such template"]
    assert (got[4].title, got[4].intent, got[4].kind, got[4].status) == ("T", "research", "reference", "active")


def test_words_that_cancel_still_have_length_one():
    """`the` and `of` meet in a place of 32 with opposite signs: their sum is no text without words."""
    norms = (Hashing(32).embed(["the of", "the of the", "", "the of of the"]) ** 2).sum(1)
    assert [round(x, 9) for x in norms] == [1, 1, 0, 1]
