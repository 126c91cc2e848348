"""The catalogue of queries over the given tables, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

import datetime
import uuid
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import KINDS, Ranking
from .functions import text as T
from .operators import batched, browse, evaluation, graph, lexical, mutations, ranking, vectors, versions
from .plans.tables import shared_folder, written
from .plans.vault import Vault, live
from .sources import markdown, providers
from .streaming import access, counters

FTS = "thing OR shes OR ound"
DAY = datetime.datetime
#: How near vectors of the given tables have to be; hardly any two are as near as the defaults ask.
NEAR = 0.3


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _vector(v: Vault, note_id: int = 0) -> list[float] | None:
    row = v.vectors.where(F.col("note_id") == note_id).first()
    return None if row is None else list(row["embedding"])


_kinds = ", ".join(f"'{k}'" for k in KINDS)
HEADS = f"""
lab AS (SELECT doc_id, max(quality) q, max(toxic) t FROM labels GROUP BY 1),
acc AS (SELECT user_id AS note_id, count(*) AS access_count, max(ts) AS last_accessed FROM events WHERE event_type = 'view' GROUP BY 1),
heads AS (SELECT d.doc_id AS note_id, substr(trim(regexp_replace(split_part(text, chr(10), 1), '^#+', ''), ' '), 1, 80) AS title, source AS domain, lang AS intent,
  ([{_kinds}])[CAST(d.doc_id % 12 AS INT) + 1] AS kind, CASE WHEN t = 1 THEN 'retracted' WHEN q = 0 THEN 'deprecated' WHEN q = 1 THEN 'active' ELSE 'draft' END AS status,
  TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id % 720 AS INT)) AS updated_at, text AS body, coalesce(access_count, 0) AS access_count, last_accessed
  FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id LEFT JOIN acc ON acc.note_id = d.doc_id),
live AS (SELECT * FROM heads WHERE status <> 'retracted')"""
TAGS = "tags AS (SELECT p_partkey AS note_id, unnest(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)]))) AS tag FROM part)"
EDGES = """edges AS (SELECT l_suppkey AS src, l_partkey AS dst, (['references', 'depends-on', 'supersedes', 'contradicts', 'extends', 'informed-by', 'unknown'])[l_linenumber] AS edge_type,
  min(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2, 3)"""
VERSIONS = "versions AS (SELECT conv_id AS note_id, turn AS seq, CASE WHEN turn > 0 THEN turn - 1 END AS prev, sha256(text) AS content_hash FROM conversations)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
EVALUATED = f"""q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0),
pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS note_id, q.label = e.label AS good, {DOT.format(a="q.embedding", b="e.embedding")} AS s FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
ranked AS (SELECT *, CASE WHEN s >= {NEAR} THEN row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) END AS rank FROM pairs),
m AS (SELECT query_id, count(*) FILTER (good) AS n, count(*) FILTER (good AND rank <= 1) AS h1, count(*) FILTER (good AND rank <= 5) AS h5, count(*) FILTER (good AND rank <= 10) AS h10,
  min(rank) FILTER (good AND rank <= 20) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (good AND rank <= 10), 0) AS dcg FROM ranked GROUP BY 1),
metrics AS (SELECT query_id, CASE WHEN n = 0 THEN 1 ELSE h1 / n END AS recall_at_1, CASE WHEN n = 0 THEN 1 ELSE h5 / n END AS recall_at_5, CASE WHEN n = 0 THEN 1 ELSE h10 / n END AS recall_at_10,
  coalesce(1 / first, 0) AS mrr, CASE WHEN n = 0 THEN 1 ELSE dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)) END AS ndcg_at_10 FROM m)"""
KEYWORDS = "kw AS (SELECT note_id, string_agg(tag, ' ' ORDER BY tag) AS keywords FROM tags GROUP BY 1)"


def _tokens(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({column})), '[\\p{{L}}\\p{{N}}]+')"


_COLUMNS = (("title", "title"), ("body", "body"), ("spine", "domain || '/' || intent || '/' || kind"), ("aliases", "''"), ("keywords", "coalesce(keywords, '')"))
ANALYSED = f"{TAGS}, {KEYWORDS}, tok AS (SELECT note_id, status, updated_at, domain, kind, " + ", ".join(f"{_tokens(c)} AS {f}" for f, c in _COLUMNS) + " FROM heads LEFT JOIN kw USING (note_id))"


def bm25_sql(leaves: list[tuple], match: str, weights: dict[str, float], top: int) -> str:
    """SQL for leaves (test on a token or on a place, field or None, number of words); match names their counts n0, n1, ..."""
    counts = []
    for i, (test, field, n) in enumerate(leaves):
        used = {field: weights[field]} if field else weights
        one = lambda f, test=test, n=n: f"len(list_filter({f}, lambda x: {test}))" if n == 1 else f"len(list_filter(range(1, len({f}) - {n - 2}), lambda i: {test.replace('$', f)}))"
        counts += [" + ".join(one(f) for f in used) + f" AS n{i}", " + ".join(f"{w} * {one(f)}" for f, w in used.items()) + f" AS f{i}"]
    length = " + ".join(f"len({f})" for f in weights)
    idf = lambda i: f"CASE WHEN ln((N - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN ({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avgdl)) ELSE 0 END" for i in range(len(leaves)) if f"-n{i}" not in match)
    return f"""WITH {HEADS}, {ANALYSED}, r AS (SELECT note_id, status, {length} AS len, {', '.join(counts)} FROM tok),
      s AS (SELECT CAST(count(*) AS DOUBLE) AS N, avg(len) AS avgdl, {', '.join(f'count(*) FILTER (n{i} > 0) AS d{i}' for i in range(len(leaves)))} FROM r)
      SELECT note_id, round(-({score}), 6) AS bm25 FROM r, s WHERE ({match.replace('-n', 'n')}) ORDER BY -({score}), note_id LIMIT {top}"""


_W = Ranking().fields


def _bm25(query: str, top: int = 20, fields=None):
    return lambda v: rounded(v.index.top(query, top, fields or _W), "bm25")


def _word(w: str, field: str | None = None) -> tuple:
    return f"x = '{w}'", field, 1


def _pool_sql(leaves: list[tuple], match: str) -> str:
    """(note_id, bm25) of the 100 best live notes, unrounded, without its own WITH; HEADS and ANALYSED have to stand before."""
    whole = bm25_sql(leaves, match, _W, 100).replace("round(-(", "(-(").replace("), 6) AS bm25", ")) AS bm25")
    return whole.split(" FROM heads LEFT JOIN kw USING (note_id)), ", 1)[1]


#: Lexical candidates of `thing OR shes`; rank counts from 0.
_LEXICAL = f"""WITH {HEADS}, {ANALYSED}, lexical AS (SELECT note_id, CAST(row_number() OVER (ORDER BY bm25, note_id) - 1 AS BIGINT) AS rank FROM (WITH {_pool_sql([_word("thing"), _word("shes")], "status <> 'retracted' AND (n0 > 0 OR n1 > 0)")}))"""
_ENGAGEMENT = "0.6 * coalesce(exp(-(greatest(epoch(TIMESTAMP '2024-01-31') - floor(epoch(greatest(coalesce(last_accessed, updated_at), updated_at))), 0) / 3600.0) * ln(2) / 168), 0.3) + 0.4 * least(1, ln(1 + access_count) / ln(21))"
_WEIGHTS = "CASE edge_type WHEN 'depends-on' THEN 2.0 WHEN 'supersedes' THEN 1.5 WHEN 'contradicts' THEN 1.5 WHEN 'extends' THEN 1.2 WHEN 'informed-by' THEN 0.8 ELSE 1.0 END"
_SPREAD = f"""m AS (SELECT src, dst, s.seed AS a, t.seed AS b, (CASE WHEN s.seed IS NOT NULL AND t.seed IS NOT NULL THEN 2 ELSE 1 END) * 0.5 * {_WEIGHTS} AS w FROM edges LEFT JOIN seeds s ON s.note_id = src LEFT JOIN seeds t ON t.note_id = dst
  WHERE (s.seed IS NOT NULL OR t.seed IS NOT NULL) AND NOT (edge_type = 'supersedes' AND s.seed IS NOT NULL)),
passed AS (SELECT note_id, CAST(sum(g) AS DOUBLE) AS graph FROM (SELECT dst AS note_id, a * w AS g FROM m WHERE a IS NOT NULL UNION ALL SELECT src, b * w FROM m WHERE b IS NOT NULL) GROUP BY 1)"""


def blended_sql(pool: str, vectors: bool, limit: int) -> str:
    """A WITH clause that ends in result: candidates of pool (note_id, rank), which the text before it defines, blended and cut."""
    dot = DOT.format(a="e.embedding", b="(SELECT embedding FROM embeddings WHERE vec_id = 0)")
    cosine = f"coalesce((SELECT {dot} FROM embeddings e WHERE e.vec_id = c.note_id), 0)" if vectors else "0.0"
    primary = "cosine" if vectors else "CASE WHEN rank IS NOT NULL THEN 1 - rank / ranked ELSE 0 END"
    return f"""{EDGES}, pool AS ({pool}), size AS (SELECT count(*) AS p, count(rank) AS ranked FROM pool), seeds AS (SELECT note_id, CASE WHEN rank IS NOT NULL THEN 1 - rank / p ELSE 0.5 END AS seed FROM pool, size),
    {_SPREAD}, c AS (SELECT note_id, rank, coalesce(graph, 0) AS graph FROM (SELECT note_id, rank, graph FROM pool FULL JOIN passed USING (note_id)) JOIN live USING (note_id)), top AS (SELECT max(graph) AS top FROM c),
    scored AS (SELECT note_id, rank, ranked, CASE WHEN top > 0 THEN graph / top ELSE graph END AS graph, {cosine} AS cosine, {_ENGAGEMENT} AS engagement FROM c JOIN live USING (note_id), top, size),
    result AS (SELECT note_id, cosine, graph, engagement, 0.5 * ({primary}) + 0.25 * graph + 0.25 * engagement AS final FROM scored WHERE 0.5 * ({primary}) + 0.25 * graph + 0.25 * engagement >= 0.1 ORDER BY final DESC, note_id LIMIT {limit})"""


_RECENT = "SELECT note_id, CAST(NULL AS BIGINT) AS rank FROM live {where} ORDER BY updated_at DESC, note_id LIMIT 100"
_NEAREST = f"SELECT e.vec_id AS note_id FROM embeddings e JOIN live ON note_id = e.vec_id ORDER BY {DOT.format(a='e.embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')} DESC, e.vec_id LIMIT 100"

#: Pages stand for notes with wikilinks: their links become them, and the number in their url is one more.
_BODY = "regexp_replace(html, 'href=\"/([^\"]*)\"', '[[\\1]]', 'g') || coalesce(chr(10) || '[[' || nullif(regexp_extract(url, '/(\\d+)', 1), '') || ']]', '')"
_LINKS = f"""lines AS (SELECT page_id, unnest(string_split({_BODY}, chr(10))) AS line, generate_subscripts(string_split({_BODY}, chr(10)), 1) AS ln FROM pages),
every AS (SELECT page_id, ln, line, unnest(regexp_extract_all(line, '\\[\\[([^\\]]+)\\]\\]', 1)) AS target, generate_subscripts(regexp_extract_all(line, '\\[\\[([^\\]]+)\\]\\]', 1), 1) AS part FROM lines),
links AS (SELECT page_id AS src, target, sha256(trim(line, ' ' || chr(9) || chr(13))) AS context_hash, ln, part FROM every QUALIFY row_number() OVER (PARTITION BY page_id, target ORDER BY ln, part) = 1)"""
#: Titles that such links can meet: a title's first word.
_FIRST_WORDS = "firsts AS (SELECT note_id, status, regexp_extract(title, '^[^ ,.]*') AS title FROM heads)"
_RESOLVED = """ids AS (SELECT note_id AS by_id, CAST(note_id AS VARCHAR) AS id FROM firsts WHERE status <> 'retracted'), titles AS (SELECT lower(title) AS t, min(note_id) AS by_title FROM firsts WHERE status <> 'retracted' GROUP BY 1),
resolved AS (SELECT links.*, coalesce(by_id, by_title) AS dst FROM links LEFT JOIN ids ON target = id LEFT JOIN titles ON lower(target) = t)"""


def _page_texts(v: Vault) -> DataFrame:
    body = F.regexp_replace("html", 'href="/([^"]*)"', "[[$1]]")
    number = F.nullif(F.regexp_extract("url", "/(\\d+)", 1), F.lit(""))
    return v.table("pages").select(F.col("page_id").alias("note_id"), F.concat(body, F.coalesce(F.concat(F.lit("\n[["), number, F.lit("]]")), F.lit(""))).alias("body"))


def _first_words(v: Vault) -> DataFrame:
    return v.heads.select("note_id", "status", F.regexp_extract("title", "^[^ ,.]*", 0).alias("title"))


def _auto(v: Vault) -> DataFrame:
    return vectors.auto_edges(_knn(v, 5, NEAR), v.edges, NEAR)


def _synced(v: Vault) -> DataFrame:
    return graph.synced(graph.text_links(_page_texts(v)), _first_words(v), _auto(v))


def _queries(v: Vault) -> DataFrame:
    return v.vectors.where("note_id % 20 = 0")


def _knn(v: Vault, k: int = 20, threshold: float = -2.0) -> DataFrame:
    return v.near.nearest(_queries(v).withColumnRenamed("note_id", "query_id"), k, threshold)


def _metrics(v: Vault, ranked: DataFrame | None = None) -> DataFrame:
    """Metrics of the vectors' queries from ranked, else from their 20 nearest that are near."""
    queries = _queries(v).select(F.col("note_id").alias("query_id"), F.col("label").alias("_l"))
    ranked = (_knn(v, threshold=NEAR) if ranked is None else ranked).select("query_id", "note_id", "rank")
    # relevant are the other vectors of a query's label: among the ranked ones by join, in all by the label's count
    gold = ranked.join(v.vectors.select("note_id", "label"), "note_id").join(queries, "query_id").where("label = _l")
    sizes = queries.join(v.vectors.groupBy(F.col("label").alias("_l")).agg((F.count(F.lit(1)) - 1).alias("n")), "_l").select("query_id", "n")
    return evaluation.per_query(ranked, gold, queries, sizes)


def _retract_deprecated(v: Vault) -> DataFrame:
    """Notes that a bulk retraction selects: the deprecated ones."""
    return live(v.heads).where("status = 'deprecated'").select("note_id", "title")


def _documents(v: Vault) -> DataFrame:
    """Notes as documents: frontmatter of two lines and the body."""
    return v.heads.select("note_id", F.concat(F.lit("title: "), "title", F.lit("\nkind: "), "kind", F.lit("\n")).alias("frontmatter"), "body")


_DOCUMENTS = "documents_of AS (SELECT note_id, 'title: ' || title || chr(10) || 'kind: ' || kind || chr(10) AS frontmatter, body FROM heads)"
_EDITS = [{"op": "replace", "old": "kind: decision", "new": "kind: note"}, {"op": "append", "text": "Seen."}]
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_EDITED = f"""edited AS (SELECT note_id, CASE WHEN n = 1 THEN replace(frontmatter, 'kind: decision', 'kind: note') ELSE frontmatter END AS frontmatter,
  CASE WHEN n = 1 THEN rtrim(body, {SPACES}) || chr(10) || 'Seen.' ELSE body END AS body, CASE WHEN n <> 1 THEN n || ' places' END AS error
  FROM (SELECT *, (length(doc) - length(replace(doc, 'kind: decision', ''))) // 14 AS n FROM (SELECT *, '---' || chr(10) || frontmatter || '---' || chr(10) || body AS doc FROM documents_of)))"""
_DRAFTS = "drafts AS (SELECT conv_id * 1000 + turn AS draft_id, text AS body, conv_id AS template, role FROM conversations)"


def _drafts(v: Vault) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return v.table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("draft_id"), F.col("text").alias("body"), none("string").alias("title"), F.when(F.col("role") == "system", "inbox").alias("domain"), none("string").alias("intent"),
        F.when(F.col("role") == "assistant", "journal").when(F.col("role") == "system", "letter").alias("kind"), none("string").alias("status"), none("array<string>").alias("tags"), F.col("conv_id").alias("template"),
    )


def _templates(v: Vault) -> DataFrame:
    tags = v.tags.groupBy("note_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return v.heads.join(tags, "note_id", "left")


_TEXT_DOC = "chr(45) || '--' || chr(10) || 'title: ' || title || chr(10) || 'tags: [' || domain || ', ' || intent || ']' || chr(10) || '---' || chr(10) || body"


def _frontmatter(v: Vault) -> DataFrame:
    doc = F.concat(F.lit("---\ntitle: '"), F.replace("title", F.lit("'"), F.lit("''")), F.lit("'\ntags: ["), "domain", F.lit(", "), "intent", F.lit("]\nlinks:\n  - target: "), "kind", F.lit("\n    rel: extends\n---\n"), "body")
    read = markdown.fields(markdown.split(v.heads.select(F.col("note_id").cast("string").alias("file"), doc.alias("doc"))))
    return read.select(F.col("file").cast("long").alias("note_id"), F.col("meta.title").alias("title"), F.array_join("meta.tags", "+").alias("tags"), F.col("meta.links")[0]["target"].alias("target"), F.sha2("body", 256).alias("body_hash"))


def _forms(v: Vault) -> DataFrame:
    """Frontmatter with comments, block scalars, flow lists with commas in quotes, and flow maps."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    doc = F.concat(F.lit("---\n# a note\ntitle: |-\n  "), "title", F.lit("\nauthor: >-\n  one\n  hand\ntags: ["), q(F.concat("domain", F.lit(", x"))), F.lit(", '"), "intent", F.lit("'] # both\nlinks:\n- {target: "), "kind", F.lit(", rel: extends}\nkind: "), "kind", F.lit(" # plain\n---\n"), "body")
    read = markdown.fields(markdown.split(v.heads.select(F.col("note_id").cast("string").alias("file"), doc.alias("doc"))))
    return read.select(F.col("file").cast("long").alias("note_id"), F.col("meta.title").alias("title"), F.col("meta.author").alias("author"), F.array_join("meta.tags", "+").alias("tags"), F.col("meta.links")[0]["target"].alias("target"), F.sha2("meta.canonical", 256).alias("canonical_hash"))


def _cut_sql(most: int) -> str:
    """body of at most so many bytes, up to its last blank, trimmed."""
    head = f"substr(body, 1, list_max(list_filter(range(0, {most + 1}), lambda i: strlen(substr(body, 1, i)) <= {most})))"
    return f"trim(CASE WHEN strlen(body) <= {most} THEN body WHEN contains({head}, ' ') THEN regexp_extract({head}, '(?s)^(.*) ', 1) ELSE {head} END, {SPACES})"


def _changes(c: dict) -> None:
    """Queries of what is written: rows to append and states after a change."""
    none = "CAST(NULL AS {})"
    now = "TIMESTAMP '2024-01-31'"
    c["batch_titles"] = (lambda v: v.table("labels").select(F.col("doc_id").alias("note_id")).distinct().join(v.heads.select("note_id", "title"), "note_id"), f"WITH {HEADS} SELECT DISTINCT doc_id AS note_id, title FROM labels JOIN heads ON note_id = doc_id")
    c["prefix_resolution"] = (
        lambda v: browse.resolved_prefixes(v.heads, v.heads.select(F.substring(F.col("note_id").cast("string"), 1, 3).alias("prefix")).distinct()),
        f"WITH {HEADS}, p AS (SELECT DISTINCT substr(CAST(note_id AS VARCHAR), 1, 3) AS prefix FROM heads), m AS (SELECT prefix, count(*) AS n, min(note_id) AS least FROM p JOIN heads ON starts_with(CAST(note_id AS VARCHAR), prefix) GROUP BY 1) SELECT prefix, n AS notes, CASE WHEN n = 1 THEN least END AS note_id FROM m",
    )
    c["head_contents"] = (
        lambda v: versions.heads(v.versions).join(versions.stored(v.versions).withColumnRenamed("hash", "content_hash"), "content_hash").select("note_id", "seq", F.length("payload").cast("long").alias("n")),
        "SELECT conv_id AS note_id, max(turn) AS seq, CAST(length(arg_max(text, turn)) AS BIGINT) AS n FROM conversations GROUP BY 1",
    )
    c["tags_each_of"] = (lambda v: browse.with_each_tag(v.heads, v.tags, ["red", "economy"]).select("note_id"), f"WITH {HEADS}, {TAGS} SELECT note_id FROM heads WHERE EXISTS (SELECT 1 FROM tags t WHERE t.note_id = heads.note_id AND tag = 'red') AND EXISTS (SELECT 1 FROM tags t WHERE t.note_id = heads.note_id AND tag = 'economy')")
    c["bm25_baseline"] = (
        lambda v: rounded(v.index.top(lexical.plain_query("the, thing!"), 20, {"body": 1.0}).select("note_id", (-F.col("bm25")).alias("score")), "score"),
        f"SELECT note_id, round(-bm25, 6) AS score FROM ({bm25_sql([_word('the'), _word('thing')], 'n0 > 0 AND n1 > 0', {'body': 1.0}, 20)})",
    )
    asked = f"asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2)"
    counted = f"words AS (SELECT doc_id AS note_id, unnest({_tokens('text')}) AS term FROM documents), f AS (SELECT term, note_id, count(*) AS f FROM words GROUP BY 1, 2), len AS (SELECT doc_id AS note_id, len({_tokens('text')}) AS len FROM documents), total AS (SELECT count(*) AS N, sum(len) / count(*) AS avgdl FROM len)"
    scored = """d AS (SELECT term, count(*) AS d FROM f WHERE term IN (SELECT term FROM asked) GROUP BY 1), idf AS (SELECT term, CASE WHEN ln((N - d + 0.5) / (d + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - d + 0.5) / (d + 0.5)) END AS idf FROM d, total),
      s AS (SELECT query_id, note_id, sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score, count(*) AS have FROM asked JOIN idf USING (term) JOIN f USING (term) JOIN len USING (note_id), total GROUP BY 1, 2)"""
    for name, every in (("bm25_batch_any", False), ("bm25_batch_all", True)):
        c[name] = (
            lambda v, every=every: rounded(lexical.batch(v.index, v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 10, every=every), "score"),
            f"WITH {asked}, {counted}, {scored} SELECT query_id, note_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s.score, 9) DESC, note_id) AS rank FROM s JOIN (SELECT query_id, count(*) AS need FROM asked GROUP BY 1) USING (query_id)" + (" WHERE have = need" if every else "") + " QUALIFY rank <= 10",
        )
    c["notes_embedded"] = (
        lambda v: providers.embedded(v.bodies.select("note_id", F.col("body").alias("input")), providers.Hashing(32)).select("note_id", "model", F.size("embedding").alias("dimensions"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm")),
        f"SELECT doc_id AS note_id, 'hashing-32' AS model, 32 AS dimensions, CASE WHEN len({_tokens('text')}) = 0 THEN 0.0 ELSE 1.0 END AS norm FROM documents",
    )
    c["query_sanitise"] = (lambda v: v.table("benchmark").select("item_id", F.sha2(T.sanitised(F.col("text")), 256).alias("query_hash")), "SELECT item_id, sha256(trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS query_hash FROM benchmark")
    plain = f"{asked}, {counted}, {scored} SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s.score, 9) DESC, note_id) AS rank FROM s JOIN (SELECT query_id, count(*) AS need FROM asked GROUP BY 1) USING (query_id) WHERE have = need QUALIFY rank <= 10"
    runs = f"WITH {_RUNS}, bm25 AS (WITH {plain}), runs AS (SELECT 'bm25' AS system, * FROM bm25 UNION ALL SELECT 'vector', * FROM vector UNION ALL SELECT 'hybrid', * FROM hybrid)"
    c["ir_runs"] = (lambda v: reduce(DataFrame.unionByName, [run.select(F.lit(name).alias("system"), "query_id", "note_id", "rank") for name, run in _runs(v)[0].items()]), f"{runs} SELECT * FROM runs")
    each_query = f"""{runs}, item_lines AS (SELECT DISTINCT item_id AS query_id, sentence FROM (SELECT item_id, unnest(string_split(text, '. ')) AS sentence FROM benchmark) WHERE length(sentence) >= 20),
        doc_lines AS (SELECT DISTINCT doc_id AS note_id, sentence FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS sentence FROM documents) WHERE length(sentence) >= 20),
        gold AS (SELECT DISTINCT query_id, note_id FROM item_lines JOIN doc_lines USING (sentence)), golds AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
        hit AS (SELECT system, query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM runs JOIN gold USING (query_id, note_id) GROUP BY 1, 2),
        each_query AS (SELECT system, query_id, n, h1, h5, h10, first, dcg FROM (SELECT unnest(['bm25', 'vector', 'hybrid']) AS system) CROSS JOIN (SELECT item_id AS query_id FROM benchmark) a LEFT JOIN golds USING (query_id) LEFT JOIN hit USING (system, query_id) WHERE NOT (system = 'hybrid' AND query_id % 10 = 9))"""
    means = """round(avg(CASE WHEN n IS NULL THEN 1 ELSE coalesce(h1, 0) / n END), 6) AS recall_at_1, round(avg(CASE WHEN n IS NULL THEN 1 ELSE coalesce(h5, 0) / n END), 6) AS recall_at_5,
        round(avg(CASE WHEN n IS NULL THEN 1 ELSE coalesce(h10, 0) / n END), 6) AS recall_at_10, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN n IS NULL THEN 1 ELSE coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)) END), 6) AS ndcg_at_10"""
    c["ir_systems"] = (
        lambda v: rounded(_systems(v), *evaluation.MEANS),
        f"{each_query} SELECT system, count(*) AS queries, (SELECT count(*) FROM benchmark) - count(*) AS errors, {means} FROM each_query GROUP BY system",
    )
    c["ir_results"] = (
        _results,
        f"""{each_query} SELECT 'ir-' || system || '-benchmark-default.json' AS name, class, queries, recall_at_1, recall_at_5, recall_at_10, mrr, ndcg_at_10, (SELECT count(*) FROM benchmark WHERE system = 'hybrid' AND item_id % 10 = 9) AS errors
        FROM (SELECT system, CASE query_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS class, count(*) AS queries, {means}, grouping(CASE query_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END) AS whole
        FROM each_query GROUP BY GROUPING SETS ((system), (system, CASE query_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END))) WHERE whole = 1 OR class IS NOT NULL""",
    )
    c["token_counters"] = (lambda v: v.table("conversations").groupBy("role").agg(F.sum(F.length("text")).alias("characters"), F.count(F.lit(1)).alias("operations")), "SELECT role, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS operations FROM conversations GROUP BY 1")
    c["regression_gate"] = (
        lambda v: rounded(_gate(v), "base", "new"),
        "WITH "
        + EVALUATED
        + ", b AS ("
        + EVALUATED.replace(f"CASE WHEN s >= {NEAR} THEN row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) END AS rank", "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) AS rank").join(["WITH ", " SELECT * FROM metrics"])
        + "), n AS (SELECT avg(recall_at_5) AS r, avg(mrr) AS m, avg(ndcg_at_10) AS g FROM metrics), o AS (SELECT avg(recall_at_5) AS r, avg(mrr) AS m, avg(ndcg_at_10) AS g FROM b), t AS (SELECT 'recall_at_5' AS metric, o.r AS base, n.r AS new FROM n, o UNION ALL SELECT 'mrr', o.m, n.m FROM n, o UNION ALL SELECT 'ndcg_at_10', o.g, n.g FROM n, o) "
        "SELECT metric, round(base, 6) AS base, round(new, 6) AS new, base > 0 AND (base - new) / base > 0.02 AS fell FROM t",
    )
    # versions and edits
    c["edit_ops"] = (
        lambda v: versions.edited(_documents(v), _EDITS).select("note_id", F.sha2("frontmatter", 256).alias("fm_hash"), F.sha2("body", 256).alias("md_hash"), "error"),
        f"WITH {HEADS}, {_DOCUMENTS}, {_EDITED} SELECT note_id, sha256(frontmatter) AS fm_hash, sha256(body) AS md_hash, error FROM edited",
    )
    both = "sha256(sha256(frontmatter) || sha256(body))"
    c["versions_committed"] = (
        lambda v: versions.committed(v.versions, versions.edited(_documents(v), _EDITS).where("error IS NULL")),
        f"WITH {HEADS}, {_DOCUMENTS}, {_EDITED}, {VERSIONS}, h AS (SELECT note_id, max(seq) AS head, arg_max(content_hash, seq) AS was FROM versions GROUP BY 1) "
        f"SELECT note_id, coalesce(head + 1, 0) AS seq, head AS prev, sha256(frontmatter) AS fm_hash, sha256(body) AS md_hash, {both} AS content_hash FROM edited LEFT JOIN h USING (note_id) WHERE error IS NULL AND (was IS NULL OR was <> {both})",
    )
    c["links_inserted"] = (
        lambda v: v.heads.select("note_id", F.sha2(versions.linked_body(F.concat("body", F.lit("\n## Depends On\n\n- [[7]]\nmore")), F.lit("12"), F.when(F.col("kind") == "decision", "depends-on").otherwise(F.lit("extends"))), 256).alias("body_hash")),
        f"""WITH {HEADS} SELECT note_id, sha256(CASE WHEN kind = 'decision' THEN body || chr(10) || '## Depends On' || chr(10) || chr(10) || '- [[7]]' || chr(10) || '- [[12]]' || chr(10) || 'more'
          ELSE body || chr(10) || '## Depends On' || chr(10) || chr(10) || '- [[7]]' || chr(10) || 'more' || chr(10) || chr(10) || '## Extends' || chr(10) || '- [[12]]' END) AS body_hash FROM heads""",
    )
    c["notes_captured"] = (
        lambda v: mutations.captured(_drafts(v), _templates(v)).select("draft_id", "title", "domain", "intent", "kind", "status", F.array_join("tags", "+").alias("tags"), "error"),
        f"""WITH {HEADS}, {TAGS}, {_DRAFTS}, kws AS (SELECT note_id, string_agg(tag, '+' ORDER BY tag) AS ts FROM tags GROUP BY 1), x AS (SELECT draft_id, trim(d.body, {SPACES}) AS body, h.note_id AS t, CASE role WHEN 'system' THEN 'inbox' ELSE h.domain END AS domain, coalesce(h.intent, 'research') AS intent,
          CASE role WHEN 'assistant' THEN 'journal' WHEN 'system' THEN 'letter' ELSE coalesce(h.kind, 'reference') END AS kind, coalesce(h.status, 'active') AS status, coalesce(ts, '') AS tags FROM drafts d LEFT JOIN heads h ON h.note_id = template LEFT JOIN kws ON kws.note_id = template)
          SELECT draft_id, substr(trim(regexp_replace(split_part(body, chr(10), 1), '^#+', ''), {SPACES}), 1, 80) AS title, domain, intent, kind, status, tags,
          CASE WHEN t IS NULL THEN 'no such template' WHEN domain IS NULL THEN 'no domain' WHEN kind = 'letter' THEN 'no such kind' WHEN body = '' THEN 'empty body' END AS error FROM x""",
    )
    # heads
    new_heads = "SELECT doc_id AS note_id, 'Page ' || doc_id AS title, quality FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)"
    c["heads_upserted"] = (
        lambda v: mutations.upserted(v.heads.select("note_id", "title", "status", "access_count", "last_accessed"), v.table("labels").groupBy(F.col("doc_id").alias("note_id")).agg(F.max("quality").alias("q")).select("note_id", F.concat(F.lit("Page "), "note_id").alias("title"), F.when(F.col("q") == 1, "active").otherwise("draft").alias("status"))),
        f"WITH {HEADS}, n AS ({new_heads}) SELECT heads.note_id, coalesce(n.title, heads.title) AS title, CASE WHEN n.note_id IS NULL THEN status WHEN quality = 1 THEN 'active' ELSE 'draft' END AS status, access_count, last_accessed FROM heads LEFT JOIN n USING (note_id)",
    )
    c["heads_retracted"] = (
        lambda v: mutations.retracted(v.heads.select("note_id", "status", "updated_at"), mutations.selected(v.heads, None, _retract_deprecated(v)), v.now).groupBy("status").agg(F.count(F.lit(1)).alias("notes"), F.max("updated_at").alias("updated_at")),
        f"WITH {HEADS}, r AS (SELECT CASE WHEN status = 'deprecated' THEN 'retracted' ELSE status END AS status, CASE WHEN status = 'deprecated' THEN {now} ELSE updated_at END AS updated_at FROM heads) SELECT status, count(*) AS notes, max(updated_at) AS updated_at FROM r GROUP BY 1",
    )
    c["bulk_retract_plan"] = (_retract_deprecated, f"WITH {HEADS} SELECT note_id, title FROM live WHERE status = 'deprecated'")
    c["audit_rows"] = (
        lambda v: mutations.audited(_retract_deprecated(v), "retract", v.now).select("action", "target_id", "detail", "created_at"),
        f"WITH {HEADS} SELECT 'retract' AS action, note_id AS target_id, {none.format('VARCHAR')} AS detail, {now} AS created_at FROM live WHERE status = 'deprecated'",
    )
    gone = "gone AS (SELECT note_id FROM heads WHERE status = 'retracted')"
    left = "rest AS (SELECT * FROM edges WHERE src NOT IN (SELECT note_id FROM gone) AND dst NOT IN (SELECT note_id FROM gone))"
    dead = lambda v: v.heads.where("status = 'retracted'").select("note_id")
    c["edges_after_delete"] = (lambda v: mutations.without(v.edges, dead(v), "src", "dst").select("src", "dst", "edge_type"), f"WITH {HEADS}, {EDGES}, {gone}, {left} SELECT src, dst, edge_type FROM rest")
    degree = lambda e, h: f"SELECT note_id, coalesce(o, 0) AS links_out, coalesce(i, 0) AS links_in FROM {h} LEFT JOIN (SELECT src, count(*) o FROM {e} GROUP BY 1) ON src = note_id LEFT JOIN (SELECT dst, count(*) i FROM {e} GROUP BY 1) ON dst = note_id"
    c["degrees_after_delete"] = (
        lambda v: mutations.degree_changes(graph.degrees(v.edges, v.heads), graph.degrees(mutations.without(v.edges, dead(v), "src", "dst"), mutations.without(v.heads, dead(v), "note_id"))),
        f"WITH {HEADS}, {EDGES}, {gone}, {left}, a AS ({degree('edges', 'heads')}), b AS ({degree('rest', 'live')}) SELECT b.* FROM b JOIN a USING (note_id) WHERE a.links_out <> b.links_out OR a.links_in <> b.links_in",
    )
    c["contents_orphaned"] = (
        lambda v: mutations.orphaned(versions.stored(v.table("documents")), v.table("documents").select(F.col("doc_id").alias("note_id"), F.sha2("text", 256).alias("hash")), dead(v)),
        f"WITH {HEADS} SELECT sha256(body) AS hash FROM heads GROUP BY 1 HAVING bool_and(status = 'retracted')",
    )
    # tags
    marked = lambda v: browse.with_all_tags(v.tags, ["red"])
    changed = f"changed AS (SELECT note_id, tag FROM tags WHERE NOT (tag = 'economy' AND note_id IN (SELECT note_id FROM tags WHERE tag = 'red')) UNION SELECT note_id, 'reviewed' FROM tags WHERE tag = 'red')"
    c["tags_mutated"] = (lambda v: mutations.tags_after(v.tags, mutations.tag_events(marked(v), ["reviewed"], ["economy"], v.now)), f"WITH {TAGS}, {changed} SELECT note_id, tag FROM changed")
    c["keywords_refreshed"] = (lambda v: mutations.keywords(mutations.tags_after(v.tags, mutations.tag_events(marked(v), ["reviewed"], ["economy"], v.now))), f"WITH {TAGS}, {changed} SELECT note_id, string_agg(tag, ' ' ORDER BY tag) AS keywords FROM changed GROUP BY 1")
    # accesses and vectors
    c["accesses_bumped"] = (
        lambda v: mutations.counted(v.access, mutations.accessed(browse.recent(v.heads, 50), v.now)),
        f"WITH {HEADS}, r AS (SELECT note_id FROM live ORDER BY updated_at DESC, note_id LIMIT 50), u AS (SELECT * FROM acc UNION ALL SELECT note_id, 1, {now} FROM r) SELECT note_id, CAST(sum(access_count) AS BIGINT) AS access_count, max(last_accessed) AS last_accessed FROM u GROUP BY 1",
    )
    stated = lambda v: v.vectors.select("note_id", "embedding", F.concat(F.lit("m"), "label").alias("model"), F.lit(v.now).cast("timestamp_ntz").alias("updated_at"))
    c["vectors_upserted"] = (
        lambda v: mutations.latest_vectors(stated(v).unionByName(stated(v).where("model = 'm3'").withColumns({"model": F.lit("new"), "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY")}))).groupBy("model").agg(F.count(F.lit(1)).alias("notes")),
        "SELECT CASE WHEN label = 3 THEN 'new' ELSE 'm' || label END AS model, count(*) AS notes FROM embeddings GROUP BY 1",
    )
    c["embed_backfill"] = (lambda v: mutations.backfill(v.heads, stated(v), "m3"), f"WITH {HEADS} SELECT note_id FROM live")
    # streams
    c["stream_reads"] = (
        lambda v: access.drained(access.reads_by_window(access.event_stream(v.spark, v.folder, v.table("events").schema, "events*")), "complete").select("note_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "reads"),
        "SELECT user_id AS note_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS reads FROM events WHERE event_type = 'view' GROUP BY 1, 2",
    )
    c["stream_contents"] = (
        lambda v: access.drained(access.stored_once(access.event_stream(v.spark, v.folder, v.table("events").schema, "events*").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("payload"), F.date_trunc("month", F.col("ts").cast("timestamp")).alias("at")))).select("hash", "payload"),
        "SELECT DISTINCT sha256(event_type || '/' || user_id) AS hash, event_type || '/' || user_id AS payload FROM events",
    )


def _asked(v: Vault) -> DataFrame:
    """Benchmark items as searches: their first words, a phrase of the next two, and the vector of their number.

    Each tenth is asked as it stands, which no parser takes."""
    words = F.split(T.sanitised(F.lower("text")), " ")
    query = F.concat(F.get(words, 0), F.lit(" OR "), F.get(words, 1), F.lit(' OR "'), F.get(words, 2), F.lit(" "), F.get(words, 3), F.lit('"'))
    items = v.table("benchmark").select(F.col("item_id").alias("query_id"), "text", F.when(F.col("item_id") % 10 == 9, F.col("text")).otherwise(query).alias("query"))
    return items.join(v.vectors.select(F.col("note_id").alias("query_id"), "embedding"), "query_id", "left")


def _sentences(table: DataFrame, key: str, text: str) -> DataFrame:
    return table.select(key, F.explode(F.split(text, "\\. ")).alias("sentence")).where(F.length("sentence") >= 20)


def _gold(v: Vault) -> DataFrame:
    """(query_id, note_id): notes that share a sentence with an item are relevant to it."""
    items = _sentences(v.table("benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text").distinct()
    return items.join(_sentences(v.bodies, "note_id", "body"), "sentence").select("query_id", "note_id").distinct()


def _runs(v: Vault) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Ranked notes of each system for all items, and the error rows of those that have any."""
    asked = _asked(v)
    words = lexical.batch(v.index, asked.select("query_id", F.col("text").alias("query")), 10)
    near = v.near.nearest(asked.where("embedding IS NOT NULL").select("query_id", "embedding"), 10, itself=True)
    hits, failed = batched.hybrid(v, asked)
    found = {"bm25": words, "vector": near, "hybrid": hits}
    return {name: written(run.select("query_id", "note_id", "rank"), "run") for name, run in found.items()}, {"hybrid": failed}


def _systems(v: Vault) -> DataFrame:
    runs, failed = _runs(v)
    return evaluation.systems(runs, failed, written(_gold(v), "gold"), _asked(v).select("query_id"))


def _counters(v: Vault) -> DataFrame:
    """Counters after a stream of all views; a stream takes a file or a folder alike by a pattern alone."""
    schema, folder = v.table("events").schema, f"{shared_folder(v.spark)}/counters-{uuid.uuid4().hex}"
    views = v.spark.readStream.schema(schema).parquet(f"{v.folder}/events.parque[t]").where("event_type = 'view'")
    counters.stored(counters.counters(counters.reads(views.select(F.col("user_id").alias("note_id"), "ts"))), folder)
    found = counters.latest(v.spark, folder)
    return found.select("note_id", "access_count", F.col("last_accessed").cast("timestamp_ntz").alias("last_accessed"), "links_out", "links_in")


def _results(v: Vault) -> DataFrame:
    """Results of each system as they are written, a row for all its queries and for each class."""
    runs, failed = _runs(v)
    asked = _asked(v)
    classes = asked.select("query_id", F.element_at(F.create_map(F.lit(0), F.lit("a"), F.lit(1), F.lit("b")), (F.col("query_id") % 3).cast("int")).alias("class"))
    every = evaluation.results(runs, failed, written(_gold(v), "gold"), asked.select("query_id"), dict.fromkeys(runs, "1"), "benchmark", v.now, classes=classes)
    name = F.concat(F.concat_ws("-", "task", "system", "corpus", "config"), F.lit(".json")).alias("name")
    each = F.explode(F.map_concat(F.create_map(F.lit(""), F.col("ir")), F.col("ir_per_class"))).alias("class", "x")
    found = every.select(name, F.size("errors").cast("long").alias("errors"), "ir", "ir_per_class").select("name", "errors", each)
    return rounded(found.select("name", F.nullif("class", F.lit("")).alias("class"), "errors", "x.*"), *evaluation.MEANS)


_RUNS = f"""{HEADS}, {EDGES}, {ANALYSED},
asked AS (SELECT item_id AS query_id, {_tokens('text')} AS w, item_id % 10 = 9 AS wrong FROM benchmark),
leaf AS (SELECT query_id, unnest([0, 1]) AS p, unnest([w[1], w[2]]) AS t, NULL AS u FROM asked WHERE NOT wrong UNION ALL SELECT query_id, 2, w[3], w[4] FROM asked WHERE NOT wrong),
occ AS ({" UNION ALL ".join(f"SELECT note_id, '{f}' AS field, unnest({f}) AS term, generate_subscripts({f}, 1) AS place FROM tok" for f, _ in _COLUMNS)}),
len AS (SELECT note_id, {" + ".join(f"len({f})" for f, _ in _COLUMNS)} AS len FROM tok),
found AS (SELECT query_id, p, a.note_id, a.field FROM leaf JOIN occ a ON a.term = t WHERE u IS NULL UNION ALL SELECT query_id, p, a.note_id, a.field FROM leaf JOIN occ a ON a.term = t JOIN occ b ON b.note_id = a.note_id AND b.field = a.field AND b.place = a.place + 1 AND b.term = u),
f AS (SELECT query_id, p, note_id, sum(CASE field WHEN 'title' THEN 5.0 WHEN 'body' THEN 1.0 WHEN 'spine' THEN 2.0 WHEN 'aliases' THEN 3.0 ELSE 10.0 END) AS f FROM found GROUP BY ALL),
idf AS (SELECT query_id, p, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM f, (SELECT count(*) AS n FROM len) GROUP BY query_id, p, n),
words AS (SELECT query_id, note_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM len)))) AS s FROM f JOIN idf USING (query_id, p) JOIN len USING (note_id) GROUP BY ALL),
lexical AS (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9), note_id) - 1 AS rank FROM words JOIN live USING (note_id) QUALIFY rank < 100),
vq AS (SELECT query_id, wrong, embedding AS qv FROM asked JOIN embeddings ON vec_id = query_id),
sims AS (SELECT query_id, wrong, vec_id AS note_id, {DOT.format(a="embedding", b="qv")} AS s FROM vq, embeddings),
nearest AS (SELECT query_id, note_id FROM sims JOIN live USING (note_id) WHERE NOT wrong QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) <= 100),
pool AS (SELECT query_id, note_id, rank FROM lexical FULL JOIN nearest USING (query_id, note_id)),
size AS (SELECT query_id, count(*) AS p, count(rank) AS ranked FROM pool GROUP BY 1),
seeds AS (SELECT query_id, note_id, CASE WHEN rank IS NOT NULL THEN 1 - rank / p ELSE 0.5 END AS seed FROM pool JOIN size USING (query_id)),
both_ends AS (SELECT query_id, src, dst, edge_type, seed AS a, NULL AS b FROM edges JOIN seeds ON note_id = src UNION ALL SELECT query_id, src, dst, edge_type, NULL, seed FROM edges JOIN seeds ON note_id = dst),
m AS (SELECT query_id, src, dst, max(a) AS a, max(b) AS b, (CASE WHEN max(a) IS NOT NULL AND max(b) IS NOT NULL THEN 2 ELSE 1 END) * 0.5 * {_WEIGHTS} AS w FROM both_ends GROUP BY query_id, src, dst, edge_type HAVING NOT (edge_type = 'supersedes' AND max(a) IS NOT NULL)),
passed AS (SELECT query_id, note_id, CAST(sum(g) AS DOUBLE) AS graph FROM (SELECT query_id, dst AS note_id, a * w AS g FROM m WHERE a IS NOT NULL UNION ALL SELECT query_id, src, b * w FROM m WHERE b IS NOT NULL) GROUP BY 1, 2),
c AS (SELECT query_id, note_id, rank, coalesce(graph, 0) AS graph FROM pool FULL JOIN passed USING (query_id, note_id)),
scored AS (SELECT c.query_id, c.note_id, graph / nullif(max(graph) OVER (PARTITION BY c.query_id), 0) AS graph, coalesce(s, 0) AS cosine, CASE WHEN c.query_id IN (SELECT query_id FROM vq) THEN coalesce(s, 0) WHEN rank IS NOT NULL THEN 1 - rank / ranked ELSE 0 END AS main, {_ENGAGEMENT} AS engagement
  FROM c JOIN live USING (note_id) JOIN size USING (query_id) LEFT JOIN sims ON sims.query_id = c.query_id AND sims.note_id = c.note_id),
blended AS (SELECT query_id, note_id, 0.5 * main + 0.25 * coalesce(graph, 0) + 0.25 * engagement AS final FROM scored),
hybrid AS (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, note_id) AS rank FROM blended WHERE final >= 0.1 QUALIFY rank <= 10),
vector AS (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) AS rank FROM sims QUALIFY rank <= 10)"""


def _gate(v: Vault) -> DataFrame:
    """Means of a threshold search (new) against those of a search without one (base), and which fell by more than 2 %."""
    names = ("recall_at_5", "mrr", "ndcg_at_10")
    mean = lambda m, what: m.agg(*[F.avg(x).alias(x) for x in names]).select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias(what)) for x in names])).alias("m")).select("m.*")
    ranked = written(_knn(v), "nearest")  # those that are near are the first of them
    return evaluation.gate(mean(_metrics(v, ranked.where(F.col("similarity") >= NEAR)), "new"), mean(_metrics(v, ranked), "base"))


def _catalogue() -> dict:
    day = lambda *x: F.lit(DAY(*x)).cast("timestamp_ntz")
    c: dict[str, tuple] = {}
    for name, by in (("domains", "domain"), ("intents", "intent"), ("kinds", "kind")):
        c[f"browse_{name}"] = (lambda v, by=by: browse.groups(v.heads, by), f"WITH {HEADS} SELECT {by}, count(*) AS notes FROM live WHERE {by} IS NOT NULL GROUP BY 1")
    for by in ("domain", "kind"):
        c[f"facet_{by}"] = (lambda v, by=by: browse.facets(v.heads, by), f"WITH {HEADS} SELECT {by}, count(*) AS notes FROM live GROUP BY 1")
    c["browse_leaf"] = (lambda v: browse.listing(v.heads, "src1", "en", "decision"), f"WITH {HEADS} SELECT note_id, title, updated_at FROM live WHERE domain = 'src1' AND intent = 'en' AND kind = 'decision' ORDER BY updated_at DESC, note_id LIMIT 50")
    c["stats_overview"] = (lambda v: browse.overview(v.heads), f"WITH {HEADS} SELECT count(*) AS notes, CAST(coalesce(sum(access_count), 0) AS BIGINT) AS reads, count(*) FILTER (access_count = 0) AS never_read FROM live")
    c["recent_notes"] = (lambda v: browse.recent(v.heads), f"WITH {HEADS} SELECT note_id, title, updated_at FROM live ORDER BY updated_at DESC, note_id LIMIT 5")
    c["most_accessed"] = (lambda v: browse.most_accessed(v.heads), f"WITH {HEADS} SELECT note_id, title, access_count FROM live WHERE access_count > 0 ORDER BY access_count DESC, note_id LIMIT 1")
    c["tags_usage"] = (lambda v: browse.tag_usage(v.tags, v.heads), f"WITH {HEADS}, {TAGS} SELECT tag, count(*) AS notes FROM tags JOIN live USING (note_id) GROUP BY 1")
    c["tags_all_of"] = (lambda v: browse.with_all_tags(v.tags, ["red", "economy"]), f"WITH {TAGS} SELECT note_id FROM tags WHERE tag IN ('red', 'economy') GROUP BY 1 HAVING count(DISTINCT tag) = 2")
    c["tags_for_note"] = (lambda v: browse.tags_of(v.tags), f"WITH {TAGS} SELECT note_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM tags GROUP BY 1")
    c["bulk_filter"] = (
        lambda v: browse.bulk(v.heads, v.tags, wanted=["red"], since=DAY(2024, 1, 5)),
        f"WITH {HEADS}, {TAGS} SELECT note_id, title, updated_at FROM live WHERE updated_at >= TIMESTAMP '2024-01-05' AND note_id IN (SELECT note_id FROM tags WHERE tag = 'red')",
    )
    c["notes_missing_vectors"] = (lambda v: live(v.heads).select("note_id").join(v.vectors.select("note_id"), "note_id", "left_anti"), f"WITH {HEADS} SELECT note_id FROM live WHERE note_id NOT IN (SELECT vec_id FROM embeddings)")
    c["time_range"] = (
        lambda v: live(v.heads).where((F.col("updated_at") >= day(2024, 1, 3)) & (F.col("updated_at") <= day(2024, 1, 9))).select("note_id", "updated_at"),
        f"WITH {HEADS} SELECT note_id, updated_at FROM live WHERE updated_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'",
    )
    c["prefix_lookup"] = (lambda v: v.heads.where(F.col("note_id").cast("string").startswith("12")).select("note_id", "title"), f"WITH {HEADS} SELECT note_id, title FROM heads WHERE CAST(note_id AS VARCHAR) LIKE '12%'")
    c["bm25_topk"] = (_bm25("thing OR shes", fields={"body": 1.0}), bm25_sql([("x = 'thing'", None, 1), ("x = 'shes'", None, 1)], "n0 > 0 OR n1 > 0", {"body": 1.0}, 20))
    c["bm25_weighted"] = (_bm25(FTS), bm25_sql([("x = 'thing'", None, 1), ("x = 'shes'", None, 1), ("x = 'ound'", None, 1)], "n0 > 0 OR n1 > 0 OR n2 > 0", _W, 20))
    c["fts_phrase"] = (_bm25('"of the"', 50), bm25_sql([("$[i] = 'of' AND $[i + 1] = 'the'", None, 2)], "n0 > 0", _W, 50))
    c["fts_or_not"] = (_bm25("thing OR (ing NOT src1)", 50), bm25_sql([("x = 'thing'", None, 1), ("x = 'ing'", None, 1), ("x = 'src1'", None, 1)], "n0 > 0 OR (n1 > 0 AND NOT -n2 > 0)", _W, 50))
    c["fts_prefix"] = (_bm25("thin*", 50), bm25_sql([("x LIKE 'thin%'", None, 1)], "n0 > 0", _W, 50))
    c["fts_column"] = (_bm25("title:the", 50), bm25_sql([("x = 'the'", "title", 1)], "n0 > 0", _W, 50))
    c["term_stats"] = (lambda v: lexical.term_stats(v.heads), f"WITH t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS occurrences FROM t GROUP BY 1")
    sim = DOT.format(a="e.embedding", b="q.embedding")
    pairs = f"p AS (SELECT q.vec_id AS query_id, e.vec_id AS note_id, {sim} AS s FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)"
    near = f"{pairs}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) AS rank FROM p WHERE s >= {NEAR} QUALIFY rank <= 5)"
    c["knn_topk"] = (lambda v: rounded(_knn(v, 10), "similarity"), f"WITH {pairs} SELECT query_id, note_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) AS rank FROM p QUALIFY rank <= 10")
    c["knn_threshold"] = (lambda v: rounded(_knn(v, None, NEAR).select("query_id", "note_id", "similarity"), "similarity"), f"WITH {pairs} SELECT query_id, note_id, round(s, 6) AS similarity FROM p WHERE s >= {NEAR}")
    c["knn_pairwise"] = (lambda v: _knn(v, 5).select("query_id", "note_id", "rank"), f"WITH {pairs} SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) AS rank FROM p QUALIFY rank <= 5")
    c["related_notes"] = (
        lambda v: vectors.suggestions(v.vectors.join(live(v.heads).select("note_id"), "note_id", "left_semi"), _queries(v), v.heads, 5, NEAR),
        f"WITH {HEADS}, p AS (SELECT q.vec_id AS query_id, e.vec_id AS note_id, {sim} AS s FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id JOIN live ON live.note_id = e.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) AS rank FROM p WHERE s >= {NEAR} QUALIFY rank <= 5) "
        "SELECT query_id, n.note_id, title, round(s, 3) AS similarity, rank FROM n JOIN heads ON heads.note_id = n.note_id",
    )
    c["live_vectors"] = (lambda v: v.vectors.join(live(v.heads).select("note_id"), "note_id").groupBy("label").agg(F.count(F.lit(1)).alias("notes")), f"WITH {HEADS} SELECT label, count(*) AS notes FROM embeddings JOIN live ON note_id = vec_id GROUP BY 1")
    c["vectors_off_unit"] = (lambda v: vectors.off_unit(v.vectors.withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.col("label"))))).select("note_id", F.round("norm", 4).alias("norm")), f"SELECT vec_id AS note_id, round((1 + label) * sqrt({DOT.format(a='embedding', b='embedding')}), 4) AS norm FROM embeddings WHERE label > 0")
    c["l2_normalize"] = (lambda v: v.vectors.select("note_id", F.round(F.get(vectors.normalized(F.transform("embedding", lambda x: x * 3)), 0), 6).alias("x0")), f"SELECT vec_id AS note_id, round(CAST(embedding[1] AS DOUBLE) / sqrt({DOT.format(a='embedding', b='embedding')}), 6) AS x0 FROM embeddings")
    c["auto_edges"] = (
        lambda v: _auto(v).select("src", "dst"),
        f"WITH {EDGES}, {near} SELECT query_id AS src, note_id AS dst FROM near WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = query_id AND dst = note_id AND edge_type = 'references')",
    )
    c["link_extract"] = (lambda v: graph.text_links(_page_texts(v)).select("src", "target", F.sha2(F.trim(F.col("context")), 256).alias("context_hash")), f"WITH {_LINKS} SELECT src, target, context_hash FROM links")
    c["link_resolve"] = (
        lambda v: graph.resolved(graph.text_links(_page_texts(v)), _first_words(v)).where("dst IS NOT NULL").select("src", "target", "dst"),
        f"WITH {HEADS}, {_LINKS}, {_FIRST_WORDS}, {_RESOLVED} SELECT src, target, dst FROM resolved WHERE dst IS NOT NULL",
    )
    synced = f"""{HEADS}, {EDGES}, {_LINKS}, {_FIRST_WORDS}, {_RESOLVED}, {near},
        kept AS (SELECT query_id AS src, note_id AS dst FROM near WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = query_id AND dst = note_id AND edge_type = 'references')),
        every AS (SELECT src, dst, 'auto' AS source_type, 0 AS k, 0 AS ln, 0 AS part FROM kept UNION ALL SELECT src, dst, 'body', 1, ln, part FROM resolved WHERE dst IS NOT NULL AND dst <> src),
        synced AS (SELECT src, dst, 'references' AS edge_type, source_type FROM every QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY k, ln, part) = 1)""".replace("every AS (SELECT page_id", "every_link AS (SELECT page_id").replace("FROM every QUALIFY row_number() OVER (PARTITION BY page_id", "FROM every_link QUALIFY row_number() OVER (PARTITION BY page_id")
    c["edges_synced"] = (lambda v: _synced(v).select("src", "dst", "edge_type", "source_type"), f"WITH {synced} SELECT src, dst, edge_type, source_type FROM synced")
    c["edges_touched"] = (lambda v: graph.touched(v.edges.where("edge_type = 'unknown'"), _synced(v)), f"WITH {synced} SELECT src AS note_id FROM synced UNION SELECT dst FROM synced UNION SELECT src FROM edges WHERE edge_type = 'unknown' UNION SELECT dst FROM edges WHERE edge_type = 'unknown'")
    c["neighbors"] = (lambda v: graph.neighbors(v.edges, v.heads), f"WITH {HEADS}, {EDGES}, n AS (SELECT src AS note_id, 'out' AS direction, dst AS other, edge_type FROM edges UNION ALL SELECT dst, 'in', src, edge_type FROM edges) SELECT n.note_id, other, direction, edge_type, title FROM n JOIN heads ON other = heads.note_id")
    c["degrees"] = (lambda v: graph.degrees(v.edges, v.heads), f"WITH {HEADS}, {EDGES} SELECT note_id, coalesce(o, 0) AS links_out, coalesce(i, 0) AS links_in FROM heads LEFT JOIN (SELECT src, count(*) o FROM edges GROUP BY 1) ON src = note_id LEFT JOIN (SELECT dst, count(*) i FROM edges GROUP BY 1) ON dst = note_id")
    c["graph_expand"] = (
        lambda v: rounded(graph.expand(live(v.heads).select("note_id", (1 / (1 + F.col("access_count"))).alias("seed")), v.edges), "graph"),
        f"WITH {HEADS}, {EDGES}, seeds AS (SELECT note_id, 1 / (1 + access_count) AS seed FROM live), {_SPREAD} SELECT note_id, round(graph, 6) AS graph FROM passed",
    )
    c["engagement"] = (lambda v: v.heads.select("note_id", F.round(ranking.engagement(v.now, Ranking()), 6).alias("engagement")), f"WITH {HEADS} SELECT note_id, round({_ENGAGEMENT}, 6) AS engagement FROM heads")
    scores = ("cosine", "graph", "engagement", "final")
    scored = lambda df: rounded(df.select("note_id", *scores), *scores)
    told = "SELECT note_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in scores) + " FROM result"
    c["search_filter_only"] = (
        lambda v: scored(ranking.search(v, filters=ranking.Filters(domain="src0", since=DAY(2024, 1, 5)), cfg=Ranking(limit=20))),
        f"WITH {HEADS}, {blended_sql(_RECENT.format(where=chr(87) + 'HERE domain = ' + chr(39) + 'src0' + chr(39) + ' AND updated_at >= TIMESTAMP ' + chr(39) + '2024-01-05' + chr(39)), False, 20)} {told}",
    )
    c["search_bm25"] = (
        lambda v: rounded(ranking.search(v, "thing OR shes", mode="bm25").select("note_id", "final"), "final"),
        f"{_LEXICAL}, f AS (SELECT note_id, 0.75 * (1 - rank / (SELECT count(*) FROM lexical)) + 0.25 * ({_ENGAGEMENT}) AS final FROM lexical JOIN heads USING (note_id)) SELECT note_id, round(final, 6) AS final FROM f WHERE final >= 0.1 ORDER BY f.final DESC, note_id LIMIT 10",
    )
    merged = f"SELECT coalesce(l.note_id, n.note_id) AS note_id, rank FROM lexical l FULL JOIN ({_NEAREST}) n ON l.note_id = n.note_id"
    c["search_hybrid"] = (lambda v: scored(ranking.search(v, "thing OR shes", vector=_vector(v))), f"{_LEXICAL}, {blended_sql(merged, True, 10)} {told}")
    c["search_graph"] = (lambda v: scored(ranking.search(v, "thing OR shes")), f"{_LEXICAL}, {blended_sql('SELECT note_id, rank FROM lexical', False, 10)} {told}")
    c["search_semantic"] = (lambda v: scored(ranking.search(v, "thing", mode="semantic", vector=_vector(v))), f"WITH {HEADS}, {blended_sql(_RECENT.format(where=''), True, 10)} {told}")
    tagged = _LEXICAL.replace("status <> 'retracted' AND", "status <> 'retracted' AND note_id IN (SELECT note_id FROM tags WHERE tag = 'red') AND")
    c["search_tagged"] = (lambda v: scored(ranking.search(v, "thing OR shes", filters=ranking.Filters(tags=("red",)))), f"{tagged}, {blended_sql('SELECT note_id, rank FROM lexical', False, 10)} {told}")
    narrow = _LEXICAL.replace("status <> 'retracted' AND", "status <> 'retracted' AND note_id IN (SELECT note_id FROM heads WHERE domain = 'src0') AND")
    inside = blended_sql("SELECT note_id, rank FROM lexical", False, 10).replace("JOIN live USING (note_id)), top", "JOIN live USING (note_id) WHERE domain = 'src0' OR note_id IN (SELECT note_id FROM pool)), top")
    c["search_in_domain"] = (lambda v: scored(ranking.search(v, "thing OR shes", filters=ranking.Filters(domain="src0"), cfg=Ranking(respect_domain=True))), f"{narrow}, {inside} {told}")
    c["search_hits"] = (lambda v: rounded(ranking.hits(v, ranking.search(v, "thing OR shes", vector=_vector(v)), "thing OR shes"), "final"), None)
    degree = "(SELECT count(*) FROM edges WHERE dst = note_id) AS links_in, (SELECT count(*) FROM edges WHERE src = note_id) AS links_out"
    c["about_notes"] = (
        lambda v: ranking.about(v, "thing OR shes").select("note_id", F.round("final", 6).alias("final"), F.sha2("body_preview", 256).alias("preview_hash"), "links_in", "links_out"),
        f"{_LEXICAL}, {blended_sql('SELECT note_id, rank FROM lexical', False, 3)} SELECT note_id, round(final, 6) AS final, sha256({_cut_sql(500)}) AS preview_hash, {degree} FROM result JOIN heads USING (note_id)",
    )
    c["orient_briefing"] = (lambda v: v.spark.createDataFrame([(ranking.briefing(v, "thing OR shes"),)], "briefing string"), None)
    c["orient_tags"] = (
        lambda v: v.tags.join(ranking.search(v, "thing OR shes", cfg=Ranking(limit=5)).select("note_id"), "note_id", "left_semi").select("tag").distinct(),
        f"{_LEXICAL}, {blended_sql('SELECT note_id, rank FROM lexical', False, 5)} SELECT DISTINCT tag FROM tags JOIN result USING (note_id)",
    )
    c["orient_recent"] = (
        lambda v: ranking.recently_updated(v, ranking.Filters(tags=("red",)), T.cutoff("7d", v.now)),
        f"WITH {HEADS}, {TAGS} SELECT count(*) AS notes FROM live WHERE updated_at >= TIMESTAMP '2024-01-24' AND EXISTS (SELECT 1 FROM tags WHERE tags.note_id = live.note_id AND tag = 'red')",
    )
    c["candidate_merge"] = (
        lambda v: v.index.bm25(FTS, _W).select("note_id", F.lit(1).alias("lexical")).join(_knn(v, None, NEAR).select("note_id").distinct().select("note_id", F.lit(1).alias("near")), "note_id", "full_outer"),
        f"WITH a AS ({bm25_sql([_word(w) for w in ('thing', 'shes', 'ound')], 'n0 > 0 OR n1 > 0 OR n2 > 0', _W, 1000000000)}), {pairs}, b AS (SELECT DISTINCT note_id FROM p WHERE s >= {NEAR}) "
        "SELECT coalesce(a.note_id, b.note_id) AS note_id, CASE WHEN a.note_id IS NOT NULL THEN 1 END AS lexical, CASE WHEN b.note_id IS NOT NULL THEN 1 END AS near FROM a FULL JOIN b ON a.note_id = b.note_id",
    )
    c["version_history"] = (lambda v: versions.history(v.versions), f"WITH RECURSIVE {VERSIONS}, chain AS (SELECT note_id, max(seq) AS seq, 0 AS depth FROM versions GROUP BY 1 UNION ALL SELECT v.note_id, p.seq, depth + 1 FROM chain c JOIN versions v USING (note_id, seq) JOIN versions p ON p.note_id = v.note_id AND p.seq = v.prev) SELECT note_id, seq, content_hash, depth FROM chain JOIN versions USING (note_id, seq)")
    c["version_heads"] = (lambda v: versions.heads(v.versions), f"WITH {VERSIONS} SELECT note_id, max(seq) AS seq, arg_max(content_hash, seq) AS content_hash FROM versions GROUP BY 1")
    c["rollback"] = (lambda v: versions.rollback(v.versions, 0), f"WITH {VERSIONS}, h AS (SELECT note_id, max(seq) AS head FROM versions GROUP BY 1) SELECT note_id, head + 1 AS seq, head AS prev, content_hash FROM h JOIN versions USING (note_id) WHERE seq = 0")
    c["content_hash"] = (lambda v: v.table("documents").select("doc_id", F.sha2("text", 256).alias("content_hash")), "SELECT doc_id, sha256(text) AS content_hash FROM documents")
    c["cas_dedup"] = (lambda v: versions.stored(v.table("documents")).select("hash", F.length("payload").alias("n")), "SELECT sha256(text) AS hash, CAST(any_value(length(text)) AS INT) AS n FROM documents GROUP BY 1")
    c["title_infer"] = (lambda v: v.heads.select("note_id", "title"), f"WITH {HEADS} SELECT note_id, title FROM heads")
    c["embed_input"] = (
        lambda v: v.heads.select("note_id", F.sha2(T.embed_input(F.col("title"), F.col("domain"), F.col("kind"), F.col("intent"), F.array(F.col("intent"), F.col("kind")), F.col("body")), 256).alias("input_hash")),
        f"WITH {HEADS} SELECT note_id, sha256('[' || domain || ' ' || kind || ' — ' || intent || '] [' || intent || ', ' || kind || '] ' || title || chr(10) || chr(10) || body) AS input_hash FROM heads",
    )
    for name, columns in (("ir_recall", ("recall_at_1", "recall_at_5", "recall_at_10")), ("ir_mrr", ("mrr",)), ("ir_ndcg", ("ndcg_at_10",))):
        c[name] = (lambda v, columns=columns: rounded(_metrics(v).select("query_id", *columns), *columns), f"WITH {EVALUATED} SELECT query_id, {', '.join(f'round({x}, 6) AS {x}' for x in columns)} FROM metrics")
    c["ir_by_class"] = (
        lambda v: rounded(evaluation.by_class(_metrics(v).select("query_id", "recall_at_5", "mrr"), v.vectors.select(F.col("note_id").alias("query_id"), F.col("label").alias("class"))), "recall_at_5", "mrr"),
        f"WITH {EVALUATED} SELECT label AS class, count(*) AS queries, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr FROM metrics JOIN q ON vec_id = query_id GROUP BY GROUPING SETS ((label), ())",
    )
    c["latency_percentile"] = (
        lambda v: evaluation.nearest_ranks(v.table("orders"), "o_orderpriority", "o_totalprice", {"p50": 0.5, "p99": 0.99}),
        "SELECT o_orderpriority, s[CAST(floor((len(s) - 1) * 0.5 + 0.5) AS INT) + 1] AS p50, s[CAST(floor((len(s) - 1) * 0.99 + 0.5) AS INT) + 1] AS p99 FROM (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS s FROM orders GROUP BY 1)",
    )
    c["reads_by_day"] = (
        lambda v: access.reads_by_window(v.table("events")).select("note_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "reads"),
        "SELECT user_id AS note_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS reads FROM events WHERE event_type = 'view' GROUP BY 1, 2",
    )
    c["counters_streamed"] = (
        _counters,
        "SELECT user_id AS note_id, count(*) AS access_count, max(ts) AS last_accessed, CAST(0 AS BIGINT) AS links_out, CAST(0 AS BIGINT) AS links_in FROM events WHERE event_type = 'view' AND user_id IS NOT NULL GROUP BY 1",
    )
    c["vectors_as_blobs"] = (
        lambda v: vectors.from_blobs(vectors.to_blobs(v.vectors)).join(v.vectors.select("note_id", F.col("embedding").alias("given")), "note_id").select("note_id", F.size("embedding").cast("long").alias("numbers"), (F.col("embedding") == F.col("given")).alias("same")),
        "SELECT vec_id AS note_id, len(embedding) AS numbers, true AS same FROM embeddings",
    )
    c["version_diffs"] = (lambda v: versions.diffs(v.versions), None)
    c["snippet_fallback"] = (
        lambda v: v.heads.select("note_id", F.sha2(T.trimmed(T.cut_at_word(F.col("body"), 150)), 256).alias("snippet_hash")),
        f"WITH {HEADS} SELECT note_id, sha256({_cut_sql(150)}) AS snippet_hash FROM heads",
    )
    c["frontmatter_parse"] = (_frontmatter, f"WITH {HEADS} SELECT note_id, title, domain || '+' || intent AS tags, kind AS target, sha256(trim(body, {SPACES})) AS body_hash FROM heads")
    quote = lambda x: f"to_json({x})"
    c["frontmatter_forms"] = (
        _forms,
        f"""WITH {HEADS} SELECT note_id, title, 'one hand' AS author, domain || ', x+' || intent AS tags, kind AS target,
        sha256('"title": ' || {quote('title')} || chr(10) || '"author": "one hand"' || chr(10) || '"kind": ' || {quote('kind')} || chr(10) || '"tags": [' || {quote("domain || ', x'")} || ', ' || {quote('intent')} || ']' || chr(10) || '"links": [{{"rel": "extends", "target": ' || {quote('kind')} || '}}]' || chr(10)) AS canonical_hash FROM heads""",
    )
    _changes(c)
    return c


@lru_cache(maxsize=4)
def _vault(application: str, spark: SparkSession, folder: str) -> Vault:
    """One vault for all queries of a session on a folder, so that its index is built once."""
    return Vault(spark, folder)


def vault_of(spark: SparkSession, folder: str) -> Vault:
    vault = _vault(spark.sparkContext.applicationId, spark, folder)
    vault.stamp()  # plans made before the tables changed aren't used
    return vault


def queries() -> dict:
    def of(plan):
        return lambda spark, sf_dir: plan(vault_of(spark, sf_dir))

    return {name: of(plan) for name, (plan, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items() if sql}
