"""Full-text search: a query language, BM25 over weighted fields, exact best notes by bounds of blocks, snippets, statistics.

A query's words lead to the rows of their postings (operators/postings.py), which one grouping by note turns into the counts
of all its phrases. For the k best, blocks are bounded first, without reading notes: the few with the greatest bounds give a
score that k notes have, and only blocks that can reach it are scored."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FIELD_WEIGHTS
from ..functions.text import fold, tokens, words
from ..plans.tables import shared_folder, written
from .blocks import K1, B, scored
from .postings import Store

#: Blocks that give the first k-th score.
FIRST = 24


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    field: str | None = None
    prefix: bool = False


@dataclass(frozen=True)
class Both:
    left: object
    right: object
    how: str  # AND, OR, NOT


def parse(query: str, fields=tuple(FIELD_WEIGHTS)):
    """The query's tree of Both and Phrase. Precedence, tightest first: side by side, NOT, AND, OR."""
    found = re.findall(r'\s*(?:("(?:[^"]|"")*")|([\w\x80-\U0010ffff]+)|(\S))', query)
    items = [("text", a[1:-1].replace('""', '"')) if a else ("word", b) if b else ("sign", c) for a, b, c in found]
    at = 0

    def peek():
        return items[at] if at < len(items) else (None, None)

    def take():
        nonlocal at
        at += 1
        return items[at - 1] if at <= len(items) else (None, None)

    def chain(operator: str, inner):
        left = inner()
        while peek() == ("word", operator):
            take()
            left = Both(left, inner(), operator)
        return left

    def either():
        return chain("OR", both)

    def both():
        return chain("AND", without)

    def without():
        return chain("NOT", beside)

    def beside():
        left = single(None)
        while (k := peek())[0] in ("text", "word") and k[1] not in ("AND", "OR", "NOT") or k == ("sign", "("):
            left = Both(left, single(None), "AND")
        return left

    def single(column):
        kind, value = take()
        if (kind, value) == ("sign", "("):
            inner = either()
            if take() != ("sign", ")"):
                raise ValueError("unbalanced parentheses")
            return _within(inner, column)
        if kind not in ("text", "word") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise ValueError(f"unexpected {value!r}")
        if kind == "word" and peek() == ("sign", ":"):
            take()
            if value not in fields:
                raise ValueError(f"no such column: {value}")
            return single(value)
        prefix = peek() == ("sign", "*")
        if prefix:
            take()
        return Phrase(words(value), column, prefix)

    tree = either()
    if at < len(items):
        raise ValueError(f"unexpected {items[at][1]!r}")
    return tree


def _within(tree, column):
    if column is None:
        return tree
    return Phrase(tree.words, column, tree.prefix) if isinstance(tree, Phrase) else Both(_within(tree.left, column), _within(tree.right, column), tree.how)


def scored_phrases(tree) -> list[Phrase]:
    """Phrases in order, each time that they occur, but for the right sides of NOT."""
    if isinstance(tree, Phrase):
        return [tree]
    return scored_phrases(tree.left) + ([] if tree.how == "NOT" else scored_phrases(tree.right))


def all_phrases(tree) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else all_phrases(tree.left) + all_phrases(tree.right)


class Index:
    """Search over stored postings, of texts (note_id, a column for each field) or of an index that is stored already."""

    def __init__(self, texts: DataFrame | None = None, fields=tuple(FIELD_WEIGHTS), store: Store | None = None):
        self.fields = store.fields if store else tuple(f for f in fields if f in texts.columns)
        self._texts, self._store = texts, store

    @property
    def store(self) -> Store:
        if self._store is None:
            spark = self._texts.sparkSession
            self._store = Store(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", self.fields)
            self._store.refresh(self._texts)
        return self._store

    @property
    def totals(self) -> dict[str, int]:
        """Number of notes, and of words by field."""
        return self.store.totals()

    def asked(self, query: str, weights: dict[str, float] | None = None) -> Asked | None:
        """A query over this index; None where it is malformed."""
        weights = {f: w for f, w in (weights or FIELD_WEIGHTS).items() if f in self.fields}
        try:
            return Asked(self, parse(query, tuple(weights)), weights)
        except ValueError:
            return None

    def bm25(self, query: str, weights: dict[str, float] | None = None) -> DataFrame:
        """(note_id, bm25) of the notes that match, the least (most negative) being the best. A malformed query matches none.

        Statistics span all notes of the index, as filters come after matching. All fields of weights count in a note's
        length; a phrase that is bound to a column has its occurrences from there alone."""
        asked = self.asked(query, weights)
        return self._none() if asked is None else asked.scored()

    def top(self, query: str, k: int, weights: dict[str, float] | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """The k best rows of bm25, in order, of the notes (note_id) that are allowed; blocks that can't hold one aren't scored."""
        asked = self.asked(query, weights)
        return self._none() if asked is None else asked.top(k, allowed)

    def _none(self) -> DataFrame:
        return self.store.spark.createDataFrame([], "note_id long, bm25 double")


class Asked:
    """A query's plan: the rows of its words, the notes that match, their scores, and what bounds these by block."""

    def __init__(self, index: Index, tree, weights: dict[str, float]):
        self.index, self.store, self.tree, self.weights = index, index.store, tree, weights
        self.phrases = list(dict.fromkeys(all_phrases(tree)))
        self.name = {p: f"p{i}" for i, p in enumerate(self.phrases)}
        ends = [p.words[-1] for p in self.phrases if p.words and p.prefix]
        terms = {w for p in self.phrases for w in (p.words[:-1] if p.prefix else p.words)}
        self.terms = sorted(terms | set(self.store.expanded(sorted(set(ends)))))
        totals = index.totals
        self.notes, size = totals["_notes"], sum(totals[f] for f in weights)
        self.average = size / self.notes if self.notes and size else 1.0

    @cached_property
    def rows(self) -> DataFrame:
        """Postings of the query's words in the fields of weights, with w, their field's weight."""
        number = {self.index.fields.index(f): float(w) for f, w in self.weights.items()}
        weight = F.lit(0.0)
        for k, w in number.items():
            weight = F.when(F.col("field") == k, w).otherwise(weight)
        return self.store.postings(self.terms).where(F.col("field").isin(list(number))).withColumn("w", weight)

    def _length(self, one: str, every: str) -> Column | None:
        """A note's length in the fields of weights, where these are one or all; None where notes have to tell it."""
        return F.col(every) if len(self.weights) == len(self.index.fields) else F.col(one) if len(self.weights) == 1 else None

    def _meets(self, p: Phrase, i: int) -> Column:
        word = F.col("term").startswith(p.words[i]) if p.prefix and i == len(p.words) - 1 else F.col("term") == p.words[i]
        return word & (F.col("field") == self.index.fields.index(p.field)) if p.field else word

    # ------------------------------------------------------------ notes

    def counted(self, blocks: DataFrame | list[int] | None = None) -> DataFrame:
        """(note_id, len, and n_ and f_ of each phrase: how often, and by weights) of the notes that have a word."""
        rows = self.rows
        if isinstance(blocks, list):
            rows = rows.where(F.col("block").isin(blocks))
        elif blocks is not None:
            rows = rows.join(blocks.select("block"), "block", "left_semi")
        several = any(len(p.words) > 1 for p in self.phrases)
        lists = ["notes", "counts", "own", "every", *(["places"] if several else [])]
        each = rows.select("term", "field", "w", "block", F.explode(F.arrays_zip(*lists)).alias("x")).select("term", "field", "w", "block", F.col("x.notes").alias("note_id"), *[f"x.{c}" for c in lists[1:]])
        length = self._length("own", "every")
        sums, after = [F.max(F.lit(0) if length is None else length).alias("len")], ["note_id", "len"]
        for p in self.phrases:
            k = self.name[p]
            if len(p.words) == 1:
                sums += [F.coalesce(F.sum(F.when(self._meets(p, 0), F.col("counts"))), F.lit(0)).alias(f"n_{k}"), F.coalesce(F.sum(F.when(self._meets(p, 0), F.col("counts") * F.col("w"))), F.lit(0.0)).alias(f"f_{k}")]
                after += [f"n_{k}", f"f_{k}"]
                continue
            # where a phrase begins is told by each of its words: its place less its number in the phrase
            sums += [F.flatten(F.collect_list(F.when(self._meets(p, i), _begins(i)))).alias(f"{k}_{i}") for i in range(len(p.words))]  # of one note
            hits = reduce(F.array_intersect, [F.col(f"{k}_{i}") for i in range(len(p.words))]) if p.words else F.array().cast("array<struct<field:int,w:double,at:int>>")
            after += [F.size(hits).cast("long").alias(f"n_{k}"), F.aggregate(hits, F.lit(0.0), lambda s, x: s + x["w"]).alias(f"f_{k}")]
        found = self.store.living(each).groupBy("note_id").agg(*sums).select(*after)
        if length is None:
            told = self.store.notes().select("note_id", reduce(lambda a, b: a + b, [F.col(f"l_{f}") for f in self.weights]).alias("len"))
            found = found.drop("len").join(told, "note_id")
        return found

    def matches(self, t=None, has=None) -> Column:
        """Whether a row of counted matches the query; has tells a phrase's presence otherwise."""
        t = self.tree if t is None else t
        has = has or (lambda p: F.col(f"n_{self.name[p]}") > 0)
        if isinstance(t, Phrase):
            return has(t)
        left, right = self.matches(t.left, has), self.matches(t.right, has)
        return left & right if t.how == "AND" else left | right if t.how == "OR" else left & ~right

    @cached_property
    def rare(self) -> dict[Phrase, float]:
        """How much a scored phrase counts, by the living notes that have it.

        Rows of postings tell it for single words, of all fields or of one; otherwise notes are counted."""
        scored = list(dict.fromkeys(scored_phrases(self.tree)))
        whole = len(self.weights) == len(self.index.fields)
        if not scored:
            return {}
        if self.store.tombstones is None and all(len(p.words) == 1 and not p.prefix and (p.field or whole or len(self.weights) == 1) for p in scored):
            of = lambda p: F.sum(F.when(self._meets(p, 0), F.col("fresh" if whole and not p.field else "n")))
            row = self.rows.agg(*[of(p).alias(self.name[p]) for p in scored]).first()
        else:
            row = self.counted().agg(*[F.count_if(F.col(f"n_{self.name[p]}") > 0).alias(self.name[p]) for p in scored]).first()
        have = {p: row[self.name[p]] or 0 for p in scored}
        value = {p: math.log((self.notes - d + 0.5) / (d + 0.5)) for p, d in have.items()}
        return {p: v if v > 0 else 1e-6 for p, v in value.items()}

    def _saturated(self, p: Phrase, f: Column, length: Column) -> Column:
        return F.lit(self.rare[p]) * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(self.average)))

    def scored(self, blocks: DataFrame | list[int] | None = None) -> DataFrame:
        score = F.lit(0.0)
        for p in scored_phrases(self.tree):
            f = F.col(f"f_{self.name[p]}")
            score = score - F.when(f > 0, self._saturated(p, f, F.col("len"))).otherwise(F.lit(0.0))
        return self.counted(blocks).where(self.matches()).select("note_id", score.alias("bm25"))

    # ------------------------------------------------------------ blocks

    def bounds(self) -> DataFrame:
        """(block, bound, n) of the blocks that may hold a match: no note's score, taken positive, exceeds bound.

        Of a phrase the greatest count is that of its rarest word, of a prefix the sum of its terms'; lengths are at least the
        sum of the fields' least. n is the number of postings."""
        sums, after = [F.sum("n").alias("n")], F.lit(0.0)
        least = self._length("least", "least_of_all")
        for p in self.phrases:
            for i in range(len(p.words)):
                k = f"{self.name[p]}_{i}"
                sums += [F.coalesce(F.sum(F.when(self._meets(p, i), F.col("most") * F.col("w"))), F.lit(0.0)).alias(f"m_{k}"), F.min(F.when(self._meets(p, i), F.lit(0) if least is None else least)).alias(f"l_{k}")]

        def most_of(p: Phrase) -> Column:
            every = [F.col(f"m_{self.name[p]}_{i}") for i in range(len(p.words))]
            return F.lit(0.0) if not every else every[0] if len(every) == 1 else F.least(*every)

        for p in scored_phrases(self.tree):
            if p.words:
                length = reduce(F.greatest, [F.coalesce(f"l_{self.name[p]}_{i}", F.lit(0)) for i in range(len(p.words))])
                after = after + F.when(most_of(p) > 0, self._saturated(p, most_of(p), length)).otherwise(F.lit(0.0))
        may = self.matches(_without_not(self.tree), lambda p: most_of(p) > 0)
        return self.rows.groupBy("block").agg(*sums).where(may).select("block", (after * (1 + 1e-9) + 1e-12).alias("bound"), "n")

    def floor(self, k: int, allowed: DataFrame | None, first: list) -> float | None:
        """A score that k allowed notes of the first blocks have; None where they don't hold as many."""
        best = _allowed(self.scored([r.block for r in first]), allowed).orderBy("bm25").limit(k).collect()
        return -best[-1].bm25 if len(best) == k else None

    def chosen(self, k: int, allowed: DataFrame | None = None) -> DataFrame | list[int]:
        """The blocks that may hold one of the k best allowed notes: those whose bound reaches a score that k notes have.

        The k-th score of FIRST blocks with the greatest bounds is that score."""
        first = self.bounds().orderBy(F.col("bound").desc(), "block").limit(FIRST + 1).collect()
        if len(first) <= FIRST:
            return [r.block for r in first]
        floor = self.floor(k, allowed, first[:FIRST])
        if floor is not None and first[FIRST].bound < floor:
            return [r.block for r in first[:FIRST] if r.bound >= floor]
        return self.bounds() if floor is None else self.bounds().where(F.col("bound") >= floor)

    def top(self, k: int, allowed: DataFrame | None = None) -> DataFrame:
        return _allowed(self.scored(self.chosen(k, allowed)), allowed).orderBy("bm25", "note_id").limit(k)


def _begins(after: int) -> Column:
    """Where a phrase would begin whose word at number after stands at a row's places."""
    return F.transform("places", lambda x: F.struct(F.col("field").alias("field"), F.col("w").alias("w"), (x - F.lit(after)).alias("at")))


def _allowed(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return rows if allowed is None else rows.join(allowed.select("note_id"), "note_id", "left_semi")


def _without_not(tree):
    """What a match has to have: a tree without right sides of NOT."""
    if isinstance(tree, Phrase):
        return tree
    return _without_not(tree.left) if tree.how == "NOT" else Both(_without_not(tree.left), _without_not(tree.right), tree.how)


def batch(index: Index, queries: DataFrame, k: int, field: str = "body", every: bool = True) -> DataFrame:
    """(query_id, note_id, score, rank) of the k best notes for each of queries (query_id, query), by one field; more is better.

    A query is its letters and digits, whatever signs it holds; a note has to have all of its words, or any, if not every.
    A word that a query has twice counts twice. Postings meet the queries by block; queries without words find nothing."""
    terms = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    own = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("x"))  # a query's words
    none = F.lit(None).cast("string")
    phrases = F.transform("x", lambda x, i: F.struct(i.cast("int").alias("p"), F.array(x["term"]).alias("words"), F.lit(False).alias("prefix"), none.alias("field"), x["times"].cast("int").alias("times")))
    step = lambda op, p: F.struct(op.alias("op"), p.cast("int").alias("p"))
    joined = step(F.lit("AND" if every else "OR"), F.lit(None))
    program = F.flatten(F.transform("x", lambda x, i: F.when(i == 0, F.array(step(F.lit("has"), i))).otherwise(F.array(step(F.lit("has"), i), joined))))
    found = scored(index, written(own.select("query_id", phrases.alias("phrases"), program.alias("program")), "queries"), {field: 1.0}, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "note_id"))  # sums of other orders tie
    return found.select("query_id", "note_id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def bm25(notes: DataFrame, query: str, fields: dict[str, float] | None = None) -> DataFrame:
    """Index.bm25 over an index of notes that is built for this query alone."""
    fields = fields or FIELD_WEIGHTS
    return Index(notes, fields=tuple(fields)).bm25(query, fields)


def plain_query(text: str) -> str:
    """A text's letters and digits as a query in which all of them have to occur, whatever signs it holds."""
    return " ".join(f'"{w}"' for w in re.findall(r"[^\W_]+", text))


# ---------------------------------------------------------------- snippets

SNIPPET = 32


def _spans(body: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), fold(m[0])) for m in re.finditer(r"[^\W_]+(?:[\u0300-\u036f]+[^\W_]*)*", body)]


def _hits(spans: list[tuple[int, int, str]], phrases: list[Phrase]) -> list[tuple[int, int, int]]:
    """(first token, number of tokens, phrase) of the phrases' places, in order."""
    out = []
    for k, p in enumerate(phrases):
        n = len(p.words)
        for i in range(len(spans) - n + 1 if n else 0):
            last = spans[i + n - 1][2]
            if all(spans[i + j][2] == p.words[j] for j in range(n - 1)) and (last.startswith(p.words[-1]) if p.prefix else last == p.words[-1]):
                out.append((i, n, k))
    return sorted(out)


def snippet(body: str | None, phrases: list[Phrase], size: int = SNIPPET) -> str:
    """The part of a body of at most size tokens with most of the phrases, these in brackets; empty without a body.

    A window begins at each hit, centred on its hits, and at the sentence before it. It scores 1000 for each phrase, 1 for
    each repetition, 100 for a sentence's start and 120 for the body's; of the best, the first counts."""
    body = body or ""
    spans = _spans(body)
    hits = _hits(spans, phrases)
    starts = [0]
    for i in range(1, len(spans)):
        gap = body[spans[i - 1][1] : spans[i][0]]
        if gap[-1:].isspace() and gap.rstrip()[-1:] in (".", ":"):
            starts.append(i)

    def value(begin: int) -> tuple[int, int, int]:
        seen, total, first, last = set(), 0, None, None
        for i, n, k in hits:
            if begin <= i and i + n <= begin + size:
                total += 1 if k in seen else 1000
                seen.add(k)
                first = i if first is None else first
                last = i + n
        return total, begin if first is None else first, begin + 1 if last is None else last

    best, at = -1, 0
    for begin, _, _ in hits:
        total, first, last = value(begin)
        if total > best:
            best = total
            at = max(0, min(first - int((size - (last - first)) / 2), max(len(spans) - size, 0)))
        if len(spans) > size:
            before = [s for s in starts if s < begin]
            if before:
                total = value(before[-1])[0] + (120 if before[-1] == 0 else 100)
                if total > best:
                    best, at = total, before[-1]
    if not spans:
        return body
    end = min(at + size, len(spans))
    out, here, until = [], spans[at][0] if at else 0, spans[end - 1][1] if end < len(spans) else len(body)
    marked = []
    for i, n, _ in hits:
        if at <= i and i + n <= end:
            if marked and i < marked[-1][1]:
                marked[-1][1] = max(marked[-1][1], i + n)
            else:
                marked.append([i, i + n])
    for a, b in marked:
        out += [body[here : spans[a][0]], "[", body[spans[a][0] : spans[b - 1][1]], "]"]
        here = spans[b - 1][1]
    return "..." * (at > 0) + "".join(out) + body[here:until] + "..." * (end < len(spans))


def snippets(notes: DataFrame, query: str, size: int = SNIPPET) -> DataFrame:
    """(note_id, snippet) of a few notes (note_id, body) for a query; a phrase bound to another column marks nothing."""
    try:
        phrases = [p for p in dict.fromkeys(scored_phrases(parse(query))) if p.field in (None, "body")]
    except ValueError:
        phrases = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([snippet(x.as_py(), phrases, size) for x in batch.column(1)], pa.string())], names=["note_id", "snippet"])

    return notes.select("note_id", "body").mapInArrow(run, f"note_id {dict(notes.dtypes)['note_id']}, snippet string")


# ---------------------------------------------------------------- statistics


def term_stats(notes: DataFrame, field: str = "body") -> DataFrame:
    """Documents and occurrences of each term of a field."""
    found = notes.select("note_id", F.explode(tokens(F.col(field))).alias("term"))
    return found.groupBy("note_id", "term").count().groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("count").alias("occurrences"))
