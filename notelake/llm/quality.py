"""Robust multivariate outliers: a minimum covariance determinant for each language and source judges documents.

Counts of a whole text (words, characters, symbols, repeated lines and words) become a vector of five transformed
statistics. Documents that fail the base rules are rejected and take no part in the estimates. For each group of at
least MIN_GROUP others, concentration steps look for the half of them with the least determinant of covariance: estimate
mean and covariance, take the half that is nearest, estimate again, until the determinant falls no more. Three starts
(medians and their deviations, mean and covariance, covariance of spatial signs) go through the steps, and the least
determinant of all counts. Documents within the 97.5 % quantile of that half's distances then give the final estimate.

Most texts have no symbol and no repetition, so a covariance alone would be singular. The variance of each statistic has
that of the smallest difference added: one word, character, symbol, repeated line or window more in the group's median
text. Statistics that vary less than that in the half are no degrees of freedom. A squared Mahalanobis distance is
divided by the group's median one over that of the chi-square distribution, but never enlarged, and a document is an outlier
beyond the distribution's quantile at which one clean document in 1 / TAIL would be.

A step is one grouped sum: moments by group, start and distance bin, added up from the nearest bin on; the bin that
completes the half counts in part. So all rows count, no group meets in one task, and a source with a third of the rows
is summed in parts. Inverses are taken on the executors, a group a row. Smaller groups use the estimate of their
language, and small languages that of all documents; with fewer than MIN_GROUP documents in all, only the base rules
judge.

Nulls: a null text has no words and fails; null language and source are groups of their own; null ids stay null.
Repeated rows count each. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Words, blocks, forget, mix, new_path, range_hash, utf8, written

#: Documents that an estimate needs: ten for each statistic.
MIN_GROUP = 50
#: Share of clean documents that may lie beyond the cutoff, were they normal.
TAIL = 1e-9
#: Fall of the determinant's logarithm that is none.
EPSILON = 0.01
#: Groups, with a start each, that one task estimates.
GROUPS_A_TASK = 64
#: Files of a table of groups.
FILES = 32
#: Groups whose estimates may be broadcast.
MOST_GROUPS = 1 << 16
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = 5


def text_stats(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The five counts of each text of a block."""
    n = len(offs) - 1
    w = Words(buf, offs)
    lead = np.concatenate([[0], np.cumsum(~w.space & ((buf & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    # lines with a word that equal an earlier one
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offs[:-1]] = True
    cut[np.flatnonzero(buf == 10) + 1] = True
    cut = cut[: len(buf)]
    start = np.flatnonzero(cut)
    end = np.concatenate([start[1:], [len(buf)]])
    end = np.where((end > start) & (buf[np.maximum(end - 1, 0)] == 10), end - 1, end) if len(buf) else end
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[filled], end[filled]
    line_doc = np.searchsorted(offs, start, side="right") - 1
    dup = _again(line_doc, range_hash(w.prefix, start, end))
    dup_lines = np.bincount(line_doc[dup], minlength=n)
    # words in windows of five that the text has twice
    at, h = w.windows(5)
    twice = at[_shared(w.doc[at], h)]
    cover = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return [w.count, lead[offs[1:]] - lead[offs[:-1]], symbols[offs[1:]] - symbols[offs[:-1]], dup_lines, covered[w.first[1:]] - covered[w.first[:-1]]]


def _keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + doc.astype(U64) * U64(0xA24BAED4963EE407))


def _again(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries have an equal one before them in the same text."""
    key = _keyed(doc, h)
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def _shared(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries have an equal one in the same text."""
    key = _keyed(doc, h)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(key, twice) if len(twice) else np.zeros(len(key), dtype=bool)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        buf, offs = utf8(batch.column(batch.num_columns - 1))
        parts = [text_stats(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in blocks(offs)]
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *STATS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts and base_failed of docs (doc_id, text, lang, source)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    rows = rows.mapInArrow(_stats, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _vector() -> list:
    n, chars = F.col("n_words"), F.col("word_chars")
    return [F.log1p(n), F.log(chars / n), F.log1p(100 * F.col("n_symbols") / chars), F.log1p("n_dup_lines"), F.col("n_repeat_words") / n]


_PAIRS = list(itertools.combinations_with_replacement(range(DIMS), 2))
#: What stands for the determinant before the first: any is less.
BEFORE = 1e300
MODEL = "_group string, _start int, m array<double>, center array<double>, inverse array<double>, logdet double, was double, dof int, unit double"
_FIELDS = [(x.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}.get(x.split()[1], pa.list_(pa.float64()))) for x in MODEL.split(", ")]


def chi_square_quantile(tail: float, dof: int) -> float:
    """The value that a chi-square variable of dof degrees of freedom exceeds with probability tail, by bisection."""

    def beyond(x: float) -> float:
        if dof % 2 == 0:
            term = total = math.exp(-x / 2)
            for i in range(1, dof // 2):
                term *= x / 2 / i
                total += term
            return total
        total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for i in range(3, dof + 1, 2):
            total += term
            term *= x / i
        return total

    low, high = 0.0, 1500.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) > tail else (low, mid)
    return low


def smallest_steps(median: np.ndarray) -> np.ndarray:
    """What one more word, character, symbol, repeated line and repeated window change in the statistics of the median text."""
    words = max(math.expm1(median[0]), 1.0)
    chars = max(words * math.exp(median[1]), 1.0)
    return np.array([1 / (words + 1), 1 / chars, math.log1p(100 / chars), math.log(2), 5 / max(words, 5.0)])


def _model(group: str, start: int, m: np.ndarray, center: np.ndarray, cov: np.ndarray, was: float, unit: float = 1.0, dof: int | None = None) -> tuple:
    steps = smallest_steps(m)
    whole = cov + np.diag(steps**2)
    dof = dof or max(int((np.diag(cov) > steps**2).sum()), 1)
    return group, start, m.tolist(), center.tolist(), np.linalg.inv(whole).ravel().tolist(), float(np.linalg.slogdet(whole)[1]), was, dof, unit


def _moments(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    center, cov = sums / n, np.zeros((DIMS, DIMS))
    for (i, j), q in zip(_PAIRS, products, strict=True):
        cov[i, j] = cov[j, i] = q / n - center[i] * center[j]
    return center, cov


def _models(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


_SUMS = [f"s{i}" for i in range(DIMS)] + [f"q{i}{j}" for i, j in _PAIRS]


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three starts of each group from its medians, deviations, moments and moments of spatial signs."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            m, mad = np.array(r["m"]), 1.4826 * np.array(r["mad"])
            scale, signs = np.maximum(mad, 1e-3), np.zeros((DIMS, DIMS))
            for i, j in _PAIRS:
                signs[i, j] = signs[j, i] = r[f"u{i}{j}"] / r["n"] * DIMS * scale[i] * scale[j]
            sums = np.array([r[c] for c in _SUMS])
            starts = [(m, np.diag(mad**2)), _moments(r["n"], sums[:DIMS], sums[DIMS:]), (m, signs)]
            for k, (center, cov) in enumerate(starts):
                own = _model(r["_group"], k, m, center, cov, BEFORE)
                out.append((*own[:5], BEFORE, *own[6:]))  # it is no half's
        yield _models(out)


def _halves(whole: bool):
    """Of sums by group, start and bin, in this order, the model of the nearest half, or the given one with its unit of distance."""

    def one(rows: list[dict]) -> tuple:
        r = rows[0]
        n = np.array([x["n"] for x in rows])
        need = int(n.sum()) // 2 + 1
        at = int(np.searchsorted(np.cumsum(n), need))
        part = (need - n[:at].sum()) / n[at]  # of the bin that completes the half
        if not whole:
            median = 2.0 ** ((rows[at]["_bin"] + part) / 16) - 1e-9
            return (*(r[c] for c, _ in _FIELDS[:-1]), median / chi_square_quantile(0.5, r["dof"]))
        sums = np.array([[x[c] for c in _SUMS] for x in rows[: at + 1]])
        sums[at] *= part
        sums = sums.sum(axis=0)
        return _model(r["_group"], r["_start"], np.array(r["m"]), *_moments(need, sums[:DIMS], sums[DIMS:]), r["logdet"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["_group"], row["_start"]) != (held[-1]["_group"], held[-1]["_start"]):
                    out.append(one(held))
                    held = []
                held.append(row)
        if held:
            out.append(one(held))
        yield _models(out)

    return run


def _distance():
    """Squared Mahalanobis distance of x from the group's center."""
    off = [F.col("x")[i] - F.col("center")[i] for i in range(DIMS)]
    terms = [off[i] * off[j] * F.col("inverse")[i * DIMS + j] * (1 if i == j else 2) for i, j in _PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _near(table: DataFrame, what: str) -> DataFrame:
    """A table of a row or a few for each group, written in few files; broadcast where groups are few enough."""
    table = written(table.coalesce(FILES), what, plain=True)
    return F.broadcast(table) if table.count() <= 3 * MOST_GROUPS else table


def _binned(rows: DataFrame, model: DataFrame, whole: bool, groups: int) -> DataFrame:
    """_halves of rows by model of so many groups and starts: at most some hundred bins each, so a task takes many of them."""
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(DIMS)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}{j}") for i, j in _PAIRS]
    bins = rows.join(model.select("_group", "_start", "center", "inverse"), "_group").withColumn("_bin", F.floor(16 * F.log2(_distance() + 1e-9)))
    bins = bins.groupBy("_group", "_start", "_bin").agg(F.count(F.lit(1)).cast("double").alias("n"), *(sums if whole else [])).join(model, ["_group", "_start"])
    return bins.repartition("_group", "_start").coalesce(max(8, groups // GROUPS_A_TASK)).sortWithinPartitions("_group", "_start", "_bin").mapInArrow(_halves(whole), MODEL)


def fitted(rows: DataFrame) -> DataFrame:
    """The model of each group of rows (_group, x): center, inverse covariance, degrees of freedom and the unit of distance."""
    spark, rows = rows.sparkSession, written(rows, "vectors", plain=True)
    x = lambda i: F.col("x")[i]
    median = [F.percentile(F.round(x(i), 3), 0.5) for i in range(DIMS)]  # at most some 10,000 distinct values
    mid = _near(rows.groupBy("_group").agg(F.array(*median).alias("m")), "medians")
    away = [F.percentile(F.round(F.abs(x(i) - F.col("m")[i]), 3), 0.5) for i in range(DIMS)]
    spread = _near(rows.join(mid, "_group").groupBy("_group").agg(F.array(*away).alias("mad")).join(mid, "_group"), "deviations")
    # statistics in units of their deviation, for their signs; no deviation is taken for less than a thousandth
    unit = F.transform(F.zip_with("x", F.arrays_zip("m", "mad"), lambda a, b: (a - b["m"]) / F.greatest(b["mad"] * 1.4826, F.lit(1e-3))), lambda y: y)
    length = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, y: t + y * y)), F.lit(1e-9))
    signs = rows.join(spread, "_group").withColumn("v", unit).withColumn("v", F.transform("v", lambda y: y / length))
    sums = [F.sum(x(i)).alias(f"s{i}") for i in range(DIMS)] + [F.sum(x(i) * x(j)).alias(f"q{i}{j}") for i, j in _PAIRS]
    signs = signs.groupBy("_group").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums, *[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"u{i}{j}") for i, j in _PAIRS]).join(spread, "_group")
    path = new_path(spark, "mcd")
    signs.coalesce(FILES).mapInArrow(_starts, MODEL).write.option("compression", "none").parquet(f"{path}/step=0")
    model, step = spark.read.schema(MODEL).parquet(f"{path}/step=0"), 0
    while (groups := model.count()) > 0:  # a start's determinant falls by EPSILON at least each time, and it has a bound
        step += 1
        _binned(rows, F.broadcast(model) if groups <= 3 * MOST_GROUPS else model, True, groups).write.option("compression", "none").parquet(f"{path}/step={step}")
        model = spark.read.schema(MODEL).parquet(f"{path}/step={step}").where(F.col("logdet") < F.col("was") - EPSILON)
    steps = spark.read.schema(MODEL).parquet(*[f"{path}/step={k}" for k in range(1, step + 1)]) if step else model
    least = steps.groupBy("_group").agg(F.min_by(F.struct(*[c for c in steps.columns if c != "_group"]), F.struct("logdet", "_start")).alias("b")).select("_group", "b.*")
    least = _near(least, "least")
    groups = least.count()
    model = _near(_binned(rows, least, False, groups), "half")
    near = F.array(*[F.lit(chi_square_quantile(0.025, k)) for k in range(1, DIMS + 1)])
    close = rows.join(model, "_group").where(_distance() <= F.col("unit") * F.element_at(near, F.col("dof")))
    again = close.groupBy("_group").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums).join(model.select("_group", "m", "dof"), "_group")

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moments = [(r, np.array([r[c] for c in _SUMS])) for r in batch.to_pylist()]
            yield _models([_model(r["_group"], 0, np.array(r["m"]), *_moments(r["n"], s[:DIMS], s[DIMS:]), 0.0, dof=r["dof"]) for r, s in moments])

    last = _binned(rows, _near(again.mapInArrow(estimated, MODEL), "reweighted"), False, groups)
    return _near(last.select("_group", "center", "inverse", "logdet", "dof", F.greatest("unit", F.lit(1.0)).alias("unit")), "models")


def judged(stats: DataFrame, tail: float = TAIL, min_group: int = MIN_GROUP) -> DataFrame:
    """stats (of measured, written) with distance, in units of the cutoff, and kept."""
    keys = {"s": F.to_json(F.struct("lang", "source")), "l": F.to_json(F.struct("lang")), "a": F.lit("")}
    good = stats.where(~F.col("base_failed"))
    counts = good.groupBy("lang", "source").count()
    sizes = counts.select("lang", "source", F.col("count").alias("_s"), F.sum("count").over(Window.partitionBy("lang")).alias("_l"))
    level = F.when(F.col("_s") >= min_group, F.lit("s")).when(F.col("_l") >= min_group, F.lit("l")).otherwise(F.lit("a"))
    named = sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), level.alias("_level"))
    rows = good.select("lang", "source", F.array(*_vector()).alias("x"))
    used = {r[0] for r in named.select("_level").distinct().collect()}  # at most three
    # a document counts for its own group and, where smaller groups need it, for its language and for all
    wanted = F.array(*[F.concat(F.lit(f"{k}:"), keys[k]) for k in sorted(used | {"s"})])
    spread = rows.select(F.explode(wanted).alias("_group"), "x")
    enough = _near(spread.groupBy("_group").count().where(F.col("count") >= min_group).select("_group"), "enough")
    model = fitted(spread.join(enough, "_group", "left_semi"))
    own = F.when(F.col("_level") == "s", F.concat(F.lit("s:"), F.to_json(F.struct(F.col("_lang").alias("lang"), F.col("_source").alias("source")))))
    own = own.when(F.col("_level") == "l", F.concat(F.lit("l:"), F.to_json(F.struct(F.col("_lang").alias("lang"))))).otherwise(F.lit("a:"))
    models = _near(named.select("_lang", "_source", own.alias("_group")).join(model, "_group", "left").drop("_group"), "named-models")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    beyond = F.array(*[F.lit(chi_square_quantile(tail, k)) for k in range(1, DIMS + 1)])
    scored = stats.withColumn("x", F.when(~F.col("base_failed"), F.array(*_vector()))).join(models, same, "left").withColumn("distance", _distance() / F.col("unit") / F.element_at(beyond, F.col("dof")))
    scored = scored.withColumn("distance", F.when(F.col("center").isNotNull() & ~F.col("base_failed"), F.col("distance")))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= 1)).select(*stats.columns, "distance", "kept")


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict for all documents."""
    stats = written(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "stats")
    return judged(stats).select("doc_id", *STATS, "base_failed", "kept", "distance")
