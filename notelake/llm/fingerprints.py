"""Consistent weighted sampling: signatures of weighted terms that collide as often as texts are alike.

Each sample draws, for every term, a step r and a level c from gamma distributions of shape two and an offset beta, all
by hash from term and sample number alone. A weight w falls on the grid point t = floor(ln w / r + beta), and the term
with the least ln c - r (t - beta) - r is the sample, together with its t. Two texts have the same sample with the
probability of their generalised Jaccard similarity: the sum of the lesser weights over the sum of the greater ones.

Terms are the words of a whole text, a run without blanks, tabs and line ends; a word's weight is how often it occurs.
All is DataFrame functions. A document's words are counted and sampled in the task that holds it: the only exchange of
texts is by ranges of ids, which the neighbour in order of ids needs as well. Least samples are packed in a long each
(32 bits of the grid point's hash below the score), so both sums and minima are hash aggregates of fixed width.

Nulls: a null text is empty; texts without words have one signature of their own. A null id comes after all others and
stays null. Rows with one id are ordered by text. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = 32
LEAST = -(1 << 63)
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
_BITS = 0xFFFFFFFF


def _sample(term: Column, log_weight: Column, k: int) -> Column:
    """Score and grid point of one sample for a term (its 64-bit hash), packed; null where there is no weight."""
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    u1 = (F.shiftrightunsigned(h, 43) + F.lit(0.5)) * F.lit(2.0**-21)
    u2 = (F.shiftrightunsigned(h, 22).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)
    beta = h.bitwiseAND(F.lit((1 << 22) - 1)) * F.lit(2.0**-22)
    u3 = (F.shiftrightunsigned(g, 32) + F.lit(0.5)) * F.lit(2.0**-32)
    u4 = (g.bitwiseAND(F.lit(_BITS)) + F.lit(0.5)) * F.lit(2.0**-32)
    r, level = -F.log(u1 * u2), F.log(-F.log(u3 * u4))
    t = F.floor(log_weight / r + beta)
    score = level - r * (t - beta) - r
    return F.shiftleft(((score + F.lit(128.0)) * F.lit(float(1 << 22))).cast("long"), 32).bitwiseOR(F.hash(term, t).cast("long").bitwiseAND(F.lit(_BITS)))


def weighted_samples(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES, also: dict[str, Column] | None = None) -> DataFrame:
    """One signature (array of samples' grid points) for each of the weight columns of terms (keys, term, weights).

    A weight of 0 is an absent term. terms has each term of a key once. also: longs to keep the least of, by name."""
    also = also or {}
    logs = terms.select(*keys, F.xxhash64("term").alias("_term"), *[F.log(F.col(w)).alias(w) for w in weights], *[c.alias(n) for n, c in also.items()])
    least = logs.groupBy(*keys).agg(*[F.min(n).alias(n) for n in also], *[F.min(_sample(F.col("_term"), F.col(w), k)).alias(f"_{w}_{k}") for w in weights for k in range(samples)])
    point = lambda c: F.coalesce(c.bitwiseAND(F.lit(_BITS)), F.lit(-1).cast("long"))
    return least.select(*keys, *also, *[F.array(*[point(F.col(f"_{w}_{k}")) for k in range(samples)]).alias(w) for w in weights])


def likeness(a: Column, b: Column) -> Column:
    """The share of samples on which two signatures agree."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / F.size(a)


def spelled(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(_BITS))), 8, "0")), "")


def by_ranges(rows: DataFrame, key: str, ranges: int) -> DataFrame:
    """rows (key: long) with bucket, a range of keys, and each range's last neighbour: the rows with the next lower
    key after a range stand in it as well, with ghost true; after the lowest comes the highest. Only as many keys as
    there are ranges reach the driver."""
    cuts = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    stride = max(1, int(len(cuts) ** 0.5))
    inner, outer = F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.array(*map(F.lit, cuts[::stride])).cast("array<bigint>")
    passed = F.size(F.filter(outer, lambda x: x <= F.col(key)))
    base = (passed - 1) * stride
    bucket = F.when(passed == 0, F.lit(0)).otherwise(base + F.size(F.filter(F.slice(inner, F.greatest(base, F.lit(0)) + 1, F.lit(stride)), lambda x: x <= F.col(key))))
    rows = rows.withColumn("bucket", bucket if cuts else F.lit(0))
    heads = sorted(((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max(key)).collect()), reverse=True)
    ghosts = [(heads[(i + 1) % len(heads)][1], b) for i, (b, _) in enumerate(heads)]
    extra = rows.sparkSession.createDataFrame(ghosts, "_key long, _into int")
    both = rows.join(F.broadcast(extra), F.col(key) == F.col("_key"), "left")
    places = F.filter(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("_into").alias("bucket"), F.lit(True).alias("ghost"))), lambda x: x["bucket"].isNotNull())
    return both.withColumn("_place", F.explode(places)).select(*[c for c in rows.columns if c != "bucket"], "_place.bucket", "_place.ghost")


def op1_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("did").desc(), "text")
    # small tasks: the counts of a task's words stay in memory
    placed = by_ranges(docs, "did", 8 * parts).repartition(4 * parts, "bucket").withColumn("next", F.lead("text").over(order)).withColumn("at", F.row_number().over(order))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    placed = placed.select("bucket", "ghost", "at", "did", "text", n.alias("n_chars"), (n - cut).alias("stays"), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut).alias("tail"))
    placed = placed.withColumn("head", F.substring("text", F.lit(1), F.col("stays"))).withColumn("edited", F.concat("head", "tail"))
    # what is known of a text travels with its words, as one more that weighs nothing and holds a blank
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    facts = F.concat_ws(" ", F.lit(""), sha, F.col("n_chars").cast("string"), F.col("did").cast("string"), F.col("ghost").cast("int").cast("string"))
    # words that both texts begin with are counted once for both
    words = placed.select("bucket", "at", facts.alias("facts"), F.split("text", BLANKS).alias("own"), F.split("edited", BLANKS).alias("new"), (F.size(F.split("head", BLANKS)) - 1).alias("same"))
    most = F.lit((1 << 31) - 1)
    lists = ((1, 1, F.slice("own", 1, F.col("same"))), (1, 0, F.slice("own", F.col("same") + 1, most)), (0, 1, F.slice("new", F.col("same") + 1, most)), (0, 0, F.array("facts")))
    shares = F.array(*[F.struct(F.lit(a).alias("own"), F.lit(b).alias("new"), w.alias("words")) for a, b, w in lists])
    words = words.select("bucket", "at", F.explode(shares).alias("share")).select("bucket", "at", "share.own", "share.new", F.explode("share.words").alias("term")).where("term <> ''")
    counted = words.groupBy("bucket", "at", "term").agg(F.sum("own").alias("own"), F.sum("new").alias("new"))
    told = F.when(F.col("term").startswith(" "), F.col("term"))
    part = lambda i: F.split_part(told, F.lit(" "), F.lit(i))
    # a digest in five numbers of at most 60 bits
    digits = {f"_sha{i}": F.conv(F.substring(part(2), 15 * i + 1, 15), 16, 10).cast("long") for i in range(5)}
    also = digits | {"n_chars": part(3).cast("long"), "did": part(4).cast("long"), "ghost": part(5).cast("long")}
    both = weighted_samples(counted, ["bucket", "at"], ["own", "new"], also=also)
    both = both.withColumn("after", F.lead("own").over(Window.partitionBy("bucket").orderBy("at"))).where("ghost = 0")
    edited = F.lower(F.concat(*[F.lpad(F.hex(f"_sha{i}"), 15 if i < 4 else 4, "0") for i in range(5)]))
    return both.select(
        F.when(F.col("did") != LEAST, F.col("did")).alias("doc_id"), "n_chars", edited.alias("edited_sha256"), spelled(F.col("own")).alias("fingerprint"), spelled(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
