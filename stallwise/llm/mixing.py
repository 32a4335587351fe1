"""Mixing sources to target weights along a time-varying curriculum.

Sources share all words of the corpus by weight, none above three times its own
size. A source's weight may change over training time t in [0, 1]:
w(t) = w * (1 + slope * (2t - 1)). Its cumulative demand is the integral,
D(t) = target * (t + slope * (t^2 - t)); a copy of a document that starts after C
taken words of its source is trained at the t with D(t) = C, found by solving
the quadratic. Sorting all copies by t is the training order.

Within a source documents lie in the order of a keyed hash, and the source is
run through again until its target is met; the last copy may be cut. The running
totals are two-level: (source, first digits of the hash) sums combine map-side,
their prefix sums run over such buckets only, and a window within one bucket adds
the rest, so a source with a third of all rows is spread over thousands of groups.

Edge cases: a null or empty text has size 0 and is never taken. The null source is
a source, last in order. Ties in the hash fall back to the id and the size;
repeated rows lie next to each other and share one group. With no words at all
every target is 0. Texts of any length count all their words. Sources are shared out in
one task, a row each: that takes thousands of them, not millions. An empty table gives no
rows. Extra columns are ignored by ``mix`` and returned unchanged by ``training_order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwise.llm.common import words
from stallwise.sources.staging import stage

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)  # heavy sources early, light ones late
MAX_REPEATS = 3
BUCKET_DIGITS = 3  # 16 ** 3 buckets a source
SEED = 20_240_607


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """``source, source_size, target, slope`` from ``source, source_size``, one row per source.

    Sharing the excess of full sources again and again ends where the full ones
    are those with the least cap per weight; sorting by that finds them at once.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - F.lit(1)).cast("int")

    def pick(values: Sequence, kind: str) -> Column:
        return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("turn") % F.lit(len(values)))

    cap = F.col("source_size") * F.lit(MAX_REPEATS)
    rows = sizes.withColumn("turn", turn).withColumns({"weight": pick(weights, "long"), "slope": pick(slopes, "double")})
    rows = rows.withColumn("cap", cap)
    fullest = W.orderBy(F.col("cap").cast("double") / F.col("weight"), "turn")
    before, whole = fullest.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    rows = rows.withColumns(
        {
            "all_words": F.sum("source_size").over(whole),
            "all_weights": F.sum("weight").over(whole),
            "full_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    share = (F.col("all_words") - F.col("full_before")) * F.col("weight")
    full = share > F.col("cap") * (F.col("all_weights") - F.col("weight_before"))
    rows = rows.withColumn("full", full)
    left = F.col("all_words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(whole)
    open_weights = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        left.cast("double") * F.col("weight") / open_weights
    )
    return rows.select("source", "source_size", target.alias("target"), "slope")


def when_demanded(start: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source's cumulative demand reaches ``start`` words."""
    part = start / target
    straight = F.lit(1.0) - slope
    bent = (F.sqrt(straight * straight + F.lit(4.0) * slope * part) - straight) / (F.lit(2.0) * slope)
    return F.when(slope == 0, part).otherwise(bent)


def _laid_out(documents: DataFrame, seed: int, digits: int, weights: Sequence[int], slopes: Sequence[float]):
    """Staged ``doc_id, source, size, digest, bucket`` and the plan by document."""
    measured = documents.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), _digest(seed).alias("digest")
    ).withColumn("bucket", F.substring("digest", 1, digits))
    rows = stage(measured, "mixing")
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base")
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(sizes, weights, slopes).withColumnRenamed("source", "t")
    inside = W.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["s"]) & (rows["bucket"] == parts["b"]))
    return rows.join(shares, rows["source"].eqNullSafe(shares["t"])).drop("s", "b", "t")


def mix(
    documents: DataFrame,
    seed: int = SEED,
    bucket_digits: int = BUCKET_DIGITS,
    weights: Sequence[int] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, digest, copies, taken, position``.

    ``copies`` has a struct ``(epoch, n_words, position)`` for each time the document is taken,
    ``taken`` is the words of all copies, ``position`` the training time of the first (null if none).
    """
    rows = _laid_out(documents, seed, bucket_digits, weights, slopes)
    wanted = F.floor("target")

    def copy(epoch: Column) -> Column:
        start = epoch * F.col("source_size") + F.col("base") + F.col("inside")
        n_words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - start))
        position = when_demanded(start.cast("double"), F.col("target"), F.col("slope"))
        return F.struct(epoch.cast("int").alias("epoch"), n_words.alias("n_words"), position.alias("position"))

    epochs = F.array(*(F.lit(e).cast("long") for e in range(MAX_REPEATS)))
    used = F.filter(F.transform(epochs, copy), lambda c: c["n_words"] > 0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, used).otherwise(F.filter(used, lambda _: F.lit(False))))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["n_words"])
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "digest", "copies",
        taken.alias("taken"), F.get(F.col("copies"), 0)["position"].alias("position"),
    )


def training_order(documents: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The documents' own columns, one row per copy taken, range-sorted by training time.

    A copy that the target cuts keeps its first ``n_words`` words, joined by single
    spaces. Rows equal in id, source and text stand for each other.
    """
    key = ("id", "missing", "digest")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("row"), *_keys(_digest(seed))).dropDuplicates(key)
    plan = mix(documents, seed, **options).select("source", "copies", *_keys(F.col("digest")))
    copies = plan.select(*key, "source", F.explode("copies").alias("copy"))
    taken = rows.join(copies, list(key))
    short = F.col("copy.n_words") < F.size(words(F.col("row.text")))
    cut = F.array_join(F.slice(words(F.col("row.text")), F.lit(1), F.col("copy.n_words").cast("int")), " ")
    taken = taken.withColumn("row", F.when(short, F.col("row").withField("text", cut)).otherwise(F.col("row")))
    return taken.orderBy("copy.position", "source", "digest", "copy.epoch").select("row.*")


def _digest(seed: int) -> Column:
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text"))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _keys(digest: Column) -> list[Column]:
    """Key of a document whose parts are never null."""
    doc_id = F.col("doc_id")
    return [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("missing"), digest.alias("digest")]
