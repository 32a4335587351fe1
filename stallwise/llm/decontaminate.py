"""Benchmark decontamination by exact word windows.

Every window of ten words of a benchmark item is searched in every document.
The windows' sub-grams form a hash set that is broadcast to the scan: a window of
L words that starts anywhere in a text holds a gram of L // 2 + 1 words at a
multiple of L - L // 2, so a document only hashes its grams at those places, a
fifth of all for ten words. A gram found there proposes window starts; the words
at each are compared with the windows as text, so hash collisions can't count.

The set, and then the proposed places, are broadcast only after their rows were
counted against ``BROADCAST_ROWS``; beyond that Spark joins by shuffle. Nothing is
capped.

Edge cases: a null text, of an item or a document, has no words. An item without
words has no window; one of fewer than ten is one window. Repeated items count
once by id. Repeated document rows are scanned and returned each. An empty
benchmark hits nothing; an empty corpus gives no rows. Texts of any length are scanned
whole, in their row. Windows at one place are hits of all their items, and a word counts
once however many windows hold it, so no tie is broken. Extra columns are ignored
by ``find`` and returned unchanged by ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import NOT_ITEM_WORD, ascii_lower, let, same_row, words
from stallwise.sources.staging import stage

WINDOW = 10
BROADCAST_ROWS = 1_000_000  # about 40 MB of grams


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), NOT_ITEM_WORD)


def gram_size(length: int) -> int:
    return length // 2 + 1


def stride(length: int) -> int:
    return length - gram_size(length) + 1


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id, length, window`` (words joined by a space), distinct."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - length + F.lit(1))).alias("start")
    items = items.select("item_id", "w", length.alias("length"), starts)
    window = F.array_join(F.slice("w", F.col("start"), F.col("length")), " ")
    return items.select("item_id", "length", window.alias("window")).distinct()


def _hashed(w: Column, start: Column, size: int) -> Column:
    """Hash of ``size`` words from a zero-based start."""
    return F.xxhash64(*(F.get(w, start + F.lit(k)) for k in range(size)))


def _window_grams(w: Column, length: int) -> Column:
    offsets = F.sequence(F.lit(0), F.lit(stride(length) - 1))
    return F.transform(
        offsets, lambda o: F.struct(_hashed(w, o, gram_size(length)).alias("gram"), o.alias("offset"))
    )


def grams(benchmark_windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``length, gram, offset``: which places of a window a gram proposes."""
    distinct = benchmark_windows.select("length", F.split("window", " ").alias("w"))
    found = F.lit(None).cast("array<struct<gram:bigint,offset:int>>")
    for length in lengths:
        found = F.when(F.col("length") == length, _window_grams(F.col("w"), length)).otherwise(found)
    return distinct.select("length", F.explode(found).alias("g")).select("length", "g.*").distinct()


def _probes(w: Column, lengths: list[int]) -> Column:
    """Grams of a document at the places that every window must cover."""

    def probe(length: int) -> Column:
        size = gram_size(length)
        places = F.sequence(F.lit(0), F.size(w) - F.lit(size), F.lit(stride(length)))
        of = F.transform(
            places,
            lambda i: F.struct(F.lit(length).alias("length"), _hashed(w, i, size).alias("gram"), i.alias("place")),
        )
        return F.when(F.size(w) >= length, of).otherwise(F.array().cast("array<struct<length:int,gram:bigint,place:int>>"))

    return F.concat(*(probe(n) for n in lengths))


def _small(frame: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= limit else frame


def find(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans`` holds the hit words as disjoint ``(start, end)`` word places, end exclusive.
    """
    known = stage(windows(benchmark, size), "windows")
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # at most ``size`` values
    texts = documents.select("doc_id", F.xxhash64("text").alias("digest"), item_words(F.col("text")).alias("w"))
    distinct = _small(known.select("length", "window").distinct(), broadcast_rows)
    hits = None
    if lengths:
        table = _small(stage(grams(known.select("length", "window").distinct(), lengths), "grams"), broadcast_rows)
        probes = let(F.col("w"), lambda w: _probes(w, lengths))
        scanned = texts.select("doc_id", "digest", F.explode(probes).alias("p")).select("doc_id", "digest", "p.*")
        start = F.col("place") - F.col("offset")
        places = scanned.join(table, ["length", "gram"]).select("doc_id", "digest", "length", start.alias("start"))
        places = places.where("start >= 0").groupBy("doc_id", "digest").agg(
            F.collect_set(F.struct("length", "start")).alias("places")
        )
        places = stage(places, "places").withColumnsRenamed({"doc_id": "p_id", "digest": "p_digest"})
        starts = places.agg(F.sum(F.size("places"))).first()[0] or 0
        places = F.broadcast(places) if starts <= broadcast_rows else places
        whole = documents.select("doc_id", F.xxhash64("text").alias("digest"), "text")
        on = whole["doc_id"].eqNullSafe(places["p_id"]) & whole["digest"].eqNullSafe(places["p_digest"])
        measured = whole.join(places, on, "left").select(
            "doc_id", "digest", let(item_words(F.col("text")), lambda w: _measured(w, F.col("places"))).alias("m")
        )
        measured = stage(measured.select("doc_id", "digest", "m.*"), "measured")
        candidates = measured.where("proposed IS NOT NULL").dropDuplicates(["doc_id", "digest"])
        candidates = candidates.select("doc_id", "digest", F.explode("proposed").alias("p"))
        hits = candidates.select("doc_id", "digest", "p.*").join(distinct, ["length", "window"])
        hits = stage(hits, "hits")
        end = F.col("start") + F.col("length")
        spans = hits.groupBy("doc_id", "digest").agg(
            F.sort_array(F.collect_set(F.struct("start", end.alias("end")))).alias("spans")
        )
        spans = spans.withColumn("spans", _merged(F.col("spans")))
        items = hits.select("doc_id", "digest", "length", "window").distinct().join(known, ["length", "window"])
        items = items.select("doc_id", "digest", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
        items = items.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
        found = spans.join(items, same_row(spans, items, "doc_id", "digest")).select(
            spans["doc_id"].alias("f_id"), spans["digest"].alias("f_digest"), "spans", "items"
        )
        on = measured["doc_id"].eqNullSafe(found["f_id"]) & measured["digest"].eqNullSafe(found["f_digest"])
        joined = measured.join(found, on, "left")
    else:
        none = F.lit(None)
        joined = texts.select(
            "doc_id", "digest", F.size("w").cast("long").alias("n_words"),
            none.cast("array<struct<start:int,end:int>>").alias("spans"), none.cast("array<string>").alias("items"),
        )
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return joined.select(
        "doc_id", "digest", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        spans.alias("spans"),
    )


def _measured(w: Column, places: Column) -> Column:
    proposed = F.when(places.isNotNull(), _proposed(w, places))
    return F.struct(F.size(w).cast("long").alias("n_words"), proposed.alias("proposed"))


def _proposed(w: Column, places: Column) -> Column:
    """The words at each proposed window, where it fits into the document."""
    inside = F.filter(places, lambda p: p["start"] + p["length"] <= F.size(w))
    return F.transform(
        inside,
        lambda p: F.struct(
            p["length"].alias("length"),
            p["start"].alias("start"),
            F.array_join(F.slice(w, p["start"] + F.lit(1), p["length"]), " ").alias("window"),
        ),
    )


def _merged(spans: Column) -> Column:
    """Sorted spans as disjoint ones."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - F.lit(1))
        touches = (F.size(done) > 0) & (span["start"] <= last["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        rest = F.slice(done, F.lit(1), F.greatest(F.size(done) - F.lit(1), F.lit(0)))
        return F.when(touches, F.concat(rest, F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def remove(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without any hit, with their own columns."""
    hit = find(documents, benchmark, size).where("contaminated").select(
        F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")
    )
    hit = _small(stage(hit, "contaminated"), BROADCAST_ROWS)
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    rows = documents.select(row, F.col("doc_id").alias("key"), F.xxhash64("text").alias("digest"))
    on = rows["key"].eqNullSafe(hit["hit_id"]) & rows["digest"].eqNullSafe(hit["hit_digest"])
    return rows.join(hit, on, "left_anti").select("row.*")
