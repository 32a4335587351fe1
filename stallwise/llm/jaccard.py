"""Near duplicates by an exact Jaccard join of word shingles, as a grouped prefix join.

Steps, each over whole texts and all rows:

1. Documents with equal shingle sets (128-bit fingerprint and size) form a class.
   The least id stands for it; no pair of copies is ever made.
2. Prefixes. Two sets of similarity >= t share a token among the first
   n - ceil(t n) + 1 of each, in any fixed order of all tokens. Rare tokens come
   first here: every block of ``BLOCK`` shingles counts its repeated ones, and the
   ``HEAVY`` most frequent of the summed counts sort behind all others, by
   magnitude. The order decides only how much work there is, never which links
   are found.
3. Groups. Classes with an identical prefix and size are collapsed into one
   group, which enters the join once.
4. Group pairs. In the bucket of each shared token every group is paired with the
   one of fewest rare tokens, the hub (of near copies, the least edited), and
   within a group every member with the group's hub, so pairs grow linearly with a
   bucket. Pairs pass the length and position filters and are verified on the
   shingles of the whole texts; links give components.
5. Strays. Buckets whose members lie in one component are done. The others are
   expanded to members, and each one outside the bucket's largest component is
   paired with a random member of that, in each bucket another one, ``ROUNDS`` times.
6. The rest. A bucket that still holds several components is split by what its members
   have beside its smallest one, R. Two sets that are both similar to R are linked by it;
   of two others at least one has fewer tokens in common with R than two sets of their
   sizes need, so they share a token outside R. Every member is paired with R and goes to
   the buckets of its rare-first prefix outside R, as long as the overlap still needed
   allows. Buckets of the same members are split once. Pairs are enumerated in buckets with
   at most ``PAIRED`` pairs a member across components (after ``LEVELS`` splits in what is
   left), less those that the first token in common and the triangle inequality of the Jaccard
   distance, by both distances to the hub, exclude. So a large family of texts from one template, each too far from the next, costs its members
   times their own tokens, not its pairs. New links are joined to the components.

So no link between different texts is lost, while a clique of near copies costs
a few verifications a member. Text is shuffled for candidate documents only.

Edge cases: null or empty texts, and those without words, have an empty set and
their own id as component. Rows that share an id are one document with several
texts. A row without id keeps its ``n_shingles`` and has a null component. An
empty table gives no rows. Extra columns are ignored by ``near_duplicates`` and
returned unchanged by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.common import arrow_rows, returning_memory
from stallwise.llm.components import components
from stallwise.llm.shingles import mix, shingle_sets
from stallwise.sources.staging import recorded, remove, stage

# Similarity as 100 * intersection >= PERCENT * union.
PERCENT = 80
BLOCK = 1_000_000  # shingles counted at a time
HEAVY = 500_000  # tokens known as frequent by every task: 4.5 MB
LEAST_HEAVY = 16
HOT, HOT_ROWS = 1000, 1000  # tokens whose buckets are not brought together, and the least count of one
BROADCAST_IDS = 2_000_000  # 16 MB
ROUNDS = 2
PAIRED = 1000  # pairs across components that a member of a bucket may be compared in, on average
LEVELS = 6  # of splits
TEXT_ROWS = 256  # texts, or pairs of them, sent to Python at a time
BATCH_BYTES = 8_000_000  # of them; a longer row is sent by itself


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (id, set size, fingerprint) and, marked heavy, a row per repeated token of a block."""

    def repeated(block: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(block), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        none = np.zeros(len(tokens), np.int64)
        columns = [pa.nulls(len(tokens), pa.int64()), _long(counts), _long(tokens), _long(none)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(none == 0)], ["doc_id", "n", "s1", "s2", "heavy"])

    block, held = [], 0
    for batch in batches:
        n, s1, s2 = [], [], []
        for tokens in shingle_sets(batch.column("text")):
            n.append(len(tokens))
            s1.append(mix(tokens, 11).sum(dtype=np.uint64))
            s2.append(mix(tokens, 12).sum(dtype=np.uint64))
            block.append(tokens)
            held += len(tokens)
            if held >= BLOCK:
                yield repeated(block)
                block, held = [], 0
        sums = [_long(np.array(x, np.uint64)) for x in (s1, s2)]
        light = pa.array(np.zeros(len(n), bool))
        columns = [batch.column("doc_id"), _long(np.array(n, np.int64)), *sums, light]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "heavy"])
    if block:
        yield repeated(block)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _rare_first(tokens: np.ndarray, known: np.ndarray, magnitude: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted tokens with the frequent ones behind the others, by magnitude; and the number of others."""
    if not len(known):
        return tokens, len(tokens)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    rank = np.where(known[at] == tokens, magnitude[at], 0)
    return tokens[np.lexsort((tokens, rank))], int((rank == 0).sum())


def _prefixes(heavy, percent: int):
    """A row per non-empty text: id, set size, number of rare tokens, prefix (rare first) and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, magnitude = heavy.value
        for batch in batches:
            kept, n, rare, digest, prefix = [], [], [], [], []
            for row, tokens in enumerate(shingle_sets(batch.column("text"))):
                if not len(tokens):
                    continue
                tokens, n_rare = _rare_first(tokens, known, magnitude)
                first = tokens[: prefix_length(len(tokens), percent)]
                kept.append(row)
                n.append(len(tokens))
                rare.append(n_rare)
                digest.append(mix(first, 13).sum(dtype=np.uint64))
                prefix.append(first)
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            tokens = _long(np.concatenate(prefix) if prefix else np.empty(0, np.uint64))
            columns = [
                batch.column("doc_id").take(pa.array(kept, pa.int64())),
                _long(np.array(n, np.int64)),
                _long(np.array(rare, np.int64)),
                _long(np.array(digest, np.uint64)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "rare", "digest", "prefix"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact intersection and union sizes of the shingle sets of text pairs."""
    for batch in batches:
        sizes = []
        pairs = zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")))
        for x, y in pairs:
            common = len(np.intersect1d(x, y, assume_unique=True))
            sizes.append((common, len(x) + len(y) - common))
        both = np.array(sizes, np.int64).reshape(-1, 2)
        columns = [batch.column("a"), batch.column("b"), _long(both[:, 0].copy()), _long(both[:, 1].copy())]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "total"])


def _heavy(spark: SparkSession, rows: DataFrame):
    """The most frequent tokens, sorted, with the magnitude of their counts, on every executor; and the very first of them."""
    counts = rows.where("heavy").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_HEAVY)
    # The least count that is among the most frequent follows from how many tokens have each magnitude of count.
    counts = stage(counts.withColumn("magnitude", F.length(F.bin("n"))), "counts")
    known, least = 0, 0
    for row in sorted(counts.groupBy("magnitude").agg(F.count(F.lit(1)).alias("tokens")).collect(), reverse=True):
        if known + row.tokens > HEAVY:
            break
        known, least = known + row.tokens, row.magnitude
    top = counts.where(F.col("magnitude") >= least).select("s1", "n").collect() if known else []
    tokens = np.array([r.s1 for r in top], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    magnitude = np.array([r.n.bit_length() for r in top], np.int8)
    hottest = sorted(top, key=lambda r: (-r.n, r.s1))[:HOT]
    return spark.sparkContext.broadcast((tokens[order], magnitude[order])), [r.s1 for r in hottest if r.n >= HOT_ROWS]


def _with_hubs(tokens: DataFrame, hot: list[int]) -> DataFrame:
    """``token, id, n, rare, at, hub`` of tokens that several rows hold; the hub has the fewest rare tokens.

    Rows of the hottest tokens stay where they are and meet their hub as one row a token. The others are reduced to
    one row a token before they are joined to it, so that no task gathers a bucket.
    """

    def hubs(rows: DataFrame) -> DataFrame:
        least = F.min(F.struct("rare", "id", "n", "at")).alias("hub")
        found = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), least)
        return found.where("size > 1").select("token", "hub")

    is_hot = F.col("token").isin(hot) if hot else F.lit(False)
    columns = ("token", "id", "n", "rare", "at", "hub")
    here = tokens.where(is_hot)
    spread = here.join(F.broadcast(hubs(here)), "token").select(*columns)  # at most HOT rows
    together = tokens.where(~is_hot)
    return together.join(hubs(together), "token").select(*columns).unionByName(spread)


def _possible(percent: int, x: str = "", y: str = "") -> Column:
    """Whether a bucket can be that of the first token two similar sets have in common.

    Then all they have in common begins at its places, and either rest must be
    as long as the overlap asked for. Similar sets meet in that bucket at least.
    """
    n, at, m, place = (F.col(c) for c in (f"{x}n", f"{x}at", f"{y}n", f"{y}at"))
    return _close(percent, n, m) & (F.lit(100 + percent) * F.least(n - at, m - place) >= F.lit(percent) * (n + m))


def _close(percent: int, n: Column, m: Column) -> Column:
    """Whether sets of such sizes can be similar."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, common, total`` of the pairs ``a, b``, staged. Texts of other documents stay where they are."""
    spark = documents.sparkSession
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id")
    left = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
    with arrow_rows(spark, TEXT_ROWS, BATCH_BYTES):
        return stage(both.mapInArrow(returning_memory(_verify), "a bigint, b bigint, common bigint, total bigint"), "verified")


def _links(verified: DataFrame, percent: int) -> DataFrame:
    return verified.where(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("total")).select("a", "b")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id bigint, n bigint, s1 bigint, s2 bigint, heavy boolean"
    with arrow_rows(spark, TEXT_ROWS, BATCH_BYTES):
        rows = stage(texts.mapInArrow(returning_memory(fingerprints), schema), "fingerprints")
    heavy, hot = _heavy(spark, rows)
    known = rows.where("NOT heavy")

    named = known.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"))
    classes = stage(classes, "classes")
    first = classes.select(F.col("first").alias("id")).distinct()
    schema = "id bigint, n bigint, rare bigint, digest bigint, prefix array<bigint>"
    with arrow_rows(spark, TEXT_ROWS, BATCH_BYTES), recorded() as soon_gone:
        prefixes = texts.where("doc_id IS NOT NULL").mapInArrow(returning_memory(_prefixes(heavy, percent)), schema)
        prefixes = stage(prefixes.join(first, "id", "left_semi").dropDuplicates(["id", "n", "digest"]), "prefixes")

    groups = prefixes.groupBy("n", "digest").agg(F.min(F.struct("rare", "id")).alias("lead"), F.count(F.lit(1)).alias("members"))
    groups = groups.select("n", "digest", F.col("lead.id").alias("g"), "members")
    members = prefixes.select("id", "n", "rare", "digest").join(groups.where("members > 1"), ["n", "digest"])
    members = stage(members.select("g", "id", "n", "rare"), "members")
    leaders = prefixes.join(groups.select("n", "digest", F.col("g").alias("id")), ["n", "digest", "id"], "left_semi")
    leaders = stage(leaders.select("id", "n", "rare", "prefix"), "leaders")
    remove(spark, soon_gone)
    tokens = leaders.select("id", "n", "rare", F.posexplode("prefix").alias("at", "token"))
    shared = stage(_with_hubs(tokens, hot), "shared")

    near = shared.where((F.col("id") != F.col("hub.id")) & _possible(percent, y="hub."))
    pairs = near.select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
    pairs = pairs.unionByName(members.where("id <> g").select(F.col("g").alias("a"), F.col("id").alias("b")))
    verified = _verified(texts, stage(_in_order(F.col("a"), F.col("b"), pairs), "pairs"))
    same_id = named.join(classes, ["n", "s1", "s2"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    repeated = same_id.distinct().groupBy("b").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    found = components(_links(verified, percent).unionByName(same_id.distinct().join(repeated, "b", "left_semi")))

    entries = _entries(shared, members)
    for turn in range(ROUNDS):
        entries = _open(entries, found)
        verified, found = _joined(texts, _strays(entries, percent, turn), verified, found, percent)
    entries = _keyed(_open(entries, found), verified)
    for level in range(LEVELS + 1):
        sizes = _sizes(entries, last=level == LEVELS)
        pairs = _pairs(entries.join(sizes.where("few").select("key"), "key", "left_semi"), percent)
        crowded = sizes.where("NOT few").select("key", "least")
        if crowded.isEmpty():
            verified, found = _joined(texts, pairs, verified, found, percent)
            break
        many = stage(_distinct_sets(entries.join(crowded.select("key"), "key", "left_semi")).join(crowded, "key"), "many")
        with_least = many.where((F.col("label") != F.col("least.label")) & _close(percent, F.col("n"), F.col("least.n")))
        pairs = pairs.unionByName(_in_order(F.col("id"), F.col("least.id"), with_least)).distinct()
        verified, found = _joined(texts, pairs, verified, found, percent)
        entries = _distinct_sets(_mixed(_split(texts, many, heavy, percent), found))

    labels = classes.join(found, classes["first"] == found["id"], "left")
    labels = labels.select("n", "s1", "s2", F.coalesce("component", "first").alias("component_id"))
    linked = known.where("n > 0").join(labels, ["n", "s1", "s2"], "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
    alone = known.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _entries(shared: DataFrame, members: DataFrame) -> DataFrame:
    """``bucket, id, n, at, hub`` of every member: of the buckets of its group, and of its group as a bucket of its own."""

    def bucket(kind: int, key: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key")).alias("bucket")

    others = members.where("id <> g").withColumnRenamed("id", "member").select("g", "member")
    grown = shared.join(others, shared["id"] == others["g"]).drop("id", "g").withColumnRenamed("member", "id")
    entries = shared.unionByName(grown.select(shared.columns))
    entries = entries.select(bucket(0, "token"), "id", "n", "at", F.col("hub.id").alias("hub"))
    # Members of one group share tokens that no other group has.
    own = members.select(bucket(1, "g"), "id", "n", F.lit(0).alias("at"), F.col("g").alias("hub"))
    return entries.unionByName(own)


def _open(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The entries of buckets that hold several components, with their ``label``, staged."""
    found = found.select(F.col("id").alias("node"), "component")
    entries = entries.drop("label").join(found, entries["id"] == found["node"], "left")
    entries = entries.withColumn("label", F.coalesce("component", "id")).drop("node", "component")
    entries = stage(entries, "entries")
    mixed = entries.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return stage(entries.join(mixed.where("low < high").select("bucket"), "bucket", "left_semi"), "open")


def _strays(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """Entries outside their bucket's largest component, each with a random member of that."""
    drawn = F.struct(F.xxhash64("id", "bucket", F.lit(turn)).alias("draw"), "id", "n", "at")
    largest = entries.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"), F.min(drawn).alias("one"))
    largest = largest.groupBy("bucket").agg(F.max_by(F.struct("label", "one"), F.struct("size", "label")).alias("main"))
    strays = (F.col("label") != F.col("main.label")) & _possible(percent, y="main.one.")
    pairs = entries.join(largest, "bucket").where(strays)
    return _in_order(F.col("id"), F.col("main.one.id"), pairs)


def _in_order(x: Column, y: Column, pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _joined(
    texts: DataFrame, pairs: DataFrame, verified: DataFrame, found: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """What is verified and the components, after pairs that were not verified yet."""
    pairs = stage(pairs.join(verified.select("a", "b"), ["a", "b"], "left_anti"), "more")
    if pairs.isEmpty():
        return verified, found
    checked = _verified(texts, pairs)
    links = _links(checked, percent)
    if not links.isEmpty():
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = components(stars.unionByName(links))
    return verified.unionByName(checked), found


def _keyed(entries: DataFrame, verified: DataFrame) -> DataFrame:
    """``key, id, n, at, label, near, far`` of entries: the bucket as a number, and the measured distances to its hub."""
    apart = F.lit(1.0) - F.col("common") / F.col("total")
    measured = verified.select("a", "b", apart.alias("apart"))
    measured = measured.select(F.col("a").alias("hub"), F.col("b").alias("id"), "apart").unionByName(
        measured.select(F.col("b").alias("hub"), F.col("a").alias("id"), "apart")
    )
    # Rows that share an id may lie near the hub and far from it.
    measured = measured.groupBy("hub", "id").agg(F.min("apart").alias("near"), F.max("apart").alias("far"))
    key = F.xxhash64("bucket.kind", "bucket.key").alias("key")
    entries = entries.join(measured, ["hub", "id"], "left")
    return stage(entries.select(key, "id", "n", "at", "label", "near", "far"), "keyed")


def _sizes(entries: DataFrame, last: bool) -> DataFrame:
    """``key, few, least`` of buckets, staged: whether they have at most ``PAIRED`` pairs a member across components, and
    their smallest member. All have in the ``last`` turn."""
    labels = entries.groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct("n", "id", "label")).alias("least")
    )
    sizes = labels.groupBy("key").agg(
        F.sum("members").alias("size"), F.sum(F.col("members") * F.col("members")).alias("inside"), F.min("least").alias("least")
    )
    across = (F.col("size") * F.col("size") - F.col("inside")) / F.lit(2)
    return stage(sizes.select("key", (F.lit(last) | (across <= F.lit(PAIRED) * F.col("size"))).alias("few"), "least"), "sizes")


def _mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The entries of buckets that hold several components, with their ``label``, staged."""
    found = found.select(F.col("id").alias("node"), "component")
    entries = entries.drop("label").join(found, entries["id"] == found["node"], "left")
    entries = stage(entries.withColumn("label", F.coalesce("component", "id")).drop("node", "component"), "entries")
    mixed = entries.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return entries.join(mixed.where("low < high").select("key"), "key", "left_semi")


def _distinct_sets(entries: DataFrame) -> DataFrame:
    """The entries, of buckets with the same members those of one, staged."""
    entries = stage(entries, "mixed")
    members = [F.sum(F.xxhash64(F.lit(k), "id", "n").cast("decimal(38,0)")).alias(f"sum{k}") for k in (0, 1)]
    sets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *members)
    one = sets.groupBy("size", "sum0", "sum1").agg(F.min("key").alias("key")).select("key")
    return stage(entries.join(one, "key", "left_semi"), "sets")


def _pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket that lie in different components and may be similar by their sizes and distances."""
    x = entries.select("key", *(F.col(c).alias(f"x_{c}") for c in entries.columns if c != "key"))
    y = entries.select("key", *(F.col(c).alias(f"y_{c}") for c in entries.columns if c != "key"))
    col = F.col
    limit = F.lit(1.0 - percent / 100 + 1e-9)
    apart = F.coalesce(F.greatest(col("x_near") - col("y_far"), col("y_near") - col("x_far")), F.lit(0.0))
    both = x.join(y, "key").where((col("x_id") < col("y_id")) & (col("x_label") != col("y_label")))
    return _in_order(col("x_id"), col("y_id"), both.where(_possible(percent, "x_", "y_") & (apart <= limit)))


def _beside(heavy, percent: int):
    """The buckets of each text's prefix outside the smallest member of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, magnitude = heavy.value
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            ids = batch.column("id").to_numpy()
            found_keys, found_ids, found_n = [], [], []
            sets = zip(shingle_sets(batch.column("text")), shingle_sets(batch.column("least_text")))
            for key, own_id, (x, r) in zip(keys, ids, sets):
                rest = np.setdiff1d(x, r, assume_unique=True)
                # A partner is no smaller than R, nor than the share of x that similar sets have.
                partner = max(len(r), -(-percent * len(x) // 100))
                need = max(1, -(-percent * (len(x) + partner) // (100 + percent)) - (len(x) - len(rest)))
                if need > len(rest):
                    continue
                order, _ = _rare_first(rest, known, magnitude)
                salt = np.append(mix(r, 15), mix(np.array([key, len(r)], np.uint64), 14)).sum(dtype=np.uint64)
                found_keys.append(mix(order[: len(rest) - need + 1] + salt, 16))
                found_ids.append(np.full(len(rest) - need + 1, own_id, np.int64))
                found_n.append(np.full(len(rest) - need + 1, len(x), np.int64))
            none = [np.empty(0, np.int64)]
            columns = [np.concatenate(c or none) for c in (found_keys, found_ids, found_n)]
            yield pa.RecordBatch.from_arrays([_long(c) for c in columns], ["key", "id", "n"])

    return run


def _split(texts: DataFrame, entries: DataFrame, heavy, percent: int) -> DataFrame:
    """Entries of the buckets into which buckets fall apart, without measured distances, staged."""
    spark = texts.sparkSession
    wanted = entries.select("key", "id", F.col("least.id").alias("least")).where("id <> least").distinct()
    ids = stage(wanted.select(F.explode(F.array("id", "least")).alias("id")).distinct(), "candidates")
    known = texts.select(F.col("doc_id").alias("id"), "text")
    known = known.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id")
    least = known.withColumnsRenamed({"id": "least", "text": "least_text"})
    both = wanted.join(known, "id").join(least, "least").select("key", "id", "text", "least_text")
    with arrow_rows(spark, TEXT_ROWS, BATCH_BYTES):
        made = both.mapInArrow(returning_memory(_beside(heavy, percent)), "key bigint, id bigint, n bigint")
        made = stage(made.distinct(), "split")
    nothing = F.lit(None).cast("double")
    # The places of the split tokens say nothing about what was common before them.
    return made.select("key", "id", "n", F.lit(0).alias("at"), nothing.alias("near"), nothing.alias("far"))


def representatives(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the least id, with its own columns.

    Of rows that share an id one stays; rows without an id all stay.
    """
    with recorded() as soon_gone:
        found = near_duplicates(documents, percent)
    gone = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    remove(documents.sparkSession, soon_gone)
    gone = gone.withColumnRenamed("doc_id", "gone_id")
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    rows = documents.select(row, F.col("doc_id").alias("key"))
    small = gone.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(gone) if small else gone, rows["key"] == gone["gone_id"], "left_anti")
    repeated = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1 AND doc_id IS NOT NULL")
    repeated = stage(repeated.select(F.col("doc_id").alias("repeated_id")), "repeated")
    if repeated.isEmpty():
        return rows.select("row.*")
    same = rows["key"] == repeated["repeated_id"]
    one = rows.join(repeated, same, "left_semi").groupBy("key").agg(
        F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")
    )
    return rows.join(repeated, same, "left_anti").select("row.*").unionByName(one.select("row.*"))
