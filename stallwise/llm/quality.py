"""Host-level quality rules.

Each document gets plain statistics from its whole text and fails rules by them.
Rule failures are counted by host; each rule's failure rates are shrunk towards a
beta prior fitted to all hosts (method of moments), and a host is rejected when
the lower bound of any shrunk rate exceeds a limit. The verdict is joined back:
a document is kept if it passes the base rules itself and its host isn't rejected.

Statistics stay in the row (higher-order functions, no shuffle of words). They
are staged once without the text, so host counts and verdicts read a few numbers
per document; the counts combine map-side, and the join's other side has one row
per host, which Spark broadcasts if small and else splits where a host is hot.

Edge cases: a null or empty text has no words and fails the base rules. Documents
with a null host form one group of their own, judged like a host. The documents have
no url, so by default their ``source`` stands in for the host: one bad source takes
all its clean documents along. Repeated rows
are judged and returned each. Texts of any length are counted whole. Documents and hosts
are judged each by itself, so there are no ties; a bound that equals the limit passes.
An empty table gives no rows. Extra columns are ignored by the statistics and returned
unchanged by ``keep``, which stages the rows next to their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import let, words
from stallwise.sources.staging import stage

MIN_WORDS = 50
MAX_REPEATED_PCT = 50
SYMBOLS = r"[#*$%&|<>]"
MAX_SYMBOL_PCT = 10
MAX_DUPLICATE_LINE_PCT = 30
MAX_HOST_RATE = 0.5
Z = 1.645  # one-sided 95 %
WINDOW = 3


def _repeated(items: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more in the same text."""
    n = F.size(items)
    grams = F.transform(
        F.sequence(F.lit(0), n - F.lit(WINDOW)),
        lambda i: F.xxhash64(*(F.get(items, i + F.lit(k)) for k in range(WINDOW))),
    )
    return F.when(n < WINDOW, F.lit(0)).otherwise(
        let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)))
    )


def _covered(grams: Column) -> Column:
    """Words covered by the windows whose hash occurs more than once."""
    placed = F.sort_array(
        F.zip_with(
            grams,
            F.sequence(F.lit(1), F.size(grams)),
            lambda gram, at: F.struct(gram.alias("gram"), at.alias("at")),
        )
    )

    def places(ordered: Column) -> Column:
        def repeated(entry: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - F.lit(1)), F.get(ordered, i + F.lit(1))
            same = before["gram"].eqNullSafe(entry["gram"]) | after["gram"].eqNullSafe(entry["gram"])
            return F.when(same, entry["at"])

        return F.sort_array(F.array_compact(F.transform(ordered, repeated)))

    def spans(starts: Column) -> Column:
        following = F.slice(starts, F.lit(2), F.size(starts))
        return F.aggregate(
            F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(WINDOW))),
            F.lit(0),
            lambda total, width: total + width,
        )

    return let(let(placed, places), spans)


def text_statistics(text: Column) -> Column:
    """``struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of a text, all long."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]", "")) > 0)
    counts = let(
        words(body),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words")),
    )
    extra_lines = let(lines, lambda entries: F.size(entries) - F.size(F.array_distinct(entries)))
    return let(
        counts,
        lambda c: F.struct(
            c["n_words"].alias("n_words"),
            F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            extra_lines.cast("long").alias("n_dup_lines"),
            F.size(F.split(body, "\n", -1)).cast("long").alias("n_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PCT) * F.col("n_words")
    )


#: The rules whose failures are counted by host.
RULES = {
    "base": base_failed,
    "symbols": lambda: F.lit(100) * F.col("n_symbols") > F.lit(MAX_SYMBOL_PCT) * F.col("word_chars"),
    "lines": lambda: F.lit(100) * F.col("n_dup_lines") > F.lit(MAX_DUPLICATE_LINE_PCT) * F.col("n_lines"),
}


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE, z: float = Z) -> DataFrame:
    """``host, n, host_rejected`` from rows ``host, n_words, ...`` (the statistics)."""
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *(F.count_if(rule()).alias(name) for name, rule in RULES.items())
    )
    rejected = F.lit(False)
    for name in RULES:
        rate = F.col(name) / F.col("n")
        mean, spread = F.avg(rate), F.coalesce(F.var_samp(rate), F.lit(0.0))
        # A beta with this mean and variance; between no weight and that of 1000 documents.
        weight = F.try_divide(mean * (F.lit(1.0) - mean), spread) - F.lit(1.0)
        weight = F.least(F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1.0)), F.lit(1000.0))
        prior = hosts.agg(F.struct(mean.alias("mean"), weight.alias("weight")).alias("prior")).scalar()
        hosts = hosts.withColumn(f"{name}_prior", prior)
        total = F.col("n") + F.col(f"{name}_prior.weight")
        shrunk = (F.col(name) + F.col(f"{name}_prior.weight") * F.col(f"{name}_prior.mean")) / total
        bound = shrunk - F.lit(z) * F.sqrt(shrunk * (F.lit(1.0) - shrunk) / (total + F.lit(1.0)))
        rejected = rejected | (bound > F.lit(max_rate))
    return hosts.select("host", "n", rejected.alias("host_rejected"))


def _with_verdict(judged: DataFrame, max_rate: float, z: float) -> DataFrame:
    # Staged, so that Spark knows its size: hosts that fit are broadcast and the text stays where it is.
    hosts = stage(host_verdicts(judged, max_rate, z), "hosts").withColumnRenamed("host", "judged_host")
    joined = judged.join(hosts, judged["host"].eqNullSafe(hosts["judged_host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("judged_host", "n")


def judge(documents: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, z: float = Z) -> DataFrame:
    """Every document's statistics, ``base_failed``, its host's verdict and ``kept``."""
    measured = documents.select("doc_id", F.col(host).alias("host"), text_statistics(F.col("text")).alias("s"))
    measured = measured.select("doc_id", "host", "s.*").withColumn("base_failed", base_failed())
    return _with_verdict(stage(measured, "quality"), max_rate, z)


def keep(documents: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, z: float = Z) -> DataFrame:
    """The documents that pass, with their own columns.

    Documents are staged once next to their statistics; hosts are judged by all
    of them, and the text isn't shuffled unless the hosts are too many to broadcast.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    measured = documents.select(row, F.col(f"`{host}`").alias("host"), text_statistics(F.col("text")).alias("s"))
    measured = measured.select("row", "host", "s.*").withColumn("base_failed", base_failed())
    return _with_verdict(stage(measured, "quality"), max_rate, z).where("kept").select("row.*")
