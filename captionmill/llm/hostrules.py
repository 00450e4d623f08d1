"""Host-level quality rules with an empirical beta prior, all in DataFrame operations.

Every document gets the counts of the base rules. Failures are summed by host,
a beta prior is fitted to the hosts' failure rates by the method of moments,
each host's rate is shrunk towards it, and the host's verdict is joined back
to its documents. Hosts with few documents thus keep close to the common rate.

The counts are stored once (a few numbers for each document) and serve the
sums and the join. The join carries a salt, so that a host with a third of all
documents is spread over ``SALTS`` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionmill.llm.common import SPACE, internal, stored

SYMBOLS, WINDOW, SALTS = "#*$%&|<>", 5, 64

#: The hash of each window of five consecutive words.
_WINDOWS = f"""CASE WHEN size(words) >= {WINDOW}
    THEN transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64({", ".join(f"element_at(words, i + {k})" for k in range(WINDOW))}))
    ELSE cast(array() AS array<bigint>) END"""

#: Words inside windows that occur twice: equal neighbours among the sorted
#: (hash, place) pairs give the places, and each place covers up to five words
#: or those before the next place.
_REPEATED = f"""CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
    transform(array(array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i)))), s ->
        transform(array(sort_array(array_distinct(flatten(filter(
            zip_with(s, slice(s, 2, size(s)), (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) END), x -> x IS NOT NULL))))), p ->
            aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (n, x) -> n + x)
        )[0])[0] END"""


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base counts of every row of ``docs``. A null
    text has no words, lines or symbols."""
    text = F.coalesce("text", F.lit(""))
    rows = internal(docs, "doc_id", "source", "text").select("doc_id", "source", text.alias("text"))
    # A backslash class as in the contract; the split may leave empty ends.
    split = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    lined = split.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != ""))
    hashed = lined.withColumn("windows", F.expr(_WINDOWS))
    bare = lambda chars: F.length(F.translate("text", chars, ""))
    return hashed.select(
        "doc_id", "source",
        F.size("words").cast("long").alias("n_words"), bare(SPACE).cast("long").alias("word_chars"),
        (F.length("text") - bare(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
    )


def base_failed(least_words: int = 10, most_repeated_percent: int = 20):
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))


def host_verdicts(stats: DataFrame, max_rate: float = 0.5, least_strength: float = 2.0, most_strength: float = 1000.0) -> DataFrame:
    """source, host_n, host_failed, host_rate (shrunken) and host_ok of every
    host in ``stats`` (source, base_failed). The prior's mean is the pooled
    rate; its strength comes from the spread of the hosts' rates beyond
    sampling noise, held between the two bounds (one host: the lower)."""
    hosts = stats.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("host_n"), F.count_if("base_failed").alias("host_failed"))
    pooled = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_n")).alias("q")).first()
    n, f, k = pooled["n"] or 0, pooled["f"] or 0, pooled["k"] or 0
    mean = (f + 0.5) / (n + 1)
    strength = least_strength
    if k > 1:
        spread = (pooled["q"] - f * f / n) / n  # host-weighted variance of the rates
        between = spread - (k - 1) / n * mean * (1 - mean)
        strength = most_strength if between <= 0 else min(max(mean * (1 - mean) / between - 1, least_strength), most_strength)
    rate = (F.col("host_failed") + mean * strength) / (F.col("host_n") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_ok", F.col("host_rate") <= max_rate)


def apply_rules(docs: DataFrame, least_words: int = 10, most_repeated_percent: int = 20, max_rate: float = 0.5) -> DataFrame:
    """Base counts, base_failed, host_rate and kept of every row of ``docs``.

    A document is kept if it passes the base rules and its host's shrunken
    failure rate is at most ``max_rate``. Documents with a null source belong
    to no host and are judged by the base rules alone. Repeated rows count
    and are judged each. An empty table gives an empty result.
    """
    stats = stored(base_counts(docs).withColumn("base_failed", base_failed(least_words, most_repeated_percent)), "base-counts")
    hosts = host_verdicts(stats, max_rate).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(hosts, ["source", "salt"], "left")
    kept = ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))
    return joined.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))
