"""Host-level quality rules: failure rates by domain, shrunk by an empirical beta prior."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import SPACES, attach, bind, words_of
from kinspark.session import through_table

WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
HOST_LIMIT = 0.5
LEAST_PRIOR, MOST_PRIOR = 1.0, 1000.0
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")


def _repeat_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in the text, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def repeated(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["k"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, k: F.struct((k + WINDOW).alias("end"), (a["n"] + (k + WINDOW - F.greatest(a["end"], k))).alias("n"))
        slow = F.aggregate(bind(placed, repeated), start, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(slow)

    def windows(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda k: F.xxhash64(F.slice(ws, k, WINDOW)))
        return F.when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(bind(hashes, covered))

    return bind(words, windows)


def text_measures(text: Column) -> dict[str, Column]:
    """Counts of a whole text (null counts as empty), all by built-in functions."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counted = bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    # One pass over the words gives both numbers.
    of_words = bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    return {
        "_words": of_words,
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": counted,
        "n_lines": F.size(lines).cast("long"),
    }


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Key, source, the measures and ``base_failed`` of every document, written to the shared folder."""
    columns = text_measures(F.col("_text"))
    rows = docs.select(F.col(key), F.col(source).alias("_source"), F.col(text).alias("_text"))
    rows = rows.select(key, "_source", *(c.alias(n) for n, c in columns.items()))
    rows = rows.withColumn("n_words", F.col("_words")["n"]).withColumn("n_repeat_words", F.col("_words")["r"]).drop("_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return through_table(rows.withColumn("base_failed", failed), "quality")


def host(source: Column) -> Column:
    """The host of a URL, or the source's own name."""
    return F.regexp_extract(F.lower(source), "^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www[.])?([^/:?#]+)", 1)


def rule_failures() -> dict[str, Column]:
    """Which documents fail which rule."""
    n = F.col("n_words")
    return {
        "few_words": n < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 15 * n),
    }


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: documents, the shrunk failure rate of every rule, and ``host_ok``.

    A rule's prior is the beta distribution with the mean and variance of the failure rates
    over hosts (method of moments, strength between ``LEAST_PRIOR`` and ``MOST_PRIOR``
    documents), so a host with few documents stays near the common rate. A host is bad if a
    shrunk rate exceeds ``limit``. Failures are added up before the shuffle, so a host of any
    size is a handful of rows.
    """
    fails = rule_failures()
    sums = [F.sum(c.cast("long")).alias(f"f_{r}") for r, c in fails.items()]
    hosts = through_table(measured.groupBy(host(F.col("_source")).alias("host")).agg(F.count("*").alias("n_docs"), *sums), "hosts")
    moments = []
    for r in RULES:
        rate = F.col(f"f_{r}") / F.col("n_docs")
        moments += [(F.sum(f"f_{r}") / F.sum("n_docs")).alias(f"m_{r}"), F.var_pop(rate).alias(f"v_{r}")]
    prior = hosts.agg(*moments).first().asDict()
    rates = []
    for r in RULES:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        strength = m * (1 - m) / v - 1 if v > 0 else MOST_PRIOR
        strength = min(max(strength, LEAST_PRIOR), MOST_PRIOR)
        rates.append(((F.col(f"f_{r}") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))).alias(f"rate_{r}"))
    shrunk = hosts.select("host", "n_docs", *rates)
    return shrunk.withColumn("host_ok", reduce(lambda a, b: a & b, [F.col(f"rate_{r}") <= limit for r in RULES]))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures of every whole text, ``base_failed`` and ``kept``: not failed itself and from a host that is not bad.

    Returns the key, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept`` and ``host``. Null texts count as empty and
    fail; null sources are one host; repeated rows are judged one by one; an empty table gives
    an empty one; other columns are not read.
    """
    measured = measure(docs, key, text, source).withColumn("host", host(F.col("_source")))
    verdicts = host_verdicts(measured, limit).select("host", "host_ok")
    rows = attach(measured, verdicts, "host", width=128)
    kept = ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))
    return rows.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host")
