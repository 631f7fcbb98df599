"""Host-level quality rules. DataFrame functions only.

Document rules give a failure for each document. Failures are summed by host (here the
``source``), each host's failure rate is shrunk towards all hosts by a beta prior fitted to
the hosts' own rates, and hosts whose shrunk rate is too high lose all their documents.
The verdicts are joined back by host; a host may hold any share of the rows.

Rules on a document (fixed thresholds, see the constants):
  too few words; too many words inside repeated 5-word windows (these two are the base
  rules); too many symbols a word; too many repeated lines; words too long or too short.

5-word windows are compared by 64-bit hashes within one document only: with n windows a
false repeat has a chance of n * n / 2**65, under 1e-10 for a text of 20,000 words.

Edge cases: null or blank text has no words, so it fails the base rules and is dropped; a
null host is a host of its own; an empty table gives an empty result; repeated rows count
as separate documents; very long texts are counted whole; columns of the input that clash with results are replaced, others carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 50
WORD_LENGTH = (2, 24)
MAX_HOST_RATE = 0.5

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


def word_windows(hashes: Column, window: int = WINDOW) -> Column:
    """A hash of each run of ``window`` words, from the words' hashes."""
    n = F.size(hashes)
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))


def features(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines to ``docs`` (text dropped).

    A hash set tells whether any window repeats at all; only then are windows sorted. Of
    the repeating windows' sorted starts, each covers up to the next one or ``window`` words.
    """
    text = common.text_or_empty(F.col(f"`{text_col}`"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    carried = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in names]
    step = docs.select(*carried, text.alias("__text"), common.words(F.col(f"`{text_col}`")).alias("__words"))
    step = step.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(common.WORD)))
    step = step.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    windows = word_windows(F.col("__hashes"), window)
    step = step.select(
        *carried,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        windows.alias("__windows"),
    )
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, i: F.coalesce(F.get(F.col("__placed"), i)["h"] == x["h"], F.lit(False))
    step = step.withColumn("__placed", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed))
    again = F.filter("__placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    step = step.withColumn("__starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("__starts", lambda s, j: F.least(F.lit(window), F.coalesce(F.get(F.col("__starts"), j + 1), s + window) - s))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    return step.select(*carried, *names)


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` without the text, with the features, base_failed, rule_failed, host_rate, host_failed and kept."""
    made = ("base_failed", "rule_failed", "host_rate", "host_failed", "kept")
    marked = features(docs.select(*[f"`{c}`" for c in docs.columns if c not in made]), text_col)
    marked = marked.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    mean_length = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    rules = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
        | ~mean_length.between(*WORD_LENGTH)
    )
    marked = common.cut(marked.withColumn("rule_failed", F.col("base_failed") | rules))
    hosts = common.cut(host_rates(marked, host_col).withColumn("host_failed", F.col("host_rate") > max_host_rate))
    out = common.attach(marked, hosts.select(F.col("host"), "host_rate", "host_failed").withColumnRenamed("host", host_col), host_col, id_col)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rule_failed") & ~F.col("host_failed"))


def host_rates(marked: DataFrame, host_col: str, failed: str = "rule_failed") -> DataFrame:
    """(host, n_docs, n_failed, host_rate): failure rates shrunk by an empirical beta prior.

    The prior's mean is the failure rate over all documents. Its strength comes from the
    spread of the hosts' rates beyond what sampling gives (method of moments), held between
    1 and 10,000 documents; with one host, or no spread, it is the upper bound.
    """
    hosts = marked.groupBy(F.col(f"`{host_col}`").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col(failed)).alias("n_failed"))
    hosts = common.cut(hosts)
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("s2"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2"),
    ).first()
    n, f, k = total["n"] or 0, total["f"] or 0, total["hosts"]
    mean, strength = (f / n if n else 0.0), 1e4
    if k > 1 and 0 < mean < 1:
        # between-host variance, by one-way analysis of variance on 0/1 failures
        between = (total["s2"] - n * mean * mean) / (k - 1)
        within = (f - total["s2"]) / max(n - k, 1)
        tau = (between - within) / ((n - total["n2"] / n) / (k - 1))
        if tau > 0:
            strength = min(max(mean * (1 - mean) / tau - 1, 1.0), 1e4)
    return hosts.withColumn("host_rate", (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))
