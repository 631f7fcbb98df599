"""Registered queries of the text operators: thin digests of what the operators return, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from . import training_order

    path = f"{common.shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    return training_order.materialise(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(common.table(spark, sf_dir, "documents"))


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: counts of two tokenizers, a revision that counts code points for one of them, and deletes of short texts; one batch twice."""
    from . import token_rollups

    docs, store = common.table(spark, sf_dir, "documents"), token_rollups.new_store(spark)
    words, text = common.n_words(F.col("text")), common.text_or_empty(F.col("text"))
    by_words = token_rollups.counts(docs, words, "words-1")
    first = by_words.unionByName(token_rollups.counts(docs, F.octet_length(text), "bytes-1"))
    store.commit(1, first)
    store.commit(2, token_rollups.counts(docs, F.length(text), "bytes-1"))
    short = docs.where(words < 10)
    store.commit(3, token_rollups.counts(short, F.lit(None), "words-1", "delete").unionByName(token_rollups.counts(short, F.lit(None), "bytes-1", "delete")))
    store.commit(2, first)
    return store.totals()


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_rules import judge

    got = judge(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sampling, toxicity

    docs, rest = common.table(spark, sf_dir, "documents"), sampling.remainder(F.col("doc_id"), 3)
    model, limits = toxicity.train(docs, common.table(spark, sf_dir, "labels"), rest != 1)
    got = toxicity.classify(docs.select("doc_id", "text", "lang"), model, limits)
    return got.select("doc_id", (rest == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "toxic")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    got = dedup_lines(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.decode(byte_bpe.encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_crf, sampling

    docs, rest = common.table(spark, sf_dir, "documents"), sampling.remainder(F.col("doc_id"), 4)
    model = line_crf.train(docs, common.table(spark, sf_dir, "labels"), rest != 2)
    got = line_crf.classify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (rest == 2).alias("held_out"), "score", (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import join

    return join(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op9_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_ngram_jaccard, with the number of rows that each links with; grows with the number of links."""
    from .ngram_jaccard import join

    got = join(common.table(spark, sf_dir, "documents").select("doc_id", "text"), with_links=True)
    return got.select("doc_id", "n_shingles", "class_size", "component_id", "n_links")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup

    return dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_training_order, op2_mix_sources, op3_token_rollups, op4_host_rules, op5_toxicity, op6_line_dedup, op7_byte_bpe, op8_line_crf, op9_ngram_jaccard, op9_ngram_links, op10_exact_dedup)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _training_order_sql() -> str:
    """The permutation in SQL: one recursion step a round, a walk being rounds again."""
    from .training_order import KEY, LENGTH, PER_SHARD, PRIME, round_keys, stride

    keys = ", ".join(map(str, round_keys(KEY)))
    return rf"""
        WITH RECURSIVE k AS (SELECT doc_id, len({_WORDS}) + 1 AS t FROM documents),
        s AS (SELECT doc_id, i AS seq_no, least({LENGTH}, t - i * {LENGTH}) AS n_tokens FROM (SELECT doc_id, t, unnest(range(0, (t + {LENGTH} - 1) // {LENGTH})) AS i FROM k)),
        x AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, seq_no) - 1 AS seq_index FROM s),
        p AS (SELECT n, a, greatest(1, (greatest(n, 1) + a - 1) // a) AS b
            FROM (SELECT n, greatest(1, CAST(floor(sqrt(greatest(n, 1) - 1)) AS BIGINT) + 1) AS a FROM (SELECT count(*) AS n FROM x))),
        w AS (
            SELECT seq_index, seq_index // b AS l, seq_index % b AS r, 0 AS k FROM x, p
            UNION ALL
            SELECT seq_index,
                CASE WHEN k % 2 = 0 THEN (l + f + f // 65536) % a ELSE l END,
                CASE WHEN k % 2 = 1 THEN (r + f + f // 65536) % b ELSE r END, k + 1
            FROM (
                SELECT w.seq_index, l, r, w.k % 4 AS k, a, b, ((CASE WHEN w.k % 2 = 0 THEN r ELSE l END + [{keys}][w.k % 4 + 1] % 65521) * [{keys}][w.k % 4 + 1]) % {PRIME} AS f
                FROM w, p WHERE w.k < 4 OR l * b + r >= n)),
        z AS (SELECT seq_index, l * b + r AS slot FROM w, p WHERE k = 4 AND l * b + r < n)
        SELECT doc_id, seq_no, n_tokens, seq_index, slot, slot // {PER_SHARD} AS shard, slot % {PER_SHARD} * {stride(LENGTH)} AS byte_offset FROM x JOIN z USING (seq_index)"""


ORACLE: dict[str, str] = {
    "op1_training_order": _training_order_sql(),
    "op3_token_rollups": rf"""
        WITH d AS (SELECT source, lang, len({_WORDS}) AS w, length(coalesce(text, '')) AS c FROM documents),
        v AS (SELECT source, lang, 'words-1' AS version, w AS t FROM d WHERE w >= 10 UNION ALL SELECT source, lang, 'bytes-1', c FROM d WHERE w >= 10)
        SELECT source, lang, version, count(*) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens FROM v GROUP BY ALL""",
    "op4_host_rules": rf"""
        WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
            FROM (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w))),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM win, range(0, 5) AS o(k) WHERE n > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS d
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^ 	-
]') GROUP BY doc_id),
        f AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(d, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(r, 0) AS n_repeat_words
            FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
        m AS (SELECT *, base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
                OR word_chars / greatest(n_words, 1) NOT BETWEEN 2 AND 24 AS rule_failed FROM b),
        h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (rule_failed)::DOUBLE AS x FROM m GROUP BY source),
        t AS (SELECT count(*) AS k, sum(n) AS n, sum(x) AS f, sum(x) / sum(n) AS p, sum(x * x / n) AS s2, sum(n * n) AS n2 FROM h),
        v AS (SELECT *, ((s2 - n * p * p) / (k - 1) - (f - s2) / greatest(n - k, 1)) / ((n - n2 / n) / (k - 1)) AS tau FROM t),
        s AS (SELECT p, CASE WHEN k > 1 AND p > 0 AND p < 1 AND tau > 0 THEN least(greatest(p * (1 - p) / tau - 1, 1), 10000) ELSE 10000 END AS strength FROM v),
        r AS (SELECT source, (x + p * strength) / (n + strength) AS host_rate FROM h, s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT rule_failed AND NOT host_rate > 0.5 AS kept, host_rate
        FROM m JOIN r ON m.source IS NOT DISTINCT FROM r.source""",
    "op6_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
        s AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT l.*, s.keep IS NOT NULL AND l.doc_id < s.keep AS gone FROM l LEFT JOIN s USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
}
