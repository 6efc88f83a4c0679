"""The registered queries of this subpackage, opN_<name>, and their SQL twins.

Each query applies its operator with production parameters to the whole table and derives the columns of its
contract from the operator's output.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import (
    bpe,
    filter_audit,
    license_scan,
    line_dedup,
    lm_score,
    mixing,
    near_dup,
    periodic_runs,
    pii,
    pivot_index,
    quality,
    secret_scan,
    token_counts,
)
from quillon.llm.common import bind, text_of
from quillon.sources.session import materialize, read_table


def byte_bpe() -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.load_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), byte_bpe())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("n_chars_left"), F.sha2("clean_text", 256).alias("clean_sha256"))


OP2_SQL = """
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
worded AS (SELECT doc_id, p, regexp_replace(l, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS l FROM raw WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
win AS (SELECT doc_id, p, l AS a, lead(l, 1) OVER d AS b, lead(l, 2) OVER d AS c, lead(p, 2) OVER d AS q FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
ranked AS (SELECT doc_id, p, q, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, p) AS r FROM win WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT raw.doc_id, raw.p FROM raw JOIN ranked ON raw.doc_id = ranked.doc_id AND raw.p BETWEEN ranked.p AND ranked.q WHERE r > 1),
cut AS (SELECT raw.doc_id, raw.p, raw.l, gone.p IS NOT NULL AS g, regexp_matches(raw.l, '[^\\x20\\x09-\\x0D]') AS w FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.p = gone.p),
done AS (SELECT doc_id, count(*) FILTER (w) AS n_lines, count(*) FILTER (w AND g) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT g), '') AS x FROM cut GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(x)::BIGINT AS n_chars_left, sha256(x) AS clean_sha256 FROM done
"""


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(read_table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the Spark setting quillon.surrogate.key; where it is unset, one is drawn for this run alone."""
    key = spark.conf.get("quillon.surrogate.key", None) or secrets.token_hex(32)
    return pii.replace_pii(read_table(spark, sf_dir, "documents"), key.encode())


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: their insert under two tokenizer versions, the revision of all word counts
    to the next version, the delete of the documents labelled toxic, and the last two delivered again. Another run over
    the same documents meets the ledger and finds all four committed."""
    docs = read_table(spark, sf_dir, "documents")
    toxic = read_table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    counted = materialize(token_counts.count_tokens(docs, ("words-1", "words-2", "bytes-1")), "token-counts")
    gone = counted.join(toxic, "doc_id", "left_semi")
    ledger = token_counts.ledger_of(counted.unionByName(gone.withColumn("doc_id", -F.col("doc_id") - 1)), "token-ledger")
    ledger.commit("1-insert", token_counts.inserted(counted, "words-1").unionAll(token_counts.inserted(counted, "bytes-1")))
    for _ in range(2):
        ledger.commit("2-revise", token_counts.revised(counted, "words-1", counted, "words-2"))
        ledger.commit("3-delete", token_counts.deleted(gone, "words-2").unionAll(token_counts.deleted(gone, "bytes-1")))
    return ledger.totals()


OP6_SQL = """
WITH kept AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, strlen(coalesce(text, '')) AS bytes
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
long AS (SELECT source, lang, 'words-2' AS version, words AS n FROM kept UNION ALL SELECT source, lang, 'bytes-1', bytes FROM kept)
SELECT source, lang, version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM long GROUP BY source, lang, version
"""


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_layers")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_failed_lines", "lost_chars", F.sha2("clean_text", 256).alias("clean_sha256"),
    )


OP8_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM t),
win AS (SELECT doc_id, i, a, lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, c, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1 AND c IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS l, generate_subscripts(string_split(x, chr(10)), 1) AS k FROM t),
ln AS (SELECT *, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS nw, len(regexp_extract_all(l, '{quality.NOISE_RUN}')) AS noise,
         len(regexp_extract_all(l, '{quality.BARS}')) AS bars,
         regexp_matches(translate(l, '{quality.UPPER}', '{quality.LOWER}'), '{"|".join(quality.BOILERPLATE)}') AS plate FROM raw),
jd AS (SELECT *, nw > 0 AND (noise * 10 >= nw * 3 OR (bars >= 2 AND bars * 4 >= nw) OR (nw <= {quality.BOILERPLATE_WORDS} AND plate)) AS bad FROM ln),
pl AS (SELECT doc_id, count(*) FILTER (nw > 0) AS n_lines, count(*) FILTER (nw > 0) - count(DISTINCT l) FILTER (nw > 0) AS n_dup_lines,
         count(*) FILTER (bad) AS n_failed_lines,
         coalesce(sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (bad), 0) AS lost_chars,
         coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (NOT bad), '') AS clean FROM jd GROUP BY doc_id),
ct AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost_chars * 100 > word_chars * {quality.MAX_LOST}) AS kept,
  n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars, sha256(clean) AS clean_sha256
FROM ct JOIN pl USING (doc_id)
"""

def op9_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "times", "shards")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document, by the checksum of its id, the words from a certain one on repeat with a
    certain period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), times))
        return F.array_join(F.when(n > 0, F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a))), " ")

    new = bind(quality.words_of(text_of()), planted)
    return docs.select("doc_id", F.when(h % 10 == 0, new).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    labels = lambda spans: F.transform(spans, lambda s: s["label"])
    listed = lambda names: F.array_join(F.sort_array(F.array_distinct(names)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(labels("base")).alias("base_labels"), listed(F.concat(labels("base"), labels("hits"))).alias("labels"), "score",
        F.size("hits").cast("long").alias("n_hits"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP13_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < {filter_audit.MIN_WORDS} AS fa, 100 * len(list_distinct(w)) < {filter_audit.MIN_DISTINCT} * len(w) AS fb,
  100 * len(regexp_extract_all(x, '[A-Z]')) > {filter_audit.MAX_UPPER} * length(x) AS fc, regexp_matches(x, '{filter_audit.SIGNS}') AS fd,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS fe FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
e AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, b)),
o AS (SELECT e1.c || e2.c || e3.c || e4.c || e5.c AS filter_order, [e1.b, e2.b, e3.b, e4.b, e5.b] AS bits FROM e e1, e e2, e e3, e e4, e e5
  WHERE e1.b | e2.b | e3.b | e4.b | e5.b = 31),
s AS (SELECT filter_order, step, filter_order[step] AS filter, bits[step] AS b, list_sum(bits[1:step - 1])::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
s0 AS (SELECT filter_order, step, filter, b, coalesce(before, 0) AS before FROM s),
r AS (SELECT part, filter_order, step, filter,
  coalesce(sum(n) FILTER (mask & (b | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & b > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
  coalesce(sum(g) FILTER (mask & b > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(x) FILTER (mask & b > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM m, s0 GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scores": op3_lm_scores,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op6_token_rollups": op6_token_rollups,
    "op9_pivot_index": op9_pivot_index,
    "op5_hyperminhash": op5_hyperminhash,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op10_source_mixing": op10_source_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_license_scan": op12_license_scan,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {
    "op6_token_rollups": OP6_SQL,
    "op2_line_dedup": OP2_SQL,
    "op8_quality_rules": OP8_SQL,
    "op13_filter_audit": OP13_SQL,
}
