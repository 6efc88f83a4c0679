"""Queries on requirements, channels, verdicts and the texts of exams, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import audits
from quillon.plans import inspecting
from quillon.sources.session import read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


NAMES = [p[0] for p in audits.PRESETS]
GRADES = ("10", "11", "12", "unknown")
SUBJECTS = ("MATH", "ENGLISH", "PHYSICS")


def pick(xs, c):
    return F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))


def reports(spark, sf_dir):
    """A report an order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return read_table(spark, sf_dir, "orders").select(
        o.alias("id"), pick(NAMES, c).alias("profile"), (c % 7 == 0).alias("spoofed"), pick(SUBJECTS, o).alias("subject"), pick(GRADES, o).alias("grade"), (o % 101 / 10.0).alias("difficulty"),
        pick(("standard", "advanced", "olympiad"), o).alias("tier"), (o % 60).cast("int").alias("questions"), F.when(o % 9 > 0, c % 4 > 0).alias("answers"), (o % 2 == 0).alias("solutions"),
        (c % 5 == 0).alias("scanned"), (o % 3 > 0).alias("format_2025"), (o % 4 > 0).alias("lesson_plan"), (o % 100).cast("double").alias("quality"), (c % 100).cast("double").alias("coverage"),
        F.array(F.lit("Algebra and sets")).alias("topics"),
    )


NEEDS = ", ".join(f"('{n}', {'NULL' if t is None else repr(t)}, {'NULL' if a is None else a}, {'NULL' if b is None else b}, {k}, {s}, {f}, {l})" for n, t, a, b, k, s, _, f, l in audits.PRESETS)
CHECK_SQL = f"""n(profile, tier, lo, hi, answers, scans, format, plan) AS (VALUES {NEEDS}),
r AS (SELECT o_orderkey AS id, {NAMES}[o_custkey % 6 + 1] AS profile, o_custkey % 7 <> 0 AS honest, (o_orderkey % 101 / 10.0)::DOUBLE AS difficulty, ['standard', 'advanced', 'olympiad'][o_orderkey % 3 + 1] AS own, o_orderkey, o_custkey FROM orders),
m AS (SELECT * FROM r JOIN n USING (profile)),
c AS (SELECT id, profile, 'anti_spoof' AS rule, honest AS passed FROM m UNION ALL SELECT id, profile, 'min_difficulty', difficulty >= lo FROM m WHERE lo IS NOT NULL UNION ALL SELECT id, profile, 'max_difficulty', difficulty <= hi FROM m WHERE hi IS NOT NULL
UNION ALL SELECT id, profile, 'tier', own = tier FROM m WHERE tier IS NOT NULL UNION ALL SELECT id, profile, 'answers', o_orderkey % 9 > 0 AND o_custkey % 4 > 0 FROM m WHERE answers
UNION ALL SELECT id, profile, 'scans', o_custkey % 5 <> 0 FROM m WHERE NOT scans UNION ALL SELECT id, profile, 'format_2025', o_orderkey % 3 > 0 FROM m WHERE format UNION ALL SELECT id, profile, 'lesson_plan', o_orderkey % 4 > 0 FROM m WHERE plan)"""


@query(f"WITH {CHECK_SQL} SELECT id, profile, rule, 'error' AS severity, passed FROM c")
def requirement_checks(spark, sf_dir):
    return audits.checks(reports(spark, sf_dir), audits.presets(spark))


@query(f"WITH {CHECK_SQL} SELECT id, profile, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed, bool_and(passed) AS eligible FROM c GROUP BY 1, 2")
def requirement_status(spark, sf_dir):
    return audits.eligible(audits.checks(reports(spark, sf_dir), audits.presets(spark)))


@query(f"""WITH p AS (SELECT o_orderkey AS id, o_orderkey % 4 AS ch, o_custkey % 11 = 0 AS failed, o_custkey % 2 = 0 AS exam, o_orderkey % 5 AS track, {list(GRADES)}[o_custkey % 4 + 1] AS grade, {list(SUBJECTS)}[o_orderkey % 3 + 1] AS subject FROM orders),
r AS (SELECT *, CASE WHEN failed THEN 'unverifiable' WHEN ch = 1 AND NOT exam THEN 'category' WHEN ch = 2 AND track > 1 THEN 'track' WHEN ch = 2 AND grade NOT IN ('12', 'unknown') THEN 'grade' WHEN ch IN (1, 2) AND subject <> 'MATH' THEN 'subject' WHEN ch = 3 AND subject <> 'ENGLISH' THEN 'subject' END AS reason FROM p)
SELECT id, ['lounge', 'maths', 'gifted', 'english'][ch + 1] AS channel, reason, CASE WHEN reason <> 'unverifiable' THEN CASE subject WHEN 'MATH' THEN 'maths' WHEN 'ENGLISH' THEN 'english' ELSE 'lounge' END END AS suggested FROM r""")
def channel_compliance(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    posts = read_table(spark, sf_dir, "orders").select(
        o.alias("id"), pick(("lounge", "maths", "gifted", "english"), o).alias("channel"), F.when(c % 11 == 0, "failed").otherwise("verified").alias("verdict"), F.when(c % 2 == 0, "exam").alias("category"),
        (o % 5).cast("string").alias("track"), pick(GRADES, c).alias("grade"), pick(SUBJECTS, o).alias("subject"),
    )
    rows = [("lounge", None, None, None, None, True), ("maths", "exam", [], None, ["MATH"], False), ("gifted", None, ["0", "1"], ["12"], ["MATH"], False), ("english", None, None, [], ["ENGLISH"], None)]
    channels = spark.createDataFrame(rows, "channel string, category string, tracks array<string>, grades array<string>, subjects array<string>, wildcard boolean")
    home = spark.createDataFrame([("MATH", "maths"), ("ENGLISH", "english")], "subject string, suggested string")
    return audits.compliance(posts, channels, home, "lounge")


@query(f"WITH v AS ({inspecting.ORACLE_SQL['verdict']}) SELECT verdict, count(*) AS n, count(*) FILTER (id % 7 = 0) AS n_flagged, round(count(*) / (SELECT count(*) FROM v)::DOUBLE, 6) AS share FROM v GROUP BY 1")
def verdict_breakdown(spark, sf_dir):
    return audits.breakdown(inspecting.verdict(spark, sf_dir), "verdict", F.col("id") % 7 == 0)


FROM_SQL, TO_SQL = ("".join(x[i] for x in tx.LEGACY_LETTERS) for i in (0, 1))
OLD = "¸µ¶·¹ª«¬®¾»¼½"
EXAM_SQL = f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{OLD}' || replace(text, '. ', chr(9) || ' ' || chr(13) || chr(10) || chr(13) || chr(13)) WHEN 1 THEN replace(text, '. ', chr(8203) || ' {chr(0xF0A3)} e' || chr(769) || chr(10)) ELSE coalesce(text, '') END AS t FROM documents),
l AS (SELECT doc_id, t, len(regexp_extract_all(t, '[{tx.LEGACY_MARKS}]')) AS m, len(regexp_extract_all(t, '[\u1ea0-\u1ef9]')) AS u FROM t),
x AS (SELECT doc_id, m >= 12 AND u < m * 0.25 AS legacy, nfc_normalize(translate(CASE WHEN m >= 12 AND u < m * 0.25 THEN translate(t, '{FROM_SQL}', '{TO_SQL}') ELSE t END, '{tx.SYMBOL_FROM}', '{tx.SYMBOL_TO}')) AS x FROM l)
SELECT doc_id, legacy, sha256(regexp_replace(regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text_sha256 FROM x"""


@query(EXAM_SQL)
def exam_texts(spark, sf_dir):
    """Texts of which a third is marked as legacy and a third has symbols, tidied."""
    k = F.col("doc_id") % 3
    given = F.when(k == 0, F.concat(F.lit(OLD), F.replace("text", F.lit(". "), F.lit("\t \r\n\r\r")))).when(k == 1, F.replace("text", F.lit(". "), F.lit("\u200b \uf0a3 e\u0301\n"))).otherwise(F.coalesce("text", F.lit("")))
    t = read_table(spark, sf_dir, "documents").select("doc_id", given.alias("t"))
    return t.select("doc_id", tx.is_legacy(F.col("t")).alias("legacy"), F.sha2(tx.exam_text(F.col("t")), 256).alias("text_sha256"))
