"""Queries of the classifiers that live on the places of phrases, each with its SQL twin, which counts phrase by phrase."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import phrases, ratios
from quillon.sources.session import materialize, read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: A lexicon for the test corpus.
LEXICON = (
    ("ENGLISH", "of the", 2.0), ("ENGLISH", "and the", 2.0), ("ENGLISH", "that", 0.5), ("ENGLISH", "attion", 1.5), ("FRENCH", "de la", 3.0), ("FRENCH", "ément", 2.5), ("FRENCH", "étion", 2.0),
    ("FRENCH", "le", 0.25), ("GERMAN", "der die", 3.0), ("GERMAN", "geverü", 4.0), ("GERMAN", "enauenä", 3.0), ("GERMAN", "und", 0.5), ("SPANISH", "ciónes", 3.0), ("SPANISH", "ción", 1.0),
    ("SPANISH", "los", 0.5), ("SPANISH", "que", 0.5),
)
SUBJECTS = ("ENGLISH", "FRENCH", "GERMAN", "SPANISH")
TITLES = (("english", "ENGLISH"), ("german", "GERMAN"))
CONFLICTS = (("ENGLISH", "FRENCH", ("thatin", "orantion")), ("GERMAN", "SPANISH", ("geberö",)))
#: Some documents are given a title.
TEXT = "CASE doc_id % 5 WHEN 0 THEN 'Subject: English reading, part one\n' WHEN 1 THEN 'Subject - the German tongue\n' ELSE '' END || coalesce(text, '')"


def docs(spark, sf_dir):
    table = read_table(spark, sf_dir, "documents")
    return table.select(F.col("doc_id").alias("id"), F.expr(TEXT.replace("\n", "\\n")).alias("text"))


def count_sql(text: str, phrase: str) -> str:
    return f"((length({text}) - length(replace({text}, {phrase}, ''))) // length({phrase}))"


VALUES = ", ".join(f"('{s}', '{p}', {w}::DOUBLE, {k})" for k, (s, p, w) in enumerate(LEXICON))
BODY = "CASE WHEN length(z) > 2700 THEN substr(z, 1201, length(z) - 2700) ELSE z END"
BASE_SQL = f"""lex(subject, phrase, w, rank) AS (VALUES {VALUES}), d AS (SELECT doc_id AS id, lower({TEXT}) AS z FROM documents), x AS (SELECT *, strip_accents(z) AS u, substr(z, 1, 1200) AS hz, {BODY} AS bz FROM d)"""
CUES = [f"({' OR '.join(f'''contains(z, '{c}')''' for c in cs)})" for _, _, cs in CONFLICTS]
EVIDENCE_SQL = f"""{BASE_SQL},
c AS (SELECT id, subject, phrase, w, {count_sql('hz', 'phrase')} AS h, {count_sql('bz', 'phrase')} AS b, CASE WHEN length(phrase) > 4 AND strip_accents(phrase) <> phrase THEN {count_sql('u', 'strip_accents(phrase)')} ELSE 0 END AS q FROM x, lex),
tt AS (SELECT id, regexp_extract(hz, 'subject\\s*[:-]\\s*([^\\n\\r,;()]{{2,40}})', 1) AS title FROM x),
g AS (SELECT id, subject, phrase, 'header' AS zone, h AS n, w * 3.5::DOUBLE * least(h, 3) AS points FROM c WHERE h > 0 UNION ALL SELECT id, subject, phrase, 'body', b, w * (1 + ln(1 + b)) FROM c WHERE b > 0
  UNION ALL SELECT id, subject, phrase, 'plain', q, w * 0.6::DOUBLE * least(q, 4) FROM c WHERE b = 0 AND q > 0
  UNION ALL SELECT id, CASE WHEN starts_with(title, 'english') OR contains(title, ' english') THEN 'ENGLISH' ELSE 'GERMAN' END, title, 'title', 1, 80 FROM tt WHERE title LIKE 'english%' OR title LIKE '% english%' OR title LIKE 'german%' OR title LIKE '% german%'
  UNION ALL SELECT id, 'ENGLISH', 'thatin/orantion', 'cue', 1, 70 FROM x WHERE {CUES[0]} UNION ALL SELECT id, 'GERMAN', 'geberö', 'cue', 1, 70 FROM x WHERE {CUES[1]}),
lost AS (SELECT id, 'FRENCH' AS subject FROM x WHERE {CUES[0]} UNION ALL SELECT id, 'SPANISH' FROM x WHERE {CUES[1]}),
ev AS (SELECT g.*, CASE WHEN lost.id IS NULL THEN 1 ELSE 0.15 END::DOUBLE AS factor FROM g LEFT JOIN lost ON g.id = lost.id AND g.subject = lost.subject)"""


def dossier(spark, sf_dir):
    return phrases.evidence(docs(spark, sf_dir), LEXICON, TITLES, CONFLICTS)


@query(f"WITH {EVIDENCE_SQL} SELECT id, subject, phrase, zone, n::BIGINT AS n, round(points, 6)::DOUBLE AS points, factor, round(points * factor, 6)::DOUBLE AS counted FROM ev")
def verdict_evidence(spark, sf_dir):
    """Every piece of evidence of every subject's score: phrase, zone, count, points, and what a conflict left of them."""
    return dossier(spark, sf_dir).withColumns({"points": F.round("points", 6), "counted": F.round("counted", 6)})


@query(f"""WITH {EVIDENCE_SQL}, s AS (SELECT id, subject, round(sum(points * factor), 6) AS score FROM ev GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, list_position({list(SUBJECTS)}, subject)) AS r FROM s),
t AS (SELECT id, max(subject) FILTER (r = 1) AS top, max(score) FILTER (r = 1) AS s1, max(subject) FILTER (r = 2) AS second, max(score) FILTER (r = 2) AS s2 FROM r WHERE r <= 2 GROUP BY 1),
m AS (SELECT d.id, top, second, coalesce(s1, 0) AS score, coalesce(s2, 0) AS runner_up_score, (coalesce(s1, 0) - coalesce(s2, 0)) / greatest(coalesce(s1, 0), 1) AS margin FROM d LEFT JOIN t USING (id))
SELECT id, CASE WHEN score > 3.5 THEN top ELSE 'GENERAL' END AS subject, score::DOUBLE AS score, second AS runner_up, runner_up_score::DOUBLE AS runner_up_score, round(margin, 6)::DOUBLE AS margin,
  CASE WHEN score > 40 AND margin >= 0.35 THEN 1.0 WHEN score > 20 AND margin >= 0.2 THEN 0.98 WHEN score > 8 THEN 0.92 ELSE greatest(0.5, round(margin, 2)) END::DOUBLE AS confidence FROM m""")
def zone_classification(spark, sf_dir):
    """Subjects by zones, titles and conflicts, with the margin to the runner-up."""
    d = docs(spark, sf_dir)
    return phrases.classify(d, materialize(phrases.evidence(d, LEXICON, TITLES, CONFLICTS), "evidence"), SUBJECTS)


@query(f"""WITH {BASE_SQL}, w AS (SELECT id, subject, rank, weight_n FROM (SELECT id, subject, rank, w * least(5, CASE WHEN length(phrase) <= 4 THEN len(list_filter(regexp_split_to_array(z, '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t = phrase)) ELSE {count_sql('z', 'phrase')} END) AS weight_n FROM x, lex)),
s AS (SELECT id, subject, sum(weight_n) AS score, min(rank) AS rank FROM w GROUP BY 1, 2), b AS (SELECT id, arg_max(subject, (score, -rank)) AS top, max(score) AS score FROM s WHERE score > 0 GROUP BY 1)
SELECT d.id, coalesce(top, 'GENERAL') AS subject, coalesce(score, 0)::DOUBLE AS score, CASE WHEN score > 30 THEN 0.99 WHEN score > 15 THEN 0.95 WHEN score > 6 THEN 0.88 WHEN score > 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM d LEFT JOIN b USING (id)""")
def fast_subject(spark, sf_dir):
    """Subjects by capped counts, short words as whole words."""
    return phrases.fast_classify(docs(spark, sf_dir), LEXICON)


FINGERPRINTS = (("GRADE_12", "thatin"), ("GRADE_12", "orantion"), ("GRADE_12", "inoran"), ("GRADE_11", "hehely"), ("GRADE_11", "ononst"), ("GRADE_11", "rewh"), ("GRADE_10", "anea"), ("GRADE_10", "eriner"), ("GRADE_10", "thanea"))
SIGNS = (("GRADE_12", "english reading", 25.0), ("GRADE_11", "der der", 35.0), ("GRADE_10", "de de", 30.0))
MARK_VALUES = ", ".join([f"('{g}', '{p}', 3.0, false)" for g, p in FINGERPRINTS] + [f"('{g}', '{p}', {n}, true)" for g, p, n in SIGNS])


@query(f"""WITH {BASE_SQL}, m(grade, phrase, n, head) AS (VALUES {MARK_VALUES}), s AS (SELECT id, grade, sum(n)::DOUBLE AS score FROM x, m WHERE contains(CASE WHEN head THEN hz ELSE z END, phrase) GROUP BY 1, 2),
b AS (SELECT id, grade, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, grade) AS r FROM s)
SELECT d.id, CASE WHEN score >= 8 THEN grade END AS grade, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (id)""")
def grade_fingerprint(spark, sf_dir):
    """Grades by the topics that a document names, and by signs in its header."""
    d = docs(spark, sf_dir)
    hits = phrases.phrase_hits(d, [p for _, p in FINGERPRINTS] + [p for _, p, _ in SIGNS])
    return phrases.grade_of(hits, d, FINGERPRINTS, SIGNS)


def near_turns(spark, sf_dir):
    """Turns of conversations that are much like the turn before them, by matching blocks. SQL has no such function; it is tested
    against difflib."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    pairs = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(line).alias("before")).filter("before IS NOT NULL")
    return ratios.near_texts(pairs, "before", "text", 0.3).select("conv_id", "turn", "ratio")


QUERIES["near_turns"] = near_turns
