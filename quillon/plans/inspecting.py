"""Document inspection, assessment and streaming queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import inspection as ins
from quillon.operators import training
from quillon.plans.texts import SCRIPT_SQL, TOKEN_SQL
from quillon.sources.session import materialize, read_table
from quillon.streaming import stateful, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A lexicon of frequent words by language, for the test corpus: (subject, term, weight).
LEXICON = (
    ("ENGLISH", "the", 2), ("ENGLISH", "and", 2), ("ENGLISH", "of", 1), ("ENGLISH", "with", 3), ("ENGLISH", "from", 3),
    ("FRENCH", "la", 1), ("FRENCH", "le", 1), ("FRENCH", "dans", 3), ("FRENCH", "pour", 3), ("FRENCH", "est", 2), ("FRENCH", "une", 2),
    ("GERMAN", "der", 2), ("GERMAN", "die", 2), ("GERMAN", "und", 2), ("GERMAN", "nicht", 3), ("GERMAN", "für", 3),
    ("SPANISH", "los", 2), ("SPANISH", "del", 2), ("SPANISH", "que", 1), ("SPANISH", "por", 2), ("SPANISH", "una", 2), ("SPANISH", "la", 1),
)
LEX_SQL = f"""lex(subject, term, weight) AS (VALUES {", ".join(f"('{s}', '{t}', {w})" for s, t, w in LEXICON)}),
tok AS (SELECT doc_id AS id, {TOKEN_SQL.format("text")} AS ws FROM documents), tt AS (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM tok),
tf AS (SELECT id, dl, subject, term, weight, count(*) AS tf FROM tt JOIN lex USING (term) GROUP BY ALL),
cap AS (SELECT id, subject, sum(weight * least(tf, 6))::DOUBLE AS score FROM tf GROUP BY 1, 2),
sat AS (SELECT id, subject, round(sum(tf * 2.2 / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / 1200.0::DOUBLE))), 6) AS score FROM tf GROUP BY 1, 2)"""


def best_sql(scores: str, least: float, bands, floor: float) -> str:
    case = " ".join(f"WHEN score >= {at} THEN {v}" for at, v in bands)
    return f"""(SELECT id, CASE WHEN score >= {least} THEN top ELSE 'GENERAL' END AS subject, score, runner_up, (CASE {case} ELSE {floor} END)::DOUBLE AS confidence FROM (
  SELECT d.doc_id AS id, top, coalesce(s1, 0) AS score, coalesce(s2, 0) AS runner_up FROM documents d LEFT JOIN (SELECT id, max(subject) FILTER (r = 1) AS top, max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, subject) AS r FROM {scores}) GROUP BY id) x ON d.doc_id = x.id))"""


CAP_BEST = best_sql("cap", ins.LEXICON_LEAST, ins.LEXICON_BANDS, ins.LEXICON_FLOOR)
SAT_BEST = best_sql("sat", ins.BM25_LEAST, ins.BM25_BANDS, ins.BM25_FLOOR)


def base(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    lexicon = spark.createDataFrame(LEXICON, "subject string, term string, weight int")
    return docs, materialize(ins.term_counts(docs, lexicon), "term-counts")


@query(f"WITH {LEX_SQL} SELECT * FROM {CAP_BEST}")
def lexicon_score(spark, sf_dir):
    docs, counts = base(spark, sf_dir)
    return ins.best_subject(ins.capped_scores(counts), docs, ins.LEXICON_LEAST, ins.LEXICON_BANDS, ins.LEXICON_FLOOR)


@query(f"WITH {LEX_SQL} SELECT * FROM {SAT_BEST}")
def lexicon_bm25(spark, sf_dir):
    docs, counts = base(spark, sf_dir)
    return ins.best_subject(ins.saturated_scores(counts), docs, ins.BM25_LEAST, ins.BM25_BANDS, ins.BM25_FLOOR)


@query(f"WITH {LEX_SQL} SELECT id, subject, round(score * 100.0::DOUBLE / sum(score) OVER (PARTITION BY id), 6) AS share FROM cap")
def topic_share(spark, sf_dir):
    return ins.topic_shares(ins.capped_scores(base(spark, sf_dir)[1]))


WEIGHTS = (0.35, 0.40, 0.35)
SCRIPT_PASS = f"""(SELECT doc_id AS id, CASE WHEN n_french >= 25 AND n_vietnamese < 10 THEN 'FRENCH' WHEN n_vietnamese >= 15 THEN 'VIETNAMESE' ELSE 'ENGLISH' END AS subject, 0.8::DOUBLE AS confidence FROM (SELECT doc_id, {SCRIPT_SQL} FROM documents))"""


@query(f"""WITH {LEX_SQL}, v AS (SELECT id, subject, confidence, {WEIGHTS[0]} AS w FROM {CAP_BEST} UNION ALL SELECT id, subject, confidence, {WEIGHTS[1]} FROM {SAT_BEST} UNION ALL SELECT id, subject, confidence, {WEIGHTS[2]} FROM {SCRIPT_PASS}),
s AS (SELECT id, subject, sum((confidence * w)::DECIMAL(18, 6)) AS w, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, subject DESC) AS r, sum(w) OVER (PARTITION BY id) AS aw, count(*) OVER (PARTITION BY id) AS kinds FROM s)
SELECT id, subject, w::DOUBLE AS weight, n AS votes, kinds = 1 AS unanimous, CASE WHEN kinds = 1 THEN 1.0 ELSE round(w::DOUBLE / aw::DOUBLE, 6) END::DOUBLE AS confidence FROM r WHERE r = 1""")
def quorum_vote(spark, sf_dir):
    docs, counts = base(spark, sf_dir)
    one = ins.best_subject(ins.capped_scores(counts), docs, ins.LEXICON_LEAST, ins.LEXICON_BANDS, ins.LEXICON_FLOOR)
    two = ins.best_subject(ins.saturated_scores(counts), docs, ins.BM25_LEAST, ins.BM25_BANDS, ins.BM25_FLOOR)
    n = docs.select("id", *[c.alias(k) for k, c in tx.script_counts(F.col("text")).items()])
    by_script = F.when((F.col("french") >= 25) & (F.col("vietnamese") < 10), "FRENCH").when(F.col("vietnamese") >= 15, "VIETNAMESE").otherwise("ENGLISH")
    three = n.select("id", by_script.alias("subject"), F.lit(0.8).alias("confidence"))
    votes = [v.select("id", "subject", "confidence", F.lit(w).alias("weight")) for v, w in zip((one, two, three), WEIGHTS, strict=True)]
    return ins.quorum(votes[0].unionAll(votes[1]).unionAll(votes[2]))


@query(f"""WITH {LEX_SQL}, b AS (SELECT * FROM {CAP_BEST}), f AS (SELECT doc_id AS id, n_chars, n_chars < 200 AS scanned, len(string_split(text, chr(10))) AS q, contains(text, ' | ') AS exam FROM documents)
SELECT id, CASE WHEN (n_chars = 0 AND NOT scanned) OR (scanned AND n_chars < 30) THEN 'failed' WHEN exam AND (subject = 'GENERAL' OR (confidence < 0.6 AND score = 0)) THEN 'unidentified'
  WHEN confidence < 0.88 OR (NOT exam AND q = 0 AND subject = 'GENERAL') OR (runner_up >= 8 AND (score - runner_up) / greatest(score, 1.0) < 0.25) OR (exam AND q BETWEEN 1 AND 2) OR subject = 'GENERAL' THEN 'uncertain' ELSE 'verified' END AS verdict FROM f JOIN b USING (id)""")
def verdict(spark, sf_dir):
    best = lexicon_score(spark, sf_dir)
    f = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", (F.col("n_chars") < 200).alias("scanned"), F.size(F.split("text", "\n")).alias("q"), F.col("text").contains(" | ").alias("exam"))
    rule = ins.verdict(F.col("n_chars"), F.col("scanned"), F.col("exam"), F.col("q"), F.col("subject"), F.col("confidence"), F.col("score"), F.col("runner_up"))
    return f.join(best, "id").select("id", rule.alias("verdict"))


def exam_papers(spark, sf_dir):
    """An exam paper per order: a question a line item, four options, and an answer table."""
    items = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    line = F.concat(F.lit("Question "), F.col("l_linenumber"), F.lit(": part "), F.col("p"), F.lit("?\nA. one\nB. two\nC. three\nD. four"))
    key = F.concat(F.col("l_linenumber"), F.lit("."), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("p") % 4 + 1).cast("int")))
    parts = items.select("l_orderkey", F.struct("l_linenumber", line.alias("q"), key.alias("k")).alias("x"))
    whole = parts.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = F.concat(F.array_join("xs.q", "\n"), F.lit("\nAnswers: "), F.array_join("xs.k", " "))
    return whole.select(F.col("l_orderkey").alias("id"), text.alias("text"))


@query("""WITH i AS (SELECT l_orderkey AS id, l_linenumber AS number, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)
SELECT id, number, 'part ' || p || '?' AS stem, 4 AS n_options, substr('ABCD', (p % 4 + 1)::INTEGER, 1) AS answer_key, 'mcq' AS type FROM i""")
def parse_questions(spark, sf_dir):
    return ins.parse_questions(exam_papers(spark, sf_dir))


@query("""WITH s AS (SELECT l_orderkey AS session, l_linenumber AS number, substr('ABCD', (min(l_partkey) % 4 + 1)::INTEGER, 1) AS correct, CASE WHEN l_linenumber % 3 = 0 THEN 0.5 ELSE 0.25 * l_linenumber END::DOUBLE AS p,
  substr('ABCD', (min(l_suppkey) % 4 + 1)::INTEGER, 1) AS chosen FROM lineitem GROUP BY 1, 2)
SELECT session, count(*) AS n_questions, count(*) FILTER (correct = chosen) AS n_correct, round(sum(CASE WHEN correct = chosen THEN p ELSE 0 END), 4) AS score, round(sum(p), 4) AS max_score FROM s GROUP BY 1""")
def grade_exam(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("number")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    letter = lambda c: F.element_at(F.array(*map(F.lit, "ABCD")), (F.col(c) % 4 + 1).cast("int"))
    points = F.when(F.col("number") % 3 == 0, "not given").otherwise(F.concat((F.col("number") * 0.25).cast("string"), F.lit(" points")))
    return ins.grade(items.select("session", "number", F.concat(F.lit(" "), F.lower(letter("s"))).alias("chosen")), items.select("session", "number", letter("p").alias("correct"), points.alias("points")))


INSULTS = "idiot|moron|pathetic|worthless|scum|trash|disgusting"


@query(f"""WITH j AS (SELECT regexp_matches(text, '{INSULTS}') AS p, toxic = 1 AS e FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (p AND e) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (NOT p AND e) AS fn FROM j),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1 ELSE 0 END::DOUBLE AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END::DOUBLE AS rc FROM c)
SELECT tp, fp, fn, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 9)::DOUBLE AS f1 FROM r""")
def prf_eval(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id").select(F.col("text").rlike(INSULTS).alias("p"), (F.col("toxic") == 1).alias("e"))
    return rows.agg(*ins.precision_recall(F.col("p"), F.col("e")))


@query("""WITH f AS (SELECT doc_id AS id, contains(text, '%%%') AS legacy, n_chars < 40 AS scanned, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents),
g AS (SELECT *, len(ls) AS n, len(list_filter(ls, lambda x: ends_with(x, '.'))) AS done, len(list_filter(ls, lambda x: contains(x, ','))) AS ans, len(list_filter(ls, lambda x: length(x) < 50)) AS r,
  len(list_filter(ls, lambda x: length(x) BETWEEN 50 AND 199)) AS c, len(list_filter(ls, lambda x: length(x) BETWEEN 200 AND 599)) AS a, len(list_filter(ls, lambda x: length(x) >= 600)) AS h FROM f),
s AS (SELECT id, n, r, c, a, h, greatest(0, least(100, done / greatest(n, 1)::DOUBLE * 35.0::DOUBLE + ans / greatest(n, 1)::DOUBLE * 30.0::DOUBLE
  + CASE WHEN greatest(r, c, a, h) / greatest(r + c + a + h, 1)::DOUBLE > 0.85 AND n > 5 THEN 55.0 WHEN greatest(r, c, a, h) / greatest(r + c + a + h, 1)::DOUBLE > 0.65 AND n > 5 THEN 75.0 ELSE 95.0 END::DOUBLE * 0.20::DOUBLE
  + (100.0 - CASE WHEN legacy THEN 30 ELSE 0 END - CASE WHEN scanned THEN 40 ELSE 0 END)::DOUBLE * 0.15::DOUBLE))::DOUBLE AS q FROM g)
SELECT id, round(q, 4) AS score, CASE WHEN q >= 90 THEN 'A+' WHEN q >= 80 THEN 'A' WHEN q >= 65 THEN 'B' WHEN q >= 50 THEN 'C' ELSE 'D' END AS grade,
  round(greatest(1.0, least(10.0, (r * 2.0 + c * 4.5 + a * 7.0 + h * 9.5)::DOUBLE / greatest(r + c + a + h, 1))), 6)::DOUBLE AS difficulty FROM s""")
def quality_grade(spark, sf_dir):
    ls = F.filter(F.split("text", "\n"), lambda x: x != "")
    count = lambda test: F.size(F.filter("ls", test))
    lined = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").contains("%%%").alias("legacy"), (F.col("n_chars") < 40).alias("scanned"), ls.alias("ls"))
    f = lined.select(
        "id", "legacy", "scanned", F.size("ls").alias("n"), count(lambda x: x.endswith(".")).alias("done"), count(lambda x: x.contains(",")).alias("ans"), count(lambda x: F.length(x) < 50).alias("r"),
        count(lambda x: F.length(x).between(50, 199)).alias("c"), count(lambda x: F.length(x).between(200, 599)).alias("a"), count(lambda x: F.length(x) >= 600).alias("h"),
    )
    per = F.greatest(F.col("n"), F.lit(1))
    levels = [F.col(k) for k in "rcah"]
    score, grade = ins.quality(F.col("done") / per, F.col("ans") / per, levels, F.col("n"), F.col("legacy"), F.col("scanned"))
    return f.select("id", F.round(score, 4).alias("score"), grade.alias("grade"), F.round(ins.cognitive_difficulty(levels), 6).alias("difficulty"))


@query("""SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS n, round(sum(value::DECIMAL(18, 4))::DOUBLE, 2) AS total FROM events GROUP BY 1, 2""")
def stream_window_counts(spark, sf_dir):
    """Counts of six-hour windows by a stream that runs over all events that are there. A pattern as path lets the
    stream read a table that is one file as well as one that is a folder."""
    stream = windows.read_stream(spark, f"{sf_dir}/event[s].parquet", read_table(spark, sf_dir, "events"))
    out = windows.run_available(windows.window_counts(stream, "6 hours"), "window-counts")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOURS AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.sessions(events, "6 hours")
    return out.withColumn("started", F.col("started").cast("timestamp_ntz")).withColumn("ended", F.col("ended").cast("timestamp_ntz"))


@query("""WITH w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 4 HOURS PRECEDING AND CURRENT ROW) AS in_window FROM events)
SELECT user_id, event_id, in_window FROM w WHERE in_window >= 3""")
def stream_floods(spark, sf_dir):
    """The floods of query flood_batch, found by a stream that keeps the last window of each user."""
    stream = windows.read_stream(spark, f"{sf_dir}/event[s].parquet", read_table(spark, sf_dir, "events"))
    return windows.run_available(stateful.floods(stream, "user_id", 4 * 3600, 3), "floods", "append")


@query("""WITH x AS (SELECT event_id, event_type, ts, row_number() OVER o AS i, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS new, coalesce(ts - lag(ts, 2) OVER o <= INTERVAL 600 SECONDS, false) AS hot FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY i) AS island FROM x), h AS (SELECT *, sum(hot::INTEGER) OVER (PARTITION BY event_type, island ORDER BY i) AS seen FROM g)
SELECT event_type, event_id, hot AND seen = 1 AS started FROM h WHERE seen > 0""")
def stream_raids(spark, sf_dir):
    """Raids by event type with a latch of an hour."""
    stream = windows.read_stream(spark, f"{sf_dir}/event[s].parquet", read_table(spark, sf_dir, "events"))
    return windows.run_available(stateful.raids(stream, "event_type", 600, 3, 3600), "raids", "append")


TARGETS = {"en": "ENGLISH", "fr": "FRENCH", "de": "GERMAN", "es": "SPANISH"}
RATE, EPOCHS = 5.0, 3
TARGET_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TARGETS.items()) + " END"


def training_sql() -> str:
    """The epochs, one after the other."""
    steps = [f"{LEX_SQL}, y AS (SELECT doc_id AS id, {TARGET_SQL} AS target FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')), sc AS (SELECT cap.id, target, subject, score FROM cap JOIN y ON cap.id = y.id WHERE score > 0)",
             "tot AS (SELECT count(DISTINCT id) AS n FROM sc)", "m0 AS (SELECT DISTINCT subject, 1.0::DOUBLE AS m FROM sc UNION SELECT DISTINCT target, 1.0::DOUBLE FROM sc)"]
    for k in range(1, EPOCHS + 1):
        steps += [
            f"p{k} AS (SELECT id, target, arg_min(subject, (-score * m, subject)) AS got FROM sc JOIN m{k - 1} USING (subject) GROUP BY id, target)",
            f"d{k} AS (SELECT s, sum(g) AS g FROM (SELECT target AS s, {training.GAIN} AS g FROM p{k} WHERE got <> target UNION ALL SELECT got, -1 FROM p{k} WHERE got <> target) GROUP BY s)",
            f"m{k} AS (SELECT subject, CASE WHEN g IS NULL THEN m ELSE least({training.HIGHEST}, greatest({training.LOWEST}, m + {RATE}::DOUBLE * g::DOUBLE / n)) END::DOUBLE AS m FROM m{k - 1} LEFT JOIN d{k} ON subject = s, tot)",
        ]
    every = " UNION ALL ".join(f"SELECT {k} AS epoch, subject, m, (SELECT count(*) FILTER (got = target) / count(*)::DOUBLE FROM p{k}) AS accuracy FROM m{k}" for k in range(1, EPOCHS + 1))
    return f"WITH {', '.join(steps)}, e AS ({every}) SELECT epoch::INTEGER AS epoch, subject, round(m, 9)::DOUBLE AS multiplier, round(accuracy, 9)::DOUBLE AS accuracy, round(0.45::DOUBLE - 0.45::DOUBLE * accuracy, 9)::DOUBLE AS loss FROM e"


@query(training_sql())
def trained_multipliers(spark, sf_dir):
    """Multipliers of the subjects after each of three epochs over all documents, with their language as the subject expected."""
    docs, counts = base(spark, sf_dir)
    target = F.element_at(F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair]), F.col("lang"))
    expected = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), target.alias("target"))
    rows = materialize(training.evidence_rows(ins.capped_scores(counts), expected), "training")
    history = training.train(rows, EPOCHS, RATE, rows.count())
    out = [(e.number, s, round(e.multipliers.get(s, 1.0), 9), round(e.accuracy, 9), round(e.loss, 9)) for e in history for s in sorted(TARGETS.values())]
    return spark.createDataFrame(out, "epoch int, subject string, multiplier double, accuracy double, loss double")
