"""Queries on the structure of papers, rule-based search and streams of arrivals, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import structure
from quillon.sources.session import read_table
from quillon.streaming import intake, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


ITEM_SQL = "SELECT l_orderkey AS id, l_linenumber AS place, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2"


def items(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"))
    return rows.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))


TYPES = ("single_choice", "true_false", "fill_blank", "multiple_choice", "essay")


def parsed(spark, sf_dir):
    """A question an item: its shape is told by the keys of part and supplier."""
    p, s = F.col("p"), F.col("s")
    texts = (F.lit("one"), F.when(p % 9 == 0, " \n").otherwise("two"), F.lit("three"), F.when(p % 13 == 0, "four\nCâu 3. next").otherwise("four"))
    third = F.when(s % 6 == 2, "a").otherwise("C")
    options = F.array(*[F.struct(m.alias("marker"), t.alias("text")) for m, t in zip((F.lit("A"), F.lit("B"), third, F.lit("D")), texts, strict=True)])
    return items(spark, sf_dir).select(
        "id", "place", (F.col("place") - F.when(p % 7 == 0, 2).otherwise(0)).alias("number"), (p % 2).alias("group"), F.element_at(F.array(*map(F.lit, TYPES)), (p % 5 + 1).cast("int")).alias("type"),
        F.when(s % 5 == 0, "  ").otherwise(F.concat(F.lit("part "), p)).alias("stem"), F.slice(options, F.lit(1), F.when(s % 6 < 2, s % 6).otherwise(4).cast("int")).alias("options"),
        (p % 3).alias("n_statements"), (s % 2).alias("n_blanks"), F.when(s % 4 > 0, F.substring(F.lit("ABCDE"), (p % 5 + 1).cast("int"), F.lit(1))).alias("answer"),
    )


@query(f"""WITH i AS ({ITEM_SQL}), q AS (SELECT *, place - CASE WHEN p % 7 = 0 THEN 2 ELSE 0 END AS number, {list(TYPES)}[p % 5 + 1] AS type, CASE WHEN s % 6 < 2 THEN s % 6 ELSE 4 END AS k, p % 5 IN (0, 3) AS choice FROM i),
o AS (SELECT *, lag(number) OVER w AS ln, lag(p % 2) OVER w AS lg FROM q WINDOW w AS (PARTITION BY id ORDER BY place))
SELECT id, place, 'out_of_order' AS problem FROM o WHERE ln > number AND lg = p % 2 AND number <> 1 UNION ALL SELECT id, place, 'no_stem' FROM q WHERE s % 5 = 0
UNION ALL SELECT id, place, 'few_options' FROM q WHERE choice AND k < 2 UNION ALL SELECT id, place, 'repeated_marker' FROM q WHERE choice AND s % 6 = 2
UNION ALL SELECT id, place, 'empty_option' FROM q WHERE choice AND k >= 2 AND p % 9 = 0 UNION ALL SELECT id, place, 'header_in_option' FROM q WHERE choice AND k = 4 AND p % 13 = 0
UNION ALL SELECT id, place, 'no_statements' FROM q WHERE type = 'true_false' AND p % 3 = 0 UNION ALL SELECT id, place, 'no_blank' FROM q WHERE type = 'fill_blank' AND s % 2 = 0
UNION ALL SELECT id, place, 'answer_not_offered' FROM q WHERE s % 4 > 0 AND k > 0 AND (p % 5 = 4 OR p % 5 >= k OR (s % 6 = 2 AND p % 5 = 2))""")
def question_problems(spark, sf_dir):
    return structure.question_problems(parsed(spark, sf_dir))


@query(f"""WITH i AS ({ITEM_SQL}), r AS (SELECT id, place, 'context' AS kind, p % 10 AS name FROM i WHERE s % 3 = 0 UNION ALL SELECT id, place, 'asset', s % 10 FROM i),
k AS (SELECT id, 'context' AS kind, p % 8 AS name FROM i UNION SELECT id, 'asset', p % 10 FROM i) SELECT DISTINCT id, place, 'unknown_' || kind AS problem FROM r ANTI JOIN k USING (id, kind, name)""")
def dangling_references(spark, sf_dir):
    i = items(spark, sf_dir)
    refs = F.array(F.struct(F.lit("context").alias("kind"), F.when(F.col("s") % 3 == 0, F.col("p") % 10).alias("name")), F.struct(F.lit("asset").alias("kind"), (F.col("s") % 10).alias("name")))
    has = F.array(F.struct(F.lit("context").alias("kind"), (F.col("p") % 8).alias("name")), F.struct(F.lit("asset").alias("kind"), (F.col("p") % 10).alias("name")))
    return structure.dangling(i.select("id", "place", F.explode(refs).alias("x")).select("id", "place", "x.*"), i.select("id", F.explode(has).alias("x")).select("id", "x.*").distinct())


PAPER_SQL = "CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE repeat('Question 1 of ' || o_custkey || ', ', (o_orderkey % 40)::INTEGER) END"


@query(f"""WITH p AS (SELECT o_orderkey AS id, {PAPER_SQL} AS text, o_orderkey % 4 AS n_images, (o_custkey % 11 = 0)::INTEGER AS n_loose FROM orders),
q AS (SELECT id, place AS number, 'part ' || p AS raw FROM ({ITEM_SQL}) WHERE p % 3 > 0), a AS (SELECT id, count(*) AS n, sum(length(raw)) AS kept FROM q GROUP BY 1),
k AS (SELECT id, place AS number FROM ({ITEM_SQL}) WHERE s % 2 = 0), b AS (SELECT id, count(*) AS orphans FROM k ANTI JOIN q USING (id, number) GROUP BY 1),
m AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(kept, 0) AS kept, coalesce(orphans, 0) AS orphans FROM p LEFT JOIN a USING (id) LEFT JOIN b USING (id))
SELECT id, 'empty' AS problem FROM m WHERE trim(text) = '' AND n_images = 0 UNION ALL SELECT id, 'no_questions' FROM m WHERE n = 0 AND len(regexp_extract_all(text, 'Question 1')) >= 2
UNION ALL SELECT id, 'orphan_keys' FROM m WHERE n > 0 AND orphans > 0 UNION ALL SELECT id, 'loose_questions' FROM m WHERE n_loose > 0 UNION ALL SELECT id, 'little_kept' FROM m WHERE length(text) > 200 AND n > 0 AND kept / length(text)::DOUBLE < 0.25""")
def paper_problems(spark, sf_dir):
    i = items(spark, sf_dir)
    text = F.when(F.col("o_orderkey") % 6 == 0, " ").otherwise(F.repeat(F.concat(F.lit("Question 1 of "), "o_custkey", F.lit(", ")), (F.col("o_orderkey") % 40).cast("int")))
    papers = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), (F.col("o_orderkey") % 4).alias("n_images"), (F.col("o_custkey") % 11 == 0).cast("int").alias("n_loose"))
    questions = i.filter("p % 3 > 0").select("id", F.col("place").alias("number"), F.concat(F.lit("part "), "p").alias("raw"))
    return structure.paper_problems(papers, questions, i.filter("s % 2 = 0").select("id", F.col("place").alias("number")))


@query(f"""WITH i AS ({ITEM_SQL}), s AS (SELECT id, count(*) AS actual, count(*) FILTER (p % 2 = 0 AND s % 6 < 4) + count(*) FILTER (p % 2 = 0 AND s % 4 = 0) AS wrong FROM i GROUP BY 1),
m AS (SELECT o_orderkey AS id, o_custkey % 24 AS expected, coalesce(actual, 0) AS actual, coalesce(wrong, 0) AS wrong FROM orders LEFT JOIN s ON o_orderkey = id),
e AS (SELECT *, wrong + (abs(actual - expected) > greatest(2, floor(expected * 0.15)))::INTEGER AS n_errors FROM m) SELECT id, expected, actual, n_errors::BIGINT AS n_errors, n_errors = 0 AS valid FROM e""")
def blueprint_check(spark, sf_dir):
    q = items(spark, sf_dir).select("id", F.when(F.col("p") % 2 == 0, "mcq").otherwise("essay").alias("type"), (F.col("s") % 6).alias("n_options"), F.when(F.col("s") % 4 > 0, "A").alias("answer"))
    return structure.blueprint_check(q, read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 24).alias("expected")))


SUBJECTS = ("ENGLISH", "MATHEMATICS", "GENERAL")
KINDS = [name for name, _ in structure.EXAM_TYPES]
FIRST_SQL = " ".join(f"WHEN list_contains(c, '{name}') THEN '{name}'" for name in KINDS)
IMPLIED_SQL = " ".join(f"WHEN '{name}' THEN '{implied}'" for name, implied in structure.EXAM_TYPES if implied)


@query(f"""WITH d AS (SELECT o_orderkey AS id, {list(SUBJECTS)}[o_custkey % 3 + 1] AS subject, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [{KINDS}[o_orderkey % 12 + 1], {KINDS}[o_custkey % 12 + 1]] END AS c,
  o_orderkey % 17 = 0 AS lesson, o_custkey % 13 = 0 AS contract, o_custkey % 2 = 0 AS asks FROM orders), e AS (SELECT *, CASE {FIRST_SQL} END AS k FROM d)
SELECT id, CASE WHEN lesson THEN 'LESSON_PLAN' WHEN contract THEN 'ADMIN_CONTRACT' WHEN k IS NOT NULL OR asks THEN 'EXAM_TEST' ELSE 'GENERAL_DOCUMENT' END AS category,
  CASE WHEN lesson OR contract THEN 'NOT_AN_EXAM' WHEN k IS NOT NULL THEN k WHEN asks AND subject = 'ENGLISH' THEN 'SPECIALIZED_ENGLISH' WHEN asks THEN 'GENERAL_ESSAY' ELSE 'NOT_AN_EXAM' END AS exam_type,
  CASE WHEN lesson THEN subject WHEN contract THEN 'NON_ACADEMIC' ELSE coalesce(CASE k {IMPLIED_SQL} END, subject) END AS subject FROM e""")
def document_kind(spark, sf_dir):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    candidates = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(KINDS, "o_orderkey"), pick(KINDS, "o_custkey")))
    kind = structure.document_kind(candidates, F.col("o_orderkey") % 17 == 0, F.col("o_custkey") % 13 == 0, pick(SUBJECTS, "o_custkey"), F.col("o_custkey") % 2 == 0)
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *kind)


ASKED = "large bolt 12 hsg"
SYNONYMS = {"BRAND#13": ("widget", "tool"), "BRAND#19": ("bolt", "nut")}
LIKE_SQL = "1.0::DOUBLE - levenshtein(q, t) / greatest(length(q), length(t))::DOUBLE"


@query(f"""WITH d AS (SELECT p_partkey AS id, upper(p_brand) AS s, lower(p_name) AS t, lower(p_type) AS f, 'hsg ' || p_size AS l, '{ASKED}' AS q FROM part),
x AS (SELECT *, concat_ws(' ', t, f, lower(s), CASE s WHEN 'BRAND#13' THEN 'widget tool' WHEN 'BRAND#19' THEN 'bolt nut' ELSE '' END, l) AS a FROM d),
z AS (SELECT id, t, round((s = 'BRAND#19')::INTEGER * 120 + (contains(l, '12') OR contains(t, '12') OR contains(f, '12'))::INTEGER * 60 + 50 + contains(a, q)::INTEGER * 80
  + (contains(a, 'large')::INTEGER + contains(a, 'bolt')::INTEGER + contains(a, '12')::INTEGER + contains(a, 'hsg')::INTEGER) * 25 + CASE WHEN {LIKE_SQL} > 0.35 THEN ({LIKE_SQL}) * 40 ELSE 0 END, 6)::DOUBLE AS score FROM x)
SELECT id, score FROM (SELECT id, score, row_number() OVER (PARTITION BY t ORDER BY score DESC, id DESC) AS r FROM z) WHERE r = 1 ORDER BY score DESC, id DESC LIMIT 10""")
def rule_search(spark, sf_dir):
    """The top ten parts of different names for a query, by points."""
    d = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.concat(F.lit("hsg "), "p_size").alias("level"), F.col("p_name").alias("title"), F.col("p_type").alias("file_name")
    )
    return structure.rule_search(d, structure.rule_score(ASKED, SYNONYMS), F.lower("title"), 10)


def arrivals(spark, sf_dir):
    return windows.read_stream(spark, f"{sf_dir}/event[s].parquet", read_table(spark, sf_dir, "events"))


@query("""SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def stream_poll(spark, sf_dir):
    """The first event of each user, by a stream that drops keys it has met in any batch."""
    return windows.poll_new(arrivals(spark, sf_dir), "user_id", ("ts", "event_id"), "poll").select("user_id", "event_id")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)""")
def stream_deletes(spark, sf_dir):
    """Customers that no event of a stream of deletions names."""
    gone = arrivals(spark, sf_dir).filter("event_type = 'error'").select("user_id")
    archive = read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    return windows.without_deleted(archive, gone, "user_id", "deletes").select(F.col("user_id").alias("c_custkey"), "c_name")


def intake_rounds(spark, sf_dir):
    """Events served in rounds of six hours, three of a type and eight in all for each group of users. SQL can't carry a line from
    round to round; it is tested against a plain run, with restarts."""
    items = arrivals(spark, sf_dir).select((F.col("user_id") % 5).alias("shard"), F.col("event_type").alias("source"), F.col("event_id").alias("item"), "ts")
    return windows.run_available(intake.rounds(items, "shard", 6 * 3600, 3, 8, "0 seconds"), "intake", "append")


QUERIES["intake_rounds"] = intake_rounds
