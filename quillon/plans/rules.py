"""Queries of the platform's rules, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.sources.session import read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


CONTEST_NAMES = ("Round Div. 4", "Round Div. 3", "Round Div. 2", "Round Div. 1", "Educational Round", "Weekly Practice", "ICPC Regional", "Global Round")


def ladder_sql() -> str:
    case = ""
    for words, table, step, most in rules.DIVISIONS:
        value = f"coalesce({list(table)}[o + 1], least({most}, {table[-1]} + (o - {len(table)} + 1) * {step}))"
        case += f" WHEN {any_sql('low', words)} THEN {value}" if words else f" ELSE {value}"
    return f"CASE{case} END"


@query(f"""WITH p AS (SELECT p_partkey, {list(CONTEST_NAMES)}[p_partkey % 8 + 1] AS name, chr((65 + p_size % 12)::INTEGER) AS letter, (800 + p_size * 40)::INTEGER AS r FROM part),
q AS (SELECT *, lower(name) AS low, p_partkey IS NOT NULL AS t, ascii(letter) - 65 AS o FROM p)
SELECT p_partkey, {ladder_sql()}::INTEGER AS estimated, CASE WHEN {any_sql("low", rules.EVENT_WORDS)} OR r >= 2000 THEN
  CASE WHEN {any_sql("low", ("icpc", "huawei"))} OR r >= 2400 THEN 1.75 WHEN {any_sql("low", ("global", "championship"))} OR r >= 2100 THEN 1.5 WHEN r >= 1800 OR {any_sql("low", ("pinely", "codeton"))} THEN 1.35 ELSE 1.2 END ELSE 1.0 END::DOUBLE AS multiplier FROM q""")
def problem_ladder(spark, sf_dir):
    """The rating to expect of a problem and its event multiplier, one contest name a part."""
    name = F.element_at(F.array(*map(F.lit, CONTEST_NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    letter = F.char(65 + F.col("p_size") % 12)
    return read_table(spark, sf_dir, "part").select("p_partkey", rules.problem_rating(name, letter).alias("estimated"), rules.event_multiplier(name, 800 + F.col("p_size") * 40).alias("multiplier"))


@query("""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x, (conv_id * 7 + turn * 3) % 12 AS s, (conv_id * 13 + turn) % 101 AS ai, (conv_id * 5 + turn * 11) % 101 AS pl FROM conversations),
r AS (SELECT *, s > 0 AND s < 7.5 AND (length(x) >= 180 OR len(list_filter(string_split_regex(x, '\\r\\n|[\\r\\n]'), lambda l: regexp_matches(l, '\\S'))) >= 10) AS rapid FROM c)
SELECT conv_id, turn, rapid, CASE WHEN ai >= 80 OR pl >= 85 OR (rapid AND (ai >= 50 OR pl >= 65)) THEN 'CHEATING_DETECTED' WHEN ai >= 55 OR pl >= 65 OR rapid THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict FROM r""")
def fair_play(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    rapid = rules.rapid_paste(F.col("text"), (F.col("conv_id") * 7 + F.col("turn") * 3) % 12)
    c = c.select("conv_id", "turn", rapid.alias("rapid"))
    return c.withColumn("verdict", rules.fair_play((F.col("conv_id") * 13 + F.col("turn")) % 101, (F.col("conv_id") * 5 + F.col("turn") * 11) % 101, F.col("rapid")))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS a FROM conversations),
p AS (SELECT x.conv_id, x.turn, x.a AS a, y.a AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
g AS (SELECT *, len(a) >= 3 AND len(b) >= 3 AS l, list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || chr(31) || a[i + 1] || chr(31) || a[i + 2])) AS ga, list_distinct(list_transform(range(1, len(b) - 1), lambda i: b[i] || chr(31) || b[i + 1] || chr(31) || b[i + 2])) AS gb FROM p),
h AS (SELECT *, CASE WHEN l THEN ga ELSE list_distinct(a) END AS u, CASE WHEN l THEN gb ELSE list_distinct(b) END AS v FROM g), i AS (SELECT *, len(list_intersect(u, v)) AS k FROM h)
SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 WHEN a = b THEN 100.0 ELSE least(100.0, round(greatest(k / (len(u) + len(v) - k)::DOUBLE * 100.0, len(list_filter(a, lambda x: list_contains(b, x))) / len(a)::DOUBLE * 75.0), 1)) END::DOUBLE AS similarity FROM i""")
def token_similarity(spark, sf_dir):
    """A message against the next one of its conversation."""
    t = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split("text", " "), lambda w: w != "").alias("a"))
    following = t.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("before"), F.col("a").alias("b"))
    met = t.join(following, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("before")))
    return met.select("conv_id", "turn", rules.token_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, (800 + l_partkey % 2000)::DOUBLE AS o, (800 + l_suppkey * 37 % 2000)::DOUBLE AS x, l_linenumber % 3 AS a, (l_partkey % 3)::INTEGER AS b FROM lineitem),
p AS (SELECT *, greatest(0.01, least(0.99, 1.0 / (1.0 + power(10.0::DOUBLE, (x - o) / 400.0))))::DOUBLE AS p FROM m)
SELECT l_orderkey, l_linenumber, count(*) AS n, sum(CASE WHEN a <= 0 THEN 0.0 WHEN b <= 0 THEN 100.0 ELSE round(greatest(1.0, least(99.0, CASE WHEN a = 2 AND b = 1 THEN 1 - (1 - p) * (1 - p) WHEN a = 1 AND b = 2 THEN p * p ELSE p END * 100.0)), 1) END::DECIMAL(9, 1))::DOUBLE AS chances FROM p GROUP BY 1, 2""")
def win_chances(spark, sf_dir):
    """Chances of duels with lives, summed by the key of a line item."""
    own, other = (800 + F.col("l_partkey") % 2000).cast("double"), (800 + F.col("l_suppkey") * 37 % 2000).cast("double")
    chance = rules.win_chances(own, other, F.col("l_linenumber") % 3, F.col("l_partkey") % 3)
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(chance.cast("decimal(9,1)")).cast("double").alias("chances"))


TOPICS = ("Toán lớp 9", "IELTS 7.0", "Python cơ bản", "HSG Lý", "Olympic Tin", "Lịch sử")


@query(f"""WITH o AS (SELECT o_orderkey, ['Ngắn', 'Vừa', 'Dài', 'To', '?'][o_orderkey % 5 + 1] AS l, ['Lite', 'Flash', 'Pro', 'Max', 'Ultra', '?'][o_custkey % 6 + 1] AS m, lower({list(TOPICS)}[o_orderkey % 6 + 1]) AS s, (o_orderkey % 6)::INTEGER AS k FROM orders)
SELECT o_orderkey, round_even(CASE l WHEN 'Ngắn' THEN 10 WHEN 'Vừa' THEN 20 WHEN 'Dài' THEN 35 WHEN 'To' THEN 60 ELSE 10 END * CASE m WHEN 'Flash' THEN 1.5 WHEN 'Pro' THEN 2.0 WHEN 'Max' THEN 3.0 WHEN 'Ultra' THEN 4.0 ELSE 1.0 END::DOUBLE
  * CASE WHEN {any_sql("s", rules.INTERNATIONAL_WORDS)} THEN 1.4 WHEN {any_sql("s", rules.ADVANCED_WORDS)} THEN 1.2 ELSE 1.0 END::DOUBLE, 0)::INTEGER AS cost, {list(rules.TRUE_FALSE_POINTS)}[least(k, 4) + 1]::DOUBLE AS points FROM o""")
def token_costs(spark, sf_dir):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    cost = rules.token_cost(pick(("Ngắn", "Vừa", "Dài", "To", "?"), "o_orderkey"), pick(("Lite", "Flash", "Pro", "Max", "Ultra", "?"), "o_custkey"), pick(TOPICS, "o_orderkey"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", cost.alias("cost"), rules.true_false_points(F.col("o_orderkey") % 6).alias("points"))


@query("""WITH x AS (SELECT user_id, count(*) * 35 AS xp FROM events GROUP BY 1)
SELECT user_id, xp, CASE WHEN xp >= 3000 THEN 6 WHEN xp >= 1500 THEN 5 WHEN xp >= 700 THEN 4 WHEN xp >= 300 THEN 3 WHEN xp >= 100 THEN 2 ELSE 1 END AS level,
  CASE WHEN xp >= 3000 THEN 5000 WHEN xp >= 1500 THEN 3000 WHEN xp >= 700 THEN 1500 WHEN xp >= 300 THEN 700 WHEN xp >= 100 THEN 300 ELSE 100 END AS next_xp,
  CASE WHEN xp >= 3000 THEN least(100, (xp - 3000) // 20) WHEN xp >= 1500 THEN (xp - 1500) * 100 // 1500 WHEN xp >= 700 THEN (xp - 700) * 100 // 800 WHEN xp >= 300 THEN (xp - 300) * 100 // 400 WHEN xp >= 100 THEN (xp - 100) * 100 // 200 ELSE xp END AS progress FROM x""")
def study_ranks(spark, sf_dir):
    xp = read_table(spark, sf_dir, "events").groupBy("user_id").agg((F.count(F.lit(1)) * 35).alias("xp"))
    return xp.select("user_id", "xp", *rules.study_rank(F.col("xp")))


@query("""WITH s AS (SELECT doc_id, (n_chars * n_chars * 37)::BIGINT AS b FROM documents), u AS (SELECT *, (b >= 1024)::INTEGER + (b >= 1048576)::INTEGER + (b >= 1073741824)::INTEGER + (b >= 1099511627776)::INTEGER AS p FROM s)
SELECT doc_id, CASE WHEN b <= 0 THEN '0 B' ELSE round(b / power(1024.0::DOUBLE, p), 2)::DOUBLE::VARCHAR || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] END AS size_text FROM u""")
def size_texts(spark, sf_dir):
    b = F.col("n_chars") * F.col("n_chars") * 37
    return read_table(spark, sf_dir, "documents").select("doc_id", rules.bytes_text(b).alias("size_text"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_name WHEN c_nationkey % 2 = 1 THEN c_mktsegment ELSE 'member' END AS name FROM customer""")
def display_names(spark, sf_dir):
    first = F.when(F.col("c_custkey") % 3 == 1, F.col("c_name")).when(F.col("c_custkey") % 3 == 2, "")
    second = F.when(F.col("c_nationkey") % 2 == 1, F.col("c_mktsegment")).otherwise("")
    return read_table(spark, sf_dir, "customer").select("c_custkey", rules.display_name(first, second, default="member").alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '2030-2031' WHEN o_orderkey % 4 = 1 THEN NULL ELSE (year(o_orderdate) + 20) || '-' || (year(o_orderdate) + 21) END AS academic_year FROM orders""")
def academic_years(spark, sf_dir):
    year = F.year("o_orderdate") + 20
    text = F.when(F.col("o_orderkey") % 4 == 1, "no year").otherwise(F.concat(F.lit("HK1 năm học "), year.cast("string"), F.lit(" - "), (year + 1).cast("string"), F.lit(" | x")))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", rules.academic_year(F.when(F.col("o_orderkey") % 4 == 0, "2030-2031").otherwise(""), text).alias("academic_year"))


GRADES = ("GRADE_12", "GRADE_9", "MIDDLE_SCHOOL", "UNIVERSITY", "OLYMPIAD_GIFTED", "NANG CAO")


@query("""WITH d AS (SELECT o_custkey % 13 AS n, CASE o_orderkey % 5 WHEN 0 THEN 'THCS' WHEN 1 THEN 'Lớp ' || (o_custkey % 13) WHEN 2 THEN 'Chuyên' WHEN 3 THEN 'Nang cao' END AS lv, 'Đề lớp ' || (o_custkey % 13) AS title FROM orders),
x AS (SELECT coalesce(lower(lv), '') AS l, lower(title) AS t FROM d)
SELECT 'GRADE_12' AS grade, count(*) FILTER (contains(l, '12') OR contains(t, '12')) AS n FROM x UNION ALL SELECT 'GRADE_9', count(*) FILTER (contains(l, '9') OR contains(t, 'lớp 9') OR contains(t, 'lop 9')) FROM x
UNION ALL SELECT 'MIDDLE_SCHOOL', count(*) FILTER (contains(l, 'thcs') OR contains(l, 'cấp 2') OR contains(t, 'thcs')) FROM x UNION ALL SELECT 'UNIVERSITY', count(*) FILTER (contains(l, 'đại học') OR contains(t, 'đại học')) FROM x
UNION ALL SELECT 'OLYMPIAD_GIFTED', count(*) FILTER (contains(l, 'chuyên') OR contains(l, 'hsg') OR contains(l, 'olympic')) FROM x UNION ALL SELECT 'NANG CAO', count(*) FILTER (contains(l, 'nang cao') OR contains(t, 'nang cao')) FROM x""")
def grade_facets(spark, sf_dir):
    n = (F.col("o_custkey") % 13).cast("string")
    level = F.when(F.col("o_orderkey") % 5 == 0, "THCS").when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("Lớp "), n)).when(F.col("o_orderkey") % 5 == 2, "Chuyên").when(F.col("o_orderkey") % 5 == 3, "Nang cao")
    d = read_table(spark, sf_dir, "orders").select(level.alias("level"), F.concat(F.lit("Đề lớp "), n).alias("title"))
    counts = d.agg(*[F.count(F.when(rules.grade_matches(g, F.col("level"), F.col("title")), 1)).alias(g) for g in GRADES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(g).alias("grade"), F.col(f"`{g}`").alias("n")) for g in GRADES])).alias("x")).select("x.*")


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality NOT IN (1)""")
def unverified_docs(spark, sf_dir):
    """Documents without a status, or with one that isn't among the settled ones."""
    status = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"), "quality")
    met = read_table(spark, sf_dir, "documents").join(status, F.col("doc_id") == F.col("of"), "left")
    return met.filter(F.col("quality").isNull() | ~F.col("quality").isin(1)).select("doc_id")


@query("""WITH m AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 50 AS p1, l_suppkey % 50 AS p2, l_quantity AS s1, l_tax * 500 AS s2, l_shipdate AS at FROM lineitem WHERE l_returnflag = 'N'),
u AS (SELECT p1 AS player, p2 AS opponent, CASE WHEN s1 > s2 THEN 'win' WHEN s1 < s2 THEN 'loss' ELSE 'draw' END AS outcome FROM m UNION ALL SELECT p2, p1, CASE WHEN s2 > s1 THEN 'win' WHEN s2 < s1 THEN 'loss' ELSE 'draw' END FROM m WHERE p1 <> p2)
SELECT player, count(*) AS n, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(DISTINCT opponent) AS opponents FROM u GROUP BY 1""")
def player_records(spark, sf_dir):
    """Finished matches from either player's side, with the outcome as that player sees it."""
    m = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select((F.col("l_partkey") % 50).alias("p1"), (F.col("l_suppkey") % 50).alias("p2"), F.col("l_quantity").alias("s1"), (F.col("l_tax") * 500).alias("s2"))
    side = lambda p, o, s, t: F.struct(F.col(p).alias("player"), F.col(o).alias("opponent"), F.when(F.col(s) > F.col(t), "win").when(F.col(s) < F.col(t), "loss").otherwise("draw").alias("outcome"))
    both = F.when(F.col("p1") != F.col("p2"), F.array(side("p1", "p2", "s1", "s2"), side("p2", "p1", "s2", "s1"))).otherwise(F.array(side("p1", "p2", "s1", "s2")))
    rows = m.select(F.explode(both).alias("x")).select("x.*")
    return rows.groupBy("player").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("outcome") == "win", 1)).alias("wins"), F.count(F.when(F.col("outcome") == "loss", 1)).alias("losses"), F.countDistinct("opponent").alias("opponents"))


MODES = {"overall": ("(rating + ranked) / 2.0", "rating"), "ranked": ("ranked", "wins"), "score": ("score", "solved"), "rating": ("rating", "solved")}


@query("""WITH u AS (SELECT c_custkey AS id, 1000 + floor(c_acctbal)::BIGINT % 1500 AS rating, 900 + c_custkey * 7 % 1200 AS ranked, c_custkey % 17 AS wins, floor(c_acctbal * 2)::BIGINT AS score, c_custkey % 23 AS solved FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey >= 10 AND c_custkey <> 77),
r AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS mode, id, row_number() OVER (ORDER BY {k} DESC, {s} DESC, id) AS place, count(*) OVER () AS total FROM u" for m, (k, s) in MODES.items()) + """) SELECT mode, id, place, total FROM r WHERE place BETWEEN 11 AND 20""")
def leaderboard_modes(spark, sf_dir):
    """The second page of ten in each of four orders, without retired members, reserved ids and the owner."""
    who = read_table(spark, sf_dir, "customer").filter("c_mktsegment <> 'FURNITURE' AND c_custkey >= 10 AND c_custkey <> 77")
    u = who.select(
        F.col("c_custkey").alias("id"), (1000 + F.floor("c_acctbal") % 1500).alias("rating"), (900 + F.col("c_custkey") * 7 % 1200).alias("ranked"),
        (F.col("c_custkey") % 17).alias("wins"), F.floor(F.col("c_acctbal") * 2).alias("score"), (F.col("c_custkey") % 23).alias("solved"),
    )
    total = u.agg(F.count(F.lit(1)).alias("total"))
    out = None
    for mode, (key, second) in MODES.items():
        order = [F.expr(key).desc(), F.col(second).desc(), F.col("id").asc()]
        page = u.orderBy(*order).limit(20).withColumn("place", F.row_number().over(Window.orderBy(*order))).filter("place > 10")
        rows = page.select(F.lit(mode).alias("mode"), "id", F.col("place").cast("long").alias("place"))
        out = rows if out is None else out.unionAll(rows)
    return out.crossJoin(F.broadcast(total))  # one row


@query("""WITH d AS (SELECT DISTINCT user_id, (ts + INTERVAL 7 HOURS)::DATE AS day FROM events), t AS (SELECT max(day) AS today FROM d), g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS island FROM d),
r AS (SELECT user_id, island, count(*) AS n, max(day) AS last FROM g GROUP BY 1, 2)
SELECT user_id, arg_max(n, last) AS last_streak, max(n) AS longest, CASE WHEN max(last) >= (SELECT today FROM t) - 1 THEN arg_max(n, last) ELSE 0 END AS shown FROM r GROUP BY 1""")
def active_streaks(spark, sf_dir):
    """The streak to show is the last one if it reaches yesterday or today, else 0."""
    d = read_table(spark, sf_dir, "events").select("user_id", F.to_date(F.col("ts") + F.expr("INTERVAL 7 HOURS")).alias("day")).distinct()
    today = d.agg(F.max("day").alias("today"))
    runs = d.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"))
    per = runs.groupBy("user_id").agg(F.max_by("n", "last").alias("last_streak"), F.max("n").alias("longest"), F.max("last").alias("last"))
    return per.crossJoin(F.broadcast(today)).select("user_id", "last_streak", "longest", F.when(F.datediff("today", "last") <= 1, F.col("last_streak")).otherwise(0).alias("shown"))


@query("""WITH u AS (SELECT user_id, max((ts + INTERVAL 7 HOURS)::DATE) AS last, count(*) AS n FROM events GROUP BY 1), d AS (SELECT user_id, (ts + INTERVAL 7 HOURS)::DATE AS day, count(*) AS k FROM events GROUP BY 1, 2)
SELECT u.user_id, u.last < DATE '2024-01-30' AS new_day, CASE WHEN u.last = DATE '2024-01-30' THEN d.k ELSE 0 END AS used, greatest(0, 3 - CASE WHEN u.last = DATE '2024-01-30' THEN d.k ELSE 0 END) AS remaining FROM u JOIN d ON u.user_id = d.user_id AND u.last = d.day""")
def daily_quota(spark, sf_dir):
    """What is left of three uses a day on the 30th; what was used on another day counts no more."""
    today = F.lit("2024-01-30").cast("date")
    e = read_table(spark, sf_dir, "events").select("user_id", F.to_date(F.col("ts") + F.expr("INTERVAL 7 HOURS")).alias("day"))
    days = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("k"))
    last = days.groupBy("user_id").agg(F.max_by("k", "day").alias("k"), F.max("day").alias("last"))
    used = F.when(F.col("last") == today, F.col("k")).otherwise(0)
    return last.select("user_id", (F.col("last") < today).alias("new_day"), used.alias("used"), F.greatest(F.lit(0), 3 - used).alias("remaining"))


@query("""SELECT count(*) AS n_chunks, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT source) AS n_sources, (SELECT count(DISTINCT props) FROM events) AS n_entries, (SELECT sum(value)::DECIMAL(18, 2) FROM (SELECT value::DECIMAL(18, 2) AS value FROM events))::DOUBLE AS n_hits FROM documents""")
def store_stats(spark, sf_dir):
    """Totals of the knowledge base and of the cache, one row."""
    base = read_table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_chars").alias("n_chars"), F.countDistinct("source").alias("n_sources"))
    cache = read_table(spark, sf_dir, "events").agg(F.countDistinct("props").alias("n_entries"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("n_hits"))
    return base.crossJoin(F.broadcast(cache))


@query("""WITH j AS (SELECT d.n_chars > 1000 AS s, l.quality = 1 AS c, l.toxic = 0 AS p, d.lang = 'en' AS q FROM documents d JOIN labels l USING (doc_id)), a AS (SELECT avg(s::INTEGER) AS s, avg(c::INTEGER) AS c, avg(p::INTEGER) AS p, avg(q::INTEGER) AS q FROM j)
SELECT round(s * 100, 1) AS subject, round(c * 100, 1) AS category, round(p * 100, 1) AS spoof, round(q * 100, 1) AS questions, round(1 - (0.45::DOUBLE * s + 0.25::DOUBLE * c + 0.20::DOUBLE * p + 0.10::DOUBLE * q), 4) AS loss FROM a""")
def epoch_loss(spark, sf_dir):
    """Accuracies of four checks and their weighted loss."""
    j = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    checks = {"subject": F.col("n_chars") > 1000, "category": F.col("quality") == 1, "spoof": F.col("toxic") == 0, "questions": F.col("lang") == "en"}
    a = j.agg(*[F.avg(c.cast("int")).alias(k) for k, c in checks.items()])
    loss = 1 - sum((F.col(k) * w for k, w in zip(checks, (0.45, 0.25, 0.20, 0.10), strict=True)), F.lit(0.0))
    return a.select(*[F.round(F.col(k) * 100, 1).alias(k) for k in checks], F.round(loss, 4).alias("loss"))


@query("""WITH a AS (SELECT l_orderkey AS s, l_linenumber AS n, min(l_partkey) % 4 AS k, min(l_suppkey) % 4 AS g FROM lineitem GROUP BY 1, 2)
SELECT s AS session, count(*) FILTER (substr('ABCD', k::INTEGER + 1, 1) = substr('ABCD', g::INTEGER + 1, 1)) AS n_right, [0.0, 0.1, 0.25, 0.5, 1.0][least(4, count(*) FILTER (k = g)) + 1]::DOUBLE AS points FROM a GROUP BY 1""")
def map_grades(spark, sf_dir):
    """Maps of given answers against maps of keys, a session each."""
    items = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    letter = lambda c: F.element_at(F.array(*map(F.lit, "ABCD")), (F.col(c) % 4 + 1).cast("int"))
    of = lambda v: F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), v)))
    maps = items.groupBy("session").agg(of(F.concat(F.lit(" "), F.lower(letter("s")))).alias("given"), of(letter("p")).alias("keys"))
    right = maps.select("session", rules.matching_answers(F.col("given"), F.col("keys")).cast("long").alias("n_right"))
    return right.withColumn("points", rules.true_false_points(F.col("n_right")))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE regexp_extract(props, '([0-9]+)', 1)::BIGINT END AS k, coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE regexp_extract(props, '([0-9]+)', 1)::BIGINT END, -1) AS k_or_default FROM events""")
def json_headers(spark, sf_dir):
    """A field of a JSON column; what doesn't parse has none."""
    broken = F.when(F.col("event_id") % 9 == 0, F.lit("{not json")).otherwise(F.col("props"))
    k = F.from_json(broken, "k bigint")["k"]
    return read_table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k, F.lit(-1)).alias("k_or_default"))


@query("""WITH c AS (SELECT conv_id, turn, text || repeat(' <@' || (1000 + conv_id) || '>', (turn % 7)::INTEGER) || CASE WHEN conv_id % 5 = 0 THEN ' @here' ELSE '' END || CASE WHEN conv_id % 4 = 0 THEN ' https://Discord.gg/abc1' ELSE '' END AS x, conv_id % 5 = 0 OR turn % 7 > 4 AS m, conv_id % 4 = 0 AS i FROM conversations)
SELECT conv_id, turn, m AS mass_mention, i AS invite FROM c""")
def message_violations(spark, sf_dir):
    tail = lambda c, n, s: F.when(F.col(c) % n == 0, s).otherwise("")
    calls = F.repeat(F.concat(F.lit(" <@"), (1000 + F.col("conv_id")).cast("string"), F.lit(">")), (F.col("turn") % 7).cast("int"))
    x = F.concat(F.col("text"), calls, tail("conv_id", 5, " @here"), tail("conv_id", 4, " https://Discord.gg/abc1"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.mass_mention(x).alias("mass_mention"), rules.has_invite(x).alias("invite"))


@query("""WITH c AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS a, list_sort(list_distinct(list(o_orderstatus))) AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_distinct(a || b || ['F'])), ',') AS codes, len(list_distinct(a || b || ['F'])) AS n_codes FROM c""")
def code_unions(spark, sf_dir):
    sets = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set("o_orderstatus").alias("b"))
    union = F.array_union(F.array_union("a", "b"), F.array(F.lit("F")))
    return sets.select("o_custkey", F.array_join(F.array_sort(union), ",").alias("codes"), F.size(union).cast("long").alias("n_codes"))


@query("""SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'MACHINERY', lower(c_name), c_custkey) AS place FROM customer""")
def member_order(spark, sf_dir):
    """Members in order of name within their group, bots after the others."""
    line = Window.partitionBy("c_nationkey").orderBy(F.col("c_mktsegment") == "MACHINERY", F.lower("c_name"), "c_custkey")
    return read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(line).cast("long").alias("place"))


LABELS = {"signup": "Joined", "purchase": "Bought", "error": "Failed"}


@query(f"""SELECT event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} ELSE coalesce(event_type, 'Unknown') END AS label FROM events""")
def status_labels(spark, sf_dir):
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return read_table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(table, F.col("event_type")), F.col("event_type"), F.lit("Unknown")).alias("label"))


@query("""WITH d AS (SELECT doc_id, ['ADMIN_CONTRACT', 'LESSON_PLAN', 'THEORY_SYLLABUS', 'GENERAL_DOCUMENT', 'EXAM_PAPER', 'EXAM_PAPER', 'EXAM_PAPER'][doc_id % 7 + 1] AS cat, (n_chars % 11)::INTEGER AS q, (n_chars % 5)::INTEGER AS a, (n_chars % 3)::INTEGER AS h, (n_chars % 100) / 10.0::DOUBLE AS s,
  doc_id % 29 = 0 AS qt, doc_id % 13 = 0 AS ch, doc_id % 11 = 0 AS cy, doc_id % 6 = 0 AS hs, doc_id % 2 = 0 AS th, doc_id % 31 = 0 AS comp, doc_id % 37 = 0 AS oly, ['ENGLISH', 'CHINESE', 'KOREAN', 'RUSSIAN', 'JAPANESE', 'PHYSICS'][doc_id % 6 + 1] AS subj, CASE WHEN doc_id % 4 = 0 THEN 'UNKNOWN' ELSE 'GRADE_12' END AS g FROM documents),
t AS (SELECT *, CASE WHEN qt AND cat NOT IN ('ADMIN_CONTRACT', 'LESSON_PLAN') THEN 'QUOC_TE' WHEN cat IN ('ADMIN_CONTRACT', 'LESSON_PLAN', 'THEORY_SYLLABUS') THEN 'CHUNG' WHEN ch AND NOT cy AND NOT hs THEN 'CHUNG' WHEN q = 0 AND cat = 'GENERAL_DOCUMENT' AND NOT comp THEN 'CHUNG'
  WHEN comp OR oly OR (cy AND NOT th) OR s >= 8.3 OR h / greatest(1, q)::DOUBLE >= 0.35 THEN 'CHUYEN' WHEN hs AND NOT cy THEN 'HSG' WHEN s >= 6.2 AND ((a + h) / greatest(1, q)::DOUBLE >= 0.45 OR h / greatest(1, q)::DOUBLE >= 0.2) AND NOT (th AND s < 7.0) THEN 'HSG' ELSE 'THUONG' END AS track FROM d)
SELECT doc_id, track, CASE subj """ + " ".join(f"WHEN '{k}' THEN CASE WHEN track IN ('CHUYEN', 'HSG', 'QUOC_TE') OR g = 'OLYMPIAD_GIFTED' THEN '{a}' WHEN track = 'THUONG' AND g <> 'UNKNOWN' THEN '{b}' ELSE '{c}' END" for k, (a, b, c) in rules.BANDS.items()) + """ END AS band FROM t""")
def exam_tracks(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    hits = {"QUOC_TE": i % 29 == 0, "CHUNG": i % 13 == 0, "CHUYEN": i % 11 == 0, "HSG": i % 6 == 0, "THUONG": i % 2 == 0}
    category = pick(("ADMIN_CONTRACT", "LESSON_PLAN", "THEORY_SYLLABUS", "GENERAL_DOCUMENT", "EXAM_PAPER", "EXAM_PAPER", "EXAM_PAPER"))
    n = F.col("n_chars")
    track = rules.exam_track(hits, category, n % 11, i % 31 == 0, i % 37 == 0, (n % 100) / 10.0, n % 5, n % 3)
    d = read_table(spark, sf_dir, "documents").select("doc_id", track.alias("track"))
    subject = pick(("ENGLISH", "CHINESE", "KOREAN", "RUSSIAN", "JAPANESE", "PHYSICS"))
    return d.withColumn("band", rules.language_band(subject, F.col("track"), F.when(i % 4 == 0, "UNKNOWN").otherwise("GRADE_12")))


@query("""WITH d AS (SELECT doc_id, (n_chars % 41 + 60) / 100.0::DOUBLE AS a, (doc_id % 31 + 70) / 100.0::DOUBLE AS b, (n_chars % 17 + 50) / 100.0::DOUBLE AS c, doc_id % 7 = 0 AS e, doc_id % 23 = 0 AS f FROM documents)
SELECT doc_id, CASE WHEN (a + b + c + 0.95::DOUBLE) / 4 >= 0.82 AND least(a, b, c, 0.95) >= 0.60 AND NOT e THEN 'high' WHEN (a + b + c + 0.95::DOUBLE) / 4 >= 0.55 AND NOT f THEN 'medium' ELSE 'low' END AS level FROM d""")
def confidence_levels(spark, sf_dir):
    n, i = F.col("n_chars"), F.col("doc_id")
    dims = [(n % 41 + 60) / 100.0, (i % 31 + 70) / 100.0, (n % 17 + 50) / 100.0, F.lit(0.95)]
    return read_table(spark, sf_dir, "documents").select("doc_id", rules.confidence_level(dims, (i % 7 == 0).cast("int"), (i % 23 == 0).cast("int")).alias("level"))


TERMS = {"the": 2.0, "und": 1.5, "que": 1.0, "tion": 0.5}
COUNT_SQL = "len(regexp_extract_all({}, '{}'))"


@query("WITH d AS (SELECT doc_id, lower(substr(text, 1, 300)) AS h, lower(substr(text, 301)) AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(" + " + ".join(
    f"least({COUNT_SQL.format('h', t)}, 3) * 3.5::DOUBLE * {w} + CASE WHEN {COUNT_SQL.format('b', t)} > 0 THEN {w} * (1 + ln(1 + {COUNT_SQL.format('b', t)})) ELSE 0 END::DOUBLE" for t, w in TERMS.items()) + ", 6) AS score FROM d")
def zone_scores(spark, sf_dir):
    """Terms in the head of a document (its first 300 characters, as the rule has it) and in all the rest."""
    low = F.lower("text")
    d = read_table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.round(rules.zone_score(F.substring(low, 1, 300), F.expr("lower(substring(text, 301))"), TERMS), 6).alias("score"))


CLAIMS = (("thuat_toan", "INFORMATICS"), ("python", "INFORMATICS"), ("toan", "MATHEMATICS"), ("math", "MATHEMATICS"), ("ly", "PHYSICS"), ("hoa", "CHEMISTRY"), ("ielts", "ENGLISH"), ("hsk", "CHINESE"))
FILES = ("De_toan_12.pdf", "thuat_toan.docx", "IELTS-Cam18.pdf", "on tap.pdf", "hsk4_math.pdf", "family.pdf")


@query("""WITH o AS (SELECT o_orderkey, ['MATHEMATICS', 'INFORMATICS', 'MATHEMATICS', NULL, 'MATHEMATICS', NULL][o_orderkey % 6 + 1] AS c0, o_orderkey % 6 AS f, ['MATHEMATICS', 'ENGLISH', 'GENERAL'][o_custkey % 3 + 1] AS actual FROM orders),
c AS (SELECT *, CASE WHEN f = 2 THEN 'ENGLISH' ELSE c0 END AS claimed FROM o) SELECT o_orderkey, claimed, coalesce(actual <> 'GENERAL' AND claimed <> actual, false) AS spoofed FROM c""")
def spoofed_names(spark, sf_dir):
    """File names that claim another subject than the text has."""
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", rules.claimed(pick(FILES, "o_orderkey"), CLAIMS).alias("claimed"), pick(("MATHEMATICS", "ENGLISH", "GENERAL"), "o_custkey").alias("actual"))
    return o.select("o_orderkey", "claimed", F.coalesce((F.col("actual") != "GENERAL") & (F.col("claimed") != F.col("actual")), F.lit(False)).alias("spoofed"))


@query("""WITH b AS (SELECT user_id, max(ts) + INTERVAL 3 DAYS AS until FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, until <= TIMESTAMP '2024-01-20' AS due, greatest(0, ceil(epoch(until) - epoch(TIMESTAMP '2024-01-20')))::BIGINT AS delay_s FROM b""")
def ban_expiry(spark, sf_dir):
    """Bans that are over by the 20th, and the seconds that the others have to wait."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    bans = read_table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 3 DAYS")).alias("until"))
    left = (F.unix_micros("until") - F.unix_micros(now)) / 1e6
    return bans.select("user_id", (F.col("until") <= now).alias("due"), F.greatest(F.lit(0), F.ceil(left)).cast("long").alias("delay_s"))


@query("""WITH q AS (SELECT event_id AS id, ts, row_number() OVER (ORDER BY event_id) AS r FROM events WHERE event_type = 'purchase'), m AS (SELECT max(ts) AS now FROM events)
SELECT id, CASE WHEN r <= 5 THEN 'done' ELSE 'pending' END AS status FROM q, m WHERE ts >= now - INTERVAL 10 DAYS""")
def queue_round(spark, sf_dir):
    """The oldest five pending entries are done, and entries older than ten days go."""
    e = read_table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    pending = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "ts")
    done = pending.orderBy("id").limit(5).select(F.col("id").alias("done"))
    marked = pending.join(F.broadcast(done), F.col("id") == F.col("done"), "left")
    kept = marked.crossJoin(F.broadcast(now)).filter(F.col("ts") >= F.col("now") - F.expr("INTERVAL 10 DAYS"))
    return kept.select("id", F.when(F.col("done").isNotNull(), "done").otherwise("pending").alias("status"))
