"""Rating, contest and event-log queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import rating
from quillon.operators import bursts, contests, ranking, streaks
from quillon.sources.session import read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Attempts: a customer's rating by balance, a problem's by the order's price.
ATTEMPTS = """att AS (SELECT o_orderkey, o_custkey, greatest(0, floor(c_acctbal / 3))::INTEGER AS u, (800 + floor(o_totalprice / 100)::BIGINT % 2700)::INTEGER AS p,
  o_orderstatus = 'F' AS mode1, o_orderpriority = '1-URGENT' AS ev, (o_orderkey % 11)::INTEGER AS passed, (o_orderkey * 7 % 101) / 100.0::DOUBLE AS pct, (o_orderkey % 60)::INTEGER AS people
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SQL_FUNCTIONS = {
    "prob": "(1.0::DOUBLE / (1.0 + pow(10.0::DOUBLE, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, (greatest(800, p) - u) / 400.0::DOUBLE)))))",
    "mode": "CASE WHEN mode1 THEN 0.85::DOUBLE ELSE 1.0 END",
    "k": "CASE WHEN u < 1200 THEN 60.0::DOUBLE WHEN u < 2000 THEN 45.0 ELSE 35.0 END",
    "pen": "50.0::DOUBLE * least(1.0::DOUBLE, greatest(0.25::DOUBLE, greatest(800, least(3500, p)) / 2500.0::DOUBLE))",
}


def attempts(spark, sf_dir):
    orders, customers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 3)).cast("int").alias("u"),
        (F.lit(800) + F.floor(F.col("o_totalprice") / 100) % 2700).cast("int").alias("p"), (F.col("o_orderstatus") == "F").alias("mode1"),
        (F.col("o_orderpriority") == "1-URGENT").alias("ev"), (F.col("o_orderkey") % 11).cast("int").alias("passed"),
        (F.col("o_orderkey") * 7 % 101 / 100.0).alias("pct"), (F.col("o_orderkey") % 60).cast("int").alias("people"),
    )


@query("""WITH {a} SELECT o_orderkey, round({prob}, 9) AS expected, greatest(1, round_even({k} * (1.0 - {prob}) * {mode}, 0))::BIGINT AS win_delta,
  (CASE WHEN ev AND u < 1400 THEN 0 ELSE -greatest(5, round_even(CASE WHEN ev THEN least(50.0::DOUBLE, ({pen}) * CASE WHEN passed / 10.0 < 0.2 THEN 1.35::DOUBLE WHEN passed / 10.0 < 0.4 THEN 1.2 ELSE 0.7 END) ELSE {pen} END * {mode}, 0)) END)::BIGINT AS penalty FROM att""".format(a=ATTEMPTS, **SQL_FUNCTIONS))
def elo_delta(spark, sf_dir):
    u, p, m = F.col("u"), F.col("p"), F.col("mode1")
    return attempts(spark, sf_dir).select(
        "o_orderkey", F.round(rating.solve_probability(u, p), 9).alias("expected"), rating.solve_delta(u, p, m).cast("long").alias("win_delta"),
        rating.fail_penalty(u, p, m, F.col("ev"), F.col("passed") / 10.0).cast("long").alias("penalty"),
    )


@query("""WITH {a}, b AS (SELECT *, greatest(1, round_even({k} * (1.0 - {prob}), 0)) AS base, greatest(800, least(3500, p)) / 10.0::DOUBLE AS bs, CASE WHEN pct = 0 THEN 0.5 ELSE pct END AS q,
  greatest(5, round_even({pen}, 0)) AS plain, passed / 10.0::DOUBLE AS r FROM att),
c AS (SELECT *, CASE WHEN r < 0.4 THEN 1 WHEN people < 20 THEN 2 WHEN (u >= p + 300 AND q <= 0.3) OR q <= 0.1 THEN 3 WHEN q > 0.7 THEN 4 WHEN q > 0.5 THEN 5 WHEN q > 0.3 THEN 6 ELSE 7 END AS k FROM b)
SELECT o_orderkey, (CASE k WHEN 1 THEN CASE WHEN ev AND u < 1400 THEN 0 ELSE -greatest(5, round_even(CASE WHEN ev THEN least(50.0::DOUBLE, ({pen}) * CASE WHEN r < 0.2 THEN 1.35::DOUBLE ELSE 1.2 END) ELSE {pen} END, 0)) END
  WHEN 2 THEN base WHEN 3 THEN -greatest(5, round_even(plain * 0.6::DOUBLE, 0)) WHEN 4 THEN greatest(1, round_even(base * 1.4::DOUBLE, 0)) WHEN 5 THEN base WHEN 6 THEN greatest(1, round_even(base * 0.5::DOUBLE, 0)) ELSE 0 END)::BIGINT AS rating_delta,
  round((CASE k WHEN 1 THEN -greatest(15.0::DOUBLE, round_even(bs * 0.25, 1)) WHEN 2 THEN bs WHEN 3 THEN 0 WHEN 4 THEN round_even(bs * 1.4, 1) WHEN 5 THEN bs WHEN 6 THEN round_even(bs * 0.5, 1) ELSE round_even(bs * 0.25, 1) END)::DOUBLE, 0) AS score_delta,
  (CASE k WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN -0.5 WHEN 4 THEN 1.4 WHEN 5 THEN 1.0 WHEN 6 THEN 0.5 ELSE 0.0 END)::DOUBLE AS multiplier FROM c""".format(a=ATTEMPTS, **SQL_FUNCTIONS))
def two_step_eval(spark, sf_dir):
    got = rating.two_step(F.col("u"), F.col("p"), F.col("passed"), F.lit(10), F.col("pct"), F.col("people"), F.col("ev"))
    # whole points of the score, as binary halves at one place differ between engines
    got["score_delta"] = F.round(got["score_delta"], 0)
    return attempts(spark, sf_dir).select("o_orderkey", *[c.alias(n) for n, c in got.items()])


PARTICIPANTS = """best AS (SELECT strftime(o_orderdate, '%Y-%m') AS contest, o_custkey AS "user", max(o_totalprice) AS price FROM orders GROUP BY 1, 2),
par AS (SELECT contest, "user", (floor(greatest(0, c_acctbal) / 3))::BIGINT AS rating, rank() OVER (PARTITION BY contest ORDER BY price DESC) AS rank FROM best JOIN customer ON "user" = c_custkey)"""


def participants(spark, sf_dir):
    """A contest a month: customers by their dearest order."""
    from pyspark.sql import Window

    month = F.date_format("o_orderdate", "yyyy-MM").alias("contest")
    best = read_table(spark, sf_dir, "orders").groupBy(month, F.col("o_custkey").alias("user")).agg(F.max("o_totalprice").alias("price"))
    own = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.floor(F.greatest(F.lit(0.0), F.col("c_acctbal")) / 3).cast("long").alias("rating"))
    place = F.rank().over(Window.partitionBy("contest").orderBy(F.desc("price"))).cast("long")
    return best.join(own, "user").withColumn("rank", place).select("contest", "user", "rating", "rank")


@query(f"""WITH {PARTICIPANTS} SELECT a.contest, a."user", a.rating, a.rank,
  round(1.0 + sum(CASE WHEN a."user" = b."user" THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0 + pow(10.0::DOUBLE, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, (a.rating - b.rating) / 400.0::DOUBLE)))) END), 6) AS seed
  FROM par a JOIN par b ON a.contest = b.contest GROUP BY 1, 2, 3, 4""")
def contest_seed(spark, sf_dir):
    return contests.seeds(participants(spark, sf_dir)).select("contest", "user", "rating", "rank", F.round("seed", 6).alias("seed"))


#: Fifty halvings of the range of ratings for each participant, against all others of the contest.
PERFORMANCE_SQL = f"""WITH RECURSIVE {PARTICIPANTS}, sized AS (SELECT *, count(*) OVER (PARTITION BY contest) AS n FROM par),
hist AS (SELECT contest, rating AS o, count(*) AS m FROM par GROUP BY 1, 2),
goals AS (SELECT s.contest, s."user", s.rating, s.rank, s.n, sqrt(s.rank * (0.5 + sum(m / (1.0::DOUBLE + pow(10.0::DOUBLE, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, (s.rating - o) / 400.0::DOUBLE))))))) AS goal FROM sized s JOIN hist h ON s.contest = h.contest GROUP BY 1, 2, 3, 4, 5),
halved AS (SELECT contest, "user", rating, goal, 0.0::DOUBLE AS low, 4500.0::DOUBLE AS high, 0 AS i FROM goals WHERE n > 1
UNION ALL SELECT contest, "user", rating, goal, CASE WHEN up THEN (low + high) / 2 ELSE low END, CASE WHEN up THEN high ELSE (low + high) / 2 END, i + 1 FROM
  (SELECT b.contest, b."user", b.rating, b.goal, b.low, b.high, b.i, 1.0 - 1.0::DOUBLE / (1.0 + pow(10.0::DOUBLE, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, ((b.low + b.high) / 2 - b.rating) / 400.0::DOUBLE))))
    + sum(m / (1.0::DOUBLE + pow(10.0::DOUBLE, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, ((b.low + b.high) / 2 - o) / 400.0::DOUBLE))))) > b.goal AS up FROM halved b JOIN hist h ON b.contest = h.contest WHERE b.i < 50 GROUP BY 1, 2, 3, 4, 5, 6, 7)),
perf AS (SELECT g.contest, g."user", g.rating, g.rank, CASE WHEN g.n = 1 THEN g.rating::DOUBLE ELSE round((low + high) / 2, 1) END AS performance FROM goals g LEFT JOIN halved b ON g.contest = b.contest AND g."user" = b."user" AND b.i = 50)"""


@query(PERFORMANCE_SQL + """ SELECT contest, "user", rating, rank, performance FROM perf""")
def contest_performance(spark, sf_dir):
    return contests.performances(participants(spark, sf_dir))


@query(PERFORMANCE_SQL + """, s AS (SELECT contest, -sum(((performance - rating) * 0.5)::DECIMAL(18, 4))::DOUBLE / count(*) - 1.0::DOUBLE AS shift FROM perf GROUP BY 1),
d AS (SELECT perf.*, round_even((performance - rating) * 0.5 + shift, 0)::BIGINT AS delta FROM perf JOIN s USING (contest)) SELECT *, greatest(0, rating + delta) AS new_rating FROM d""")
def contest_batch(spark, sf_dir):
    return contests.contest_changes(contests.performances(participants(spark, sf_dir)))


DUEL_TI = lambda c: " + ".join(f"({c} >= {t})::INTEGER" for _, t in ranking.TIERS[1:])


@query(f"""WITH {ATTEMPTS}, d AS (SELECT o_orderkey, u AS w, p AS l, 1 + o_orderkey % 2 AS lives, 1 + o_orderkey % 6 AS rounds, o_orderkey % 5 = 0 AS part, o_orderkey % 37 AS streak, {DUEL_TI("u")} AS wi, {DUEL_TI("p")} AS li FROM att),
e AS (SELECT *, greatest(-20, least(20, round_even((l - w) / 25.0::DOUBLE, 0))) AS bonus, least(15, greatest(0, rounds - 2) * 5) AS st FROM d),
f AS (SELECT *, greatest(20, CASE WHEN li > wi THEN 80 WHEN li < wi THEN 50 ELSE 60 END + bonus + CASE WHEN li > wi OR (li = wi AND l - w > 50) THEN st WHEN li < wi OR (li = wi AND l - w < -50) THEN -st ELSE 0 END) AS pool FROM e),
g AS (SELECT *, round_even(CASE WHEN lives >= 2 THEN pool ELSE pool * 0.75::DOUBLE END, 0) AS w0, 1.0::DOUBLE - (0.5::DOUBLE + wi / 11.0::DOUBLE * 0.35::DOUBLE) AS sh FROM f),
h AS (SELECT *, CASE WHEN part THEN greatest(5, round_even(w0 * sh, 0)) ELSE w0 END AS w1, CASE WHEN part THEN greatest(5, round_even(pool * sh, 0)) ELSE pool END AS l1,
  CASE WHEN streak >= 30 THEN 15 WHEN streak >= 20 THEN 10 WHEN streak >= 10 THEN 5 WHEN streak >= 5 THEN 2 ELSE 0 END AS pc FROM g)
SELECT o_orderkey, (w1 + round_even(w1 * (pc / 100.0::DOUBLE), 0))::BIGINT AS winner_delta, (-l1)::BIGINT AS loser_delta FROM h""")
def duel_delta(spark, sf_dir):
    key = F.col("o_orderkey")
    won, lost = rating.duel_deltas(F.col("u"), F.col("p"), 1 + key % 2, 1 + key % 6, key % 5 == 0, key % 37)
    return attempts(spark, sf_dir).select("o_orderkey", won.alias("winner_delta"), lost.alias("loser_delta"))


NOW_SQL = {k: v.replace("greatest(800, p) - u", "greatest(800, p) - now").replace("u < 1200", "now < 1200").replace("u < 2000", "now < 2000") for k, v in SQL_FUNCTIONS.items()}


@query("""WITH RECURSIVE {a}, line AS (SELECT o_custkey AS "user", p, mode1 AS accepted, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM att),
f AS (SELECT DISTINCT "user", 0::BIGINT AS i, n, 1200::BIGINT AS now, 1200::BIGINT AS peak FROM line
UNION ALL SELECT "user", i + 1, n, moved, greatest(peak, moved) FROM (SELECT f."user", f.i, f.n, f.peak, greatest(0, now + CASE WHEN accepted THEN greatest(1, round_even({k} * (1.0 - {prob}), 0)) ELSE -greatest(5, round_even({pen}, 0)) END)::BIGINT AS moved
  FROM f JOIN line l ON l."user" = f."user" AND l.i = f.i + 1))
SELECT "user", n AS n_attempts, now AS final_rating, peak AS peak_rating FROM f WHERE i = n""".format(a=ATTEMPTS, **NOW_SQL))
def rating_fold(spark, sf_dir):
    return contests.rating_fold(attempts(spark, sf_dir).select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("seq"), F.col("p").alias("problem"), F.col("mode1").alias("accepted")))


def events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def window_sql(keys: str, hours: int, least: int, where: str = "true") -> str:
    return f"""WITH w AS (SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY {keys} ORDER BY ts RANGE BETWEEN INTERVAL {hours} HOURS PRECEDING AND CURRENT ROW) AS in_window
  FROM events WHERE {where}) SELECT event_id, user_id, event_type, in_window FROM w WHERE in_window >= {least}"""


@query(window_sql("user_id", 4, 3))
def flood_batch(spark, sf_dir):
    return bursts.floods(events(spark, sf_dir), ["user_id"], "ts", 4 * 3600, 3).select("event_id", "user_id", "event_type", "in_window")


@query(window_sql("user_id, md5(event_type)", 12, 3))
def dup_event_batch(spark, sf_dir):
    keyed = events(spark, sf_dir).withColumn("key", F.md5("event_type"))
    return bursts.floods(keyed, ["user_id", "key"], "ts", 12 * 3600, 3).select("event_id", "user_id", "event_type", "in_window")


@query("""WITH w AS (SELECT event_id, event_type, user_id, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'signup'),
h AS (SELECT * FROM w WHERE n >= 3), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS new FROM h WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS raid FROM g)
SELECT event_type, raid::BIGINT AS raid, min(ts) AS started, max(ts) AS ended, count(DISTINCT user_id) AS members, max(n) AS peak FROM i GROUP BY 1, 2""")
def raid_batch(spark, sf_dir):
    return bursts.raid_islands(events(spark, sf_dir).filter("event_type = 'signup'"), "event_type", "ts", 600, 3)


@query(window_sql("user_id", 24, 2, "event_type = 'error'"))
def tamper_batch(spark, sf_dir):
    return bursts.floods(events(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], "ts", 86400, 2).select("event_id", "user_id", "event_type", "in_window")


@query("""WITH g AS (SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE AS gap_s, CASE WHEN value > 50 THEN 3600.0 ELSE 7200.0 END::DOUBLE AS cd FROM events)
SELECT event_id, user_id, round(gap_s, 3) AS gap_s, round(cd - gap_s, 3) AS remaining_s FROM g WHERE cd - gap_s > 0""")
def cooldown_violations(spark, sf_dir):
    limit = F.when(F.col("value") > 50, 3600.0).otherwise(7200.0)
    found = bursts.cooldown_violations(events(spark, sf_dir), "user_id", "ts", limit)
    return found.select("event_id", "user_id", F.round("gap_s", 3).alias("gap_s"), F.round("remaining_s", 3).alias("remaining_s"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id FROM events),
f AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM e GROUP BY 1, 2
UNION ALL SELECT f.user_id, f.event_type, n.event_id, n.ts FROM f, LATERAL (SELECT event_id, ts FROM e WHERE e.user_id = f.user_id AND e.event_type = f.event_type AND e.ts >= f.ts + INTERVAL 48 HOURS ORDER BY ts, event_id LIMIT 1) n)
SELECT user_id, event_type, event_id FROM f""")
def dedup_ttl(spark, sf_dir):
    return bursts.dedup_ttl(events(spark, sf_dir), ["user_id", "event_type"], "ts", 48 * 3600)


@query("""WITH RECURSIVE line AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, false AS ok FROM line WHERE i = 1
UNION ALL SELECT user_id, i, event_id, CASE WHEN ok THEN us ELSE a END, CASE WHEN ok THEN a ELSE b END, CASE WHEN ok THEN b ELSE c END, ok FROM
  (SELECT l.user_id, l.i, l.event_id, l.us, f.a, f.b, f.c, f.c IS NULL OR l.us - f.c >= 86400000000 AS ok FROM f JOIN line l ON l.user_id IS NOT DISTINCT FROM f.user_id AND l.i = f.i + 1))
SELECT user_id, event_id FROM f WHERE ok""")
def rate_limit_admit(spark, sf_dir):
    return bursts.admitted(events(spark, sf_dir), "user_id", "ts", 3, 24 * 3600)


#: Words of the test corpus stand for words of quarrels.
LEXICON = {"triggers": ("que la", "éaile", "letre"), "patterns": ("eaux(pa|le)", "tionr"), "pronouns": r"(^|[^\p{L}])(der|la|de)([^\p{L}]|$)", "laughter": ("anan", "lele")}


def messages(spark, sf_dir):
    """Turns of conversations, one every twelve seconds."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("channel"), F.col("turn").alias("seq"), F.col("role").alias("user"), "text", F.timestamp_seconds(F.col("turn") * 12).alias("ts"))


PLUS_SQL = " + ".join([f"contains(t, '{x}')::INTEGER * 40" for x in LEXICON["triggers"]] + [f"regexp_matches(t, '{x}')::INTEGER * 35" for x in LEXICON["patterns"]] + [f"regexp_matches(t, '{LEXICON['pronouns']}')::INTEGER * 15"])
#: A message is one number, twice its points and one for laughter, so that a list of them can be folded.
HOSTILE_SQL = f"""l AS (SELECT conv_id AS channel, turn AS seq, role AS "user", lower(text) AS t, turn * 12 AS sec FROM conversations),
m AS (SELECT *, 2 * ({PLUS_SQL}) + ({" OR ".join(f"contains(t, '{x}')" for x in LEXICON["laughter"])})::INTEGER AS x FROM l)"""
FOLD_SQL = "list_reduce(list_prepend(0, xs), lambda s, x: CASE WHEN x % 2 = 1 THEN greatest(0, s + x // 2 - 25) ELSE s + x // 2 END)"


@query(f"""WITH {HOSTILE_SQL}, w AS (SELECT channel, seq, list(x) OVER r AS xs, len(list_distinct(list("user") OVER r)) AS users FROM m WINDOW r AS (PARTITION BY channel ORDER BY seq ROWS 7 PRECEDING)),
s AS (SELECT channel, seq, users, CASE WHEN users >= 2 THEN {FOLD_SQL} ELSE 0 END AS score FROM w) SELECT channel, seq, score, users, score >= 60 AND users >= 2 AS fires FROM s""")
def conversation_score(spark, sf_dir):
    return bursts.hostility(messages(spark, sf_dir), **LEXICON).drop("ts")


@query(f"""WITH RECURSIVE {HOSTILE_SQL}, w AS (SELECT a.channel, a.seq, a.sec, list(b.x ORDER BY b.seq) AS xs, count(DISTINCT b."user") AS users FROM m a JOIN m b ON a.channel = b.channel AND b.seq BETWEEN a.seq - 7 AND a.seq AND a.sec - b.sec <= 60 GROUP BY 1, 2, 3),
s AS (SELECT channel, seq, sec FROM w WHERE users >= 2 AND {FOLD_SQL} >= 30),
f AS (SELECT channel, min(seq) AS seq, min(sec) AS sec FROM s GROUP BY 1 UNION ALL SELECT f.channel, n.seq, n.sec FROM f, LATERAL (SELECT seq, sec FROM s WHERE s.channel = f.channel AND s.sec >= f.sec + 20 ORDER BY sec LIMIT 1) n)
SELECT channel, seq FROM f""")
def conversation_alerts(spark, sf_dir):
    """Quarrels among the turns of a minute, one alert in twenty seconds at most."""
    return bursts.alerts(bursts.hostility(messages(spark, sf_dir), **LEXICON, least=30, seconds=60), 20)


#: Matches: nine players, of whom the first one seldom loses.
MATCH_SQL = """SELECT o_orderkey AS match_id, o_orderdate AS ts, CASE WHEN o_orderkey % 53 = 0 THEN greatest(a, b) ELSE least(a, b) END AS winner, CASE WHEN o_orderkey % 53 = 0 THEN least(a, b) ELSE greatest(a, b) END AS loser,
  CAST((o_orderkey * 37 % 1000) / 10.0 AS DOUBLE) AS start_prob, CAST((o_orderkey * 91 % 400) / 10.0 AS DOUBLE) AS min_prob, CAST(100 - (o_custkey * 13 % 400) / 10.0 AS DOUBLE) AS loser_max_prob, o_orderkey % 5 = 0 AS loser_led
  FROM (SELECT *, o_custkey % 9 AS a, (o_custkey % 9 + 1 + o_orderkey % 8) % 9 AS b FROM orders)"""


@query(f"""WITH m AS ({MATCH_SQL}), e AS (SELECT m.*, winner AS player, true AS won FROM m UNION ALL SELECT m.*, loser, false FROM m),
f AS (SELECT *, (NOT won)::INTEGER AS lost, (NOT won OR NOT start_prob > 80)::INTEGER AS close, (NOT won AND (loser_max_prob >= 85 OR loser_led) AND min_prob <= 10)::INTEGER AS fell FROM e),
g AS (SELECT *, sum(lost) OVER w AS gl, sum(close) OVER w AS gc, sum(won::INTEGER) OVER w AS gw FROM f WINDOW w AS (PARTITION BY player ORDER BY ts, match_id)),
c AS (SELECT *, sum(won::INTEGER) OVER l AS streak, sum((won AND start_prob < 15)::INTEGER) OVER l AS fortune, sum((won AND min_prob <= 10 AND min_prob >= 5)::INTEGER) OVER l AS clutch,
  sum((won AND start_prob > 80)::INTEGER) OVER (PARTITION BY player, gc ORDER BY ts, match_id) AS outclassed, sum(fell) OVER (PARTITION BY player, gw ORDER BY ts, match_id) AS falls FROM g WINDOW l AS (PARTITION BY player, gl ORDER BY ts, match_id))
SELECT match_id, player, won, streak::BIGINT AS streak, fortune::BIGINT AS fortune, outclassed::BIGINT AS outclassed, clutch::BIGINT AS clutch, NOT won AND falls > 0 AS doomed,
  CASE WHEN NOT won THEN CASE WHEN falls > 0 THEN 'DOOMED' END WHEN streak >= 50 THEN 'OVERLORD' WHEN fortune >= 20 THEN 'GODLY_LUCK' WHEN min_prob < 5 OR (min_prob <= 10 AND clutch >= 10) THEN 'CLUTCHMASTER'
  WHEN outclassed >= 10 THEN 'OUTCLASSED' WHEN fortune >= 10 THEN 'FORTUNE' END AS role FROM c""")
def match_achievements(spark, sf_dir):
    """What each match leaves its players with: streaks, comebacks and the roles that they unlock. Some players are in a large part
    of all matches; their matches are counted by stretches of time."""
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("match_orders")
    return streaks.achievements(spark.sql(MATCH_SQL.replace("FROM orders)", "FROM match_orders)")))
