"""Relational queries over the vault, keyed tables and standings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import keyed, ranking, vault
from quillon.sources.session import read_table

VAULT = """vault AS (SELECT doc_id AS id, lang AS subject, source AS author, n_chars AS size, sha256(text) AS file_hash,
  source || '/' || (n_chars % 500) AS file_name, text AS raw_text FROM documents),
keyed AS (SELECT *, coalesce(nullif(file_hash, ''), lower(file_name)) AS key FROM vault)"""

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs_of(spark, sf_dir):
    return vault.vault(read_table(spark, sf_dir, "documents"))


@query(f"""WITH {VAULT}, h AS (SELECT file_hash FROM vault WHERE file_hash <> '' GROUP BY 1 HAVING count(*) > 1),
n AS (SELECT lower(file_name) AS fn FROM vault WHERE file_name <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS total_docs, coalesce(sum(size), 0)::BIGINT AS total_bytes, count(DISTINCT key) AS unique_docs,
  count(*) FILTER (file_hash IN (FROM h) OR lower(file_name) IN (FROM n)) AS duplicate_docs FROM keyed""")
def vault_stats(spark, sf_dir):
    return vault.vault_stats(docs_of(spark, sf_dir))


@query("SELECT lang AS subject, count(*) AS n_docs, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1")
def subject_breakdown(spark, sf_dir):
    return docs_of(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("bytes")).orderBy(F.desc("n_docs"), "subject")


@query(f"""WITH {VAULT} SELECT id, count(*) OVER w AS n_copies, count(*) OVER w > 1 AS is_duplicate, id <> min(id) OVER w AS is_copy
FROM keyed WINDOW w AS (PARTITION BY key)""")
def dup_flags(spark, sf_dir):
    return vault.duplicate_flags(docs_of(spark, sf_dir))


@query(f"WITH {VAULT} SELECT min(id) AS id FROM keyed GROUP BY key")
def unique_docs(spark, sf_dir):
    return vault.unique_rows(docs_of(spark, sf_dir))


@query(f"""WITH {VAULT}, f AS (SELECT id, file_hash IN (SELECT file_hash FROM vault GROUP BY 1 HAVING count(*) > 1) AS by_hash,
  lower(file_name) IN (SELECT lower(file_name) FROM vault GROUP BY 1 HAVING count(*) > 1) AS by_name FROM vault)
SELECT * FROM f WHERE by_hash OR by_name""")
def duplicate_docs(spark, sf_dir):
    return vault.duplicated_rows(docs_of(spark, sf_dir))


@query(f"WITH {VAULT} SELECT id FROM keyed WHERE id NOT IN (SELECT min(id) FROM keyed GROUP BY key)")
def prune_candidates(spark, sf_dir):
    return vault.prune_candidates(docs_of(spark, sf_dir))


@query(f"""WITH {VAULT}, hit AS (SELECT * FROM vault WHERE subject = 'en' AND author IN ('src0', 'src1', 'src2', 'src3')
  AND (raw_text ILIKE '%the%' OR file_name ILIKE '%the%'))
SELECT id, subject, author, size, (SELECT count(*) FROM hit) AS total_rows FROM hit ORDER BY size DESC, id LIMIT 20 OFFSET 20""")
def facet_page(spark, sf_dir):
    hit = vault.facets(docs_of(spark, sf_dir), "en", ("src0", "src1", "src2", "src3"), "the").select("id", "subject", "author", "size")
    return vault.with_total(hit, vault.page(hit, [F.desc("size"), F.asc("id")], 2, 20))


@query(f"WITH {VAULT} SELECT id, author, raw_text ILIKE '%LICENSE%' AS in_text FROM vault WHERE raw_text ILIKE '%LICENSE%' OR file_name ILIKE '%SRC1/%'")
def facet_ilike(spark, sf_dir):
    rows = docs_of(spark, sf_dir)
    return rows.filter(F.col("raw_text").ilike("%LICENSE%") | F.col("file_name").ilike("%SRC1/%")).select("id", "author", F.col("raw_text").ilike("%LICENSE%").alias("in_text"))


CATEGORIES = {"license": ("license",), "numbers": ("555-", "@mail"), "labels": (" | ",)}


@query("""SELECT doc_id AS id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), '555-') OR contains(lower(text), '@mail') THEN 'numbers'
  WHEN contains(lower(text), ' | ') THEN 'labels' ELSE 'other' END AS category FROM documents""")
def exam_category(spark, sf_dir):
    return docs_of(spark, sf_dir).select("id", vault.exam_category(F.col("raw_text"), CATEGORIES, "other").alias("category"))


@query("""SELECT doc_id AS id, lang AS subject, source AS author, CASE WHEN lang = 'fr' AND source = 'src7' THEN 1 WHEN lang = 'fr' THEN 2 ELSE 3 END AS relaxed,
  md5(doc_id::VARCHAR || '|' || 'seed-1') AS shuffle_key FROM documents ORDER BY relaxed, shuffle_key LIMIT 1""")
def random_pick(spark, sf_dir):
    return vault.seeded_pick(docs_of(spark, sf_dir), "fr", "src7", "seed-1")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, sf_dir):
    have = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return read_table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(have, "doc_id", "left_anti")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def docs_with_labels(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels")
    return read_table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").na.fill(-1, ["quality", "toxic"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def labelled_semi(spark, sf_dir):
    toxic = read_table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return read_table(spark, sf_dir, "documents").select("doc_id", "source").join(toxic, "doc_id", "left_semi")


@query("SELECT source AS author, count(*) AS n_docs, greatest(count(*) * 50, 2500)::BIGINT AS xp FROM documents GROUP BY 1")
def contributor_xp(spark, sf_dir):
    return keyed.contributor_xp(docs_of(spark, sf_dir), 50, 2500)


ACCOUNTS = "SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS best, min(o_orderpriority) AS first_seen FROM orders WHERE o_orderdate {} TIMESTAMP '1996-01-01' GROUP BY 1"


@query(f"""WITH o AS ({ACCOUNTS.format("<")}), n AS ({ACCOUNTS.format(">=")})
SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.n_orders, 0) + coalesce(n.n_orders, 0) AS n_orders, greatest(o.best, n.best) AS best,
  coalesce(o.first_seen, n.first_seen) AS first_seen FROM o FULL JOIN n ON o.o_custkey = n.o_custkey""")
def merge_upsert(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    accounts = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("best"), F.min("o_orderpriority").alias("first_seen"))
    cut = F.expr("timestamp_ntz'1996-01-01 00:00:00'")
    old, new = accounts(orders.filter(F.col("o_orderdate") < cut)), accounts(orders.filter(F.col("o_orderdate") >= cut))
    return keyed.merge_upsert(old, new, "o_custkey", {"n_orders": "add", "best": "max", "first_seen": "keep"})


@query("""WITH old AS (SELECT DISTINCT l_partkey AS part, 0::BIGINT AS origin FROM lineitem WHERE l_linenumber = 1),
new AS (SELECT l_partkey AS part, min(l_orderkey) AS origin FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE part NOT IN (SELECT part FROM old)""")
def insert_ignore(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem")
    old = items.filter("l_linenumber = 1").select(F.col("l_partkey").alias("part"), F.lit(0).cast("long").alias("origin")).distinct()
    new = items.filter("l_linenumber > 1").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("origin"))
    return keyed.insert_ignore(old, new, "part", F.col("origin"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS")
def retention_delete(spark, sf_dir):
    return keyed.retention_delete(read_table(spark, sf_dir, "events"), "ts", "2024-01-30 00:00:00", 7).select("event_id", "user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark, sf_dir):
    parents = read_table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return keyed.cascade_delete(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parents, "l_orderkey", "o_orderkey")


@query("""SELECT d.doc_id, d.source, coalesce(nullif(u.lang, ''), d.lang) AS lang FROM documents d
LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE '' END AS lang FROM labels) u USING (doc_id)""")
def coalesce_update(spark, sf_dir):
    updates = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "xx").otherwise("").alias("lang"))
    return keyed.coalesce_update(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), updates, "doc_id", ["lang"])


@query("""WITH c AS (SELECT page_id AS key, length(html) AS size, page_id % 97 AS last_used FROM pages), t AS (SELECT sum(size) AS total FROM c),
o AS (SELECT * FROM c ORDER BY last_used, key LIMIT 50),
r AS (SELECT key, size, coalesce(sum(size) OVER (ORDER BY last_used, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o)
SELECT key, size::BIGINT AS size, (b + size)::BIGINT AS freed FROM r, t WHERE b < total - floor(total::DOUBLE * 0.95 * 0.85)""")
def lru_evict(spark, sf_dir):
    cache = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.length("html").cast("long").alias("size"), (F.col("page_id") % 97).alias("last_used"))
    return keyed.lru_evict(cache, 0.95)


@query("SELECT event_id AS queue_id, user_id, 'claimed' AS status FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 5")
def queue_claim(spark, sf_dir):
    queue = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("queue_id"), "user_id", F.col("event_type").alias("status"))
    return keyed.queue_claim(queue, "purchase", 5)


@query("""SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS position, c_custkey, c_name, c_acctbal FROM customer
WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0 ORDER BY position LIMIT 25 OFFSET 25""")
def leaderboard_page(spark, sf_dir):
    from pyspark.sql import Window

    ranked = read_table(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY' and c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")
    order = [F.desc("c_acctbal"), F.asc("c_custkey")]
    top = vault.page(ranked, order, 1, 50)  # as far as the end of the page, so that places are counted over few rows
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).filter("position > 25")


@query("SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC)::BIGINT AS standing FROM customer")
def user_standing(spark, sf_dir):
    return ranking.standing(read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "standing")


@query("""SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3""")
def recent_topk(spark, sf_dir):
    return ranking.recent(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rn")


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) FILTER (o_orderstatus = 'O') AS losses FROM orders GROUP BY 1)
SELECT o_custkey, wins, losses, round_even(wins * 100.0::DOUBLE / greatest(wins + losses, 1), 1) AS win_rate FROM c""")
def win_rate(spark, sf_dir):
    is_ = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    c = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(is_("F").alias("wins"), is_("O").alias("losses"))
    return c.withColumn("win_rate", ranking.win_rate(F.col("wins"), F.col("losses")))


@query("SELECT user_id, count(*) AS n_warnings FROM events WHERE event_type = 'error' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def warn_counts(spark, sf_dir):
    ids = read_table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return read_table(spark, sf_dir, "events").filter("event_type = 'error'").join(ids, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_warnings"))


@query("""WITH a AS (SELECT o_custkey AS "user", l_suppkey AS problem, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_returnflag = 'R' AS accepted FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT *, row_number() OVER p AS attempt, coalesce(bool_or(accepted) OVER (PARTITION BY "user", problem ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS solved_before
  FROM a WINDOW p AS (PARTITION BY "user", problem ORDER BY seq))
SELECT "user", problem, seq, accepted, attempt, solved_before, accepted AND NOT solved_before AS is_first_solve FROM w""")
def attempts_first_solve(spark, sf_dir):
    items, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    attempts = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("problem"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"), (F.col("l_returnflag") == "R").alias("accepted")
    )
    return ranking.first_solves(attempts)


@query("""WITH d AS (SELECT DISTINCT user_id, (ts + INTERVAL 7 HOURS)::DATE AS day FROM events),
r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS anchor FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, anchor ORDER BY day) AS streak FROM r)
SELECT user_id, arg_max(streak, day) AS current_streak, max(streak) AS max_streak, max(day) AS last_day, sum(50 + least(streak * 5, 50))::BIGINT AS xp FROM s GROUP BY 1""")
def day_streaks(spark, sf_dir):
    return ranking.day_streaks(read_table(spark, sf_dir, "events").select("user_id", "ts"))


@query("""WITH m AS (SELECT o_custkey AS player, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'WIN' WHEN 'O' THEN 'LOSS' ELSE 'DRAW' END AS outcome FROM orders),
i AS (SELECT *, count(*) FILTER (outcome = 'LOSS') OVER (PARTITION BY player ORDER BY seq) AS losses FROM m),
w AS (SELECT player, losses, count(*) FILTER (outcome = 'WIN') AS wins FROM i GROUP BY 1, 2)
SELECT player, arg_max(wins, losses) AS current_streak, max(wins) AS max_streak FROM w GROUP BY 1""")
def match_streaks(spark, sf_dir):
    outcome = F.when(F.col("o_orderstatus") == "F", "WIN").when(F.col("o_orderstatus") == "O", "LOSS").otherwise("DRAW")
    return ranking.match_streaks(read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player"), F.col("o_orderkey").alias("seq"), outcome.alias("outcome")))


TIER_SQL = ", ".join(f"('{n}', {t}, {i})" for i, (n, t) in enumerate(ranking.TIERS))


@query(f"""WITH tiers(name, least, i) AS (VALUES {TIER_SQL}), r AS (SELECT c_custkey, greatest(0, floor(c_acctbal / 3))::INTEGER AS rating FROM customer),
b AS (SELECT r.*, t.name, t.least, coalesce(n.least, 3000) AS nxt FROM r JOIN tiers t ON t.least = (SELECT max(least) FROM tiers WHERE least <= rating) LEFT JOIN tiers n ON n.i = t.i + 1)
SELECT c_custkey, rating, name AS tier, CASE WHEN rating >= 3000 THEN 100.0 ELSE round_even(least(100.0, (rating - least) * 100.0::DOUBLE / greatest(nxt - least, 1)), 1) END::DOUBLE AS progress_pct,
  CASE WHEN rating >= 3000 THEN 0 ELSE nxt - rating END AS points_needed FROM b""")
def tier_assign(spark, sf_dir):
    rating = F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 3)).cast("int")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", rating.alias("rating"))
    name, progress, needed = ranking.tier_progress(F.col("rating"))
    return rows.select("c_custkey", "rating", name.alias("tier"), progress.alias("progress_pct"), needed.cast("int").alias("points_needed"))
