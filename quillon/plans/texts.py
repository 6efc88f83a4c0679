"""Text, similarity and search queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import search, similarity
from quillon.sources.session import materialize, read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


KEY_SQL = r"""regexp_replace(regexp_replace(lower(nfc_normalize(coalesce({}, ''))), '\b(?:page|trang)[ \t\n\r]*[0-9]+[ \t\n\r]*(?:of|/|trên)?[ \t\n\r]*[0-9]*\b', '', 'g'), '[^\p{{L}}\p{{N}}_+=\-*/^()]+', '', 'g')"""
TOKEN_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


@query(f"SELECT doc_id, length({KEY_SQL.format('text')})::BIGINT AS key_length, sha256({KEY_SQL.format('text')}) AS content_hash FROM documents")
def norm_text(spark, sf_dir):
    key = tx.content_key(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", key.alias("k")).select("doc_id", F.length("k").cast("long").alias("key_length"), F.sha2("k", 256).alias("content_hash"))


HTML_SQL = "html"
for _tag in ("script", "style", "nav", "footer", "aside"):
    HTML_SQL = f"regexp_replace({HTML_SQL}, '<{_tag}[^>]*>.*?</{_tag}>', ' ', 'gis')"
HTML_SQL = rf"regexp_replace(regexp_replace({HTML_SQL}, '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'gs')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML_SQL = f"replace({HTML_SQL}, '{_entity}', '{_char}')"
HTML_SQL = rf"trim(regexp_replace({HTML_SQL}, '[ \t\n\r\f]+', ' ', 'g'))"


@query(f"SELECT page_id, length({HTML_SQL})::BIGINT AS n_chars, md5({HTML_SQL}) AS text_md5 FROM pages")
def html_to_text(spark, sf_dir):
    text = tx.html_to_text(F.col("html"))
    return read_table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, lower(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)) AS path FROM pages)
SELECT page_id, host, (CASE WHEN regexp_matches(host, '(^|\.)example\.org$') THEN 95 WHEN regexp_matches(path, '\.(exe|scr|bat|apk|jar)$') THEN 95 ELSE
  CASE WHEN regexp_matches(host, 'free|gift|thth') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(host, '^m\.') THEN 35 ELSE 0 END END)::INTEGER AS risk FROM h""")
def url_risk(spark, sf_dir):
    """Blacklisted hosts and executable paths score 95; suspicious words 50 and shorteners 35 add up."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1))
    heuristic = F.when(host.rlike("free|gift|thth"), 50).otherwise(0) + F.when(host.rlike(r"^m\."), 35).otherwise(0)
    risk = F.when(host.rlike(r"(^|\.)example\.org$") | path.rlike(r"\.(exe|scr|bat|apk|jar)$"), 95).otherwise(heuristic)
    return read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), risk.cast("int").alias("risk"))


@query(r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda w: w <> '') AS ws FROM documents),
c AS (SELECT *, len(list_filter(ls, lambda x: trim(x) = '')) AS b, len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^(//|#|/\*|\*)'))) AS k FROM l)
SELECT doc_id, len(ls)::INTEGER AS n_lines, b::INTEGER AS n_blank, k::INTEGER AS n_comment, round(CASE WHEN len(ls) > b THEN k / (len(ls) - b)::DOUBLE ELSE 0 END, 9) AS comment_ratio,
  round(len(list_distinct(ws)) / greatest(len(ws), 1)::DOUBLE, 9) AS lexical_density FROM c""")
def text_metrics(spark, sf_dir):
    m = tx.line_metrics(F.col("text"))
    m["comment_ratio"] = F.round(m["comment_ratio"], 9)
    return docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in m.items()], F.round(tx.lexical_density(F.col("text")), 9).alias("lexical_density"))


@query("""WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2)
SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 3) AS entropy FROM c GROUP BY 1""")
def entropy(spark, sf_dir):
    return tx.char_entropy(docs(spark, sf_dir), "doc_id", "text")


SCRIPT_SQL = ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS n_{k}" for k, p in tx.SCRIPTS.items())


@query(f"""WITH s AS (SELECT doc_id, {SCRIPT_SQL} FROM documents) SELECT doc_id, n_vietnamese::INTEGER AS n_vietnamese, n_french::INTEGER AS n_french, n_cyrillic::INTEGER AS n_cyrillic,
  CASE WHEN n_kana >= 10 THEN 'JAPANESE' WHEN n_hangul >= 10 THEN 'KOREAN' WHEN n_cjk >= 20 AND n_kana = 0 THEN 'CHINESE' WHEN n_cyrillic >= 20 THEN 'RUSSIAN'
  WHEN n_vietnamese >= 15 THEN 'VIETNAMESE' WHEN n_french >= 25 AND n_vietnamese < 10 THEN 'FRENCH' ELSE 'ENGLISH' END AS language FROM s""")
def script_profile(spark, sf_dir):
    counts = docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in tx.script_counts(F.col("text")).items()])
    language = tx.script_language({k: F.col(k) for k in tx.SCRIPTS})
    return counts.select("doc_id", F.col("vietnamese").alias("n_vietnamese"), F.col("french").alias("n_french"), F.col("cyrillic").alias("n_cyrillic"), language.alias("language"))


SIMHASH = rf"""tk AS (SELECT doc_id, text, {TOKEN_SQL.format("text")} AS w FROM documents WHERE length(text) >= 10),
ws AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN w ELSE [substr(text, i::INTEGER, 4) FOR i IN range(1, length(text) - 2)] END AS w FROM tk),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], '_') FOR i IN range(1, len(w) - 1)] ELSE w END) AS s FROM ws),
hx AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h FROM sh),
bt AS (SELECT doc_id, b, sum(((h >> b::UBIGINT) & 1)::INTEGER) * 2 > count(*) AS bit FROM hx, range(64) t(b) GROUP BY 1, 2),
fp AS (SELECT doc_id, sum(CASE WHEN bit THEN CASE WHEN b = 63 THEN -(1::HUGEINT << 63) ELSE (1::HUGEINT << b::INTEGER) END ELSE 0 END)::BIGINT AS fp FROM bt GROUP BY 1)"""


@query(f"WITH {SIMHASH} SELECT d.doc_id, coalesce(fp.fp, 0) AS fp FROM documents d LEFT JOIN fp USING (doc_id)")
def simhash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.simhash("text").alias("fp"))


@query(f"""WITH {SIMHASH}, d AS (SELECT DISTINCT fp FROM (SELECT coalesce(fp.fp, 0) AS fp FROM documents d LEFT JOIN fp USING (doc_id)))
SELECT a.fp AS a, b.fp AS b, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM d a, d b WHERE a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= 3""")
def simhash_near(spark, sf_dir):
    """Pairs of different fingerprints; which documents have them is query simhash."""
    return similarity.near_fingerprints(materialize(docs(spark, sf_dir).select(tx.simhash("text").alias("fp")), "simhash"))


@query(f"""WITH a AS (SELECT doc_id AS id, sha256(text) AS file_hash, sha256({KEY_SQL.format('text')}) AS content_hash, source AS name, n_chars AS size FROM documents),
n AS (SELECT doc_id AS item, sha256(text || ' !') AS file_hash, sha256({KEY_SQL.format('text')}) AS content_hash, source AS name, n_chars + doc_id % 3 AS size FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT -item_id - 1, sha256(text), sha256({KEY_SQL.format('text')}), 'src' || item_id % 20, length(text) FROM benchmark),
h AS (SELECT item, 1 AS layer, min(a.id) AS match FROM n JOIN a USING (file_hash) GROUP BY 1 UNION ALL SELECT item, 2, min(a.id) FROM n JOIN a USING (content_hash) GROUP BY 1
  UNION ALL SELECT item, 3, min(a.id) FROM n JOIN a ON n.name = a.name AND n.size = a.size GROUP BY 1)
SELECT item, min(layer)::INTEGER AS layer, arg_min(match, layer) AS match FROM h GROUP BY 1""")
def dup_layers(spark, sf_dir):
    """Copies of the labelled documents with other punctuation, and benchmark passages, looked up in the archive of documents."""
    key = lambda c: F.sha2(tx.content_key(c), 256).alias("content_hash")
    t = F.col("text")
    archive = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2(t, 256).alias("file_hash"), key(t), F.col("source").alias("name"), F.col("n_chars").alias("size"))
    labelled = docs(spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id")
    items = labelled.select(F.col("doc_id").alias("item"), F.sha2(F.concat(t, F.lit(" !")), 256).alias("file_hash"), key(F.concat(t, F.lit(" !"))), F.col("source").alias("name"), (F.col("n_chars") + F.col("doc_id") % 3).alias("size"))
    bench = read_table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("item"), F.sha2(t, 256).alias("file_hash"), key(t), F.concat(F.lit("src"), F.col("item_id") % 20).alias("name"), F.length(t).cast("long").alias("size"))
    return similarity.duplicate_layers(items.unionAll(bench), archive)


@query()
def chunk_docs(spark, sf_dir):
    return tx.chunk_texts(docs(spark, sf_dir), "doc_id", "text", 2000)


@query("""WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(1, (strlen(text) + 4095) // 4096))) AS part_no FROM documents)
SELECT doc_id, count(*) AS n_parts, any_value(strlen(text))::BIGINT AS n_bytes, any_value(sha256(text)) AS merged_sha256 FROM p GROUP BY doc_id""")
def split_bytes(spark, sf_dir):
    """Texts cut into parts of 4096 bytes and put together again in order."""
    data = docs(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("b"))
    last = F.greatest(F.floor((F.octet_length("b") - 1) / 4096), F.lit(0)).cast("int")
    parts = data.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("part_no"), F.substring(F.col("b"), i * 4096 + 1, F.lit(4096)).alias("part")))).alias("x")).select("doc_id", "x.*")
    merged = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_no", "part"))).alias("ps"))
    whole = F.aggregate("ps", F.lit(b""), lambda a, p: F.concat(a, p["part"]))
    return merged.select("doc_id", F.size("ps").cast("long").alias("n_parts"), whole.alias("w")).select("doc_id", "n_parts", F.octet_length("w").cast("long").alias("n_bytes"), F.sha2("w", 256).alias("merged_sha256"))


TERMS = ("thor", "inge", "lyn")


def bm25_sql(terms: tuple[str, ...], every: bool) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    having = f"HAVING count(*) = {len(terms)}" if every else ""
    return rf"""d AS (SELECT doc_id AS id, {TOKEN_SQL.format("text")} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM d),
f AS (SELECT id, len(ws) AS dl, p, len(list_filter(ws, lambda w: starts_with(w, p))) AS tf FROM d, (VALUES {values}) t(p)), g AS (SELECT *, count(*) OVER (PARTITION BY p) AS df FROM f WHERE tf > 0),
bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score FROM g, s GROUP BY id {having})"""


def scored(spark, sf_dir, every=False, terms=TERMS):
    return search.hits(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), terms, every)


@query(f"WITH {bm25_sql(TERMS, False)} SELECT id, score, (row_number() OVER (ORDER BY score DESC, id) - 1) AS rank FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return search.top(scored(spark, sf_dir), 20)


@query(f"WITH {bm25_sql(TERMS, True)} SELECT id, score FROM bm")
def bm25_and(spark, sf_dir):
    return scored(spark, sf_dir, every=True)


COS_SQL = """cs AS (SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"""


def cosines(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.vector_scores(vectors, vectors.filter("id = 7").select(F.col("v").alias("q")))


@query(f"WITH {COS_SQL} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM cs WHERE score >= 0.25 ORDER BY score DESC, id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return search.top(cosines(spark, sf_dir), 10, 0.25)


RRF_SQL = f"""{bm25_sql(TERMS, False)}, {COS_SQL}, bt AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM bm ORDER BY score DESC, id LIMIT 30),
ct AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM cs WHERE score >= 0.25 ORDER BY score DESC, id LIMIT 30),
fu AS (SELECT coalesce(bt.id, ct.id) AS id, round(1000.0::DOUBLE * (coalesce(1.0::DOUBLE / (60.0 + bt.r), 0) + coalesce(1.3::DOUBLE / (60.0 + ct.r), 0)), 6) AS fused FROM bt FULL JOIN ct ON bt.id = ct.id),
fd AS (SELECT fu.id, fused, md5(text) AS key, length(text) AS n FROM fu JOIN documents ON fu.id = doc_id)"""


def fused(spark, sf_dir):
    both = search.fuse(search.top(scored(spark, sf_dir), 30), search.top(cosines(spark, sf_dir), 30, 0.25))
    texts = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5("text").alias("key"), F.length("text").cast("long").alias("n"))
    return search.first_of_key(both.join(texts, "id"), "key", [F.desc("fused"), F.asc("id")])


@query(f"WITH {RRF_SQL} SELECT id, fused FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fused DESC, id) AS k FROM fd) WHERE k = 1")
def rrf_hybrid(spark, sf_dir):
    return fused(spark, sf_dir).select("id", "fused")


@query(f"""WITH {RRF_SQL}, o AS (SELECT id, n, fused FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fused DESC, id) AS k FROM fd) WHERE k = 1),
u AS (SELECT id, row_number() OVER (ORDER BY fused DESC, id) - 1 AS rank, sum(n) OVER (ORDER BY fused DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM o) SELECT id, rank, used FROM u WHERE used <= 60000""")
def context_budget(spark, sf_dir):
    best = search.top(fused(spark, sf_dir).withColumnRenamed("fused", "score"), 60)
    return search.within_budget(best, "n", 60_000).select("id", "rank", "used")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(1.0 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 6) AS similarity
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE round(1.0 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 6) >= 0.4""")
def levenshtein_match(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return similarity.similar_names(parts, ["p_brand", "p_size"], 0.4)


GRAM_SQL = "list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])"


@query(rf"""WITH a AS (SELECT item_id AS item, {GRAM_SQL} AS g FROM (SELECT item_id, {TOKEN_SQL.format("text")} AS w FROM benchmark)),
b AS (SELECT doc_id AS doc, {GRAM_SQL} AS g FROM (SELECT doc_id, {TOKEN_SQL.format("text")} AS w FROM documents)),
x AS (SELECT item, len(g) AS na, unnest(g) AS t FROM a), y AS (SELECT doc, len(g) AS nb, unnest(g) AS t FROM b),
m AS (SELECT item, doc, count(*) AS bo, any_value(na) AS na, any_value(nb) AS nb FROM x JOIN y USING (t) GROUP BY 1, 2)
SELECT item, doc, round(bo * 100.0::DOUBLE / (na + nb - bo), 6) AS jaccard, round(bo * 100.0::DOUBLE / na, 6) AS containment FROM m WHERE round(bo * 100.0::DOUBLE / na, 6) >= 20""")
def jaccard3(spark, sf_dir):
    of = lambda name, key: read_table(spark, sf_dir, name).select(F.col(key).alias("id"), tx.tokens(F.col("text")).alias("w")).select("id", similarity.grams(F.col("w")).alias("grams"))
    return similarity.gram_similarity(of("benchmark", "item_id"), of("documents", "doc_id"), 20.0)
