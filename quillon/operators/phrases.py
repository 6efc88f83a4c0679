"""Every phrase of a lexicon with its places, in one pass over a text, and the classifiers that live on them.

An automaton over all phrases (Aho-Corasick) goes over each text once, however many phrases there are; it is built on the
driver from the lexicon, whose size is the caller's, and broadcast. What comes back is narrow: places, no text. Zones,
weights, suppression, margins and evidence are SQL on these places.

Lexicons are sequences (subject, phrase, weight); a phrase is looked for in lower case as a substring, from left to right
without overlaps, as a count of a substring goes. Phrases of more than SHORT characters with accents are also looked for in
the text without accents.

Defined results: a null text counts as empty, and a document without hits has no rows of hits but one of each verdict.
Documents have ids (id, text); two rows with one id are one document with the hits of both.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Lexicon = Sequence[tuple[str, str, float]]

# Fixed values of the platform's rules.
HEADER, FOOTER, HEADER_BOOST, HEADER_MOST = 1200, 1500, 3.5, 3
PLAIN_FACTOR, PLAIN_MOST, SHORT = 0.6, 4, 4
SUPPRESSION, BONUS, TITLE_BONUS = 0.15, 70.0, 80.0
LEAST_SCORE = 3.5
TITLE = r"(?iu)(?:môn\s*(?:thi|học)?|bài\s*thi|subject)\s*[:：–—-]\s*([^\n\r,;()]{2,40})"
FAST_MOST = 5
FAST_BANDS = ((30.0, 0.99), (15.0, 0.95), (6.0, 0.88), (0.0, 0.75))
FINGERPRINT, LEAST_GRADE = 3.0, 8.0


def without_accents(text: str) -> str:
    """Lower case without combining marks; đ becomes d."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn").replace("đ", "d")


class Finder:
    """An automaton over phrases, and one over those that are longer and have accents, without them."""

    def __init__(self, phrases: Sequence[str]):
        self.phrases = list(dict.fromkeys(p.lower() for p in phrases if p))
        self.plain = {k: without_accents(p) for k, p in enumerate(self.phrases) if len(p) > SHORT and without_accents(p) != p}

    @staticmethod
    def _automaton(words: dict[str, list[int]]):
        import ahocorasick

        made = ahocorasick.Automaton()
        for w, ks in words.items():
            made.add_word(w, (len(w), ks))
        made.make_automaton()
        return made

    def build(self) -> Finder:
        """In the task: automata are made where they are used."""
        by_plain: dict[str, list[int]] = {}
        for k, p in self.plain.items():
            by_plain.setdefault(p, []).append(k)
        self.first = self._automaton({p: [k] for k, p in enumerate(self.phrases)}) if self.phrases else None
        self.second = self._automaton(by_plain) if by_plain else None
        return self

    @staticmethod
    def _places(automaton, text: str) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for end, (n, ks) in automaton.iter(text):
            start = end - n + 1
            for k in ks:
                mine = found.setdefault(k, [])
                if not mine or start >= mine[-1] + n:
                    mine.append(start)
        return found

    def find(self, text: str) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        """Places of each phrase in a text in lower case, and of those without accents in the text without them."""
        hits = self._places(self.first, text) if self.first else {}
        return hits, self._places(self.second, without_accents(text)) if self.second else {}

    def zones(self, text: str, k: int, places: list[int]) -> tuple[int, int]:
        """How often a phrase stands in the header and in the body, each counted from its own beginning: of places that
        overlap, the first may lie across a boundary and the next within the zone."""
        p = self.phrases[k]
        last = len(text) - FOOTER if len(text) > HEADER + FOOTER else None
        body = text.count(p, HEADER, last) if last is not None else len(places)
        return text.count(p, 0, HEADER), body

    def whole(self, text: str, k: int, places: list[int]) -> int:
        """How many places of a phrase have no letter, digit or underscore beside them."""
        n, inner = len(self.phrases[k]), lambda c: c.isalnum() or c == "_"
        return sum(not (p and inner(text[p - 1])) and not (p + n < len(text) and inner(text[p + n])) for p in places)


def phrase_hits(docs: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """(id, length, phrase, places, n_plain, n_whole, n_header, n_body) of each phrase that a document (id, text) has: its places, how often it
    stands in the text without accents, how many places are whole words, and how often it stands in each zone. A document without hits has one row whose
    phrase is null."""
    shared = docs.sparkSession.sparkContext.broadcast(Finder(phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.value.build()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                rows = []
                for i, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    hits, plain = finder.find(text)
                    for k in sorted({*hits, *plain}):
                        places = hits.get(k, [])
                        rows.append((i, len(text), finder.phrases[k], places, len(plain.get(k, ())), finder.whole(text, k, places), *finder.zones(text, k, places)))
                    if not hits and not plain:
                        rows.append((i, len(text), None, [], 0, 0, 0, 0))
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                types = (b.schema.field(0).type, pa.int64(), pa.string(), pa.list_(pa.int64()), *[pa.int64()] * 4)
                made = [pa.array([x.as_py() for x in columns[0]] if k == 0 else columns[k], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(made, names=["id", "length", "phrase", "places", "n_plain", "n_whole", "n_header", "n_body"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, f"id {kind}, length long, phrase string, places array<long>, n_plain long, n_whole long, n_header long, n_body long")


def lexicon_frame(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    rows = [(s, p.lower(), float(w), k) for k, (s, p, w) in enumerate(lexicon)]
    return docs.sparkSession.createDataFrame(rows, "subject string, phrase string, weight double, rank int")


def zone_evidence(hits: DataFrame, lexicon: DataFrame, multipliers: dict[str, float] | None = None) -> DataFrame:
    """(id, subject, phrase, zone, n, points) for the header, the body and, where the body has none, the text without accents:
    n places, and the points that they give. A phrase in the header counts for more; in the body its count saturates."""
    own = F.lit(1.0)
    for subject, m in sorted((multipliers or {}).items()):
        own = F.when(F.col("subject") == subject, m).otherwise(own)
    w = F.col("weight") * own
    found = hits.filter("phrase IS NOT NULL").join(F.broadcast(lexicon), "phrase").select("id", "subject", "phrase", "n_plain", F.col("n_header").alias("h"), F.col("n_body").alias("b"), w.alias("w"))
    zones = F.array(
        F.struct(F.lit("header").alias("zone"), F.col("h").cast("long").alias("n"), (F.col("w") * HEADER_BOOST * F.least("h", F.lit(HEADER_MOST))).alias("points")),
        F.struct(F.lit("body").alias("zone"), F.col("b").cast("long").alias("n"), (F.col("w") * (1.0 + F.log1p("b"))).alias("points")),
        F.struct(F.lit("plain").alias("zone"), F.when(F.col("b") == 0, F.col("n_plain")).otherwise(0).alias("n"), (F.col("w") * PLAIN_FACTOR * F.least("n_plain", F.lit(PLAIN_MOST))).alias("points")),
    )
    return found.select("id", "subject", "phrase", F.explode(F.filter(zones, lambda z: z["n"] > 0)).alias("z")).select("id", "subject", "phrase", "z.*")


def cues(docs: DataFrame, titles: Sequence[tuple[str, str]], conflicts: Sequence[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """(id, subject, phrase, zone, n, points, factor) of what a document's title and cues add: TITLE_BONUS for the subject whose
    name its title begins with, or has as a word; for each conflict (winner, loser, cues) that has a cue anywhere, BONUS for the
    winner and a factor for the loser."""
    text = F.lower(F.coalesce("text", F.lit("")))
    title = F.lower(F.trim(F.regexp_extract(F.substring(text, 1, HEADER), TITLE, 1)))
    row = "array<struct<subject: string, phrase: string, zone: string, n: bigint, points: double, factor: double>>"
    entry = lambda s, p, z, points, factor: F.struct(F.lit(s).alias("subject"), p.alias("phrase"), F.lit(z).alias("zone"), F.lit(1).cast("long").alias("n"), F.lit(points).alias("points"), F.lit(factor).alias("factor"))
    named = F.lit(None)
    for name, subject in reversed(titles):
        named = F.when(F.col("title").startswith(name) | F.col("title").contains(f" {name}"), entry(subject, F.col("title"), "title", TITLE_BONUS, 1.0)).otherwise(named)
    met = [(w, loser, F.exists(F.array(*map(F.lit, cs)), lambda c: F.col("low").contains(c)), "/".join(cs)) for w, loser, cs in conflicts]
    pairs = [F.when(hit, e) for w, loser, hit, cs in met for e in (entry(w, F.lit(cs), "cue", BONUS, 1.0), entry(loser, F.lit(cs), "cue", 0.0, SUPPRESSION))]
    rows = docs.select("id", text.alias("low"), title.alias("title"))
    all_of = F.array_compact(F.array(*([named] if titles else []), *pairs)).cast(row) if titles or pairs else F.array().cast(row)
    return rows.select("id", F.explode(all_of).alias("e")).select("id", "e.*")


def evidence(docs: DataFrame, lexicon: Lexicon, titles: Sequence[tuple[str, str]] = (), conflicts: Sequence[tuple[str, str, tuple[str, ...]]] = (), multipliers: dict[str, float] | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(id, subject, phrase, zone, n, points, factor, counted): the dossier of each subject's score. counted is points times
    the factors of the conflicts that the subject loses; a document's counted of a subject sum to its score."""
    found = phrase_hits(docs, [p for _, p, _ in lexicon]) if hits is None else hits
    lexical = zone_evidence(found, lexicon_frame(docs, lexicon), multipliers).withColumn("factor", F.lit(1.0))
    told = cues(docs, titles, conflicts)
    lost = told.filter("factor < 1").groupBy("id", "subject").agg(F.count(F.lit(1)).alias("k"))
    lost = lost.select("id", "subject", F.pow(F.lit(SUPPRESSION), "k").alias("lost"))
    gained = told.filter("factor = 1")
    # bonuses and losses are given in the order of the conflicts: the loss comes last
    rows = lexical.unionByName(gained).join(lost, ["id", "subject"], "left")
    factor = F.coalesce("lost", F.lit(1.0))
    return rows.select("id", "subject", "phrase", "zone", "n", "points", factor.alias("factor"), (F.col("points") * factor).alias("counted"))


def classify(docs: DataFrame, dossier: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """(id, subject, score, runner_up, runner_up_score, margin, confidence) of every document: the subject with the highest
    score, GENERAL up to LEAST_SCORE; ties go to the earlier of subjects. Confidence goes by the margin to the next."""
    order = F.array_position(F.array(*map(F.lit, subjects)), F.col("subject"))
    sums = dossier.groupBy("id", "subject").agg(F.round(F.sum("counted"), 6).alias("score"))
    line = Window.partitionBy("id").orderBy(F.desc("score"), order)
    two = sums.withColumn("r", F.row_number().over(line)).filter("r <= 2").groupBy("id").agg(
        F.max(F.when(F.col("r") == 1, F.col("subject"))).alias("top"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("r") == 2, F.col("subject"))).alias("second"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("s2"),
    )
    met = docs.select("id").distinct().join(two, "id", "left")
    s1, s2 = F.coalesce("s1", F.lit(0.0)), F.coalesce("s2", F.lit(0.0))
    scored = met.select("id", "top", "second", s1.alias("score"), s2.alias("runner_up_score"), ((s1 - s2) / F.greatest(s1, F.lit(1.0))).alias("margin"))
    score, margin = F.col("score"), F.col("margin")
    confidence = F.when((score > 40) & (margin >= 0.35), 1.0).when((score > 20) & (margin >= 0.20), 0.98).when(score > 8, 0.92).otherwise(F.greatest(F.lit(0.5), F.round(margin, 2)))
    return scored.select("id", F.when(score > LEAST_SCORE, F.col("top")).otherwise("GENERAL").alias("subject"), "score", F.col("second").alias("runner_up"), "runner_up_score", F.round("margin", 6).alias("margin"), confidence.alias("confidence"))


def fast_classify(docs: DataFrame, lexicon: Lexicon, hits: DataFrame | None = None) -> DataFrame:
    """(id, subject, score, confidence): counts up to FAST_MOST a phrase times its weight; phrases of up to SHORT characters
    count as whole words only. Of equal scores the subject that comes first in the lexicon wins; none is GENERAL."""
    found = phrase_hits(docs, [p for _, p, _ in lexicon]) if hits is None else hits
    frame = lexicon_frame(docs, lexicon)
    n = F.when(F.length("phrase") <= SHORT, F.col("n_whole")).otherwise(F.size("places"))
    sums = found.join(F.broadcast(frame), "phrase").groupBy("id", "subject").agg(F.sum(F.col("weight") * F.least(n, F.lit(FAST_MOST))).alias("score"), F.min("rank").alias("rank"))
    best = sums.filter("score > 0").groupBy("id").agg(F.max_by(F.struct("subject", "score"), F.struct("score", -F.col("rank"))).alias("b"))
    met = docs.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("b.subject", F.lit("GENERAL")).alias("subject"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
    confidence: Column = F.lit(0.50)
    for above, value in reversed(FAST_BANDS):
        confidence = F.when(F.col("score") > above, value).otherwise(confidence)
    return met.withColumn("confidence", confidence)


def grade_of(hits: DataFrame, docs: DataFrame, fingerprints: Sequence[tuple[str, str]], explicit: Sequence[tuple[str, str, float]]) -> DataFrame:
    """(id, grade, score) of every document: FINGERPRINT points for each phrase of a grade (grade, phrase) that it has, and the
    points of each sign (grade, phrase, points) in its header; below LEAST_GRADE the grade is null. Ties go to the first name."""
    spark = docs.sparkSession
    marks = spark.createDataFrame([(g, p.lower(), FINGERPRINT, False) for g, p in fingerprints] + [(g, p.lower(), x, True) for g, p, x in explicit], "grade string, phrase string, points double, head boolean")
    headed = F.exists("places", lambda p: p + F.length("phrase") <= HEADER)
    sums = hits.join(F.broadcast(marks), "phrase").filter(~F.col("head") | headed).filter(F.size("places") > 0).groupBy("id", "grade").agg(F.sum("points").alias("score"))
    best = sums.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "grade")).alias("b"))
    met = docs.select("id").distinct().join(best, "id", "left")
    return met.select("id", F.when(-F.col("b.s") >= LEAST_GRADE, F.col("b.grade")).alias("grade"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("score"))
