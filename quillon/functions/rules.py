"""Rules of the platform as columns: contests, fair play, quotas, study ranks, tracks, names and titles."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the platform's rules.
EVENT_WORDS = ("icpc", "huawei", "challenge", "global", "championship", "cup", "marathon", "kotlin", "pinely", "harbour", "codeton", "good bye", "hello", "epic", "ton")
DIVISIONS = (
    (("div. 4", "div 4"), (800, 800, 800, 900, 1100, 1200, 1400, 1500), 100, 1600),
    (("div. 3", "div 3"), (800, 900, 1000, 1200, 1500, 1700, 1900), 100, 2100),
    (("div. 2", "div 2"), (1000, 1200, 1500, 1800, 2100, 2400), 150, 2800),
    (("div. 1", "div 1"), (1800, 2100, 2400, 2700, 3000, 3300), 150, 3500),
    (("educational", "edu", "global", "pinely", "ton", "harbour", "codeton", "hello", "good bye"), (800, 1000, 1300, 1600, 1900, 2300, 2700, 3000), 150, 3500),
    ((), (800, 1000, 1200, 1500, 1800, 2100, 2400), 200, 3500),
)
RAPID_SECONDS, RAPID_CHARS, RAPID_LINES = 7.5, 180, 10
LENGTH_POINTS = {"Ngắn": 10, "Vừa": 20, "Dài": 35, "To": 60}
MODE_FACTORS = {"Lite": 1.0, "Flash": 1.5, "Pro": 2.0, "Max": 3.0, "Ultra": 4.0}
INTERNATIONAL_WORDS = ("ielts", "jlpt n1", "jlpt n2", "n1", "n2", "hsk 5", "hsk 6", "hsk5", "hsk6", "sat", "toefl", "olympic", "vnoi", "codeforces", "icpc", "usaco")
ADVANCED_WORDS = ("c++", "cpp", "python", "py", "java", "dsa", "cấu trúc dữ liệu", "thuật toán", "hsg", "chuyên", "thpt quốc gia", "đại học", "n3", "hsk 3", "hsk 4", "nâng cao")
TRUE_FALSE_POINTS = (0.0, 0.10, 0.25, 0.50, 1.00)
#: XP from which a level begins, and the XP of the next.
STUDY_LEVELS = ((0, 100), (100, 300), (300, 700), (700, 1500), (1500, 3000), (3000, 5000))
#: Bands of language proficiency: gifted, regular, any.
BANDS = {
    "ENGLISH": ("IELTS 6.5 -> 8.0+", "IELTS 4.0 -> 5.5", "IELTS 4.0 -> 6.5"),
    "CHINESE": ("HSK 5 -> 9", "HSK 1 -> 4", "HSK 1 -> 9"),
    "JAPANESE": ("JLPT N2 -> N1", "JLPT N5 -> N3", "JLPT N5 -> N1"),
    "KOREAN": ("TOPIK 4 -> 6", "TOPIK 1 -> 3", "TOPIK 1 -> 6"),
    "RUSSIAN": ("TRKI B2 -> C2", "TRKI A1 -> B1", "TRKI A1 -> C1"),
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(w) for w in words]) if words else F.lit(True)


def event_multiplier(text: Column, rating: Column) -> Column:
    """The factor of points for events: by words of the names (in any case), or by a rating of 2000 or more; else 1."""
    low, r = F.lower(text), F.coalesce(F.nullif(rating, F.lit(0)), F.lit(1200))
    factor = (
        F.when(has_any(low, ("icpc", "huawei")) | (r >= 2400), 1.75)
        .when(has_any(low, ("global", "championship")) | (r >= 2100), 1.50)
        .when((r >= 1800) | has_any(low, ("pinely", "codeton")), 1.35)
        .otherwise(1.20)
    )
    return F.when(has_any(low, EVENT_WORDS) | (r >= 2000), factor).otherwise(1.0)


def problem_rating(contest: Column, index: Column) -> Column:
    """The rating to expect of a problem from its contest's division and its letter; past the table it rises by steps
    up to a bound."""
    low, letter = F.lower(contest), F.upper(F.substring(index, 1, 1))
    place = F.when(letter.rlike("^[A-Z]"), F.ascii(letter) - 65).otherwise(0)

    def of(table: tuple[int, ...], step: int, most: int) -> Column:
        return F.coalesce(F.get(F.array(*map(F.lit, table)), place), F.least(F.lit(most), F.lit(table[-1]) + (place - len(table) + 1) * step))

    *named, (_, table, step, most) = DIVISIONS
    out = of(table, step, most)
    for words, table, step, most in reversed(named):
        out = F.when(has_any(low, words), of(table, step, most)).otherwise(out)
    return out.cast("int")


def rapid_paste(code: Column, seconds: Column) -> Column:
    """Whether code came faster than it can be typed."""
    trimmed = F.regexp_replace(code, r"^\s+|\s+$", "")
    lines = F.size(F.filter(F.split(trimmed, r"\r\n|[\r\n]"), lambda x: x.rlike(r"\S")))
    return (seconds > 0) & (seconds < RAPID_SECONDS) & ((F.length(trimmed) >= RAPID_CHARS) | (lines >= RAPID_LINES))


def fair_play(ai: Column, plagiarism: Column, rapid: Column) -> Column:
    """CHEATING_DETECTED, SUSPICIOUS or CLEAN from the scores (of 100) and rapid pasting."""
    cheating = (ai >= 80) | (plagiarism >= 85) | (rapid & ((ai >= 50) | (plagiarism >= 65)))
    return F.when(cheating, "CHEATING_DETECTED").when((ai >= 55) | (plagiarism >= 65) | rapid, "SUSPICIOUS").otherwise("CLEAN")


def token_similarity(a: Column, b: Column) -> Column:
    """Percent: the larger of the Jaccard similarity of three-token windows (tokens, where either has fewer than three)
    and 75 times the share of a's tokens that b has."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.concat_ws("\x1f", F.slice(t, i, 3))))
    long_enough = (F.size(a) >= 3) & (F.size(b) >= 3)
    ga, gb = F.when(long_enough, grams(a)).otherwise(F.array_distinct(a)), F.when(long_enough, grams(b)).otherwise(F.array_distinct(b))
    both = F.size(F.array_intersect(ga, gb))
    jaccard = both / (F.size(ga) + F.size(gb) - both)
    overlap = F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a)
    score = F.when(a == b, 100.0).otherwise(F.least(F.lit(100.0), F.round(F.greatest(jaccard * 100.0, overlap * 75.0), 1)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def win_chances(own: Column, other: Column, own_lives: Column, other_lives: Column) -> Column:
    """Percent: the Elo chance between 1 and 99, where one life against two must win twice; no life is no chance."""
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own) / 400.0))))
    won = F.when((own_lives == 2) & (other_lives == 1), 1 - (1 - p) * (1 - p)).when((own_lives == 1) & (other_lives == 2), p * p).otherwise(p)
    return F.when(own_lives <= 0, 0.0).when(other_lives <= 0, 100.0).otherwise(F.round(F.greatest(F.lit(1.0), F.least(F.lit(99.0), won * 100.0)), 1))


def token_cost(length: Column, mode: Column, subject: Column) -> Column:
    """Points of the length times the factors of mode and subject, rounded half to even; 10 and 1 for unknown names."""
    low = F.lower(subject)
    factor = F.when(has_any(low, INTERNATIONAL_WORDS), 1.4).when(has_any(low, ADVANCED_WORDS), 1.2).otherwise(1.0)
    look = lambda table, key, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))
    return F.bround(look(LENGTH_POINTS, length, 10) * look(MODE_FACTORS, mode, 1.0) * factor).cast("int")


def true_false_points(right: Column) -> Column:
    """Points of a question with four statements, by how many were judged right."""
    return F.element_at(F.array(*map(F.lit, TRUE_FALSE_POINTS)), F.greatest(F.lit(0), F.least(F.lit(4), right)).cast("int") + 1)


def matching_answers(given: Column, keys: Column) -> Column:
    """How many entries of the map of given answers equal those of the keys, without case or blanks around."""
    norm = lambda x: F.upper(F.trim(x))
    return F.size(F.map_filter(given, lambda k, v: norm(v) == norm(F.coalesce(F.try_element_at(keys, k), F.lit("")))))


def study_rank(xp: Column) -> list[Column]:
    """level, next_xp and progress in percent."""
    x = F.greatest(F.lit(0), F.coalesce(xp, F.lit(0)))
    level, goal, progress = F.lit(1), F.lit(100), F.floor(x * 100 / 100)
    for k, (start, end) in enumerate(STUDY_LEVELS[1:], 2):
        here = F.least(F.lit(100), F.floor((x - start) / 20)) if k == len(STUDY_LEVELS) else F.floor((x - start) * 100 / (end - start))
        level, goal, progress = (F.when(x >= start, new).otherwise(old) for new, old in ((k, level), (end, goal), (here, progress)))
    return [level.alias("level"), goal.alias("next_xp"), progress.cast("int").alias("progress")]


def bytes_text(size: Column) -> Column:
    """A size in B to TB, rounded to two places."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    power = sum(((size >= F.lit(1024**k)).cast("int") for k in range(2, 5)), (size >= 1024).cast("int"))
    return F.when(size <= 0, "0 B").otherwise(F.concat(F.round(size / F.pow(F.lit(1024.0), power), 2).cast("string"), F.lit(" "), F.element_at(units, power + 1)))


def display_name(*names: Column, default: str) -> Column:
    """The first name that is neither null nor empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(default))


def academic_year(stored: Column, text: Column) -> Column:
    """The stored year, or the first span of two years in the text, without blanks."""
    found = F.regexp_replace(F.regexp_extract(text, r"(20\d{2}\s*[-–—]\s*20\d{2})", 1), " ", "")
    return F.coalesce(F.nullif(stored, F.lit("")), F.nullif(found, F.lit("")))


def grade_matches(grade: str, level: Column, title: Column) -> Column:
    """Whether level or title name a grade; the lower grades need the word before the number in a title."""
    lv, tt = F.lower(F.coalesce(level, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    if grade in ("GRADE_12", "GRADE_11", "GRADE_10"):
        return lv.contains(grade[6:]) | tt.contains(grade[6:])
    if grade.startswith("GRADE_"):
        n = grade[6:]
        return lv.contains(n) | has_any(tt, (f"lớp {n}", f"lop {n}"))
    if grade == "MIDDLE_SCHOOL":
        return has_any(lv, ("thcs", "cấp 2")) | tt.contains("thcs")
    if grade == "UNIVERSITY":
        return lv.contains("đại học") | tt.contains("đại học")
    if grade == "OLYMPIAD_GIFTED":
        return has_any(lv, ("chuyên", "hsg", "olympic"))
    return lv.contains(grade.lower()) | tt.contains(grade.lower())


def mass_mention(text: Column, most: int = 4) -> Column:
    """Whether a message calls everyone, or more than ``most`` members."""
    return text.rlike("@(everyone|here)") | (F.regexp_count(text, F.lit("<@!?[0-9]+>")) > most)


def has_invite(text: Column) -> Column:
    return text.rlike(r"(?i)(discord\.gg|discord(app)?\.com/invite)/[a-z0-9-]+")


def language_band(subject: Column, track: Column, grade: Column) -> Column:
    """The band of proficiency of a foreign language for a track and grade; null for other subjects."""
    gifted = track.isin("CHUYEN", "HSG", "QUOC_TE") | (grade == "OLYMPIAD_GIFTED")
    regular = (track == "THUONG") & (grade != "UNKNOWN")
    out = F.lit(None).cast("string")
    for name, (high, low, any_) in BANDS.items():
        out = F.when(subject == name, F.when(gifted, high).when(regular, low).otherwise(any_)).otherwise(out)
    return out


def exam_track(hits: dict[str, Column], category: Column, questions: Column, competitive: Column, olympiad: Column, score: Column, applied: Column, high: Column) -> Column:
    """QUOC_TE, CHUNG, CHUYEN, HSG or THUONG. hits: whether words of each of the five were found; applied and high: the
    numbers of questions of the two upper levels."""
    n = F.greatest(F.lit(1), questions)
    far, both = high / n, (applied + high) / n
    return (
        F.when(hits["QUOC_TE"] & ~category.isin("ADMIN_CONTRACT", "LESSON_PLAN"), "QUOC_TE")
        .when(category.isin("ADMIN_CONTRACT", "LESSON_PLAN", "THEORY_SYLLABUS"), "CHUNG")
        .when(hits["CHUNG"] & ~hits["CHUYEN"] & ~hits["HSG"], "CHUNG")
        .when((questions == 0) & (category == "GENERAL_DOCUMENT") & ~competitive, "CHUNG")
        .when(competitive | olympiad | (hits["CHUYEN"] & ~hits["THUONG"]) | (score >= 8.3) | (far >= 0.35), "CHUYEN")
        .when(hits["HSG"] & ~hits["CHUYEN"], "HSG")
        .when((score >= 6.2) & ((both >= 0.45) | (far >= 0.20)) & ~(hits["THUONG"] & (score < 7.0)), "HSG")
        .otherwise("THUONG")
    )


def confidence_level(dimensions: list[Column], errors: Column, fatal: Column) -> Column:
    """high, medium or low from the mean and the least of the dimensions, and from the errors there are."""
    mean = reduce(add, dimensions) / len(dimensions)
    return F.when((mean >= 0.82) & (F.least(*dimensions) >= 0.60) & (errors == 0), "high").when((mean >= 0.55) & (fatal == 0), "medium").otherwise("low")


def zone_score(head: Column, body: Column, terms: dict[str, float]) -> Column:
    """The score of weighted terms: 3.5 times the weight for each of up to three in the head, and the weight times
    1 + ln(1 + n) for n in the body."""
    count = lambda text, term: F.regexp_count(text, F.lit(term))
    parts = [count(head, t).cast("double") for t in terms], [count(body, t).cast("double") for t in terms]
    return reduce(add, [F.least(h, F.lit(3.0)) * (3.5 * w) + F.when(b > 0, (F.log1p(b) + 1.0) * w).otherwise(0.0) for h, b, w in zip(*parts, terms.values(), strict=True)])


def claimed(name: Column, claims: tuple[tuple[str, str], ...]) -> Column:
    """The subject that the first keyword found in a file name claims, words being set off by other characters."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for word, subject in reversed(claims):
        out = F.when(low.rlike(rf"(^|[^a-z0-9]){word}($|[^a-z0-9])"), subject).otherwise(out)
    return out
