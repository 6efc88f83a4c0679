"""Reports of inspected documents against requirements and channels, and the shares of their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE = """profile string, subject string, grade string, tier string, min_difficulty double, max_difficulty double, min_questions int, max_questions int, need_answers boolean,
need_solutions boolean, allow_scans boolean, no_spoofs boolean, need_format_2025 boolean, need_lesson_plan boolean, min_quality double, min_coverage double, topics array<string>"""

# Fixed values of the platform's rules: profile, tier, difficulty from and to, answers, scans, spoofs, format of 2025, lesson plan.
PRESETS = (
    ("thpt_graduation", None, 3.5, 6.5, True, False, True, False, False),
    ("university_top", "advanced", 6.6, 8.5, True, False, True, False, False),
    ("olympiad", "olympiad", 8.0, 10.0, False, True, True, False, False),
    ("cv5512", None, None, None, False, True, True, False, True),
    ("moet_2025", None, None, None, True, True, True, True, False),
    ("strict_security", None, None, None, True, False, True, False, False),
)


def presets(spark) -> DataFrame:
    return profiles(spark.createDataFrame(PRESETS, "profile string, tier string, min_difficulty double, max_difficulty double, need_answers boolean, allow_scans boolean, no_spoofs boolean, need_format_2025 boolean, need_lesson_plan boolean"))


def profiles(given: DataFrame) -> DataFrame:
    """Profiles with every requirement, those not given being open: no bound, nothing needed, scans allowed, spoofs not."""
    default = {"need_answers": False, "need_solutions": False, "allow_scans": True, "no_spoofs": True, "need_format_2025": False, "need_lesson_plan": False}
    fields = [f.strip().split(" ") for f in PROFILE.split(",")]
    own = lambda n, t: F.coalesce(F.col(n) if n in given.columns else F.lit(None), F.lit(default.get(n))).cast(t).alias(n)
    return given.select(*[own(n, t) for n, t in fields])


def checks(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, profile, rule, severity, passed): a row for each requirement of a report's profile (profile and PROFILE). A
    report lacks what is null, so it fails the requirement. Reports: id, profile, spoofed, subject, grade, difficulty, tier,
    questions, answers, solutions, scanned, format_2025, lesson_plan, quality, coverage, topics."""
    w = {f.name: F.col(f"w.{f.name}") for f in wanted.schema.fields}
    met = reports.join(wanted.select("profile", F.struct(*wanted.columns).alias("w")), "profile")
    low = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), F.lower)
    has = F.forall(low(w["topics"]), lambda t: F.exists(low(F.col("topics")), lambda x: F.contains(x, t)))
    rules = (
        ("anti_spoof", "error", w["no_spoofs"], ~F.col("spoofed")),
        ("subject", "error", w["subject"].isNotNull(), F.col("subject") == w["subject"]),
        ("grade", "warning", w["grade"].isNotNull(), F.col("grade") == w["grade"]),
        ("min_difficulty", "error", w["min_difficulty"].isNotNull(), F.col("difficulty") >= w["min_difficulty"]),
        ("max_difficulty", "error", w["max_difficulty"].isNotNull(), F.col("difficulty") <= w["max_difficulty"]),
        ("tier", "error", w["tier"].isNotNull(), F.col("tier") == w["tier"]),
        ("min_questions", "error", w["min_questions"].isNotNull(), F.col("questions") >= w["min_questions"]),
        ("max_questions", "error", w["max_questions"].isNotNull(), F.col("questions") <= w["max_questions"]),
        ("answers", "error", w["need_answers"], F.col("answers")),
        ("solutions", "warning", w["need_solutions"], F.col("solutions")),
        ("scans", "error", ~w["allow_scans"], ~F.col("scanned")),
        ("format_2025", "error", w["need_format_2025"], F.col("format_2025")),
        ("lesson_plan", "error", w["need_lesson_plan"], F.col("lesson_plan")),
        ("quality", "error", w["min_quality"].isNotNull(), F.col("quality") >= w["min_quality"]),
        ("coverage", "error", w["min_coverage"].isNotNull(), F.col("coverage") >= w["min_coverage"]),
        ("topics", "warning", F.size(w["topics"]) > 0, has),
    )
    rows = [F.when(asked, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(ok, F.lit(False)).alias("passed"))) for name, severity, asked, ok in rules]
    return met.select("id", "profile", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("id", "profile", "c.*")


def eligible(checked: DataFrame) -> DataFrame:
    """(id, profile, n_passed, n_failed, eligible): a failed error makes a report ineligible, a failed warning doesn't."""
    count = lambda c: F.count(F.when(c, 1))
    failed = ~F.col("passed")
    return checked.groupBy("id", "profile").agg(count(F.col("passed")).alias("n_passed"), count(failed).alias("n_failed"), (count(failed & (F.col("severity") == "error")) == 0).alias("eligible"))


def compliance(posts: DataFrame, channels: DataFrame, home: DataFrame, elsewhere: str) -> DataFrame:
    """(id, channel, reason, suggested): the first rule of its channel that a post breaks, null where it breaks none, and
    the home channel of its subject then. posts: id, channel, verdict, category, track, grade, subject; channels: channel,
    category, tracks, grades, subjects, wildcard, null or empty lists allowing all but subjects; home: subject, suggested."""
    rules = channels.select("channel", F.struct(*[c for c in channels.columns if c != "channel"]).alias("r"))
    allows = lambda xs, x: (F.coalesce(F.size(xs), F.lit(0)) <= 0) | F.coalesce(F.array_contains(xs, F.col(x)), F.lit(False))
    known = F.coalesce(F.col("grade"), F.lit("unknown")) != "unknown"
    reason = (
        F.when(F.col("verdict") == "failed", "unverifiable")
        .when(F.col("r.category").isNotNull() & ~F.col("category").eqNullSafe(F.col("r.category")), "category")
        .when(~allows(F.col("r.tracks"), "track"), "track")
        .when(known & ~allows(F.col("r.grades"), "grade"), "grade")
        .when(~F.coalesce(F.col("r.wildcard"), F.lit(False)) & ~F.coalesce(F.array_contains("r.subjects", F.col("subject")), F.lit(False)), "subject")
    )
    met = posts.join(rules, "channel").withColumn("reason", reason).join(home, "subject", "left")
    return met.select("id", "channel", "reason", F.when(F.col("reason") != "unverifiable", F.coalesce("suggested", F.lit(elsewhere))).alias("suggested"))


def breakdown(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """(by, n, n_flagged, share) of all rows."""
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(flag, 1)).alias("n_flagged"))
    # the total is one row
    return sums.join(F.broadcast(sums.agg(F.sum("n").alias("all"))), F.lit(True)).select(by, "n", "n_flagged", F.round(F.col("n") / F.col("all"), 6).alias("share"))
