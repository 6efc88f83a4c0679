"""Small scalar functions as columns: durations, bans, URLs, ids, clean-up, comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a ban by the number of violations, the last for all further ones (fixed values).
BAN_LADDER = (3600, 10_800, 86_400, 259_200)
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def local_day(ts: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """The local date of a UTC time."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts))


def parse_duration(text: Column) -> Column:
    """Seconds of ``30s``, ``1m``, ``1h`` or ``2d``; null for other texts."""
    number = F.expr("cast(null as bigint)")
    low = F.lower(F.trim(text))
    for unit, seconds in UNITS.items():
        number = F.when(low.rlike(f"^[0-9]{{1,9}}{unit}$"), F.regexp_extract(low, "^([0-9]+)", 1).try_cast("bigint") * seconds).otherwise(number)
    return number


def ban_seconds(violations: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BAN_LADDER)), F.least(F.greatest(violations, F.lit(1)), F.lit(len(BAN_LADDER))).cast("int"))


def remaining_text(seconds: Column) -> Column:
    """``1d 2h``, ``3h 4m`` or ``5m 6s``; empty once nothing remains."""
    s = F.ceil(seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    pair = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))
    return F.when(s <= 0, "").when(d > 0, pair(d, "d", h, "h")).when(h > 0, pair(h, "h", m, "m")).otherwise(pair(m, "m", s % 60, "s"))


def seconds_to_midnight(ts: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    return (F.lit(86400) - (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local))).cast("long")


def snowflake_bucket(i: Column, buckets: int) -> Column:
    return F.pmod(F.shiftright(i, 22), F.lit(buckets))


def url_norm(text: Column) -> Column:
    """A URL without quotes or brackets around it, with a scheme."""
    bare = F.regexp_replace(F.trim(text), "^[<\"']+|[>\"']+$", "")
    return F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def private_host(host: Column) -> Column:
    """Whether a host isn't public: by name, or by the private, loopback, link-local, shared, multicast and reserved
    ranges of IPv4 and IPv6 addresses, with or without brackets."""
    name = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    v4 = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") & name.rlike(r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^192\.0\.[02]\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.")
    v6 = name.contains(":") & name.rlike(r"^(::1?$|::ffff:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|2001:db8:)")
    return name.isin("localhost", "0.0.0.0") | name.rlike(r"\.(local|localhost|internal|lan|onion)$") | v4 | v6


def drive_id(url: Column) -> Column:
    """The file id of a share link, by path or by query."""
    return F.coalesce(F.nullif(F.regexp_extract(url, "/d/([A-Za-z0-9_-]{10,})", 1), F.lit("")), F.nullif(F.regexp_extract(url, "[?&]id=([A-Za-z0-9_-]{10,})", 1), F.lit("")))


def mention_ids(text: Column) -> Column:
    """The numbers among the words of a text, once the marks of mentions are gone, in order."""
    bare = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, "<@|[>!&]", ""))
    return F.filter(bare, lambda w: w.rlike("^[0-9]+$"))


def hex_color(text: Column) -> Column:
    """#RGB, #RRGGBB or 0xRRGGBB as a number; null for other texts."""
    digits = F.lower(F.regexp_replace(F.trim(text), "^(#|0[xX])", ""))
    double = F.regexp_replace(digits, "^([0-9a-f])([0-9a-f])([0-9a-f])$", "$1$1$2$2$3$3")
    return F.when(double.rlike("^[0-9a-f]{6}$"), F.conv(double, 16, 10).cast("long"))


def slug(text: Column, plain: Column | None = None) -> Column:
    low = plain if plain is not None else F.lower(text)
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_think(text: Column) -> Column:
    """Text without <think> blocks, closed or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def dedup_words(text: Column, passes: int = 5) -> Column:
    """Words that repeat right away once."""
    out = text
    for _ in range(passes):
        out = F.regexp_replace(out, r"(?iU)\b(\w+)\s+\1\b", "$1")
    return out


def json_block(text: Column) -> Column:
    """The JSON object in a text, from a fence or between the outer braces, without trailing commas."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    found = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.nullif(F.regexp_replace(found, r",\s*([}\]])", "$1"), F.lit(""))


def outputs_equal(actual: Column, expected: Column, eps: float = 1e-6) -> Column:
    """Whether two outputs have the same tokens, numbers up to eps relative to the expected one or to 1."""
    split = lambda t: F.filter(F.split(F.trim(t), r"[ \t\r\n]+"), lambda x: x != "")

    def same(x: Column, y: Column) -> Column:
        a, b = x.try_cast("double"), y.try_cast("double")
        return F.coalesce(x == y, F.lit(False)) | F.coalesce(F.abs(a - b) <= F.greatest(F.abs(b), F.lit(1.0)) * eps, F.lit(False))

    a, b = split(actual), split(expected)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, same), lambda ok: ok)


def study_level(xp: Column, marks: tuple[int, ...] = (0, 100, 300, 700, 1500, 3000, 5000)) -> Column:
    """The number of marks that XP has reached."""
    return sum((F.when(xp >= m, 1).otherwise(0) for m in marks), F.lit(0))


def exam_difficulty(raw: Column, kind: Column) -> Column:
    """Difficulty of 10 from a raw index, lifted and held in a band by the kind of paper."""
    band = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    return (
        F.when(kind == "none", 2.0).when(kind == "competitive", band(raw + 2.5, 8.8, 10.0)).when(kind == "olympiad", band(raw + 1.8, 8.0, 9.8))
        .when(kind == "gifted", band(raw + 2.0, 8.5, 10.0)).when(kind == "grade12", band(raw, 4.5, 8.5)).otherwise(band(raw, 1.0, 10.0))
    )


def difficulty_tier(x: Column) -> Column:
    return F.when(x < 4.5, "easy").when(x < 6.5, "medium").when(x < 8.2, "hard").otherwise("expert")


def default_minutes(questions: Column) -> Column:
    return F.greatest(F.lit(45), F.least(F.lit(120), F.bround(questions * 1.8, 0).cast("int")))
