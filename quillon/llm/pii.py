"""PII by surrogate generation.

Detected entities are replaced by surrogates that a secret key decides. A value is brought into its normal form
first (digits without separators, e-mail addresses in lower case, IBANs without spaces), its surrogate is made from
that, and poured into the format in which it was met; so the same number or address has the same surrogate however
it is written.

* Digits of cards, phones, social security numbers and dates of birth, octets of IPv4 addresses, the letters and
  digits of e-mail addresses and of IBANs go through a keyed Feistel permutation of all values of the same kind
  (same length, same kind of character at each place), so that different entities have different surrogates. A card
  or IBAN that passes its check (Luhn, modulo 97) keeps passing it, and one that doesn't keeps failing. Country codes
  and top-level domains stay; a date of birth becomes another day of the same century.
* Names after a title (Mr, Mrs, Herr, Frau, Monsieur, ...) become invented names of the gender that the title
  tells, in the script of the name (Latin or Cyrillic) and with its capitals; each word of a name has a surrogate
  of its own, and later mentions of the word in the same text, with or without title, get it too.

Coreference holds within and across documents, since a surrogate depends on key, kind and normal form only.
Collisions are looked for over the whole corpus: a surrogate that two values of a kind share, or that is itself a
value of the corpus, is drawn anew for the later value (by another attempt number). A value for which ROUNDS draws
find nothing, as its format leaves too few, gets letters that its key digest spells, whatever its format. Only the
values with such a draw, rarely any, are joined to their documents.

The key is the caller's: there is no default, as whoever has it can undo the permutations.

Tasks stream batches; what is shuffled is the distinct entities. Defined results: a null text becomes an empty
text without entities; repeated rows get equal results; other columns are not looked at. Names without a title and
postal addresses are not looked for.
"""

from __future__ import annotations

import datetime
import hmac
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.session import materialize

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "birth", "name")
#: Draws for values whose surrogates collide.
ROUNDS = 8
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\d-])", re.A)
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A)
PHONE = re.compile(r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)", re.A)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = re.compile(rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)", re.A)
BIRTH = re.compile(r"(?i:\b(?:born(?: on)?|date of birth|d\.?o\.?b\.?|geboren(?: am)?|né(?:e)? le|nacid[oa] el)[:\s]{1,3})(\d{4}-\d{2}-\d{2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?!\d)", re.A)
#: Titles by gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Doña", "Госпожа", "Г-жа")
WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё'’-]+"
NAME = re.compile(rf"(?<![\w-])({'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.? ({WORD}(?: {WORD}){{0,2}})")
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fe", "ga", "ha", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "no", "pa", "ra", "re", "ri", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve"),
    "cyrillic": ("ба", "ве", "га", "да", "де", "за", "ка", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "мо", "на", "не", "ни", "но", "па", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "то", "фа", "ха"),
}
ENDS = {("latin", "m"): ("n", "r", "s", "l"), ("latin", "f"): ("na", "ra", "sa", "la"), ("cyrillic", "m"): ("н", "р", "с", "л"), ("cyrillic", "f"): ("на", "ра", "са", "ла")}


def _number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(parts).encode(), "sha256"), "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network over the next even number of bits, walked on until it
    comes back into the range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            left, right = right, left ^ (_number(key, tweak, str(r), str(right)) & mask)
        value = left << half | right
        if value < size:
            return value


def permute_text(key: bytes, tweak: str, text: str) -> str:
    """text with its ASCII digits and lower-case letters permuted among all texts of the same format."""
    radix = [10 if c.isdigit() else 26 for c in text if c.isascii() and c.isalnum()]
    value, size = 0, 1
    for c, r in zip((c for c in text if c.isascii() and c.isalnum()), radix, strict=True):
        value = value * r + (ord(c) - ord("0") if r == 10 else ord(c) - ord("a"))
        size *= r
    pattern = "".join("9" if c.isascii() and c.isdigit() else "a" if c.isascii() and c.isalpha() else c for c in text)
    value = permute(key, f"{tweak}:{pattern}", value, size)
    new = []
    for r in reversed(radix):
        value, x = divmod(value, r)
        new.append(chr(ord("0") + x) if r == 10 else chr(ord("a") + x))
    return "".join(new.pop() if c.isascii() and c.isalnum() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit of digits."""
    return -sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _remainder(body: str, country: str) -> int:
    """The check number of an IBAN."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _iban(key: bytes, tweak: str, value: str) -> str:
    country, check, body = value[:2], int(value[2:4]), value[4:]
    new = permute_text(key, tweak, body.lower()).upper()
    right, off = _remainder(new, country), (check - _remainder(body, country)) % 97
    return f"{country}{2 + (right - 2 + off) % 97:02d}{new}"


def _head(phone: str) -> int:
    """How many characters of a phone number are its country code."""
    head = re.match(r"\+\d{1,3}(?=[ .(-])", phone)
    return head.end() if head else 2 if phone.startswith("+") else 0


def _day(value: str) -> datetime.date | None:
    try:
        return datetime.date(int(value[:4]), int(value[4:6]), int(value[6:]))
    except ValueError:
        return None


def _birth(key: bytes, tweak: str, value: str) -> str:
    """Another day of the same century."""
    first = datetime.date(int(value[:2]) * 100 or 1, 1, 1)
    days = (datetime.date(first.year + 99, 12, 31) - first).days + 1
    place = permute(key, f"{tweak}:{first.year}", (_day(value) - first).days, days)
    return (first + datetime.timedelta(place)).strftime("%Y%m%d").zfill(8)


def _dated(raw: str, new: str) -> str:
    """The day new (year, month, day) in the format of raw."""
    parts = re.split(r"(\D)", raw)
    year, month, day = new[:4], new[4:6], new[6:]
    return f"{year}{parts[1]}{month}{parts[3]}{day}" if len(parts[0]) == 4 else f"{day}{parts[1]}{month}{parts[3]}{year}"


def normal(kind: str, raw: str) -> str:
    """The form of a value that all ways to write it share."""
    if kind == "email":
        return raw.lower()
    if kind == "iban":
        return raw.replace(" ", "").upper()
    if kind == "phone":
        return re.sub(r"\D", "", raw[_head(raw) :])
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", raw)
    if kind == "birth":
        parts = re.split(r"\D", raw)
        year, month, day = parts if len(parts[0]) == 4 else parts[::-1]
        return f"{year}{month:0>2}{day:0>2}"
    return raw.casefold() if kind == "name" else raw


def pour(kind: str, raw: str, new: str) -> str:
    """The surrogate of a normal form in the format of raw."""
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(raw, new, strict=True)) if len(new) == len(raw) else new
    if kind == "birth" and new.isdigit():
        return _dated(raw, new)
    if kind in ("ssn", "card", "phone", "iban") and not new.islower():
        at = _head(raw) if kind == "phone" else 0
        it = iter(new)
        return raw[:at] + "".join(next(it) if c.isascii() and c.isalnum() else c for c in raw[at:])
    if kind == "name":
        return new.upper() if raw.isupper() and len(raw) > 1 else new.capitalize()
    return new


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a normal form. A name's is gender, ``/`` and the word."""
    tweak = f"{kind}:{attempt}"
    if attempt > ROUNDS:
        digest = f"{_number(key, kind, value):064x}"[:32].translate(str.maketrans("0123456789abcdef", "ghijklmnopqrstuv"))
        return f"{digest}@{value.rpartition('@')[2]}" if kind == "email" else digest
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, dot, top = domain.rpartition(".")
        return f"{permute_text(key, tweak, local)}@{permute_text(key, 'host', host)}{dot}{top}"
    if kind == "card":
        new = permute_text(key, tweak, value[:-1])
        return new + str((luhn(new) + int(value[-1]) - luhn(value[:-1])) % 10)
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, permute(key, tweak, n, 1 << 32).to_bytes(4, "big")))
    if kind == "iban":
        return _iban(key, tweak, value)
    if kind == "birth":
        return _birth(key, tweak, value)
    if kind == "name":
        gender, _, word = value.partition("/")
        script = "cyrillic" if re.search(r"[а-яё]", word) else "latin"
        x = _number(key, tweak, gender, word)
        made = []
        for _ in range(4):
            x, i = divmod(x, len(SYLLABLES[script]))
            made.append(SYLLABLES[script][i])
        x, i = divmod(x, len(ENDS[script, gender]))
        return "".join(made) + ENDS[script, gender][i]
    return permute_text(key, tweak, value)


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a text, without overlaps: earlier kinds win. value: the normal
    form, for a name with the gender before it."""
    found: list[tuple[int, int, str, str]] = []
    starts: list[int] = []
    ends: list[int] = []

    def add(start: int, end: int, kind: str, value: str) -> None:
        # those that are taken don't overlap, so only the neighbours matter
        k = bisect_left(starts, start)
        if (k == 0 or ends[k - 1] <= start) and (k == len(starts) or starts[k] >= end):
            starts.insert(k, start)
            ends.insert(k, end)
            found.append((start, end, kind, value))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email", normal("email", m.group()))
    if re.search(r"\d", text):
        for kind, pattern in (("iban", IBAN), ("card", CARD), ("ssn", SSN), ("phone", PHONE), ("ip", IP)):
            for m in pattern.finditer(text):
                add(m.start(), m.end(), kind, normal(kind, m.group()))
        for m in BIRTH.finditer(text):
            if _day(value := normal("birth", m[1])):
                add(m.start(1), m.end(1), "birth", value)
    words: dict[str, str] = {}
    for m in NAME.finditer(text):
        gender = "m" if m[1] in MALE else "f"
        for w in m[2].split(" "):
            words.setdefault(w, gender)
    if words:
        for m in re.finditer(rf"(?<![\w'’-])(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?![\w-])", text):
            add(m.start(), m.end(), "name", f"{words[m.group()]}/{normal('name', m.group())}")
    return sorted(found)


def _rewrite(text: str, replace: Callable[[str, str], str]) -> tuple[str, list]:
    """The text with its entities replaced, and the entities."""
    out, at, entities = [], 0, detect(text)
    for start, end, kind, value in entities:
        out += [text[at:start], pour(kind, text[start:end], replace(kind, value))]
        at = end
    return "".join(out) + text[at:], entities


def _entities(docs: DataFrame, text: str, key: bytes) -> DataFrame:
    """(kind, value, surrogate): the distinct entities of the corpus with their first surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = sorted({(k, v) for x in batch.column(0).slice(at, 256).to_pylist() if x for _, _, k, v in detect(x)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string()), pa.array([surrogate(key, k, v) for k, v in rows], pa.string())],
                    names=["kind", "value", "surrogate"],
                )

    return docs.select(text).mapInArrow(run, "kind string, value string, surrogate string").distinct()


def _drawn_again(rows: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate, attempt): the next attempt for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, values, attempts = (b.column(i).to_pylist() for i in range(3))
            new = [surrogate(key, k, v, n + 1) for k, v, n in zip(kinds, values, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string()), pa.array([n + 1 for n in attempts], pa.int32())], names=["kind", "value", "surrogate", "attempt"])

    return rows.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, surrogate string, attempt int")


def resolve(entities: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, value, surrogate) of the values whose first surrogate collides; None if there is none."""
    plain = lambda c: F.regexp_replace(c, "^[mf]/", "")
    now = entities.select("kind", "value", "surrogate", F.lit(0).alias("attempt"))
    any_redone = False
    for attempt in range(ROUNDS + 2):
        twice = now.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("kind").alias("k"), F.col("surrogate").alias("s"), "first")
        values = entities.select(F.col("kind").alias("ok"), plain("value").alias("ov")).distinct()
        hit = now.join(twice, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left").join(values, (F.col("kind") == F.col("ok")) & (F.col("surrogate") == F.col("ov")), "left")
        bad = (F.col("s").isNotNull() & (F.col("value") != F.col("first"))) | F.col("ov").isNotNull()
        marked = materialize(hit.select("kind", "value", "surrogate", "attempt", bad.alias("bad")), "surrogates")
        # beyond ROUNDS a surrogate is a digest of the value, which is its own
        if attempt > ROUNDS or marked.filter("bad").isEmpty():
            break
        any_redone = True
        now = marked.filter("not bad").select("kind", "value", "surrogate", "attempt").unionAll(_drawn_again(marked.filter("bad"), key))
    return marked.filter("attempt > 0").select("kind", "value", "surrogate") if any_redone else None


def replace_pii(docs: DataFrame, key: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_entities, kinds): each text with its entities replaced, and how many of which kinds there were."""
    if not key:
        raise ValueError("surrogates need a key")
    kind_of = docs.schema[id_column].dataType.simpleString()
    redone = resolve(materialize(_entities(docs, text, key), "entities"), key)
    plain = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    if redone is None:
        source = plain.select("id", "text", F.lit(None).cast("array<struct<kind:string,value:string,surrogate:string>>").alias("own"))
    else:

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(h, k, v) for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x for k, v in {(k, v) for _, _, k, v in detect(x)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["h", "kind", "value"])

        keyed = plain.withColumn("h", F.xxhash64("text"))
        uses = keyed.select("h", "text").mapInArrow(named, "h long, kind string, value string").distinct()
        own = uses.join(redone, ["kind", "value"]).groupBy(F.col("h").alias("oh")).agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("own"))
        source = keyed.join(own, F.col("h") == F.col("oh"), "left").select("id", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts, counts, kinds = [], [], []
                for x, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    other = {(o["kind"], o["value"]): o["surrogate"] for o in own or ()}
                    new, found = _rewrite(x or "", lambda k, v, other=other: other.get((k, v)) or surrogate(key, k, v))
                    texts.append(new)
                    counts.append(len(found))
                    kinds.append(",".join(f"{k}:{n}" for k in KINDS if (n := sum(f[2] == k for f in found))))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=[id_column, "text", "n_entities", "kinds"])

    return source.mapInArrow(run, f"`{id_column}` {kind_of}, text string, n_entities long, kinds string")
