"""Text functions as columns, and the few that need Python as small Arrow helpers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of letters, digits and underscores, the same in Java and RE2.
TOKEN = r"[\p{L}\p{N}_]+"
#: Vietnamese letters with marks and their plain forms (fixed values).
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, which Spark SQL lacks."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def composed(text: Column) -> Column:
    """text in normal form C. Characters below U+0300 are in it, whatever stands beside them, so texts of these alone, which are
    most, don't leave the JVM."""
    return F.coalesce(nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def strip_accents(text: Column) -> Column:
    """Lower case without the marks of Vietnamese letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def content_key(text: Column) -> Column:
    """A text's content in normal form C, without case, page marks, white space and punctuation other than that of formulas."""
    low = F.lower(composed(F.coalesce(text, F.lit(""))))
    unpaged = F.regexp_replace(low, r"\b(?:page|trang)[ \t\n\r]*[0-9]+[ \t\n\r]*(?:of|/|trên)?[ \t\n\r]*[0-9]*\b", "")
    return F.regexp_replace(unpaged, r"[^\p{L}\p{N}_+=\-*/^()]+", "")


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles, navigation, footers, asides, comments and tags go, entities are read, white
    space is one blank."""
    t = html
    for tag in ("script", "style", "nav", "footer", "aside"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def lexical_density(text: Column) -> Column:
    """Distinct words per word, words being split at blanks."""
    words = F.filter(F.split(F.lower(text), "[ \t\n\r]+"), lambda w: w != "")
    return F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))


def line_metrics(text: Column) -> dict[str, Column]:
    """Counts of lines, blank lines and comment lines, and the comments' share of the lines that aren't blank."""
    lines = F.split(text, "\n")
    blank = F.size(F.filter(lines, lambda x: F.trim(x) == ""))
    comment = F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^(//|#|/\\*|\\*)")))
    solid = F.size(lines) - blank
    return {"n_lines": F.size(lines), "n_blank": blank, "n_comment": comment, "comment_ratio": F.when(solid > 0, comment / solid).otherwise(0.0)}


@F.pandas_udf(T.DoubleType())
def _entropy(s: pd.Series) -> pd.Series:
    def of(text: str) -> float:
        n = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)[1]
        # H = log2 N - (sum n log2 n) / N
        return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())

    return s.map(of)


def char_entropy(docs: DataFrame, key: str, text: str, places: int = 3) -> DataFrame:
    """(key, entropy): Shannon entropy of a text's characters in bits; texts without characters give no row. Characters
    are counted within the row, so nothing is shuffled."""
    return docs.filter(F.length(text) > 0).select(key, F.round(_entropy(text), places).alias("entropy"))


#: Character classes of the script profile (fixed values).
SCRIPTS = {
    "kana": "[぀-ヿ]", "hangul": "[가-힯]", "cjk": "[一-龥]",
    "vietnamese": f"[{ACCENTED}]", "cyrillic": "[Ѐ-ӿ]", "french": "[àâæçéèêëîïôœùûüÿ]",
}


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each class. No class has ASCII, so that goes first; letters that aren't one range are looked up, not tried
    one by one."""
    rest = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x7F]+", "")
    listed = lambda p: F.length(rest) - F.length(F.translate(rest, p[1:-1], ""))
    return {k: F.regexp_count(rest, F.lit(p)) if p[2] == "-" else listed(p) for k, p in SCRIPTS.items()}


def script_language(n: dict[str, Column]) -> Column:
    """The language that the script counts tell, by priority."""
    return (
        F.when(n["kana"] >= 10, "JAPANESE").when(n["hangul"] >= 10, "KOREAN").when((n["cjk"] >= 20) & (n["kana"] == 0), "CHINESE")
        .when(n["cyrillic"] >= 20, "RUSSIAN").when(n["vietnamese"] >= 15, "VIETNAMESE")
        .when((n["french"] >= 25) & (n["vietnamese"] < 10), "FRENCH").otherwise("ENGLISH")
    )


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def magic_type(data: Column) -> Column:
    """The format that the first bytes of a file tell."""
    head = F.upper(F.hex(F.substring(data, 1, 8)))
    marks = (("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("4D5A", "exe"), ("7F454C46", "elf"), ("1F8B", "gzip"))
    out = F.lit("unknown")
    for mark, name in reversed(marks):
        out = F.when(head.startswith(mark), name).otherwise(out)
    return out


def pack_chunks(text: str, limit: int) -> list[str]:
    """A text in pieces of at most ``limit`` characters: whole paragraphs while they fit, else whole sentences; a
    longer sentence stays whole."""
    if len(text) <= limit:
        return [text]
    units: list[tuple[str, str, bool]] = []  # separator, text, whether it begins a chunk of its own
    for para in text.split("\n\n"):
        if len(para) > limit:
            units += [(" ", s, i == 0) for i, s in enumerate(re.split(r"(?<=[.!?])\s+", para))]
        else:
            units.append(("\n\n", para, False))
    out, now = [], ""
    for sep, unit, fresh in units:
        if fresh or len(now) + len(sep) + len(unit) > limit:
            out += [now] if now else []
            now = unit
        else:
            now = f"{now}{sep}{unit}" if now else unit
    return [*out, now] if now else out


def chunk_texts(docs: DataFrame, key: str, text: str, limit: int = 2000) -> DataFrame:
    """(key, part_no, chunk, hash16): a row for each chunk, with a short content hash."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: pack_chunks(x or "", limit))

    rows = docs.select(key, F.posexplode(packed(text)).alias("part_no", "chunk"))
    return rows.withColumn("hash16", F.substring(F.sha2("chunk", 256), 1, 16))


def simhash64(words: list[str]) -> int:
    """64-bit SimHash of the three-word shingles of words, as a signed number; a tied bit is 0."""
    from hashlib import md5

    grams = ["_".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else words
    if not grams:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join(md5(g.encode()).digest()[:8] for g in grams), np.uint8).reshape(-1, 8), axis=1)
    on = bits.sum(axis=0, dtype=np.int64) * 2 > len(grams)
    return int.from_bytes(np.packbits(on).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def simhash(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash of texts; 0 for those of under 10 characters. With fewer than three words, runs of four characters
    are the words."""
    word = re.compile(r"[^\W]+")
    for x in s:
        yield x.map(lambda t: 0 if not t or len(t) < 10 else simhash64(w if len(w := word.findall(t.lower())) >= 3 else [t[i : i + 4] for i in range(len(t) - 3)]))


# Letters of a legacy Vietnamese charset (TCVN3), each before its letter in Unicode; those that mark a text as
# legacy; signs of a symbol font's private area, each before its sign.
LEGACY_LETTERS = (
    "¡Ă ¢Â £Ê ¤Ô ¥Ơ ¦Ư §Đ ¨ă ©â ªê «ô ¬ơ \xadư ®đ µà ¶ả ·ã ¸á ¹ạ »ằ ¼ẳ ½ẵ ¾ắ Æặ Çầ Èẩ Éẫ Êấ Ëậ Ìè Îẻ Ïẽ Ðé Ñẹ Òề Óể Ôễ Õế Öệ "
    "×ì Øỉ Üĩ Ýí Þị ßò áỏ âõ ãó äọ åồ æổ çỗ èố éộ êờ ëở ìỡ íớ îợ ïù ñủ òũ óú ôụ õừ öử ÷ữ øứ ùự úỳ ûỷ üỹ ýý þỵ"
).split(" ")
LEGACY_MARKS = "¸µ¶·¹ª«¬®¾»¼½ÆÇÈÉËÌÎÏÐÑÒÓÕÖ×ØÜÞßäåæçëìîïñö÷øþ\xad"
SYMBOLS = (
    "\uf02b+ \uf02d- \uf03d= \uf0b1± \uf0b4× \uf0b8÷ \uf0d6√ \uf0a5∞ \uf0a3≤ \uf0b3≥ \uf0b9≠ \uf0bb≈ \uf0ae→ \uf0ac← \uf0ab↔ \uf0db⇔ \uf0de⇒ \uf0dc⇐ \uf0ce∈ \uf0cf∉ \uf0cc⊂ \uf0cd⊆ \uf0c7∩ "
    "\uf0c8∪ \uf0c6∅ \uf022∀ \uf024∃ \uf044Δ \uf057Ω \uf070π \uf061α \uf062β \uf067γ \uf064δ \uf065ε \uf06cλ \uf06dμ \uf072ρ \uf073σ \uf074τ \uf066φ \uf077ω \uf0b0° \uf0d0∠ \uf05e⊥ \uf0b7•"
).split(" ")
# a blank of the symbol font, and two marks of no width that go
SYMBOL_FROM = "\uf020" + "".join(x[0] for x in SYMBOLS) + "\u200b\ufeff"
SYMBOL_TO = " " + "".join(x[1] for x in SYMBOLS)


def is_legacy(text: Column) -> Column:
    """Twelve or more letters that mark the legacy charset, and few that only Unicode has."""
    marks = F.regexp_count(text, F.lit(f"[{LEGACY_MARKS}]"))
    return (marks >= 12) & (F.regexp_count(text, F.lit("[\u1ea0-\u1ef9]")) < marks * 0.25)


def exam_text(text: Column) -> Column:
    """An exam's text with legacy letters and symbols as Unicode in NFC, and no blanks before line ends; two empty lines in a
    row become one. Null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    read = F.when(is_legacy(text), F.translate(text, "".join(x[0] for x in LEGACY_LETTERS), "".join(x[1] for x in LEGACY_LETTERS))).otherwise(text)
    plain = composed(F.translate(read, SYMBOL_FROM, SYMBOL_TO))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "\r\n?", "\n"), "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
