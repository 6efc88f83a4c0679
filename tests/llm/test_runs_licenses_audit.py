"""Periodic runs, license scans and the filter audit against brute force, and the cases that their docstrings define."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import filter_audit, license_scan, periodic_runs, queries
from quillon.llm.periodic_runs import lyndon_groups, word_runs
from quillon.sources.session import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "doc_id long, text string, lang string, n_words string, runs string, mask int, id string, score string"


def table(spark, rows):
    """(doc_id, text, lang), and columns that clash with what operators add."""
    return spark.createDataFrame([(i, t, g, "own", "own", 7, "own", "own") for i, t, g in rows], ROWS)


def brute_lyndon(s, descending):
    t = [-c for c in s] if descending else list(s)
    return [next((k for k in range(i + 1, len(t)) if t[k:] <= t[i:]), len(t)) - i for i in range(len(t))]


def brute_runs(s, least, times):
    out = []
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            part = s[i : j + p]
            if len(part) >= max(least, times * p) and not any(part[q:] == part[: len(part) - q] for q in range(1, p)):
                out.append((i, len(part), p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_and_runs():
    r = random.Random(11)
    for _ in range(1500):
        n, letters = r.randint(0, 40), r.choice([1, 2, 2, 3, 4])
        s = [r.randrange(letters) for _ in range(n)]
        if n > 4 and r.random() < 0.5:
            at, p = r.randrange(n), r.randint(1, 6)
            s = s[:at] + [s[at + (i - at) % p] for i in range(at, n)]
        for descending in (False, True):
            lengths, groups = lyndon_groups(s, descending)
            assert lengths == brute_lyndon(s, descending)
            words = {g: {tuple(s[i : i + lengths[i]]) for i in range(n) if groups[i] == g} for g in groups}
            assert all(len(w) == 1 for w in words.values())
        for least, times in ((6, 4), (1, 2), (5, 3), (12, 5)):
            assert word_runs([b"%d" % c for c in s], least, times) == brute_runs(s, least, times)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected_runs(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words, 6, 4)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    four = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_the_query(spark, sf_dir):
    got = queries.op11_periodic_runs(spark, sf_dir).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    docs = [(x["doc_id"], x["text"]) for x in read_table(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, got)) == sorted(expected_runs(*d) for d in docs)
    assert sum(x["n_runs"] > 0 for x in got) > 5


def odd(r):
    line = "a b c d "
    return [
        (None, None, None), (None, line * 5, "en"), (1, None, "en"), (2, "", ""), (3, " \n\t ", "de"), (4, line * 40, "de"), (4, line * 40, "de"), (5, "x " * 5, None),
        (6, "x " * 6, "en"), (7, " ".join(str(r.randrange(50)) for _ in range(30000)), "en"), (8, "            é é", "fr"),
        (9, line * 40 + "\x1f " * 9 + "Z", "fr"),
    ]


def test_runs_of_odd_rows(spark):
    rows = odd(random.Random(2))
    df = table(spark, rows)
    got = periodic_runs.periodic_runs(df).collect()
    assert periodic_runs.periodic_runs(df).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []
    want = []
    for i, t, _ in rows:
        words = WORD.findall(t or "")
        runs = brute_runs(words, 6, 4) if len(words) < 1000 else word_runs([w.encode() for w in words])
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted(((x["doc_id"], x["n_words"], [tuple(y) for y in x["runs"]], x["collapsed"]) for x in got), key=str) == sorted(want, key=str)
    assert {x["doc_id"]: x["collapsed"] for x in got}[4] == "a b c d" and {x["doc_id"]: len(x["runs"]) for x in got}[5] == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, min_exponent=1)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def standing(template, words):
    """Places of a template's start, by its definition."""
    at = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    starts = [[i - t for i in at([w.decode() for w in p])] for p, t in template.phrases]
    return [s for s in starts[0] if all(any(abs(o - s) <= template.drift for o in other) for other in starts[1:])]


BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def expected_license(doc_id, text):
    words = plain_words(text)
    base = [(i, label) for i in range(len(words)) for p, label in BASE.items() if tuple(words[i : i + len(p)]) == p]
    own = [(t.label, k, s) for k, t in enumerate(license_scan.TEMPLATES) for s in standing(t, words)]
    names = {b for _, b in base}
    places = [i for i, _ in base]
    return (doc_id, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(names | {x[0] for x in own})), len(own))


def test_licenses_of_the_query(spark, sf_dir):
    df = queries.op12_license_scan(spark, sf_dir)
    got = df.collect()
    docs = [(x["doc_id"], x["text"]) for x in read_table(spark, sf_dir, "documents").collect()]
    shown = [(x["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], x["n_hits"]) for x in got]
    assert sorted(shown) == sorted(expected_license(*d) for d in docs)
    assert all(0 <= x["score"] <= 1 and (x["score"] > 0) == (x["labels"] != "") for x in got)
    assert any(x["labels"] == "cc-by-nc" for x in got) or not any("CC BY-NC" in (t or "") for _, t in docs)


def test_license_templates_in_noise(spark):
    """Whole wordings with words left out, put in, and phrases broken: hits by definition, scores by hand."""
    r = random.Random(5)
    noise = [f"n{i}" for i in range(60)] + ["license", "public", "software", "permission", "the", "of", "by", "4", "0"]
    texts = []
    for k in range(300):
        words = [r.choice(noise) for _ in range(r.randint(0, 40))]
        for t in r.sample(license_scan.TEMPLATES, r.choice([0, 1, 1, 2])):
            body = [w.decode() for w in t.words]
            for _ in range(r.choice([0, 0, 2, 6, 30])):
                i = r.randrange(len(body) + 1)
                body = body[:i] + ([r.choice(noise)] if r.random() < 0.7 else []) + body[i + (r.random() < 0.5) :]
            words += body + [r.choice(noise) for _ in range(r.randint(0, 5))]
        texts.append((k, " ".join(w.upper() if r.random() < 0.3 else w for w in words), "en"))
    df = table(spark, texts)
    idf = license_scan.inverse_frequencies(df, frozenset(w for t in license_scan.TEMPLATES for w in t.words))
    hits = {x["doc_id"]: x["hits"] for x in license_scan.scan_licenses(df).collect()}
    n_found = 0
    for k, text, _ in texts:
        words = plain_words(text)
        want = []
        for n, t in enumerate(license_scan.TEMPLATES):
            for s in standing(t, words):
                held = sum(idf[w] for i, w in enumerate(t.words) if w.decode() in words[max(0, s + i - t.drift) : max(0, s + i + t.drift + 1)])
                want.append((t.label, n, round(held / sum(idf[w] for w in t.words), 9)))
        n_found += len(want)
        assert sorted((h["label"], h["template"], round(h["score"], 9)) for h in hits[k]) == sorted(want)
    assert n_found > 100


def test_licenses_of_odd_rows(spark):
    rows = [*odd(random.Random(2)), (10, "MIT License mit-license, MIT LICENSE", None), (10, "é" * 20000 + " mit license" * 3000, "en")]
    df = table(spark, rows)
    got = license_scan.scan_licenses(df).collect()
    assert license_scan.scan_licenses(df.limit(0)).collect() == []
    want = sorted((expected_license(i, t)[:3] for i, t, _ in rows), key=str)
    assert sorted(((x["doc_id"], x["n_words"], len(x["base"])) for x in got), key=str) == want
    assert all(x["score"] == 0 and not x["hits"] for x in got if x["doc_id"] != 10)
    assert {len(x["base"]) for x in got if x["doc_id"] == 10} == {2, 3000}


def brute_audit(rows, labels):
    """Plain filters, run in every order."""
    def fails(f, i, t):
        words = WORD.findall(t)
        return {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in clean),
        }[f]

    clean = [(i, t or "", g or "") for i, t, g in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = [(g, i, {f for f in "ABCDE" if fails(f, i, t)}) for i, t, g in clean]
    out, total = {}, Counter()
    for part in {g for g, _, _ in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [x for x in failed if x[0] == part]
            for k, f in enumerate(order):
                mine = [x for x in failed if x[0] == part and f in x[2]]
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                total[part, f] += len(gone)
                out[part, order, k + 1, f] = (len(left), len(gone), len(mine) - len(gone), sum(x[2] == {f} for x in mine), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone))
    return {k: (*v, total[k[0], k[3]]) for k, v in out.items()}


def audited(spark, rows, labels):
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(table(spark, rows), made).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(x["part"], x["filter_order"], x["step"], x["filter"]): tuple(x[n] for n in names) for x in got}


def test_audit_of_odd_rows(spark):
    r = random.Random(8)
    rows = odd(r)
    rows += [(20 + k % 30, r.choice(["A B C", "a b c", None, "", " ".join(f"w{i}" for i in range(150)), "x# " * 120, "AAAA bbb $"]), r.choice(["en", "de", None, ""])) for k in range(90)]
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)
    assert audited(spark, [], labels) == {}


def test_the_prepass_clears_only_what_is_unique(spark):
    texts = [(i, f"text {i if i % 10 else i % 70}", "en") for i in range(3000)]
    df = table(spark, texts).select("doc_id", "text", F.xxhash64("text").alias("key"))
    blocks = 2
    sketch = filter_audit.counting_bloom(df, blocks)
    maybe = {x["doc_id"] for x in filter_audit.repeats_maybe(df, sketch, blocks).filter("maybe").collect()}
    n = Counter(t for _, t, _ in texts)
    true = {i for i, t, _ in texts if n[t] > 1}
    assert true <= maybe and len(maybe - true) < 0.05 * len(texts)


def test_planting_on_odd_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:24]
    texts = [None, "", " \n ", "one", "two words", "a b c d e f g h i j"]
    rows = [(i, texts[k % len(texts)]) for k, i in enumerate(ids)] + [(None, "a b c"), (7, "a b c")]
    got = {x["doc_id"]: x["text"] for x in queries.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(WORD.findall(got[i] or "") == planted(i, t) for i, t in rows)
