"""The operators for large corpora: brute force, round trips, and the cases that their docstrings define."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, graph, line_dedup, lm_score, mixing, near_dup, pii, pivot_index, quality, queries, secret_scan, token_counts
from quillon.sources.session import read_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, h string"
WORDS = [f"w{i}" for i in range(400)]


def docs_df(spark, rows):
    """rows: (id, text, source); further columns clash with names that operators add."""
    return spark.createDataFrame([(i, t, "en", s, None, "own", "own", "own") for i, t, s in rows], DOCS)


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, empty texts, ties, repeated rows, one very long text."""
    r = random.Random(5)
    text = "\n".join(prose(r, 12) + "." for _ in range(8))
    return [
        (None, None, None), (None, text, None), (1, None, "a"), (2, "", "a"), (3, " \n\t\n ", "b"), (4, text, "b"), (4, text, "b"), (4, text + "\nmore", None),
        (5, "one line", "c"), (6, "x" * 3000, "c"), (7, "\n".join(prose(r, 30) for _ in range(3000)), "a"), (8, text.upper(), "é"),
    ]


OPERATORS = {
    "bpe": lambda d: bpe.round_trip(d, queries.byte_bpe()),
    "line_dedup": line_dedup.line_dedup,
    "lm": lm_score.lm_scores,
    "pii": lambda d: pii.replace_pii(d, b"k"),
    "near": near_dup.near_duplicates,
    "secrets": secret_scan.scan_secrets,
    "quality": quality.quality_rules,
    "mixing": mixing.mixture,
    "counts": lambda d: token_counts.inserted(token_counts.count_tokens(d, ("words-2",)), "words-2"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, odd_rows, name):
    df = docs_df(spark, odd_rows)
    rows = OPERATORS[name](df).collect()
    assert len(rows) == len(odd_rows)
    assert OPERATORS[name](df.limit(0)).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    keys = [b"", b"a", *(str(i).encode() for i in range(3000))]
    h = bpe.PerfectHash(keys, list(range(len(keys))))
    assert sorted(h.values) == list(range(len(keys))) and all(h.get(k) == i for i, k in enumerate(keys))
    assert h.get(b"absent") == -1 and bpe.PerfectHash([], []).get(b"a") == -1


def test_bpe_is_the_library(spark, sf_dir):
    import base64

    import public_tokenizers as P
    import tiktoken

    t = queries.byte_bpe()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    letters = "aàéßłЖ中あ한🙂'sSte 1٣½      \t\n\r\x0b\x1c\x85\xa0　​.,!#-_’"
    for _ in range(1500):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
        assert t.encode(x) == library.encode_ordinary(x)
        assert t.decode(t.encode(x)).decode() == x
    got = {x["doc_id"]: x for x in queries.op1_byte_bpe(spark, sf_dir).collect()}
    for d in read_table(spark, sf_dir, "documents").collect():
        ids = library.encode_ordinary(d["text"])
        assert got[d["doc_id"]]["n_tokens"] == len(ids)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def test_bpe_chunks_agree(monkeypatch):
    t = queries.byte_bpe()
    x = "some words, and  double spaces\n\nhere 123 " * 20
    whole = t.encode(x), t.encode(x.replace("  ", " ").replace("\n\n", "\n").strip())
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 10)
    monkeypatch.setattr(bpe, "CHUNK_TOKENS", 3)
    assert (t.encode(x), t.encode(x.replace("  ", " ").replace("\n\n", "\n").strip())) == whole


def test_line_dedup_keeps_the_first(spark):
    rows = [(2, "p\na\nb\nc\nd\nq", "s"), (1, "a\nb\n\nc\nd", "s"), (3, "a\nb", "s"), (4, "x\nx\nx\nx", "s")]
    got = {r["doc_id"]: (r["clean_text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(docs_df(spark, rows)).collect()}
    assert got == {1: ("a\nb\n\nc\nd", 4, 0), 2: ("p\nq", 6, 4), 3: ("a\nb", 2, 0), 4: ("x", 4, 3)}


def test_quality_rules(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [
        (1, good, "s"), (2, good + "\nAll rights reserved by us.", "s"), (3, "\n".join(["home | about | news | help"] * 3 + [" ".join(f"v{i}" for i in range(55))]), "s"),
        (4, " ".join(f"w{i}%%%" for i in range(60)), "s"), (5, "a b c " * 40, "s"), (6, "short", "s"),
    ]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_df(spark, rows)).collect()}
    assert {i for i, r in got.items() if r["kept"]} == {1, 2, 3}
    assert {i for i, r in got.items() if r["base_failed"]} == {5, 6}
    assert got[2]["clean_text"] == good and got[2]["n_failed_lines"] == 1
    assert got[3]["n_dup_lines"] == 2 and got[5]["n_repeat_words"] == 120


def brute_components(rows, links):
    up = {i: i for i in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in rows}


def word_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(9)
    rows, n = [], 0
    for size in (4, 7, 12, 40, 150):
        for _ in range(4):
            base = prose(r, size).split()
            for share in (0, 0, 0.01, 0.03, 0.04, 0.05, 0.08, 0.2):
                rows.append((n, " ".join(r.choice(WORDS) if r.random() < share else w for w in base), "s"))
                n += 1
    template = prose(r, 120).split()
    for _ in range(80):
        share = r.choice((0.01, 0.02, 0.04, 0.06))
        rows.append((n, " ".join(r.choice(WORDS) if r.random() < share else w for w in template), "s"))
        n += 1
    passage = prose(r, 40)
    rows += [(n + i, f"{passage} {prose(r, 20)}", "s") for i in range(60)] + [(n + 99, None, "s"), (n + 98, "", "s")]
    sets = {i: word_set(t) for i, t, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    got = near_dup.near_duplicates(docs_df(spark, rows)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want
    assert all(x["n_shingles"] == len(sets[x["doc_id"]]) and x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_families_below_the_threshold_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LISTED", 8)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 9_000)
    monkeypatch.setattr(near_dup, "TILE", 16)
    monkeypatch.setattr(near_dup, "COLUMNS", 64)
    seen = []
    plain = near_dup._across

    def across(*a):
        few, many = plain(*a)
        seen.append((few.count(), many.count()))
        return few, many

    monkeypatch.setattr(near_dup, "_across", across)
    r = random.Random(21)
    template, rows = [f"t{i}" for i in range(200)], []
    for i in range(120):
        words = list(template)
        for k in r.sample(range(200), r.choice((3, 4, 5, 5, 5, 5))):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words), "s"))
    sets = {i: word_set(t) for i, t, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(docs_df(spark, rows)).collect()}
    want = brute_components(sets, links)
    assert got == want and 1 < len(set(want.values())) < 120
    [(few, many)] = seen
    assert many > 0 and few < 8 * 120


def test_intersections_by_products():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, n)) for n in (0, 5, 80, 200, 300)]
    got = near_dup._intersections(sets, sets[1:])
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets[1:]))


def test_registers_estimate_similarity():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 2**64, 3000, np.uint64))
    b = np.unique(np.concatenate([a[:2400], r.integers(0, 2**64, 600, np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    j, least = near_dup.estimate(near_dup.registers(a)[None], near_dup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
    assert abs(j[0] - true) < 0.13 and least[0] < 0.75


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140))


def test_pivot_index(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    vectors = [(i, (centres[i % 12] + r.normal(size=16) * (0.02 + 0.02 * (i % 9))).tolist()) for i in range(400)]
    vectors += [(900, vectors[0][1]), (901, vectors[0][1]), (902, [0.0] * 16), (903, None), (904, [float("nan")] * 16), (905, [1.0, None]), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x for x in pivot_index.near_duplicates(df).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if i < 902}
    found = true = 0
    for i, v in ok.items():
        n = sum(float(v @ w) >= 0.9 for j, w in ok.items() if j != i)
        assert got[i]["n_links"] <= n
        found, true = found + got[i]["n_links"], true + n
    assert found >= 0.9 * true
    assert [got[i]["n_links"] for i in (902, 903, 904, 905)] == [0] * 4 and got[901]["component_id"] == 0
    assert got[907]["component_id"] == 906 and got[906]["n_links"] == 1
    assert pivot_index.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("cosine", [0.86, 0.97])
def test_pivot_index_of_a_hot_group(spark, cosine):
    # a third of the rows are noisy copies of one vector; at 0.86 only the closer of their pairs are links
    r = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(r.normal(size=(4_500, 64)))
    x[:1_500] = unit(x[0] + (1 / cosine - 1) ** 0.5 * unit(r.normal(size=(1_500, 64))))
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {y["vec_id"]: y["n_links"] for y in pivot_index.near_duplicates(df).collect()}
    true = close.sum(axis=1)
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.98 * true.sum()


def test_pivot_pairs_are_found_alike(monkeypatch):
    import pandas as pd

    r = np.random.default_rng(3)
    v = r.normal(size=8) + 0.1 * r.normal(size=(60, 8))
    # a list of pivot 3: all stand in it
    near = [r.permutation(np.r_[3, r.permutation([0, 1, 2, *range(4, 30)])[:7]]).astype(np.int32) for _ in v]
    t = pd.DataFrame({"node": range(60), "size": r.integers(1, 4, 60), "v": list(v), "near": near})
    a, b = t[:30], t[30:]
    for x, y, same in ((a, b, False), (a, a, True)):
        few = pivot_index._compare(x, y, 3, same)
        with monkeypatch.context() as m:
            m.setattr(pivot_index, "MANY", -1)
            assert few[0] and pivot_index._compare(x, y, 3, same) == few


def test_secrets_in_layers():
    import base64
    import gzip
    import urllib.parse

    plain = 'say password = "hunter22" twice'
    assert secret_scan.joined(secret_scan.scan(plain)[1]) == "assign:4:24"
    coded = base64.b64encode(gzip.compress(urllib.parse.quote(plain).encode())).decode()
    base, spans, layers = secret_scan.scan(f"é {coded}.")
    assert not base and layers == 2 and secret_scan.joined(spans) == f"assign:2:{2 + len(coded)}"
    _, spans, _ = secret_scan.scan("a %74oken=abcdef b")
    assert secret_scan.joined(spans) == "assign:2:16"
    assert secret_scan.joined(secret_scan.scan("\\u0041KIA" + "Z" * 16)[1]) == "access:0:25"
    assert secret_scan.scan("%25%32%35 " * 3)[2] <= 4


def test_secrets_at_every_place():
    import base64
    import gzip

    plain = b"say password=hunter22 twice"
    coded, packed = base64.b64encode(plain).decode(), base64.b64encode(gzip.compress(plain, mtime=0)).decode()
    text = f"{coded} and {coded} and {packed} or {packed}"
    places, at = [], 0
    for x in (coded, coded, packed, packed):
        at = text.index(x, at)
        # in base64: bytes 4 to 21, which are the digits 5 to 28
        places.append(f"assign:{at}:{at + len(x)}" if x == packed else f"assign:{at + 5}:{at + 28}")
        at += 1
    assert secret_scan.joined(secret_scan.scan(text)[1]) == ",".join(places)
    # nested: the inner layer is met twice, by its own run and inside another
    nested = base64.b64encode(f"see {coded} here".encode()).decode()
    assert [k for _, k, _ in secret_scan.scan(f"{nested} {coded} {nested}")[1]] == [0, 0, 0]


def test_secrets_in_base64_beside_other_things():
    import base64
    import gzip
    import textwrap

    code = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    for odd in ("\u00a0", "\u200d", "\u3000", "\x07"):
        x = code(f"caf\u00e9{odd} password=hunter22 ok")
        assert len(secret_scan.scan(f"a {x} b")[1]) == 1, odd
    # at any alignment, and in the path of a URL
    for before in ("https://example.com/p/", "https://example.com/pq/", "Q", "QQ", "QQQ", "x-y_"):
        for x in (code("the password=hunter22 is"), code(gzip.compress(b"the password=hunter22 is"))):
            text = f"{before}{x} end"
            spans = secret_scan.scan(text)[1]
            assert len(spans) == 1, text
            s, _, e = spans[0]
            assert len(before) <= s + 1 and e <= len(before) + len(x)
    # wrapped over lines
    for width in (20, 64, 76):
        for x in (b"one two three four five password=" + b"hunter22" * 6 + b" end", gzip.compress(bytes(range(256)) + b" password=hunter22 end")):
            lines = textwrap.wrap(code(x), width)
            for br in ("\n", "\r\n", "\n  "):
                text = f"begin:\n{br.join(lines)}\nend"
                widest = max(e - s for s, _, e in secret_scan.scan(text)[1])
                assert widest >= 57 * 4 // 3, (width, br)


def test_secrets_past_the_inflated_window(monkeypatch):
    import base64
    import gzip
    import zlib

    monkeypatch.setattr(secret_scan, "INFLATE_LIMIT", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP", 64)
    secret = b" password=hunter22 "
    for packed in (gzip.compress(b"word " * 10) + gzip.compress(secret), zlib.compress(b"word " * 5_000 + secret), *(gzip.compress(b"." * (4096 - k) + secret + b"." * 9_000) for k in range(20))):
        coded = base64.b64encode(packed).decode()
        assert secret_scan.joined(secret_scan.scan(f"a {coded} b")[1]) == f"assign:2:{2 + len(coded)}"


def test_base_findings_follow_the_patterns(spark, sf_dir):
    import re

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {x["doc_id"]: x for x in queries.op7_secret_scan(spark, sf_dir).collect()}
    for d in read_table(spark, sf_dir, "documents").collect():
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(d["text"]) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", d["text"]) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", d["text"]) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        assert got[d["doc_id"]]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_surrogates(spark):
    key = b"k"
    assert len({pii.permute(key, "t", i, 777) for i in range(777)}) == 777
    text = "Mr. John Smith, +1 (521) 555-2373, 4111111111111111, a.b@mail8.example.com, 10.1.2.3. Smith paid. Mrs Anna Jones and Госпожа Иванова."
    out = {r["doc_id"]: r for r in pii.replace_pii(docs_df(spark, [(1, text, "s"), (2, "Mr Smith of a.b@mail8.example.com", "s"), (3, None, "s")]), key).collect()}
    new = out[1]["text"]
    assert not any(x in new for x in ("John", "Smith", "2373", "4111", "a.b@", "10.1.2.3", "Anna", "Иванова"))
    assert out[1]["n_entities"] == 10 and out[3]["text"] == ""
    names = new.split(",")[0].split()
    assert new.split(". ")[2].startswith(names[2]) and out[2]["text"].split()[1] == names[2]
    assert new.split(", ")[3] == out[2]["text"].split()[3]
    digits = new.split(", ")[2]
    assert len(digits) == 16 and pii.luhn(digits[:-1]) == int(digits[-1])


def test_surrogates_do_not_depend_on_the_format(spark):
    same = [
        ("+1 521 555 2373", "+1-521-555-2373", "(521) 555-2373", "521.555.2373"), ("John.Doe@Mail.example.com", "john.doe@mail.example.com", "JOHN.DOE@MAIL.EXAMPLE.COM"),
        ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"),
    ]
    for forms in same:
        found = [pii.detect(f"x {f} y") for f in forms]
        assert len({(k, v) for [(_, _, k, v)] in found}) == 1, forms
        new = {pii.normal(k, pii.pour(k, f, pii.surrogate(b"k", k, v))) for f, [(_, _, k, v)] in zip(forms, found, strict=True)}
        assert len(new) == 1 and new != {found[0][0][3]}
    valid = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    for x in ("DE89370400440532013000", "GB82WEST12345698765432", "DE88370400440532013000", "GB00WEST12345698765432"):
        made = pii.surrogate(b"k", "iban", x)
        assert valid(made) == valid(x) and made[:2] == x[:2] and made != x
    out = pii.replace_pii(docs_df(spark, [(1, "She was born on 03.07.1984, DOB: 1984-07-03.", "s")]), b"k").first()
    first, second = out["text"].split("born on ")[1].split(", DOB: ")
    assert first.split(".")[2] == second[:4] and first.split(".")[1] == second[5:7] and first != "03.07.1984" and second[:2] == "19"
    with pytest.raises(ValueError):
        pii.replace_pii(docs_df(spark, []), b"")


def test_surrogates_of_formats_with_too_few_values(spark):
    # every address of this format stands in the corpus
    letters = [chr(97 + i) for i in range(26)]
    old = [f"{x}@{y}.io" for x in letters for y in letters]
    new = [r["text"] for r in pii.replace_pii(docs_df(spark, [(i, t, "s") for i, t in enumerate(old)]), b"k").collect()]
    assert len(set(new)) == len(old) and not set(new) & set(old) and all(t.endswith(".io") for t in new)


def test_many_entities_take_linear_time():
    import time

    def seconds(n):
        text = " ".join(f"user{i}@mail{i}.example.com" for i in range(n))
        began = time.perf_counter()
        assert len(pii.detect(text)) == n
        return time.perf_counter() - began

    seconds(2_000)
    assert min(seconds(16_000) for _ in range(3)) < 16 * min(seconds(2_000) for _ in range(3))


def test_surrogate_collisions_are_resolved(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, value, attempt=0: "same" if attempt == 0 else f"{value}-{attempt}")
    entities = spark.createDataFrame([("card", v, "same") for v in "abc"], "kind string, value string, surrogate string")
    got = {r["value"]: r["surrogate"] for r in pii.resolve(entities, b"k").collect()}
    assert got == {"b": "b-1", "c": "c-1"}


def test_ledger_is_idempotent(spark):
    counted = token_counts.count_tokens(docs_df(spark, [(1, "a b", "s"), (2, None, None)]), ("words-1", "words-2"))
    ledger = token_counts.new_ledger(spark, "test-ledger")
    assert ledger.totals().collect() == []
    assert ledger.commit("1", token_counts.inserted(counted, "words-1"))
    assert not ledger.commit("1", token_counts.inserted(counted, "words-1"))
    assert ledger.commit("2", token_counts.revised(counted, "words-1", counted, "words-2"))
    assert ledger.commit("3", token_counts.deleted(counted.filter("doc_id = 2"), "words-2"))
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "words-2", 1, 2)]


def test_one_of_two_committers_wins(spark):
    counted = token_counts.count_tokens(docs_df(spark, [(1, "a b", "s")]), ("words-2",))
    ledger = token_counts.ledger_of(counted, "met-ledger")
    again = token_counts.ledger_of(counted, "met-ledger")
    other = token_counts.ledger_of(counted.withColumn("source", F.lit("t")), "met-ledger")
    assert ledger.path == again.path != other.path
    # both have looked, neither has committed: the second one to take the name loses
    rows = token_counts.inserted(counted, "words-2").groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    for k in range(2):
        rows.write.parquet(f"{ledger.path}/_aside/x{k}")
    assert [ledger._take_name(f"{ledger.path}/_aside/x{k}", "x") for k in range(2)] == [True, False]
    assert not again.commit("x", token_counts.inserted(counted, "words-2"))
    assert [tuple(r) for r in again.totals().collect()] == [("s", "en", "words-2", 1, 2)]


def test_bpe_counts_are_a_version(spark, odd_rows):
    t = queries.byte_bpe()
    got = sorted(x["n_bpe"] for x in token_counts.count_bpe(docs_df(spark, odd_rows), t, "bpe").collect())
    assert got == sorted(len(t.encode(x or "")) for _, x, _ in odd_rows)


def test_language_model_prefers_order(spark):
    r = random.Random(2)
    cycle = [f"c{i}" for i in range(20)]
    lines = []
    for i in range(300):
        at = r.randrange(20)
        lines.append((i, " ".join(cycle[(at + k) % 20] for k in range(60)), "s"))
    shuffled = [(1000 + i, " ".join(r.sample(t.split(), 60)), "s") for i, t, _ in lines[:60]]
    lex, weights, _ = lm_score.train(docs_df(spark, lines))
    mean = lambda rows: np.mean([x["mean_log_prob"] for x in lm_score.score(lm_score.read_words(docs_df(spark, rows), lex), lex, weights).collect()])
    assert mean(lines[:60]) > mean(shuffled) + 1


def plain_log_prob(tokens, lex, counts, weights):
    """log P of a text, word by word, in double precision."""
    m = lm_score
    number = lambda w: lex.index[w] if lex.index.get(w, m.VOCABULARY) < m.VOCABULARY else m.VOCABULARY + m.bucket(w)
    at = [m.OUTSIDE] * 2 + [number(w) for w in tokens] + [m.OUTSIDE] * 2
    e, sides, b, a, ab, t, tb = [w.astype(np.float64) for w in weights]
    total = 0.0
    log_share = lambda x, i: x[i] - np.log(np.exp(x).sum())
    for i, w in enumerate(tokens):
        h = np.tanh(sum(e[at[i + 2 + s]] @ sides[j] for j, s in enumerate(m.SIDES)) + b)
        n = at[i + 2]
        total += log_share(h @ a + ab, m.CLASS_OF[n])
        if m.HEAD <= n < m.VOCABULARY:
            c, slot = divmod(n - m.HEAD, m.SLOTS)
            total += log_share(h @ t[c] + tb[c], slot)
        elif n >= m.VOCABULARY:
            others = [x for x in counts if lex.index.get(x, m.VOCABULARY) >= m.VOCABULARY and m.bucket(x) == m.bucket(w)]
            total += np.log((counts.get(w, 0) + 1) / (sum(counts[x] for x in others) + len(others) + 1))
    return total


def test_scores_are_those_of_the_formula(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", lm_score.VOCABULARY + 40)
    r = random.Random(11)
    rows = [(i, " ".join(f"v{r.randrange(r.choice((50, 40_000)))}" for _ in range(r.randint(1, 900))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, rows[0][1], "s")]
    lex, weights, _ = lm_score.train(docs_df(spark, rows))
    counts = Counter(w for _, t, _ in rows for w in lm_score.words(t))
    assert len(counts) > lm_score.KNOWN
    tried = [*rows, (200, "never-seen v1 v2 also-never", "s")]
    got = {x["doc_id"]: x for x in lm_score.score(lm_score.read_words(docs_df(spark, tried), lex), lex, weights).collect()}
    for i, t, _ in tried:
        tokens = lm_score.words(t)
        assert got[i]["n_tokens"] == len(tokens)
        assert abs(got[i]["log_prob"] - plain_log_prob(tokens, lex, counts, weights)) <= 1e-4 * max(1, len(tokens))
        assert (got[i]["mean_log_prob"] is None) == (not tokens)
    # the words of a cluster and of a bucket have probabilities that sum to 1 at most
    for k in range(lm_score.BUCKETS):
        others = [x for x in counts if lex.index.get(x, lm_score.VOCABULARY) >= lm_score.VOCABULARY and lm_score.bucket(x) == k]
        assert sum((counts[x] + 1) * np.exp(lex.base[k]) for x in others) <= 1 + 1e-9


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP_WORDS", 3_000)
    r = random.Random(12)
    rows = [(i, prose(r, r.randint(0, 300)), "s") for i in range(150)]
    score = lambda df: {x["doc_id"]: x["log_prob"] for x in lm_score.lm_scores(df).collect()}
    one, other = score(docs_df(spark, rows).coalesce(1)), score(docs_df(spark, rows[::-1]).repartition(7))
    assert all(abs(one[i] - other[i]) <= 1e-6 * max(1, abs(one[i])) for i, _, _ in rows)


def test_training_takes_every_word_once(spark, monkeypatch):
    seen = Counter()
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(n)), "s") for i, n in enumerate((1, 2, 3, 15, 16, 33, 900))]
    docs = docs_df(spark, rows)
    lex = lm_score.lexicon(lm_score.count_words(docs))
    read = lm_score.read_words(docs, lex)
    for turn in range(lm_score.ROUNDS):
        mine = read.filter(F.pmod(F.shiftright("deal", 32), F.lit(lm_score.ROUNDS)) == turn).collect()
        seen.update(x["id"] for x in mine)
    assert seen == Counter(i for i, _, _ in rows)
    # the steps over a line meet each of its places once
    numbers = [np.frombuffer(x["numbers"], np.int16) for x in read.collect()]
    line = lm_score.in_line(numbers)
    met = np.concatenate([line[i - 2 : min(i + 50, len(line) - 2) + 2][2:-2] for i in range(2, len(line) - 2, 50)])
    assert (met[met != lm_score.OUTSIDE] == np.concatenate(numbers)).all()
    # a document of one word moves the weights
    start = lm_score.start_weights(lex.frequency)
    ends = [lm_score.train_round(read.filter("id = 0"), start, turn, 1) for turn in range(lm_score.ROUNDS)]
    assert any(not np.array_equal(a, b) for e in ends for a, b in zip(start, e, strict=True))


def test_hypergeometric_draws(spark):
    rows = [(40, 17, 20), (40, 0, 20), (40, 40, 20), (3, 1, 1), (1000, 300, 500), (5, 2, 5)]
    n = 3000
    df = spark.createDataFrame(rows, "t long, g long, d long").crossJoin(spark.range(n))
    drawn = df.select("t", "g", "d", mixing._hypergeometric(F.col("t"), F.col("g"), F.col("d"), mixing._uniform(F.col("id"), F.col("t"))).alias("x")).collect()
    by = defaultdict(list)
    for x in drawn:
        by[x["t"], x["g"], x["d"]].append(x["x"])
    for (t, g, d), xs in by.items():
        assert max(0, d + g - t) <= min(xs) and max(xs) <= min(g, d)
        sd = (d * g / t * (1 - g / t) * (t - d) / max(1, t - 1)) ** 0.5
        assert abs(np.mean(xs) - d * g / t) <= 5 * sd / n**0.5 + 1e-9


def brute_targets(sizes):
    """Shares by weight, cut at three times the size, the excess shared again until nothing is above."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    r = random.Random(8)
    sources = ["a"] * 150 + ["b"] * 10 + ["c"] * 40 + ["é"] * 3 + [None] * 20 + ["z"]
    rows = [(i, prose(r, r.randint(0, 60)), s) for i, s in enumerate(sources)]
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    got = mixing.mixture(docs_df(spark, rows)).collect()
    again = mixing.mixture(docs_df(spark, rows).repartition(5)).collect()
    view = lambda xs: sorted((x["doc_id"], x["taken"], x["shards"]) for x in xs)
    assert view(got) == view(again)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = brute_targets(sizes), Counter()
    for x in got:
        assert abs(x["target"] - want[x["source"]]) < 1e-6 * (1 + want[x["source"]])
        assert x["taken"] == x["times"] * x["size"] <= 3 * x["size"] and len(x["shards"]) == x["times"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)


def test_shards_have_exact_quotas_and_a_partition_each(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 3)
    quotas = [(f"s{i}", 1 + i * i % 37) for i in range(25)] + [(None, 11), ("big", 400), ("none", 0)]
    runs = mixing.splitting_tree(spark.createDataFrame(quotas, "source string, quota long"), 3).collect()
    by_source, by_shard = defaultdict(list), Counter()
    for x in runs:
        by_source[x["source"]].append((x["begin"], x["end"]))
        by_shard[x["shard"]] += x["end"] - x["begin"]
    for s, q in quotas:
        at = 0
        for begin, end in sorted(by_source[s]):
            assert begin == at < end
            at = end
        assert at == q
    assert sum(by_shard.values()) == sum(q for _, q in quotas) and max(by_shard.values()) - min(by_shard.values()) <= 1
    # a large source is spread as a draw would be
    big = [x["end"] - x["begin"] for x in runs if x["source"] == "big"]
    assert len(big) == 8 and max(big) - min(big) < 40
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    r = random.Random(3)
    rows = [(i, prose(r, r.randint(1, 60)), f"s{i % 3}") for i in range(200)]
    mixed = mixing.mix(docs_df(spark, rows), levels=3).withColumn("part", F.spark_partition_id()).collect()
    where = defaultdict(set)
    for x in mixed:
        where[x["shard"]].add(x["part"])
    assert len(where) == 8 and all(len(p) == 1 for p in where.values())
    times = {x["doc_id"]: x["times"] for x in mixing.mixture(docs_df(spark, rows), levels=3).collect() if x["times"]}
    assert Counter(x["doc_id"] for x in mixed) == times


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = read_table(spark, sf_dir, "documents")
    one = cp.clean(spark, docs, sf_dir).cache()
    verdicts = {x["doc_id"] for x in quality.quality_rules(docs).filter("kept").collect()}
    assert {x["doc_id"] for x in one.collect()} == verdicts and one.columns == list(cp.COLUMNS)
    two = cp.drop_repeated_lines(spark, one, sf_dir).cache()
    three = cp.drop_near_duplicates(spark, two, sf_dir).cache()
    sets = {x["doc_id"]: word_set(x["text"]) for x in two.collect()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {x["doc_id"] for x in three.collect()} == {i for i, c in brute_components(sets, links).items() if i == c}
    four = cp.mix_sources(spark, three, sf_dir).cache()
    times = {x["doc_id"]: x["times"] for x in mixing.mixture(three).collect() if x["times"]}
    assert Counter(x["doc_id"] for x in four.collect()) == times
    five = cp.encode(spark, four, sf_dir).collect()
    texts = {x["doc_id"]: x["text"] for x in three.collect()}
    assert all(queries.byte_bpe is not None and x["decoded_sha256"] == hashlib.sha256(texts[x["doc_id"]].encode()).hexdigest() and len(x["ids"]) == x["n_tokens"] for x in five)
    assert sum(times.values()) == len(five)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    normal = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert normal(df.select(*columns).collect()) == normal(want.select(*[f'"{x}"' for x in columns]).fetchall())


def test_values_of_odd_rows(spark, odd_rows):
    df = docs_df(spark, odd_rows)
    texts = [(i, t) for i, t, _ in odd_rows]
    some = lambda xs: sorted(xs, key=str)
    # near duplicates: no words, no links; equal texts are one class, a null id takes part
    near = near_dup.near_duplicates(df).collect()
    assert some((x["doc_id"], x["n_shingles"]) for x in near) == some((i, len(word_set(t))) for i, t in texts)
    groups = {x["component_id"] for x in near if x["doc_id"] == 4} | {x["component_id"] for x in near if x["doc_id"] in (8,)}
    assert groups == {4} and [x["component_id"] for x in near if x["n_shingles"] == 0] == [x["doc_id"] for x in near if x["n_shingles"] == 0]
    # quality: empty texts are rejected, equal rows have equal verdicts, other columns stay but for names of the output
    quality_rows = quality.quality_rules(df).collect()
    assert all(x["base_failed"] and not x["kept"] for x in quality_rows if x["n_words"] < 50)
    assert len({(x["kept"], x["clean_text"]) for x in quality_rows if x["doc_id"] == 4 and x["source"] == "b"}) == 1
    assert all(x["size"] == x["h"] == "own" for x in quality_rows) and all(isinstance(x["kept"], bool) for x in quality_rows)
    # lines: of equal texts the first keeps them
    kept = line_dedup.line_dedup(df).collect()
    assert some((x["doc_id"], x["n_lines"]) for x in kept) == some((i, sum(bool(line.strip(" \t\r\x0b\x0c")) for line in (t or "").split("\n"))) for i, t in texts)
    assert [x["clean_text"] for x in kept if x["n_lines"] == 0] == [t or "" for _, t in texts if not (t or "").split()]
    # mixing: a null source is a source, empty texts take nothing
    mixed = mixing.mixture(df).collect()
    assert some((x["doc_id"], x["size"]) for x in mixed) == some((i, len((t or "").encode().split())) for i, t in texts)
    assert all(x["taken"] == x["times"] * x["size"] <= 3 * x["size"] for x in mixed)
    # secrets, surrogates and tokens: null texts count as empty
    assert all(x["n_layers"] == 0 and not x["base"] for x in secret_scan.scan_secrets(df).collect() if x["doc_id"] in (2, 3))
    assert some((x["doc_id"], x["text"]) for x in pii.replace_pii(df, b"k").collect() if x["n_entities"] == 0) == some((i, t or "") for i, t in texts if not pii.detect(t or ""))
    assert all(x["n_tokens"] == 0 for x in bpe.round_trip(df, queries.byte_bpe()).collect() if x["doc_id"] == 2)


def test_pivot_index_of_odd_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(None, v, "a"), (1, v, "a"), (1, v, "b"), (2, [2.0, 0.0, 4.0], "c"), (3, None, None), (3, [], "x"), (4, [0.0, -0.0, 0.0], "x"), (5, [1.0, float("inf"), 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links string")
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in pivot_index.near_duplicates(df).collect()), key=str)
    want = [(None, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    assert got == sorted(want, key=str)


def test_pipeline_stages_on_odd_rows(spark, odd_rows):
    import corpus_pipeline as cp

    df = docs_df(spark, odd_rows)
    for name, stage in cp.STAGES:
        out = stage(spark, df, "")
        if name != cp.STAGES[-1][0]:
            assert out.columns == list(cp.COLUMNS)
        assert stage(spark, df.limit(0), "").collect() == []
        out.collect()
    kept = cp.drop_near_duplicates(spark, df, "").collect()
    assert sum(x["doc_id"] == 4 for x in kept) == 3 and not any(x["doc_id"] == 8 for x in kept)
