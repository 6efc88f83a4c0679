"""Secrets below generated nestings of encodings, against a decoder that knows how each was made; chains in linear time."""

import base64
import gzip
import random
import time
import zlib

import pytest

from quillon.llm import secret_scan

SECRETS = ['password = "hunter22abc"', "AKIA" + "Q7" * 9, "api_key: s3cr3t/va+lue="]


def text_of(raw):
    """Bytes as a text that holds them, by an escape for every byte."""
    return {
        "percent": "".join(f"%{c:02X}" for c in raw), "hex": "".join(f"\\x{c:02x}" for c in raw), "unicode": "".join(f"\\u{c:04x}" for c in raw),
        "html": "".join(f"&#{c};" for c in raw), "base64": base64.b64encode(raw).decode(), "url": base64.urlsafe_b64encode(raw).decode().rstrip("="),
    }


PACKERS = {"gzip": lambda b: gzip.compress(b, mtime=0), "zlib": zlib.compress, "two": lambda b: gzip.compress(b[:5], mtime=0) + gzip.compress(b[5:], mtime=0), "wide": lambda b: b.decode("latin-1").encode("utf-16")}


def nested(r, secret):
    """A text that encodes the secret, and how."""
    inner, steps = secret, []
    for _ in range(r.randint(1, 3)):
        raw = inner.encode()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            name = r.choice([*PACKERS] if raw.isascii() and len(raw) < 400 else ["gzip", "zlib"])
            raw = PACKERS[name](raw)
            steps.append(name)
        name = r.choice([*text_of(b"")])
        inner = text_of(raw)[name]
        steps.append(name)
        if len(inner) > 4000:
            break
    return inner, steps


def test_generated_nestings_are_unwrapped():
    r = random.Random(12)
    for _ in range(250):
        secret = r.choice(SECRETS)
        coded, steps = nested(r, secret)
        kind = 1 if secret.startswith("AKIA") else 0
        found = [(s, e) for s, k, e in secret_scan.scan(f"see {coded} end")[1] if k == kind]
        assert any(4 <= s < e <= 4 + len(coded) + 1 for s, e in found), (steps, coded[:200])


@pytest.mark.parametrize("chain", [lambda n: "%" + "25" * n + "41", lambda n: "\\u005c" + "u005c" * n + "u0041", lambda n: "&#38;" + "#38;" * n + "#65;"])
def test_chains_take_linear_time(chain):
    assert secret_scan.scan("pass" + chain(300) + "B")[2] <= 4
    began = time.time()
    for n in (400, 800, 1600, 3200):
        secret_scan.scan(chain(n))
    assert time.time() - began < 2
    # what a chain leads to is read on
    assert [k for _, k, _ in secret_scan.scan("tok%" + "25" * 40 + "65n=abcdef1")[1] if k == 0] == [0]


def test_marks_of_compression_in_prose_cost_little():
    began = time.time()
    assert secret_scan.scan("f(x)=x^2 + 3x^3, " * 6000)[1] == []
    assert time.time() - began < 3
