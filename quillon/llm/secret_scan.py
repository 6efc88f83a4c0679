"""Secret scans that look through encodings.

Every text is scanned for three kinds of secrets (assignments, access keys, runs of hex digits). Then a worklist
unwraps what the text encodes: percent escapes, Unicode and HTML escapes, base64 (standard and URL-safe), ASCII as
UTF-16, and zlib or gzip data in what any of these decode to, or in what such data inflates to: a layer keeps its bytes,
those that are no UTF-8 as surrogates. Each decoded layer is scanned like the text and may hold further layers; it goes on
until no layer yields a new one. A layer that occurs again in the same document (by hash) is not decoded again, but
its findings are reported at every place that encodes it; encodings that decode to themselves or to each other end,
as the spans of a text are finite.

A run of base64 digits is read from its start and after each / - and _ as far as the bytes are UTF-8, and in all
four alignments, where other bytes may stand around what is found; runs that go on over line breaks are also read
as one. A layer counts if it is UTF-8 as a whole, inflated to an end, or holds a finding.

A finding in a layer is reported at the code points of the original text that encode it: escapes are mapped
character by character, base64 by groups of four digits, and compressed data as the whole run of digits. The spans
of the text itself always stay; a finding in a layer that maps to a span already there adds nothing.

Each row depends on its own text only: there is no shuffle. Compressed data is inflated in windows of INFLATE_LIMIT
bytes, which bounds a task's memory against archives made to explode, through all members to the end; a window
begins with the last OVERLAP bytes of the one before.

Defined results: a null or empty text has no findings; repeated rows get equal results; other columns are not
looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
INFLATE_LIMIT, OVERLAP = 64 << 20, 1 << 20
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Chains of escapes of an escape's own first character: a sign that there is one, that character, the chain.
CHAINS = {
    "%25252525": ("%", re.compile(r"%25(?:25){7,}(?=[0-9A-Fa-f]{2})")),
    "u005cu005c": ("\\", re.compile(r"\\u005c(?:u005c){7,}(?=u[0-9A-Fa-f]{4})")),
    "u005Cu005C": ("\\", re.compile(r"\\u005C(?:u005C){7,}(?=u[0-9A-Fa-f]{4})")),
    "#38;#38;": ("&", re.compile(r"&#38;(?:#38;){7,}(?=#)")),
    "#x26;#x26;": ("&", re.compile(r"&#x26;(?:#x26;){7,}(?=#)")),
}
#: Sixteen digits and more. Escapes and other text may stand right before and after.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The next line of a wrapped run: nothing else stands in it, but for what closes a run.
WRAPPED = re.compile(r"""\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})(?=[\x20\t]*(?:[\r\n"'`<>()\[\]{},;]|$))""")
SHORTEST = 16
#: Bytes that may be, or lead to, a finding.
TELLING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}|(?:[\x20-\x7e]\x00){8}|(?:\x00[\x20-\x7e]){8}")
#: ASCII as UTF-16, of either order.
WIDE = re.compile("(?:[\x20-\x7e]\x00){8,}|(?:\x00[\x20-\x7e]){8,}")
#: The beginnings of gzip and zlib data in a text: bytes that are no UTF-8 stand as surrogates, or each byte as the character of
#: its number.
PACKED_TEXT = re.compile("\x1f[\x8b\udc8b]\x08|x[\x01\x5e\x9c\xda\udc9c\udcda]")
LATIN = re.compile("[\x00-\xff]+")
BYTES = re.compile("[^\ud800-\udc7f\udd00-\udfff]+")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")

Span = tuple[int, int]


class Layer:
    """A decoded text. edge(i, 0) and edge(i, 1) are where, in the text that it was decoded from, the code of its i-th
    character begins and ends; so a layer costs no table of its length. whole: all of it is text."""

    __slots__ = ("edge", "text", "whole")

    def __init__(self, text: str, edge: Callable[[int, int], int], whole: bool = True):
        self.text, self.edge, self.whole = text, edge, whole


class Found:
    """What is known of a distinct text: the spans found in it, and the texts that encode it with their edges."""

    __slots__ = ("spans", "ups", "whole")

    def __init__(self, text: str):
        self.spans, self.ups, self.whole = set(findings(text)), [], False


def findings(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the secrets in a text as it stands."""
    if KEYWORD.search(text):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield m.start(), m.end(), 0
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield m.start(), m.end(), 1
    for m in HEX.finditer(text):
        yield m.start(), m.end(), 2


def _replaced(old: str, pieces: list[tuple[int, int, str, list[Span]]]) -> Layer:
    """The text with some of its spans replaced; each new character has the span, within the text, that encodes it.

    The new text is runs that were copied, which lie in the old one from a number on, and runs with spans."""
    out, begins, runs, at, length = [], [], [], 0, 0
    for begin, end, new, spans in [*pieces, (len(old), len(old), "", [])]:
        for text, run in ((old[at:begin], at), (new, spans)):
            if text:
                out.append(text)
                begins.append(length)
                runs.append(run)
                length += len(text)
        at = end

    def edge(i: int, side: int) -> int:
        k = bisect_right(begins, i) - 1
        run, far = runs[k], i - begins[k]
        return run + far + side if isinstance(run, int) else run[far][side]

    return Layer("".join(out), edge)


def _utf8(raw: bytes, begin: int, width: int) -> tuple[str, list[Span]]:
    """raw read as UTF-8, bad bytes as surrogates, and the span of each character; a byte is width characters wide."""
    text = raw.decode("utf-8", "surrogateescape")
    if text.isascii():
        return text, [(begin + i * width, begin + (i + 1) * width) for i in range(len(text))]
    spans, at = [], 0
    for c in text:
        size = len(c.encode("utf-8", "surrogateescape"))
        spans.append((begin + at * width, begin + (at + size) * width))
        at += size
    return text, spans


def unescape_chain(old: str) -> Layer | None:
    """The text with long chains of escapes of an escape's own first character, such as %252525...41, replaced by that character:
    as many layers as the chain has links would lead to the same."""
    if not any(x in old for x in CHAINS):
        return None
    pieces = sorted((m.start(), m.end(), first, [m.span()]) for first, chain in CHAINS.values() for m in chain.finditer(old))
    return _replaced(old, pieces) if pieces else None


def unescape_percent(old: str) -> Layer | None:
    """The text with its percent escapes replaced."""
    if "%" not in old:
        return None
    pieces = [(m.start(), m.end(), *_utf8(bytes.fromhex(m.group().replace("%", "")), m.start(), 3)) for m in PERCENT.finditer(old)]
    return _replaced(old, pieces) if pieces else None


def unescape_unicode(old: str) -> Layer | None:
    """The text with its Unicode and HTML escapes replaced; two surrogate escapes in a row are one character."""
    if "\\" not in old and "&#" not in old:
        return None
    pieces: list[tuple[int, int, str, list[Span]]] = []
    high = None
    for m in ESCAPE.finditer(old):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        if 0xD800 <= code < 0xDC00:
            high = (m.start(), m.end(), code)
            continue
        begin = m.start()
        if 0xDC00 <= code < 0xE000:
            if not high or high[1] != begin:
                continue
            begin, code = high[0], 0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00
        if code <= 0x10FFFF:
            pieces.append((begin, m.end(), chr(code), [(begin, m.end())]))
    return _replaced(old, pieces) if pieces else None


def _packed(raw: bytes) -> bool:
    """Whether bytes begin like gzip or zlib data."""
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _inflated(raw: bytes, used: list[int]) -> Iterator[bytes]:
    """Windows of what the bytes inflate to, member after member; used becomes how many bytes were taken, and 1 once a
    member has come to its end or filled a window: what only begins like compressed data does not."""
    out, fresh, data = b"", False, raw
    while _packed(data):
        one = zlib.decompressobj(47)
        while True:
            try:
                new = one.decompress(data, max(1, INFLATE_LIMIT - len(out)))
            except zlib.error:
                new = None
                break
            data = one.unconsumed_tail
            out, fresh = out + new, fresh or bool(new)
            if len(out) >= INFLATE_LIMIT:
                used[:] = len(raw) - len(data), 1
                yield out
                out, fresh = out[len(out) - min(OVERLAP, INFLATE_LIMIT // 2) :], False
            if one.eof or not new:
                break
        if new is None:
            break
        data = one.unused_data if one.eof else b""
        used[:] = len(raw) - len(data), used[1] | one.eof
    if fresh:
        yield out


class _Run:
    """Base64 digits with the place of each in the text; lines: (number of the first digit, its place) of each line."""

    def __init__(self, digits: str, lines: list[tuple[int, int]], end: int):
        self.digits, self.lines, self.end = digits, lines, end
        self.plain = digits.replace("-", "+").replace("_", "/")
        self.firsts = [x for x, _ in lines]

    def bytes(self, begin: int, end: int) -> bytes:
        """What the digits begin to end encode; one digit too many is left out."""
        if (end - begin) % 4 == 1:
            end -= 1
        return base64.b64decode(self.plain[begin:end] + "=" * (-(end - begin) % 4))

    def at(self, digit: int) -> int:
        first, place = self.lines[bisect_right(self.firsts, digit) - 1]
        return place + digit - first

    def text(self, raw: bytes, begin: int, end: int, whole: bool) -> Layer:
        """The layer of bytes from the digits begin to end; a byte that is no UTF-8 stands as a surrogate."""
        text = raw.decode("utf-8", "surrogateescape")

        def edge(i: int, side: int) -> int:
            # byte b lies in the digits from 4b/3 to 4(b+1)/3
            at = i + side if text.isascii() else len(text[: i + side].encode("utf-8", "surrogateescape"))
            return self.at(min(end, begin - (-at * 4 // 3)) - 1) + 1 if side else self.at(begin + at * 4 // 3)

        return Layer(text, edge, whole)

    def inflated(self, raw: bytes, begin: int, used: list[int]) -> Iterator[Layer]:
        """Layers of compressed bytes from the digit begin on; they lie at all digits that were taken."""

        def edge(i: int, side: int) -> int:
            if not side:
                return self.at(begin)
            return self.end if used[0] >= len(raw) else self.at(begin - (-used[0] * 4 // 3) - 1) + 1

        for inner in _inflated(raw, used):
            yield Layer(inner.decode("utf-8", "surrogateescape"), edge, bool(used[1]))

    def layers(self) -> Iterator[Layer]:
        n, pieces, done = len(self.digits), [], 0
        cuts = [i for i, c in enumerate(self.digits) if c in "/-_"]
        for start in [0, *(i + 1 for i in cuts)]:
            if start < done or n - start < SHORTEST:
                continue
            # most starts are none: their first bytes tell
            head = self.bytes(start, min(n, start + 64))
            if _packed(head):
                raw, used = self.bytes(start, n), [0, 0]
                yield from self.inflated(raw, start, used)
                if used[1]:
                    done = n if used[0] == len(raw) else start - (-used[0] * 4 // 3)
                    pieces.append((start, done))
                    continue
            if _valid(head) * 4 // 3 < SHORTEST - 4:
                continue
            raw = self.bytes(start, n)
            good = _valid(raw)
            end = n if good == len(raw) else next((i for i in reversed(cuts[: bisect_right(cuts, start + good * 4 // 3)]) if _valid(x := self.bytes(start, i)) == len(x)), 0)
            if end - start >= SHORTEST:
                yield self.text(self.bytes(start, end), start, end, True)
                pieces.append((start, end))
                done = end
        for r in range(4):
            # what has been read in this alignment is not read again
            at = r
            for begin, end in [*(x for x in pieces if x[0] % 4 == r), (n, n)]:
                if begin - at >= SHORTEST:
                    raw = self.bytes(at, begin)
                    if TELLING.search(raw):
                        yield self.text(raw, at, begin, _valid(raw) == len(raw))
                    for m in PACKED.finditer(raw):
                        first = at + m.start() * 4 // 3
                        yield from self.inflated(raw[m.start() :], first, [0, 0]) if m.start() % 3 == 0 else self._inside(raw[m.start() :], at, m.start())
                at = max(at, end + (r - end) % 4)

    def _inside(self, raw: bytes, begin: int, skipped: int) -> Iterator[Layer]:
        """Layers of compressed bytes that begin between two groups of digits."""
        used = [0, 0]

        def edge(i: int, side: int) -> int:
            at = skipped + (used[0] if side else 0)
            return self.at(min(len(self.digits), begin - (-at * 4 // 3)) - 1) + 1 if side else self.at(begin + at * 4 // 3)

        for inner in _inflated(raw, used):
            yield Layer(inner.decode("utf-8", "surrogateescape"), edge, bool(used[1]))


def _valid(raw: bytes) -> int:
    """How many of the first bytes are UTF-8."""
    try:
        raw.decode()
    except UnicodeDecodeError as e:
        return e.start
    return len(raw)


def unwrap_base64(old: str) -> Iterator[Layer]:
    """Layers of the runs of base64 digits, each line for itself and wrapped lines as one."""
    done = 0
    for m in BASE64.finditer(old):
        yield from _Run(m.group().rstrip("="), [(0, m.start())], m.end()).layers()
        if m.start() < done or m.group().endswith("="):
            continue
        digits, lines, size, end = [m.group()], [(0, m.start())], len(m.group()), m.end()
        while w := WRAPPED.match(old, end):
            digits.append(w[1].rstrip("="))
            lines.append((size, w.start(1)))
            size, end = size + len(digits[-1]), w.end(1)
            if w[1].endswith("="):
                break
        if len(lines) > 1:
            done = end
            yield from _Run("".join(digits), lines, end).layers()


def unwrap_wide(old: str) -> Layer | None:
    """The text with its stretches of UTF-16 read."""
    if "\x00" not in old:
        return None
    pieces = []
    for m in WIDE.finditer(old):
        first = 0 if m.group()[1] == "\x00" else 1
        pieces.append((m.start(), m.end(), m.group()[first::2], [(i, i + 2) for i in range(m.start(), m.end(), 2)]))
    return _replaced(old, pieces) if pieces else None


def unwrap_packed(old: str) -> Iterator[Layer]:
    """Layers of compressed data that stands in the text as bytes."""
    done = 0
    for m in PACKED_TEXT.finditer(old):
        begin = m.start()
        if begin < done:
            continue
        for latin in (False, True):
            part, to_bytes = (LATIN, lambda x: x.encode("latin-1")) if latin else (BYTES, lambda x: x.encode("utf-8", "surrogateescape"))
            # the first bytes tell most that are none
            if not _inflates(to_bytes(part.match(old[begin : begin + 64])[0])):
                continue
            end = part.match(old, begin).end()
            raw, used = to_bytes(old[begin:end]), [0, 0]

            def edge(i: int, side: int, raw: bytes = raw, used: list[int] = used, begin: int = begin, latin: bool = latin) -> int:
                return begin + side * (used[0] if latin else len(raw[: used[0]].decode("utf-8", "surrogateescape")))

            for inner in _inflated(raw, used):
                yield Layer(inner.decode("utf-8", "surrogateescape"), edge, bool(used[1]))
            if used[1]:
                done = edge(0, 1)
                break


def _inflates(head: bytes) -> bool:
    """Whether the first bytes of compressed data are in order."""
    if not _packed(head):
        return False
    try:
        zlib.decompressobj(47).decompress(head)
    except zlib.error:
        return False
    return True


def _name(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass")).digest()


def _unwrapped(text: str) -> Iterator[Layer]:
    if (new := unescape_chain(text)) is not None:
        yield new
    else:
        for f in (unescape_percent, unescape_unicode, unwrap_wide):
            if (new := f(text)) is not None:
                yield new
    yield from unwrap_packed(text)
    yield from unwrap_base64(text)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base, all, layers): the findings of the text itself, those of all layers (start, kind, end), and how many
    layers there are."""
    base = list(findings(text))
    root = Found(text)
    known, path = {_name(text): root}, [(root, _unwrapped(text))]
    # depth first, so only the texts of one path are held
    while path:
        source, inner = path[-1]
        if (new := next(inner, None)) is None:
            path.pop()
        elif new.text:
            if (name := _name(new.text)) not in known:
                known[name] = Found(new.text)
                path.append((known[name], _unwrapped(new.text)))
            known[name].ups.append((source, new.edge))
            known[name].whole |= new.whole
    # a layer's spans go to all places that encode it, until none is new
    work = [(x, set(x.spans)) for x in known.values() if x.spans and x is not root]
    while work:
        layer, spans = work.pop()
        for source, edge in layer.ups:
            new = {(edge(s, 0), edge(e - 1, 1), k) for s, e, k in spans} - source.spans
            if new:
                source.spans |= new
                work.append((source, new))
    layers = sum(x.whole or bool(x.spans) for x in known.values() if x is not root)
    return base, _without_doubles(base, {(s, k, e) for s, e, k in root.spans}), layers


def _without_doubles(base: list[tuple[int, int, int]], found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """found, sorted by start and kind, without what lies inside a base span of its kind: the same secret, seen
    again in a layer that keeps the text around its escapes."""
    own = {(s, k, e) for s, e, k in base}
    out = set(own)
    by_kind = {k: sorted((s, e) for s, e, x in base if x == k) for k in range(len(KINDS))}
    for s, k, e in found - own:
        spans = by_kind[k]
        i = bisect_right(spans, (s, 1 << 60)) - 1
        if i < 0 or spans[i][1] < e:
            out.add((s, k, e))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, spans, n_layers): findings of the text itself and of all layers, as arrays of kind, start, end."""
    kind = docs.schema[id_column].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [scan(x or "") for x in part.column(1).to_pylist()]
                named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
                base = pa.array([named(sorted((s, k, e) for s, e, k in r[0])) for r in rows], pa.list_(item))
                spans = pa.array([named(r[1]) for r in rows], pa.list_(item))
                yield pa.RecordBatch.from_arrays([part.column(0), base, spans, pa.array([r[2] for r in rows], pa.int64())], names=[id_column, "base", "spans", "n_layers"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, base {spans}, spans {spans}, n_layers long")
