"""Near duplicates by HyperMinHash.

1. Sketch. Each text becomes the set of its distinct five-word shingles, hashed to 64 bits. The hash range is cut
   into REGISTERS buckets; a register keeps the smallest hash of its bucket as its number of leading zeros and the
   next MANTISSA bits. An empty register takes the value of the first filled one in a fixed random order of its
   own (densification), so that two registers agree with probability J also in small sets.
2. Bands. BANDS bands of ROWS registers each; texts that agree in a whole band are candidates. At J = 0.75 a pair
   shares no band with probability (1 - 0.75**5)**56 < 3e-7, and above that less.
3. Estimate. The share p of equal registers, less the chance c that different minima look alike, gives
   J = (p - c) / (1 - c); c follows from the two set sizes. Pairs more than SIGMAS standard errors below the
   threshold are dropped.
4. Verification on the full sets: 100 * intersection >= 75 * union.

Texts with equal sets are one class from the start, named by the 128-bit digest of the set and numbered; texts are found
again by two 64-bit hashes. Candidates are compared in two passes, so that a large group of near copies
never becomes all its pairs. First each class meets the centre of its buckets, the class that shares bands with most others,
and the best estimate of each class is verified. Then come the classes of the buckets that still hold more than one component. Two sets can
only be as similar as asked if they share one of the rarest shingles of either, of which a quarter of the set is
enough (a fact about any order of the shingles; the order is by a table of counts of fixed size). So pairs are made
by those shingles, between different components only, and never within the largest component of a shingle; they go
through estimate and verification. A pair within one component adds nothing, so no link between components is lost.
A shingle that more than LISTED classes have makes no rows of pairs: its classes are compared in blocks of about
BLOCK_SHINGLES shingles, pair of blocks by pair of blocks, by estimate and on the full sets, and what comes out is a
spanning forest of the links. So families whose members are all a little less similar than asked cost rows in
proportion to their members (times the blocks of a list), although their pairs are compared.

Bands of hot groups are spread by equi-joins and by minima that are combined before their shuffle.

Defined results: a null or empty text, or one without words, has n_shingles 0 and is linked with nothing, its
component is its own id; rows with equal texts are one class; a null id takes part, and its component is the
smallest id that isn't null, if there is one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import _Memo
from quillon.llm.graph import connected_components, forest
from quillon.sources.session import materialize

SHINGLE = 5
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
BANDS, ROWS, MANTISSA = 56, 5, 10
REGISTERS = BANDS * ROWS
SIGMAS = 6
#: Bits of the table of shingle counts that orders shingles by rarity.
SLOT_BITS, SLOT_PART = 20, 1 << 14
#: Classes of a shingle up to which their pairs are rows; beyond, shingles of a block, rows of a tile, columns at once.
LISTED, BLOCK_SHINGLES, TILE, COLUMNS = 64, 250_000, 256, 16_384
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_word_hash = _Memo(xxhash.xxh64_intdigest)
_ORDERS = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1).astype(np.int32)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; A-Z count as a-z, and fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(_word_hash.__getitem__, words), _U, len(words))
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, _U)
    for i in range(size):
        h = h * _P + w[i : len(w) - size + 1 + i]
    return np.unique(_mixed(h))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set: uint16, leading zeros above MANTISSA bits."""
    scaled = (hashes >> _U(32)) * _U(REGISTERS)
    bucket = (scaled >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (scaled[first] & _U(0xFFFFFFFF)).astype(np.int64)
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    mantissa = ((rest << (33 - length)) & 0xFFFFFFFF) >> (32 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    filled = np.zeros(REGISTERS, bool)
    out[bucket[first]] = (32 - length) << MANTISSA | mantissa
    filled[bucket[first]] = True
    empty = np.flatnonzero(~filled)
    for width in (8, 64, REGISTERS):
        if not len(empty):
            break
        donors = _ORDERS[empty, :width]
        has = filled[donors]
        at = has.argmax(axis=1)
        ok = has[np.arange(len(empty)), at]
        out[empty[ok]] = out[donors[ok, at[ok]]]
        empty = empty[~ok]
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """int64 names of the bands of sketches, one row a sketch."""
    r = sketches.reshape(len(sketches), BANDS, ROWS).astype(_U)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), r.shape[:2]).copy()
    for i in range(ROWS):
        h = _mixed(h * _P + r[:, :, i])
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates of pairs of sketches, the least estimate that isn't surely below the threshold)."""
    return corrected((a == b).mean(axis=1), na, nb)


def corrected(p: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``estimate`` from the shares of equal registers."""
    la, lb = na / REGISTERS, nb / REGISTERS
    c = np.zeros(len(p))
    for k in range(32):
        # minima with k leading zeros lie in [2^-(k+1), 2^-k); a cell of that range is 2^-(k+1+MANTISSA) wide
        x, width = 1.5 * 2.0 ** -(k + 1), 2.0 ** -(k + 1)
        c += la * (1 - x) ** np.maximum(la - 1, 0) * lb * (1 - x) ** np.maximum(lb - 1, 0) * width * width * 2.0**-MANTISSA
    c = np.minimum(c, 0.5)
    free = REGISTERS * -np.expm1(-np.minimum(na, nb) / REGISTERS)
    t = THRESHOLD / 100
    return (p - c) / (1 - c), t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(free, 1))


def _texts(column: pa.Array) -> Iterator[str]:
    for at in range(0, len(column), 256):
        for x in column.slice(at, 256).to_pylist():
            yield x or ""


def _text_keys(text: str) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("key"), F.xxhash64(F.lit(2), text).alias("key2")


def sketch(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, key2, n, lo, hi, sketch): the size of each text's set, the digest of its class and its registers. key
    and key2: hashes of the text, with which the text is found again."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, nodes, out = [], [], []
            for x in _texts(b.column(3)):
                s = shingles(x)
                n.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                out.append(registers(s).tobytes() if len(s) else None)
            pair = np.frombuffer(b"".join(nodes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(out, pa.binary())],
                names=["id", "key", "key2", "n", "lo", "hi", "sketch"],
            )

    keyed = docs.select(F.col(id_column).alias("id"), *_text_keys(text), F.col(text).alias("text"))
    return keyed.mapInArrow(run, f"id {kind}, key long, key2 long, n long, lo long, hi long, sketch binary")


def _band_rows(sketches: DataFrame) -> DataFrame:
    """(band, node): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                yield pa.RecordBatch.from_arrays([pa.array(bands(regs).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["band", "node"])

    return sketches.select("node", "sketch").mapInArrow(run, "band long, node long")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, j): the pairs (a, b) whose estimate leaves the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                sa, sb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                na, nb = b.column(4).to_numpy(), b.column(5).to_numpy()
                j, least = estimate(sa, sb, na, nb)
                ok = (j >= least) & (100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(j[ok])], names=["a", "b", "j"])

    of = lambda x: sketches.select(F.col("node").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"size_{x}"))
    met = pairs.join(of("a"), F.col("a") == F.col("na")).join(of("b"), F.col("b") == F.col("nb"))
    return met.select("a", "b", "sa", "sb", "size_a", "size_b").mapInArrow(run, "a long, b long, j double")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs whose full sets are similar enough."""
    of = lambda x: sets.select(F.col("node").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))
    met = pairs.select("a", "b").join(of("a"), F.col("a") == F.col("na")).join(of("b"), F.col("b") == F.col("nb"))
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    return met.select("a", "b", both.alias("i"), (F.size("ha") + F.size("hb")).alias("t")).filter(F.col("i") * 100 >= (F.col("t") - F.col("i")) * THRESHOLD).select("a", "b")


def _sets(docs: DataFrame, sketches: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, hashes): the full sets of the classes in nodes, made anew from the text of one document of each."""
    one = sketches.join(nodes.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).select("node", F.col("key").alias("k"), F.col("key2").alias("k2"))
    found = docs.select(*_text_keys(text), F.col(text).alias("text")).join(one, (F.col("k") == F.col("key")) & (F.col("k2") == F.col("key2"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x or "").view(np.int64) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["node", "hashes"])

    # copies of a text give their class's set again
    return found.dropDuplicates(["node"]).mapInArrow(run, "node long, hashes array<long>")


def _counts(sets: DataFrame) -> np.ndarray:
    """About how often each shingle occurs: counts by the first SLOT_BITS bits of its hash, a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            slots = b.column(0).flatten().to_numpy().view(_U) >> _U(64 - SLOT_BITS)
            table += np.bincount(slots.astype(np.int64), minlength=1 << SLOT_BITS)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["slot", "n"])

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(SLOT_PART, np.int32)
        table[rows["slot"].to_numpy() % SLOT_PART] = np.minimum(rows["n"].to_numpy(), np.iinfo(np.int32).max)
        return pd.DataFrame({"part": [key[0]], "table": [table.tobytes()]})

    sums = sets.select("hashes").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    parts = sums.groupBy(F.floor(F.col("slot") / SLOT_PART).alias("part")).applyInPandas(pack, "part long, table binary").collect()
    out = np.zeros(1 << SLOT_BITS, np.int32)
    for part, table in parts:
        out[part * SLOT_PART : (part + 1) * SLOT_PART] = np.frombuffer(table, np.int32)
    return out


def _rarest(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, node, at): the rarest shingles of each set, as many as two sets that are similar enough must share one
    of, and their places by rarity. Those that occur once are left out, as no other set has them."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                nodes, tokens, places = [], [], []
                for node, h in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    x = h.values.to_numpy().view(_U)
                    n = table[(x >> _U(64 - SLOT_BITS)).astype(np.int64)]
                    first = np.lexsort((x, n))[: len(x) - -(-THRESHOLD * len(x) // 100) + 1]
                    at = np.flatnonzero(n[first] > 1)
                    tokens.append(x[first[at]].view(np.int64))
                    nodes.append(np.full(len(at), node, np.int64))
                    places.append(at)
                joined = [pa.array(np.concatenate([np.empty(0, np.int64), *v])) for v in (tokens, nodes, places)]
                yield pa.RecordBatch.from_arrays(joined, names=["token", "node", "at"])

    return sets.select("node", "hashes").mapInArrow(run, "token long, node long, at long")


def _equal_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many registers each row of a shares with each row of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x[:, None] == y[None, :]
    return out


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of each set of a with each set of b, by products of their incidence matrices."""
    names, column = np.unique(np.concatenate(a + b), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    both = np.bincount(column[row < len(a)], minlength=len(names)).astype(bool) & np.bincount(column[row >= len(a)], minlength=len(names)).astype(bool)
    place = np.cumsum(both) - 1
    keep = both[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(both.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        marks = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        marks[row[lo:hi], column[lo:hi] - start] = 1
        out += marks[: len(a)] @ marks[len(a) :].T
    return out


def _linked(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of the classes of one shingle; pairs within a component, or of
    which one has too little left after the shingle, aren't looked at."""
    edges: list[tuple[int, int]] = []
    t = THRESHOLD
    parts = []
    for x in (a, b):
        registers_of = np.frombuffer(b"".join(x["sketch"]), np.uint16).reshape(-1, REGISTERS)
        parts.append((x["node"].to_numpy(), x["n"].to_numpy(), x["left"].to_numpy(), x["c"].to_numpy(), registers_of, list(x["hashes"])))
    for p in range(0, len(a), TILE):
        for q in range(p if same else 0, len(b), TILE):
            (ia, na, la, ca, ra, ha), (ib, nb, lb, cb, rb, hb) = ([v[k : k + TILE] for v in part] for part, k in zip(parts, (p, q), strict=True))
            total = na[:, None] + nb[None, :]
            ok = (ca[:, None] != cb[None, :]) & (np.minimum(la[:, None], lb[None, :]) * (100 + t) >= total * t) & (np.minimum(na[:, None], nb[None, :]) * 100 >= np.maximum(na[:, None], nb[None, :]) * t)
            if same and p == q:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            rows, columns = np.unique(i), np.unique(j)
            share = _equal_registers(ra[rows], rb[columns])[np.searchsorted(rows, i), np.searchsorted(columns, j)] / REGISTERS
            est, least = corrected(share, na[i], nb[j])
            i, j = i[est >= least], j[est >= least]
            if not len(i):
                continue
            rows, columns = np.unique(i), np.unique(j)
            both = _intersections([ha[k] for k in rows], [hb[k] for k in columns])[np.searchsorted(rows, i), np.searchsorted(columns, j)]
            good = both * 100 >= (na[i] + nb[j] - both) * t
            edges += forest(ia[i[good]], ib[j[good]])
    return edges


def _in_blocks(there: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between classes of shingles that many classes have, enough to join what links join.
    there: token, node, left, n, c, blocks."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    full = sets.select(F.col("node").alias("m"), "hashes").join(sketches.select(F.col("node").alias("m2"), "sketch"), F.col("m") == F.col("m2")).drop("m2")
    dealt = there.withColumn("block", block).withColumn("x", F.explode(pairs)).select("token", "x.i", "x.j", "block", "node", "left", "n", "c")
    rows = dealt.join(full, F.col("node") == F.col("m")).drop("m")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        a = rows[rows["block"] == i]
        b = a if i == j else rows[rows["block"] == j]
        edges = _linked(a, b, i == j) if len(a) and len(b) else []
        return pd.DataFrame({"a": np.array([x for x, _ in edges], np.int64), "b": np.array([y for _, y in edges], np.int64)})

    return rows.groupBy("token", "i", "j").applyInPandas(run, "a long, b long")


def _across(sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of different components that share one of their rarest shingles: as pairs (a, b), and as lists (token,
    node, left, n, c, blocks) for shingles that many have. labels: m, n, c."""
    rows = materialize(_rarest(sets, _counts(sets)).join(labels, F.col("node") == F.col("m")).select("token", "node", "at", "n", "c"), "near-rarest")
    parts = rows.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    mixed = parts.groupBy("token").agg(F.max(F.struct("k", "c")).alias("most"), F.count(F.lit(1)).alias("parts"), F.min("n").alias("smallest")).filter("parts > 1")
    mixed = mixed.select(F.col("token").alias("t"), F.col("most.c").alias("largest"), "smallest")
    left = F.col("n") - F.col("at")
    # from their first common shingle on, two sets can share no more than what either has left
    useful = left * (100 + THRESHOLD) >= (F.col("n") + F.col("smallest")) * THRESHOLD
    there = materialize(rows.join(mixed, F.col("token") == F.col("t")).filter(useful).select("token", "node", left.alias("left"), "n", "c", "largest"), "near-mixed")
    sizes = there.groupBy(F.col("token").alias("t")).agg(F.count(F.lit(1)).alias("k"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).filter(F.col("k") > LISTED)
    sizes = materialize(sizes, "near-lists")
    few = there.join(sizes, F.col("token") == F.col("t"), "left_anti")
    many = there.join(sizes, F.col("token") == F.col("t")).select("token", "node", "left", "n", "c", "blocks")
    x = few.filter("c <> largest").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("c").alias("ca"))
    y = few.select(F.col("token").alias("token2"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("c").alias("cb"), (F.col("c") == F.col("largest")).alias("main"))
    near_size = (F.col("na") * 100 >= F.col("nb") * THRESHOLD) & (F.col("nb") * 100 >= F.col("na") * THRESHOLD)
    enough = F.least("la", "lb") * (100 + THRESHOLD) >= (F.col("na") + F.col("nb")) * THRESHOLD
    met = x.join(y, (F.col("token") == F.col("token2")) & (F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("a") < F.col("b"))) & near_size & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), many


def links(docs: DataFrame, sketched: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The classes (node, lo, hi, ...), and (node, component) of those that are linked with others; sketched: what
    ``sketch`` made of docs."""
    sketches = sketched.filter("n > 0")
    text_key = F.min(F.struct("key", "key2")).alias("k")
    one = sketches.groupBy("lo", "hi").agg(F.min_by("sketch", "key").alias("sketch"), F.min("n").alias("n"), text_key)
    one = materialize(one.select(F.monotonically_increasing_id().alias("node"), "lo", "hi", "sketch", "n", "k.key", "k.key2"), "near-classes")
    rows = _band_rows(one)
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumnRenamed("band", "in_band")
    members = materialize(rows.join(shared, F.col("band") == F.col("in_band")).select("band", "node", "size"), "near-bands")
    sets = materialize(_sets(docs, one, members.select("node").distinct(), text), "near-sets")

    # the centre of a bucket is the class that shares bands with the most classes: of copies, the least altered
    fame = members.groupBy(F.col("node").alias("m")).agg(F.sum("size").alias("fame"))
    famed = materialize(members.join(fame, F.col("node") == F.col("m")).select("band", "node", "fame"), "near-famed")
    centre = famed.groupBy(F.col("band").alias("in_band")).agg(F.max(F.struct("fame", "node")).alias("top")).select("in_band", F.col("top.node").alias("a"))
    stars = famed.join(centre, F.col("band") == F.col("in_band")).filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    likely = materialize(_likely(stars, one), "near-likely")
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("j", "a")).alias("a")).select("a", "b")
    sure = materialize(_verified(best, sets), "near-links")
    first = materialize(connected_components(sure), "near-first")

    label = first.select(F.col("node").alias("m"), "component")
    named = materialize(members.join(label, F.col("node") == F.col("m"), "left").select("band", "node", F.coalesce("component", "node").alias("c")), "near-named")
    mixed = named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select(F.col("band").alias("in_band"))
    open_nodes = named.join(mixed, F.col("band") == F.col("in_band")).select("node", "c").distinct()
    labels = materialize(open_nodes.join(one.select(F.col("node").alias("m"), "n"), F.col("node") == F.col("m")).select("m", "n", "c"), "near-open")
    open_sets = sets.join(labels.select(F.col("m").alias("node")), "node", "left_semi")
    few, many = _across(open_sets, labels)
    rest = materialize(_likely(few, one), "near-cross")
    more = materialize(_verified(rest, sets).unionAll(_in_blocks(many, one, open_sets)), "near-more")
    return one, first if more.isEmpty() else connected_components(sure.unionAll(more))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id that links reach) and kept (its own id is
    that one)."""
    sketched = materialize(sketch(docs, id_column, text), "near-sketches")
    one, of = links(docs, sketched, text)
    of = one.select("node", F.col("lo").alias("l"), F.col("hi").alias("h")).join(of.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("l", "h", F.coalesce("component", "node").alias("c"))
    own = sketched.filter("n > 0").select("id", "n", "lo", "hi").join(of, (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h"))).select("id", "n", "c")
    least = own.groupBy("c").agg(F.min("id").alias("least")).withColumnRenamed("c", "c2")
    linked = own.join(least, F.col("c") == F.col("c2")).select("id", "n", "least")
    alone = sketched.filter("n = 0").select("id", "n", F.col("id").alias("least"))
    return linked.unionAll(alone).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept")
    )
