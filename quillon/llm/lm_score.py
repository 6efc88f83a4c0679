"""Language-model scores: masked pseudo-likelihood of a bidirectional window network, trained in numpy.

1. Counts. The words of all documents are counted. The VOCABULARY most frequent words have numbers of their own: the
   first HEAD are classes, the others lie in CLUSTERS classes of SLOTS words, by frequency. All other words fall into
   BUCKETS classes by checksum; in its bucket a word has the share of its count. Executors hold the counts of the
   KNOWN most frequent words; those of the others are joined to the words of the documents by Spark.
2. Network. A word is predicted from the two words on each side: the vector of each goes through a matrix of its
   place; their sum, through tanh, gives the logits of the classes and, within a cluster, those of its words. So each
   word of the vocabulary has a probability of its own in each context. Biases begin at the frequencies.
3. Training. Documents are dealt by a hash of id and text into groups of about GROUP_WORDS words, and each group to one
   of ROUNDS rounds; so every word is masked and predicted once. In a round each group runs minibatch steps from the
   shared weights, its documents in the order of their hashes, and Spark averages the weights that the groups reach,
   weighted by their words. How the table is cut into files and partitions changes nothing. Training grows with the
   corpus; only numbered words and weights move.
4. Scores. log P(word | both sides) is summed over every word of a document, each in turn hidden from its own
   prediction.

The driver gets bounded things only: the KNOWN words, sums by bucket and the weights. Averages are made by Spark.

Defined results: a null or empty text has n_tokens 0, log_prob 0 and no mean; a word that has never been counted is
scored as if counted zero times; repeated rows get equal scores up to float32 rounding; with an empty table the
weights stay as they began; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.session import materialize

HEAD, CLUSTERS, SLOTS, BUCKETS = 40, 32, 256, 8
VOCABULARY, CLASSES = HEAD + CLUSTERS * SLOTS, HEAD + CLUSTERS + BUCKETS
#: Numbers: the vocabulary, then the buckets, then the outside of a text.
OUTSIDE = VOCABULARY + BUCKETS
KNOWN = 131_072
SIDES = (-2, -1, 1, 2)
WIDTH = 16
ROUNDS, RATE = 2, 0.3
#: Words of a group; a group takes about STEPS steps of BATCH places at most.
GROUP_WORDS, STEPS, BATCH = 2_000_000, 256, 8_192
#: Distinct words that a task holds back before it hands on their counts, and words that are scored at once.
FLUSH, CHUNK = 200_000, 8_192
#: Gains of counts are summed as whole numbers of this part, so that the order of a sum doesn't matter.
PART = 1e-9
#: Weights that are averaged as one row.
PIECE = 4_096
SHAPES = ((OUTSIDE + 1, WIDTH), (len(SIDES), WIDTH, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLUSTERS, WIDTH, SLOTS), (CLUSTERS, SLOTS))
#: The class of each number (the outside has none), and its place in its cluster or 0.
CLASS_OF = np.concatenate([np.arange(HEAD), HEAD + np.repeat(np.arange(CLUSTERS), SLOTS), HEAD + CLUSTERS + np.arange(BUCKETS), [-1]]).astype(np.int64)
SLOT_OF = np.concatenate([np.zeros(HEAD), np.tile(np.arange(SLOTS), CLUSTERS), np.zeros(BUCKETS + 1)]).astype(np.int64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class Lexicon:
    """What is known of words. ``index`` has the KNOWN most frequent ones from 0 on; ``number`` and ``gain`` give the
    number of each and log(n + 1) of its count n if it lies in a bucket, else 0. ``base`` is log P(word | bucket) of a
    word counted zero times. ``frequency`` counts by number. ``counts`` (word, n) stay with the driver's plan."""

    def __init__(self, index: dict[bytes, int], number: np.ndarray, gain: np.ndarray, base: np.ndarray, frequency: np.ndarray, counts: DataFrame | None = None):
        self.index, self.number, self.gain, self.base, self.frequency, self.counts = index, number, gain, base, frequency, counts

    def __reduce__(self):
        return Lexicon, (self.index, self.number, self.gain, self.base, self.frequency)

    def read(self, text: str | None) -> tuple[np.ndarray, float, list[bytes]]:
        """(numbers, sum of the gains of known words, the words that aren't known) of a text."""
        tokens = words(text)
        get = self.index.get
        at = np.fromiter([get(w, -1) for w in tokens], np.int32, len(tokens))
        numbers, gain = self.number[at], float(self.gain[at].sum())
        others = np.flatnonzero(at < 0).tolist()
        rare = [tokens[i] for i in others]
        if rare:
            numbers[others] = [VOCABULARY + zlib.crc32(w) % BUCKETS for w in rare]
        return numbers, gain, rare


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for x in b.column(0).slice(at, 256).to_pylist():
                    counts.update(words(x))
                    if len(counts) >= FLUSH:
                        yield flush()
                        counts.clear()
        yield flush()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame) -> Lexicon:
    """The lexicon of counts; the driver gets KNOWN words at most, and one row a bucket and a bin of counts. The known
    words are those above a count: words of one bin are all known or all not."""
    bin_of = F.when(F.col("n") < 4_096, F.col("n")).otherwise(4_096 + F.floor(F.log2("n") * 64)).cast("long")
    bins = sorted(counts.groupBy(bin_of.alias("bin")).count().collect(), reverse=True)
    upto = np.cumsum([b["count"] for b in bins])
    least = next((b["bin"] for b, n in zip(bins, upto, strict=True) if n > KNOWN), 0)
    top = counts.filter(bin_of > least).toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    known, n = [w.encode("utf-8", "surrogatepass") for w in top["word"]], top["n"].to_numpy(np.int64)
    sums = counts.groupBy((F.crc32("word") % BUCKETS).cast("int").alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    total, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():
        total[r["b"]], kinds[r["b"]] = r["n"], r["kinds"]
    # a row more, which stands for the words that aren't known until their buckets are filled in
    number, gain = np.zeros(len(known) + 1, np.int16), np.zeros(len(known) + 1)
    for i, w in enumerate(known):
        if i < VOCABULARY:
            number[i] = i
            total[bucket(w)] -= n[i]
            kinds[bucket(w)] -= 1
        else:
            number[i] = VOCABULARY + bucket(w)
    gain[VOCABULARY : len(known)] = np.log(n[VOCABULARY:] + 1)
    frequency = np.zeros(OUTSIDE)
    frequency[: min(len(known), VOCABULARY)] = n[:VOCABULARY]
    frequency[VOCABULARY:] = total
    return Lexicon({w: i for i, w in enumerate(known)}, number, gain, -np.log(total + kinds + 1), frequency, counts)


def start_weights(frequency: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Small random vectors and matrices; biases are the logarithms of frequencies, and a place without a word has
    hardly any."""
    r = np.random.default_rng(seed)
    out = [r.normal(0, WIDTH**-0.5, s) for s in SHAPES]
    by_class = np.bincount(CLASS_OF[:OUTSIDE], frequency, CLASSES)
    slots = frequency[HEAD:VOCABULARY].reshape(CLUSTERS, SLOTS)
    out[2] = np.zeros(WIDTH)
    out[4] = np.log((by_class + 1) / (by_class.sum() + CLASSES))
    out[6] = np.where(slots > 0, np.log(np.maximum(slots, 1)), -20.0) - np.log(np.maximum(slots.sum(axis=1, keepdims=True), 1))
    for i in (3, 5):
        out[i] *= 0.1
    return [w.astype(np.float32) for w in out]


def _flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat: np.ndarray) -> list[np.ndarray]:
    cuts = np.cumsum([math.prod(s) for s in SHAPES])
    return [p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat[: cuts[-1]], cuts[:-1]), SHAPES, strict=True)]


def _logits(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Rows of logits, moved where their exponentials might overflow."""
    out = h @ vectors
    out += bias
    if len(out) and out.max() > 60:
        out -= out.max(axis=1, keepdims=True)
    return out


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of rows of logits, their sums); changes the logits."""
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], np.float32)


def _hidden(weights: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """The hidden layer of the places of a stretch of a line, whose vectors begin and end two places further out."""
    n = len(vectors) - 4
    h = vectors[2 + SIDES[0] : 2 + SIDES[0] + n] @ weights[1][0]
    for m, s in zip(weights[1][1:], SIDES[1:], strict=True):
        h += vectors[2 + s : 2 + s + n] @ m
    h += weights[2]
    return np.tanh(h, out=h)


def _clustered(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(cluster, places) of the classes that are clusters."""
    inside = np.flatnonzero((classes >= HEAD) & (classes < HEAD + CLUSTERS))
    own = (classes[inside] - HEAD).astype(np.int16)
    order = inside[np.argsort(own, kind="stable")]
    ends = np.cumsum(np.bincount(own, minlength=CLUSTERS)).tolist()
    for c, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if a < b:
            yield c, order[a:b]


def in_line(numbers: list[np.ndarray]) -> np.ndarray:
    """Texts one after the other, with two places of the outside before, between and after them."""
    gap = np.full(2, OUTSIDE, np.int16)
    return np.concatenate([x for n in numbers for x in (gap, n)] + [gap])


def train_step(weights: list[np.ndarray], squares: list[np.ndarray], stretch: np.ndarray) -> None:
    """One minibatch step for the words of a stretch of a line but its first and last two places; changes weights and
    squares. The rate of a weight falls with what it has moved."""
    target = stretch[2:-2]
    classes = CLASS_OF[target]
    vectors = weights[0][stretch]
    h = _hidden(weights, vectors)
    d, sums = _softmax(_logits(h, weights[3], weights[4]))
    d *= (1 / sums)[:, None]
    d[np.arange(len(target)), classes] -= 1
    d[classes < 0] = 0
    dh = d @ weights[3].T
    steps = [(3, slice(None), h.T @ d), (4, slice(None), d.sum(axis=0))]
    for c, places in _clustered(classes):
        hc = h[places]
        e, sums = _softmax(_logits(hc, weights[5][c], weights[6][c]))
        e *= (1 / sums)[:, None]
        e[np.arange(len(places)), SLOT_OF[target[places]]] -= 1
        dh[places] += e @ weights[5][c].T
        steps += [(5, c, hc.T @ e), (6, c, e.sum(axis=0))]
    dh *= 1 - h * h
    steps.append((2, slice(None), dh.sum(axis=0)))
    back = np.zeros_like(vectors)
    for j, s in enumerate(SIDES):
        here = slice(2 + s, 2 + s + len(dh))
        back[here] += dh @ weights[1][j].T
        steps.append((1, j, vectors[here].T @ dh))
    order = np.argsort(stretch, kind="stable")
    first = np.flatnonzero(np.diff(stretch[order], prepend=-1))
    steps.append((0, stretch[order[first]], np.add.reduceat(back[order], first, axis=0)))
    for w, where, g in steps:
        own = squares[w][where] + g * g
        squares[w][where] = own
        weights[w][where] -= RATE * g / np.sqrt(own)


def log_probs(weights: list[np.ndarray], line: np.ndarray) -> np.ndarray:
    """log P(number | both sides) of the places of a line but its first and last two, 0 for the outside. For a bucket
    it is that of the bucket."""
    out = []
    for i in range(2, len(line) - 2, CHUNK):
        stretch = line[i - 2 : min(i + CHUNK, len(line) - 2) + 2]
        target = stretch[2:-2]
        classes = CLASS_OF[target]
        h = _hidden(weights, weights[0][stretch])
        logits = _logits(h, weights[3], weights[4])
        own = logits[np.arange(len(target)), classes]
        logs = (own - np.log(_softmax(logits)[1])).astype(np.float64)
        for c, places in _clustered(classes):
            logits = _logits(h[places], weights[5][c], weights[6][c])
            own = logits[np.arange(len(places)), SLOT_OF[target[places]]]
            logs[places] += own - np.log(_softmax(logits)[1])
        logs[classes < 0] = 0
        out.append(logs)
    return np.concatenate(out or [np.empty(0)])


def read_words(docs: DataFrame, lex: Lexicon, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, deal, n, gain, numbers, rare): the words of each text as 16-bit numbers, the gains of known words, and
    the words that aren't known, by spaces. deal: a hash of id and text."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                sizes, numbers, gains, rare = [], [], [], []
                for x in b.column(3).to_pylist():
                    n, gain, others = lex.read(x)
                    sizes.append(len(n))
                    numbers.append(n.tobytes())
                    gains.append(gain + float(lex.base[n[n >= VOCABULARY] - VOCABULARY].sum()))
                    rare.append(b" ".join(others) or None)
                columns = [
                    pa.array(sizes, pa.int64()), pa.array(gains, pa.float64()),
                    pa.array(numbers, pa.binary()), pa.array(rare, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=["row", "id", "deal", "n", "gain", "numbers", "rare"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.xxhash64(id_column, text).alias("deal"), F.col(text).alias("text"))
    return numbered.mapInArrow(run, f"row long, id {kind}, deal long, n long, gain double, numbers binary, rare binary")


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """The numbers of each row."""
    return [np.frombuffer(x, np.int16) for x in column.to_pylist()]


def train_round(read: DataFrame, weights: list[np.ndarray], turn: int, groups: int, batch_places: int = BATCH) -> list[np.ndarray]:
    """The average of the weights that the groups of a round reach from the given ones."""
    shared = read.sparkSession.sparkContext.broadcast(_flat(weights))

    def reached(weights: list[np.ndarray], seen: int) -> pa.RecordBatch:
        flat = _flat(weights).astype(np.float64)
        flat = np.pad(flat, (0, -len(flat) % PIECE))
        pieces = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PIECE), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces)), pa.int32()), pa.array(np.full(len(pieces), float(seen))), pieces], names=["piece", "seen", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, squares, waiting, n, seen = None, None, None, [], 0, 0

        def learn() -> int:
            line = in_line(waiting)
            for i in range(2, len(line) - 2, batch_places):
                train_step(own, squares, line[i - 2 : min(i + batch_places, len(line) - 2) + 2])
            return n

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                b = batch.slice(start, 64)
                for g, numbers in zip(b.column(0).to_pylist(), _numbers(b.column(1)), strict=True):
                    if g != group or n >= 16 * batch_places:
                        seen += learn() if n else 0
                        waiting, n = [], 0
                    if g != group:
                        if seen:
                            yield reached(own, seen)
                        group, seen, own = g, 0, _shaped(shared.value)
                        squares = [np.ones_like(w) for w in own]
                    waiting.append(numbers)
                    n += len(numbers)
        seen += learn() if n else 0
        if seen:
            yield reached(own, seen)

    group = F.pmod("deal", F.lit(groups)).alias("group")
    mine = read.filter((F.col("n") > 0) & (F.pmod(F.shiftright("deal", 32), F.lit(ROUNDS)) == turn)).select(group, "deal", "numbers")
    dealt = mine.repartition(groups, "group").sortWithinPartitions("group", "deal").select("group", "numbers")
    rows = dealt.mapInArrow(run, "piece int, seen double, value array<double>")
    mean = rows.groupBy("piece").agg(Summarizer.mean(array_to_vector("value"), F.col("seen")).alias("mean"))
    pieces = mean.select("piece", vector_to_array("mean").alias("mean")).collect()
    if not pieces:
        return weights
    return _shaped(np.concatenate([p["mean"] for p in sorted(pieces, key=lambda p: p["piece"])]))


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[Lexicon, list[np.ndarray], DataFrame]:
    """(lexicon, weights, the read words of docs)."""
    lex = lexicon(materialize(count_words(docs, text), "word-counts"))
    read = materialize(read_words(docs, lex, id_column, text), "lm-words")
    weights = start_weights(lex.frequency)
    in_round = lex.frequency.sum() / ROUNDS
    groups = max(1, math.ceil(in_round / GROUP_WORDS))
    batch_places = min(BATCH, max(32, math.ceil(in_round / groups / STEPS)))
    for turn in range(ROUNDS):
        weights = train_round(read, weights, turn, groups, batch_places)
    return lex, weights, read


def score(read: DataFrame, lex: Lexicon, weights: list[np.ndarray], id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob): the summed conditional log probabilities of each text that was read."""
    kind = read.schema["id"].dataType.simpleString()
    shared = read.sparkSession.sparkContext.broadcast(_flat(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shaped(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                b = batch.slice(start, 64)
                numbers = _numbers(b.column(4))
                # each text with the two places of the outside before it, but for the first, and after it
                of = np.repeat(np.arange(len(numbers)), [len(n) + 2 for n in numbers])[2:]
                sums = np.bincount(of, log_probs(own, in_line(numbers)), len(numbers))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums + b.column(3).to_numpy())], names=["row", "id", "n", "sum"])

    part = read.select("row", "id", "n", "gain", "numbers").mapInArrow(run, f"row long, id {kind}, n long, sum double")
    if lex.counts is not None:
        gain = lex.counts.select(F.col("word").alias("w"), F.round(F.log(F.col("n") + 1) / PART).cast("long").alias("gain"))
        rare = read.filter("rare is not null").select("row", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("word"))
        gains = rare.join(gain, F.col("word") == F.col("w")).groupBy(F.col("row").alias("r")).agg((F.sum("gain") * PART).alias("gains"))
        part = part.join(gains, F.col("row") == F.col("r"), "left").withColumn("sum", F.col("sum") + F.coalesce("gains", F.lit(0.0)))
    return part.select(F.col("id").alias(id_column), F.col("n").alias("n_tokens"), F.col("sum").alias("log_prob"), F.when(F.col("n") > 0, F.col("sum") / F.col("n")).alias("mean_log_prob"))


def lm_scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents by a network trained on all of them."""
    lex, weights, read = train(docs, id_column, text)
    return score(read, lex, weights, id_column)
