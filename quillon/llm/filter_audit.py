"""Audits of how filters interact: what each filter of each order removes, and what others would have removed anyway.

Each document has a mask with a bit for every filter that it fails. All that is asked for is a sum over masks: in any
order a document goes at the first of its filters, so counts by part and mask answer every order and step.

Four filters look at one text (SQL functions); the fifth fails a text that a smaller id has, too:

1. Prepass: a counting Bloom filter over 64-bit hashes of the texts, in blocks of BLOCK_BITS counters. A task's counts are
   combined before they are merged, by block and counter; of the merged ones only those of two or more matter, and these
   are a bitmap a block, BITS_PER_TEXT bits a text and at most MAX_BLOCKS blocks (which bounds the broadcast).
2. A text with a counter below two is the only one of its kind: it is done. The others may repeat; only they are shuffled,
   as whole texts, for the smallest id of each, which Spark combines before the shuffle: a text in a third of all rows is
   one row a task.
3. The first ids, with two hashes of their text, mark which of the possible repeats are first: an equi-join by id, which
   has no hot key.

With more than MAX_BLOCKS * BLOCK_BITS / BITS_PER_TEXT texts (134 million) more and more unique texts are taken for
possible repeats and shuffled with them; results stay exact.

Defined results: a null text counts as empty, a null part as the empty string. A document without an id is compared with
none: it never fails the fifth filter and makes no other fail. Rows with the same id and text are each other's equals,
neither is smaller. A label counts if any row of labels for the id has it. An empty table has no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import ceil, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bind, text_of
from quillon.llm.quality import words_of
from quillon.sources.session import materialize

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
SIGNS = "[#$%&*|]"
#: bitmap_construct_agg makes bitmaps of so many bits.
BLOCK_BITS = 32_768
#: Counters of a text within its block, and bits of the bitmaps for each text.
HASHES, BITS_PER_TEXT = 3, 16
#: 256 MB of bitmaps.
MAX_BLOCKS = 1 << 16


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4 and 8: under MIN_WORDS words; under MIN_DISTINCT percent of them distinct; over MAX_UPPER percent of
    the code points capitals A-Z; a sign."""

    def of_words(w: Column) -> Column:
        few = F.when(F.size(w) < MIN_WORDS, 1).otherwise(0)
        same = F.when(F.size(F.array_distinct(w)) * 100 < F.size(w) * MIN_DISTINCT, 2).otherwise(0)
        return few + same

    upper = F.when(F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MAX_UPPER, 4).otherwise(0)
    signs = F.when(text.rlike(SIGNS), 8).otherwise(0)
    return bind(words_of(text), of_words) + upper + signs


def _slots(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a text's hash, and its counters there."""
    mixed = F.xxhash64(F.lit("slots"), key)
    spots = [F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(BLOCK_BITS - 1).cast("int") for i in range(HASHES)]
    return F.pmod(key, F.lit(blocks)).cast("int"), F.array(*spots)


def counting_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bitmap) of the hashes in column key: a bit for each counter that two or more rows reach."""
    block, spots = _slots(F.col("key"), blocks)
    counters = keys.select(block.alias("block"), F.explode(F.array_distinct(spots)).alias("spot")).groupBy("block", "spot").agg(F.count(F.lit(1)).alias("n"))
    return counters.filter("n > 1").groupBy("block").agg(F.bitmap_construct_agg(F.col("spot").cast("long")).alias("bitmap"))


def _bit(bitmap: Column, spot: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (F.floor(byte / F.pow(F.lit(2), spot % 8)) % 2) == 1


def repeats_maybe(rows: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """rows with maybe: whether their hash, column key, reaches two in all of its counters. The others are the only ones
    with their text."""
    block, spots = _slots(F.col("key"), blocks)
    met = rows.join(F.broadcast(sketch), block == sketch["block"], "left")
    hit = F.forall(spots, lambda s: _bit(F.col("bitmap"), s))
    return met.select(*[f"`{c}`" for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("maybe"))


def masks(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask) of every row: a bit for each of the five filters that it fails."""
    t, own = text_of(f"`{text}`"), F.col(f"`{id_column}`").alias("id")
    # two hashes stand for a text where the text itself has been compared
    key = lambda x: F.xxhash64(x).alias("key")
    key2 = lambda x: F.xxhash64(F.lit("second"), x).alias("key2")
    facts = materialize(docs.select(own, F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), key(t), key2(t), text_mask(t).alias("mask")), "filter-facts")
    blocks = max(1, min(MAX_BLOCKS, ceil(facts.count() * BITS_PER_TEXT / BLOCK_BITS)))
    sketch = materialize(counting_bloom(facts, blocks), "filter-sketch")
    texts = docs.select(own, t.alias("text"), key(t)).filter("id is not null")
    first = repeats_maybe(texts, sketch, blocks).filter("maybe").groupBy("text").agg(F.min("id").alias("id"))
    first = first.select("id", key(F.col("text")), key2(F.col("text")), F.lit(True).alias("first"))
    met = repeats_maybe(facts, sketch, blocks).join(first, ["id", "key", "key2"], "left")
    later = F.col("maybe") & F.col("id").isNotNull() & F.col("first").isNull()
    return met.select("id", "part", (F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents with a mask, and those of them that labels (doc_id, quality, toxic) call so."""
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed.join(marked, failed["id"] == marked["doc_id"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each
    part, each order of the filters and each step, from counts by mask."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [("".join(o), k + 1, o[k], bit[o[k]], sum(bit[f] for f in o[:k])) for o in permutations(FILTERS) for k in range(len(o))]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("filter_order", "step", "filter", "bit", "before"), s, strict=True)]) for s in steps])
    # at most 32 masks a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.explode(table).alias("s")).select("part", "masks", "s.*")

    def total(value: str, condition) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(condition(m["mask"]), m[value]).otherwise(F.lit(0)))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    orders = factorial(len(FILTERS))
    # of all orders, a document goes at a given one of its b filters in orders / b
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(fails(m["mask"]), m["n"] * (F.lit(orders) / F.bit_count(m["mask"])).cast("long")).otherwise(F.lit(0)))
    return rows.select(
        "part", "filter_order", "step", "filter",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters over documents (doc_id, text, part) with labels (doc_id, quality, toxic)."""
    return audit(mask_counts(masks(docs, part=part), labels))
