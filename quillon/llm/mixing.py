"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Sources are ranked by code point, null last, and weigh 1, 2, 3, 1, 2, 3, ... They share the words of
   all documents by weight; a target stops at MAX_REPEAT times its source's words, and what is over is shared by
   weight among the others until none is above. Ranks come from ranges of sources; the sharing is a few rounds of
   sums over the sources.
2. Blocks. A source's documents are dealt by hash into blocks of about BLOCK_WORDS words, and blocks stand in a
   permuted (hash) order. A target of k whole passes and a rest takes every block k times and, for the rest, the
   blocks from the front; the block in which the rest ends is cut between two documents, at the nearer side. Places
   and words before a block are sums over RANGES ranges of the order, and then within the range.
3. Splitting tree. The blocks drawn from each source are its exact quota. The root holds all quotas; each node
   gives its left child half of its blocks, and how many of each source is a draw from the multivariate
   hypergeometric distribution, by inversion from the mode outwards, with a uniform number that is a hash of seed,
   node and source. Draws go to GROUPS groups of sources first and then to the sources of each group, which is the
   same distribution; a row of the tree is a group of a node, so neither sources nor shards meet in one row. Leaves
   are shards of about SHARD_WORDS words: their quotas per source are exact, sum to the sources' quotas and differ by
   one block in all at most.
4. Assignment. A source's drawn blocks, in permuted order, go to shards in runs as long as the shards' quotas, so
   draws are disjoint; ``mix`` brings each shard into one partition and shuffles its documents there by hash.

Only sizes move: the text stays where it is until ``mixture`` joins it. Sums are combined before they are shuffled,
and a hot source is spread over ranges of its blocks; joins of documents with one row a source are broadcast where
the sources are few, and split by Spark where they are skewed and not.

Defined results: a null or empty text has size 0 and is taken k times like the others of its source (its taken
words are 0); a null source is a source; rows that are equal in id and text share their place; an empty table
gives an empty result; other columns are not looked at. Reruns agree: every choice is a hash of the data and SEED.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import bind, n_words, text_of, without
from quillon.sources.session import materialize

SEED = 20240601
BLOCK_WORDS = 50_000
SHARD_WORDS = 4_000_000
MAX_REPEAT = 3
#: Ranges of a source's blocks, groups of sources, and places of a source that are looked up together.
RANGES_BITS, GROUPS, STRETCH = 12, 1_024, 256
#: Standard deviations on either side of the mode within which a draw is inverted; what lies beyond is under 1e-30.
REACH = 12
ADDED = ("size", "source_size", "target", "times", "taken", "shards", "h", "__block")


def _hash(*parts) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def _uniform(*parts) -> Column:
    """A number in (0, 1) that depends on the parts."""
    return (F.pmod(_hash(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def sized(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, h): the words of each document and its place in the permutation."""
    t = text_of(text)
    return docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), n_words(t).alias("size"), _hash(F.col(id_column), F.xxhash64(t)).alias("h")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, rest, n_blocks): one row a source.

    passes: how often the mix takes the whole source; rest: the words it takes beyond that.
    """
    order = F.col("source").asc_nulls_last()
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(order).sortWithinPartitions(order)
    # (partition, place in it) in one number
    lined = materialize(total.withColumn("at", F.monotonically_increasing_id()), "mixing-ranked").withColumn("part", F.shiftright("at", 33))
    parts = lined.groupBy(F.col("part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    parts = parts.select("of_part", (F.sum("n").over(Window.orderBy("of_part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.pmod("at", F.lit(1 << 33))
    weighed = lined.join(parts, F.col("part") == F.col("of_part")).select("source", "source_size", (rank % 3 + 1).alias("weight"), (F.col("source_size") * MAX_REPEAT).alias("most"))
    weighed = materialize(weighed, "mixing-weighed")
    everything = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, n_full = 0.0, -1
    while True:
        # sources are full at a share, and the others share what is left; shares only grow
        full = F.col("weight") * share > F.col("most")
        sums = weighed.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if sums[0] == n_full or not sums[2]:
            break
        n_full, share = sums[0], (everything - sums[1]) / sums[2]
    aimed = weighed.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), F.col("most").cast("double")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return aimed.withColumn("passes", passes).select(
        "source", "source_size", "target", "passes",
        F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)).alias("rest"),
        F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1)).cast("long").alias("n_blocks"),
    )


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items, from ``total`` of which ``good`` count, count: the inverse of the distribution
    at u. Weights relative to the mode follow from their ratios; they are summed on both sides of the mode, and the
    draw is found by walking the same way again."""
    spec = F.struct(total.cast("double").alias("all"), good.cast("double").alias("good"), drawn.cast("double").alias("drawn"), u.alias("u"))

    def at_mode(p: Column) -> Column:
        mode = F.floor((p["drawn"] + 1) * (p["good"] + 1) / (p["all"] + 2)).cast("double")
        low, high = F.greatest(F.lit(0.0), p["drawn"] + p["good"] - p["all"]), F.least(p["drawn"], p["good"])
        spread = F.sqrt(F.greatest(p["drawn"] * (p["good"] / p["all"]) * (1 - p["good"] / p["all"]), F.lit(1.0)))
        reach = F.ceil(spread * REACH + 2 * REACH).cast("double")
        at = F.greatest(low, F.least(high, mode))
        return F.struct(
            *[p[c].alias(c) for c in ("all", "good", "drawn", "u")], at.alias("m"),
            F.greatest(low, at - reach).alias("lo"), F.least(high, at + reach).alias("hi"),
        )

    def drawn_from(p: Column) -> Column:
        up = lambda x: (p["good"] - x) * (p["drawn"] - x) / ((x + 1) * (p["all"] - p["good"] - p["drawn"] + x + 1))  # noqa: E731  weight(x + 1) / weight(x)
        ups = F.sequence(F.lit(1), (p["hi"] - p["m"]).cast("int"))
        downs = F.sequence(F.lit(1), (p["m"] - p["lo"]).cast("int"))
        right = lambda w, i: w * up(p["m"] + i - 1)
        left = lambda w, i: w / up(p["m"] - i)

        def side(steps: Column, present: Column, ratio) -> Column:
            zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))

            def add(acc: Column, i: Column) -> Column:
                return bind(ratio(acc["w"], i), lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s")))

            return F.when(present, F.aggregate(steps, zero, add, lambda acc: acc["s"])).otherwise(0.0)

        def found(steps: Column, present: Column, ratio, goal: Column) -> Column:
            zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).alias("at"))

            def walk(acc: Column, i: Column) -> Column:
                return bind(
                    ratio(acc["w"], i),
                    lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s"), F.when(acc["s"] < goal, i).otherwise(acc["at"]).alias("at")),
                )

            return F.when(present, F.aggregate(steps, zero, walk, lambda acc: acc["at"])).otherwise(0)

        has_up, has_down = p["hi"] > p["m"], p["m"] > p["lo"]
        sums = F.struct(side(ups, has_up, right).alias("r"), side(downs, has_down, left).alias("l"))

        def invert(s: Column) -> Column:
            goal = p["u"] * (1 + s["r"] + s["l"])
            return (
                F.when(goal <= 1, p["m"])
                .when(goal <= 1 + s["r"], p["m"] + found(ups, has_up, right, goal - 1))
                .otherwise(p["m"] - found(downs, has_down, left, goal - 1 - s["r"]))
            )

        return bind(sums, invert).cast("long")

    return F.when((good <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(good >= total, drawn.cast("long")).otherwise(bind(bind(spec, at_mode), drawn_from))


def _left(qs: Column, room: Column, uniform) -> Column:
    """How many of the items of each entry of qs are among ``room`` that are drawn from all: one hypergeometric draw
    an entry, from what the entries before have left. uniform: of an entry."""

    def drawn(start: Column) -> Column:
        def draw(acc: Column, x: Column) -> Column:
            got = _hypergeometric(acc["rest"], x["q"], acc["room"], uniform(x))
            return bind(got, lambda g: F.struct((acc["rest"] - x["q"]).alias("rest"), (acc["room"] - g).alias("room"), F.concat(acc["left"], F.array(g)).alias("left")))

        return F.aggregate(qs, start, draw, lambda acc: acc["left"])

    total = F.aggregate(qs, F.lit(0).cast("long"), lambda a, x: a + x["q"])
    return drawn(F.struct(total.alias("rest"), room.cast("long").alias("room"), F.array().cast("array<bigint>").alias("left")))


def splitting_tree(quotas: DataFrame, levels: int) -> DataFrame:
    """(source, shard, begin, end): the run of each source's drawn blocks that each of 2**levels shards gets.

    quotas: (source, quota), one row a source. A row of the tree is a group of sources at a node.
    """
    entry = F.struct(F.col("source").isNull().alias("n"), "source", F.col("quota").cast("long").alias("q"))
    group = F.pmod(_hash("source"), F.lit(GROUPS)).alias("g")
    nodes = quotas.filter("quota > 0").groupBy(group).agg(F.sum("quota").cast("long").alias("q"), F.array_sort(F.collect_list(entry)).alias("qs")).select(F.lit(0).cast("long").alias("shard"), "g", "q", "qs")
    nodes = materialize(nodes, "mixing-tree")
    for level in range(levels):
        half = F.floor(F.aggregate("gs", F.lit(0).cast("long"), lambda a, x: a + x["q"]) / 2)
        lefts = _left(F.col("gs"), half, lambda x, level=level: _uniform(F.lit(level), F.lit("group"), F.col("shard"), x["g"]))
        tops = nodes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("g", "q"))).alias("gs"))
        rooms = tops.select("shard", F.explode(F.arrays_zip(F.col("gs.g").alias("g"), lefts.alias("room"))).alias("x")).select(F.col("shard").alias("s"), F.col("x.g").alias("of"), "x.room")

        def child(left: Column, right: int) -> Column:
            own = lambda x, i: x["q"] - F.get(left, i) if right else F.get(left, i)
            kept = F.transform("qs", lambda x, i: F.struct(x["n"].alias("n"), x["source"].alias("source"), own(x, i).alias("q")))
            total = F.col("q") - F.col("room") if right else F.col("room")
            return F.struct((F.col("shard") * 2 + right).alias("shard"), F.col("g").alias("g"), total.alias("q"), F.filter(kept, lambda x: x["q"] > 0).alias("qs"))

        left = _left(F.col("qs"), F.col("room"), lambda x, level=level: _uniform(F.lit(level), F.col("shard"), x["n"], x["source"]))
        met = nodes.join(rooms, (F.col("shard") == F.col("s")) & (F.col("g") == F.col("of")))
        halves = met.select(F.explode(bind(left, lambda x: F.array(child(x, 0), child(x, 1)))).alias("x")).select("x.*").filter("q > 0")
        nodes = materialize(halves, "mixing-tree")
    leaves = nodes.select("shard", F.explode("qs").alias("x")).select("shard", "x.source", "x.q")
    end = F.sum("q").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return leaves.withColumn("end", end).select("source", "shard", (F.col("end") - F.col("q")).alias("begin"), "end").filter("end > begin")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _block() -> Column:
    return F.pmod(F.shiftrightunsigned("h", 8), F.col("n_blocks"))


def draws(sizes: DataFrame, levels: int | None = None) -> DataFrame:
    """One row a block: s, b, source_size, target, passes, cut (words that the rest takes of the block, if it ends
    here), whole (whether the rest takes all of it), h_cut and h_last (which documents it takes of the block in
    which it ends) and shards (of the block's draws, in turn). levels: of the tree; as many as SHARD_WORDS asks for."""
    sources = materialize(targets(sizes), "mixing-sources")
    if levels is None:
        levels = max(0, math.ceil(math.log2(max(1, sources.agg(F.sum("source_size")).first()[0] or 0) / SHARD_WORDS)))
    of = sources.select(F.col("source").alias("s"), "n_blocks")
    dealt = sizes.join(of, _same("source", "s")).select("source", _block().alias("block"), "size", "h")
    place_hash = _hash("source", "block")
    sums = dealt.groupBy("source", "block").agg(F.sum("size").alias("words")).select("*", place_hash.alias("p"), F.shiftrightunsigned(place_hash, 64 - RANGES_BITS).alias("r"))
    sums = materialize(sums, "mixing-sums")
    # one row a range: at most 1 << RANGES_BITS rows a source
    ranges = sums.groupBy(F.col("source").alias("rs"), F.col("r").alias("rr")).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    own, upto = Window.partitionBy("rs"), Window.partitionBy("rs").orderBy("rr")
    ranges = ranges.select("rs", "rr", F.sum("n").over(own).alias("n_own"), (F.sum("n").over(upto) - F.col("n")).alias("n_before"), (F.sum("w").over(upto) - F.col("w")).alias("w_before"))
    ranges = ranges.join(sources.drop("n_blocks"), _same("rs", "source")).drop("source")
    line = Window.partitionBy("source", "r").orderBy("p", "block")
    there = sums.join(ranges, _same("source", "rs") & (F.col("r") == F.col("rr")))
    there = there.withColumn("place", F.col("n_before") + F.row_number().over(line) - 1).withColumn("before", F.col("w_before") + F.sum("words").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    cut = F.col("rest") - F.col("before")
    blocks = materialize(
        there.select(
            "source", "block", "place", "n_own", "source_size", "target", "passes", cut.alias("cut"),
            ((F.col("words") > 0) & (cut >= F.col("words"))).alias("whole"), ((cut > 0) & (cut < F.col("words"))).alias("ends_here"),
        ),
        "mixing-blocks",
    )
    quotas = blocks.groupBy("source").agg((F.max("passes") * F.count(F.lit(1)) + F.count(F.when(F.col("whole") | F.col("ends_here"), 1))).alias("quota"))
    # a run stands at each stretch of places that it meets
    stretch = lambda at: F.floor(at / STRETCH).cast("long")
    runs = splitting_tree(quotas, levels).select(F.col("source").alias("rs"), "shard", "begin", "end", F.explode(F.sequence(stretch(F.col("begin")), stretch(F.col("end") - 1))).alias("rk"))
    drawn = F.col("passes") + (F.col("whole") | F.col("ends_here")).cast("long")
    copies = blocks.filter(drawn > 0).select("source", "block", "n_own", "place", F.explode(F.sequence(F.lit(0).cast("long"), drawn - 1)).alias("copy"))
    copies = copies.select("source", "block", (F.col("copy") * F.col("n_own") + F.col("place")).alias("at")).withColumn("k", stretch(F.col("at")))
    met = copies.join(runs, _same("source", "rs") & (F.col("k") == F.col("rk")) & (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end")))
    shards = met.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "shard"))), lambda x: x["shard"]).alias("shards"))
    shards = shards.select(F.col("source").alias("ss"), F.col("block").alias("sb"), "shards")

    # the block in which the rest of a source ends: documents by hash while they fit, then the one nearest to the gap
    last = blocks.filter("ends_here").select(F.col("source").alias("s"), F.col("block").alias("b"), "cut")
    inside = dealt.join(last, _same("source", "s") & (F.col("block") == F.col("b")))
    upto = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("source", "block").orderBy("h")))
    fit = upto.withColumn("gap", F.col("cut") - F.max(F.when(F.col("upto") <= F.col("cut"), F.col("upto")).otherwise(0)).over(Window.partitionBy("source", "block")))
    better = (F.col("upto") > F.col("cut")) & (F.col("size") < F.col("gap") * 2)
    ends = fit.groupBy("source", "block").agg(
        F.max(F.when(F.col("upto") <= F.col("cut"), F.col("h"))).alias("h_cut"),
        F.min(F.when(better, F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), "h"))).alias("near"),
    )
    ends = ends.select(F.col("source").alias("es"), F.col("block").alias("eb"), "h_cut", F.col("near.h").alias("h_last"))
    joined = blocks.join(shards, _same("source", "ss") & (F.col("block") == F.col("sb")), "left").join(ends, _same("source", "es") & (F.col("block") == F.col("eb")), "left")
    return materialize(
        joined.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "passes", "whole", "h_cut", "h_last", F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards")),
        "mixing-draws",
    )


def mixture(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", levels: int | None = None) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target`` (its source's), ``times`` (how often the mix takes it), ``taken``
    (words, repeats counted) and ``shards`` (where its copies go).

    The last join brings each document to its block; blocks are bounded, so a hot source is spread over them.
    """
    own = without(docs, *ADDED)
    names = [F.col(f"`{c}`") for c in own.columns]
    sizes = materialize(sized(docs, id_column, text, source), "mixing-sizes")
    blocks = draws(sizes, levels)
    counts = blocks.groupBy("s").agg(F.max("source_size").alias("source_size")).select(
        F.col("s").alias("ns"), F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1)).cast("long").alias("n_blocks")
    )
    t = text_of(text)
    keyed = own.select("*", n_words(t).alias("size"), _hash(F.col(id_column), F.xxhash64(t)).alias("h"))
    keyed = keyed.join(counts, F.col(source).eqNullSafe(F.col("ns"))).withColumn("__block", _block())
    met = keyed.join(blocks, F.col(source).eqNullSafe(F.col("s")) & (F.col("__block") == F.col("b")))
    more = F.col("whole") | F.coalesce(F.col("h") <= F.col("h_cut"), F.lit(False)) | F.coalesce(F.col("h") == F.col("h_last"), F.lit(False))
    times = F.col("passes") + more.cast("long")
    return met.select(*names, "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), F.slice("shards", 1, times.cast("int")).alias("shards"), "h")


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", levels: int | None = None) -> DataFrame:
    """The mixed documents themselves: the columns of docs and ``shard``, a row for each copy that the mix takes. A
    shard lies in one partition, shuffled by hash."""
    own = without(docs, *ADDED, "shard")
    names = [F.col(f"`{c}`") for c in own.columns]
    rows = mixture(own, id_column, text, source, levels).select(*names, "h", F.posexplode("shards").alias("copy", "shard"))
    return rows.repartition("shard").sortWithinPartitions("shard", _hash("shard", "copy", "h")).select(*names, "shard")
