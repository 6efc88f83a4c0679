"""Near copies by SimHash, layered duplicate look-up, n-gram similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the six blocks of a fingerprint: at most three differing bits leave three blocks equal.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def near_fingerprints(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, distance) of different fingerprints (column fp) at most 3 bits apart.

    Fingerprints are distinct first, so copies cost nothing. Each goes to the 20 choices of three of its six blocks,
    keys of 32 or 33 bits; pairs that share a key are verified, so none is missed and few are looked at in vain.
    The rows of keys are never broadcast: Spark guesses their size from the fingerprints, of which they are 20 times as many.
    """
    if most > 3:
        raise ValueError("six blocks find up to 3 differing bits")
    part = lambda i: F.shiftrightunsigned("fp", BLOCKS[i][0]).bitwiseAND((1 << BLOCKS[i][1]) - 1)
    keys = [F.struct(F.lit(n).alias("n"), part(i).alias("x"), part(j).alias("y"), part(k).alias("z")) for n, (i, j, k) in enumerate(combinations(range(6), 3))]
    rows = prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("key")).select("key.*", "fp")
    other = rows.select("n", "x", "y", "z", F.col("fp").alias("b"))
    met = rows.withColumnRenamed("fp", "a").join(other.hint("merge"), ["n", "x", "y", "z"]).filter("a < b")
    return met.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).filter(F.col("distance") <= most).select("a", "b", "distance").distinct()


def duplicate_layers(new: DataFrame, archive: DataFrame) -> DataFrame:
    """(item, layer, match) for items of ``new`` found in the archive: 1 by file hash, 2 by content hash, 3 by name and
    size; the first layer wins, and in it the smallest id. Both have file_hash, content_hash, name, size."""
    layers = ((1, ["file_hash"]), (2, ["content_hash"]), (3, ["name", "size"]))
    hits = []
    for n, keys in layers:
        first = archive.groupBy(*keys).agg(F.min("id").alias("match"))
        hits.append(new.join(first, keys).select("item", F.lit(n).alias("layer"), "match"))
    every = hits[0].unionAll(hits[1]).unionAll(hits[2])
    return every.groupBy("item").agg(F.min(F.struct("layer", "match")).alias("m")).select("item", "m.layer", "m.match")


def grams(words: Column, n: int = 3) -> Column:
    """Distinct n-grams of an array of words."""

    def of(ws: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(F.size(ws) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    # bound once a row: inside the inner lambda the words would be made anew for every n-gram
    return F.element_at(F.transform(F.array(words), of), 1)


def gram_similarity(items: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(item, doc, jaccard, containment) in percent, of pairs with an n-gram in common and a containment of
    ``least`` or more. Both have id and grams. Pairs come from an equi-join on the grams."""
    a = items.select(F.col("id").alias("item"), F.size("grams").alias("na"), F.explode("grams").alias("g"))
    b = docs.select(F.col("id").alias("doc"), F.size("grams").alias("nb"), F.explode("grams").alias("g"))
    met = b.join(a, "g").groupBy("item", "doc").agg(F.count(F.lit(1)).alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    jaccard = F.col("both") * 100.0 / (F.col("na") + F.col("nb") - F.col("both"))
    scored = met.select("item", "doc", F.round(jaccard, 6).alias("jaccard"), F.round(F.col("both") * 100.0 / F.col("na"), 6).alias("containment"))
    return scored.filter(F.col("containment") >= least)


def similar_names(rows: DataFrame, block: list[str], least: float, prefix: int | None = None) -> DataFrame:
    """(a, b, similarity) of different names (id, name) that share a block and are similar by edit distance. Names whose
    lengths alone forbid it are not compared. ``prefix`` compares that many characters at most; without it whole names.

    Each pair of different names of a block is compared once, however many rows have them; rows are matched to the pairs
    that are similar by block and name, so no key is a whole block.
    """
    from quillon.functions.text import levenshtein_similarity

    name = F.substring("name", 1, prefix) if prefix else F.col("name")
    every = rows.select(*block, F.col("id"), name.alias("name"))
    names = every.select(*block, "name").distinct()
    x, y = names.withColumnRenamed("name", "na"), names.withColumnRenamed("name", "nb")
    short, long = F.least(F.length("na"), F.length("nb")), F.greatest(F.length("na"), F.length("nb"))
    # the distance is the difference of the lengths at least; a little less, so that rounding loses none
    near = F.col("na") <= F.col("nb"), short >= long * (least - 1e-6)
    met = x.join(y, block).filter(near[0] & near[1]).withColumn("similarity", F.round(levenshtein_similarity(F.col("na"), F.col("nb")), 6))
    one = met.filter(F.col("similarity") >= least).select(*block, F.array("na", "nb").alias("n"), "similarity")
    # both orders, as the smaller id may have either name
    sides = F.array_distinct(F.array(F.struct(F.get("n", F.lit(0)).alias("na"), F.get("n", F.lit(1)).alias("nb")), F.struct(F.get("n", F.lit(1)).alias("na"), F.get("n", F.lit(0)).alias("nb"))))
    alike = one.select(*block, "similarity", F.explode(sides).alias("s")).select(*block, "s.na", "s.nb", "similarity")
    left = every.select(*block, F.col("id").alias("a"), F.col("name").alias("na"))
    right = every.select(*block, F.col("id").alias("b"), F.col("name").alias("nb"))
    halves = left.join(alike, [*block, "na"]).select(*block, "a", "nb", "similarity")
    return halves.join(right.hint("merge"), [*block, "nb"]).filter("a < b").select("a", "b", "similarity")
