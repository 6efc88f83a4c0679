"""Training of a classifier's multipliers: a subject that was predicted wrongly loses, the one that was right gains.

Scores of a document by subject are its evidence times the subject's multiplier. In each epoch the predictions are made with the
multipliers of the epoch before; their mistakes are counted by subject, and the counts, a row a subject, move the multipliers,
which stay within bounds. Counts are whole numbers, so results don't depend on partitions.

Evidence stands in one row a document, as long as there are subjects, so an epoch is a pass over it without a shuffle of
documents.

Defined results: a document without evidence, or without an expected subject, is left out; ties go to the first name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the platform's rules.
LEARNING_RATE, GAIN, LOWEST, HIGHEST = 0.05, 1.5, 0.4, 2.5
WEIGHTS = {"subject": 0.45, "category": 0.25, "spoof": 0.20, "questions": 0.10}


@dataclass(frozen=True)
class Epoch:
    """What an epoch found with the multipliers before it, and what it made of them."""

    number: int
    accuracy: float
    loss: float
    adjustments: int
    multipliers: dict[str, float]


def evidence_rows(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, target, scores map<subject, score>) from (id, subject, score) and (id, target)."""
    wide = scores.filter("score > 0").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subject", "score")))).alias("scores"))
    return wide.join(expected.filter("target IS NOT NULL"), "id").select("id", "target", "scores")


def predicted(multipliers: dict[str, float]) -> Column:
    """The subject with the highest score under the multipliers."""
    own = F.create_map(*[F.lit(x) for pair in sorted(multipliers.items()) for x in pair]) if multipliers else F.create_map().cast("map<string, double>")
    of = F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"] * F.coalesce(F.try_element_at(own, e["key"]), F.lit(1.0))).alias("s"), e["key"].alias("subject")))
    return F.array_min(of)["subject"]


def train(rows: DataFrame, epochs: int, rate: float = LEARNING_RATE, per: float = 1.0, other_accuracy: dict[str, float] | None = None) -> list[Epoch]:
    """The epochs of a training on evidence rows: rate a mistake, or a mistake in per documents. other_accuracy has the shares of the
    other aims that the loss weighs (category, spoof, questions), 1 each by default."""
    aims = {k: 1.0 for k in WEIGHTS if k != "subject"} | (other_accuracy or {})
    multipliers: dict[str, float] = {}
    history = []
    for number in range(1, epochs + 1):
        counted = rows.select(predicted(multipliers).alias("got"), "target").groupBy("got", "target").agg(F.count(F.lit(1)).alias("n")).collect()
        total = sum(r["n"] for r in counted)
        wrong, missed, right = {}, {}, 0
        for got, target, n in counted:
            if got == target:
                right += n
            else:
                wrong[got] = wrong.get(got, 0) + n
                missed[target] = missed.get(target, 0) + n
        moved = {s: multipliers.get(s, 1.0) + rate * (GAIN * missed.get(s, 0) - wrong.get(s, 0)) / per for s in {*multipliers, *wrong, *missed}}
        multipliers = {s: min(HIGHEST, max(LOWEST, m)) for s, m in sorted(moved.items())}
        accuracy = right / total if total else 0.0
        loss = 1.0 - WEIGHTS["subject"] * accuracy - sum(WEIGHTS[k] * v for k, v in aims.items())
        history.append(Epoch(number, accuracy, loss, total - right, multipliers))
    return history
