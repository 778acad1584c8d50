"""Problem 6: a varied subset by concave feature coverage.

A record has weighted features; the value of a subset is the sum over features of the square root of the mass selected, so that each
further record of a large group adds less. Records are added in rounds of a descending threshold. In a round every partition passes over
its records that are left, with the masses so far, and adds those whose marginal gain reaches the threshold, counting in what it added
itself; the additions of all partitions are merged by passing over them the same way, FAN_IN partitions in a task, level by level, until one
is left, which sees at most FAN_IN times the wanted number, one batch at a time. Only features of selected records have mass: their 64-bit
hashes, sorted, and their masses are the one thing that is broadcast, and with the ids of the selected the one thing that reaches the driver.
A record's gain never exceeds that of being chosen first, so records below the threshold by that bound are left in their files.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.shared import stored

#: Length of a vector of masses that `gain` can take where features are small numbers.
SLOTS = 1 << 16
#: Each round's threshold is this part of the last one's.
STEP = 0.75
#: Partitions whose additions one task merges.
FAN_IN = 16
#: Features travel as the bytes of 64-bit numbers and 32-bit weights, which are read as one array per batch.
RECORD = "rec_id long, slots binary, weights binary"
RECORD_COLUMNS = ["rec_id", "slots", "weights"]
SELECTED = "rec_id long, gain double, slots array<long>, masses array<double>"


def text_features(group: Column, text: str, gram: int = 4, group_weight: float = 0.5) -> tuple[Column, Column]:
    """(slots, weights): the group of a record with group_weight, and the distinct runs of `gram` characters of its text with the rest in
    equal parts. A null group is a group of its own kind; a short text is one run."""
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - gram + 1)), lambda i: F.substr(F.col(text), i, F.lit(gram))))
    slot = lambda kind, x: F.xxhash64(F.lit(kind), x)
    slots = F.concat(F.array(slot("group", F.coalesce(group, F.lit("")))), F.transform(runs, lambda r: slot("run", r)))
    equal = F.transform(F.array(F.size(runs)), lambda n: F.array_repeat((1 - group_weight) / n, n))[0]  # the runs are made once
    weights = F.concat(F.array(F.lit(group_weight)), equal).cast("array<float>")
    return slots, weights


class Masses:
    """The mass of each feature that has any: sorted features and their masses, looked up by binary search, and what was added since."""

    def __init__(self, features: np.ndarray, masses: np.ndarray):
        self.features, self.masses, self.added = features, masses, {}

    @classmethod
    def none(cls) -> Masses:
        return cls(np.zeros(0, np.int64), np.zeros(0))

    def copy(self) -> Masses:
        out = Masses(self.features, self.masses)
        out.added = dict(self.added)
        return out

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        now = np.zeros(len(slots))
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, slots), len(self.features) - 1)
            now = np.where(self.features[at] == slots, self.masses[at], 0.0)
        if self.added:
            now = now + np.fromiter((self.added.get(s, 0.0) for s in slots.tolist()), np.float64, len(slots))
        return now

    def add(self, slots: np.ndarray, weights: np.ndarray) -> None:
        for s, w in zip(slots.tolist(), weights.tolist()):
            self.added[s] = self.added.get(s, 0.0) + w

    def settled(self) -> Masses:
        """The same with what was added sorted in."""
        features = np.concatenate((self.features, np.fromiter(self.added, np.int64, len(self.added))))
        masses = np.concatenate((self.masses, np.fromiter(self.added.values(), np.float64, len(self.added))))
        features, at = np.unique(features, return_inverse=True)
        return Masses(features, np.bincount(at, masses, len(features)))


def gain(mass: Masses | np.ndarray, slots: np.ndarray, weights: np.ndarray) -> float:
    now = mass[slots]
    return float((np.sqrt(now + weights) - np.sqrt(now)).sum())


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records with features, as bytes, and the gain of each if it is chosen first. Here, because each use of a column that is made by
    functions of arrays computes it anew."""
    for batch in batches:
        batch = batch[[x is not None and len(x) > 0 for x in batch["slots"]]]
        weights = [np.asarray(x, np.float32) for x in batch["weights"]]
        yield pd.DataFrame({
            "rec_id": batch["rec_id"], "slots": [np.asarray(x, np.int64).tobytes() for x in batch["slots"]], "weights": [x.tobytes() for x in weights],
            "top": [float(np.sqrt(x.astype(np.float64)).sum()) for x in weights],
        })


def _round(shared, threshold: float, wanted: int, last: bool = False):
    """mapInPandas: the records that a pass over a partition adds at this threshold. The last pass gives their gains instead of their
    features, and at its end a row of all features that got mass, without an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass, added, taken = shared.value.copy(), Masses.none(), 0
        for batch in batches:
            if taken >= wanted:
                break
            if len(mass.added) > len(mass.features) // 8:
                mass = mass.settled()
            slots, weights = batch["slots"].tolist(), batch["weights"].tolist()
            flat, w = np.frombuffer(b"".join(slots), np.int64), np.frombuffer(b"".join(weights), np.float32).astype(np.float64)
            ends = np.cumsum([len(s) // 8 for s in slots])
            starts = np.concatenate(([0], ends[:-1]))
            now = mass[flat]
            gains = np.add.reduceat(np.sqrt(now + w) - np.sqrt(now), starts)
            picked, won = [], []
            for i in np.argsort(-gains, kind="stable"):
                if gains[i] < threshold or taken >= wanted:  # gains only fall, so the rest is below too
                    break
                own, its = flat[starts[i] : ends[i]], w[starts[i] : ends[i]]
                more = gain(mass, own, its)
                if more >= threshold:
                    mass.add(own, its)
                    picked.append(i)
                    won.append(more)
                    taken += 1
                    if last:
                        added.add(own, its)
            if not last:
                yield batch.iloc[picked][RECORD_COLUMNS]
            elif picked:
                yield pd.DataFrame({"rec_id": batch["rec_id"].to_numpy()[picked], "gain": won, "slots": [[]] * len(picked), "masses": [[]] * len(picked)})
        if added.added:
            yield pd.DataFrame({"rec_id": pd.array([None], "Int64"), "gain": [0.0], "slots": [list(added.added)], "masses": [list(added.added.values())]})

    return run


def varied_subset(records: DataFrame, wanted: int, step: float = STEP, least: float = 1e-3) -> DataFrame:
    """(rec_id, place, gain): `wanted` records (rec_id unique, slots, weights), or all if there are fewer; place counts from 1 in the
    order of selection, gain is the marginal gain at that place.

    The threshold starts at the largest gain of a single record and falls by `step` a round; below `least` times the start it is 0, so the
    last round fills up. A record that was passed over at a threshold stays in for the next ones. Records without features gain nothing
    and are selected last. Ties go by rec_id within a partition, so that runs agree. Empty input gives no rows. The ids and gains of `wanted`
    rows and the different features that they hold reach the driver, nothing else does.
    """
    spark = records.sparkSession
    kept = records.select("rec_id", "slots", "weights").mapInPandas(_pack, f"{RECORD}, top double").repartition("rec_id").sortWithinPartitions("rec_id")
    kept = stored(kept, "features")
    start = kept.agg(F.max("top")).collect()[0][0]
    mass, selected = Masses.none(), []
    threshold = start or 0.0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # of the stored features; a merge too many or too few does no harm
    while start and len(selected) < wanted:
        shared, left = spark.sparkContext.broadcast(mass), wanted - len(selected)
        chosen = spark.createDataFrame([(r[0],) for r in selected], "rec_id long")  # at most `wanted` rows
        rest = kept.where(F.col("top") >= threshold).drop("top")
        rest = rest.join(F.broadcast(chosen), "rec_id", "left_anti") if selected else rest
        found, tasks = rest.mapInPandas(_round(shared, threshold, left), RECORD), parts
        while tasks > 1:
            tasks = ceil(tasks / FAN_IN)
            found = found.repartition(tasks, "rec_id").sortWithinPartitions("rec_id")
            found = found.mapInPandas(_round(shared, threshold, left), RECORD) if tasks > 1 else found
        found = found.coalesce(1).mapInPandas(_round(shared, threshold, left, last=True), SELECTED).collect()  # at most `wanted` rows
        shared.destroy()
        for r in found:
            if r.rec_id is None:
                mass.add(np.array(r.slots, np.int64), np.array(r.masses))
            else:
                selected.append((r.rec_id, r.gain))
        mass = mass.settled()
        if threshold == 0 and sum(r.rec_id is not None for r in found) < left:
            break
        threshold = threshold * step if threshold * step > least * start else 0.0
    rows = [(i, k + 1, g) for k, (i, g) in enumerate(selected)]
    out = spark.createDataFrame(rows, "rec_id long, place long, gain double")
    if len(selected) < wanted:
        bare = records.where((F.size("slots") <= 0) | F.col("slots").isNull()).select("rec_id").orderBy("rec_id").limit(wanted - len(selected))
        names = [r.rec_id for r in bare.collect()]
        out = out.unionByName(spark.createDataFrame([(i, len(rows) + k + 1, 0.0) for k, i in enumerate(names)], "rec_id long, place long, gain double"))
    return out
