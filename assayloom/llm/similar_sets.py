"""Problem 5: all pairs of set-valued records above a Jaccard threshold, by T-occurrence list merging over partitioned inverted lists.

Records with the same set are one class. Tokens are numbered by rarity, so that a set is an ascending array of small numbers. A similar pair
overlaps by at least t times the larger size, so a token that both hold is among the first n - ceil(t n) + 1 of the larger, and among the
first n - ceil(2 t n / (1 + t)) + 1 of the smaller. Each of these tokens is a partition of the inverted lists: only records that hold it are
in its lists. In a partition the records come by size, each one probing the lists of those before it:

* its longest lists are set aside; at most IN_SHORT_LISTS occurrences must then be in the short ones,
* the short lists are merged by skips: the record that the heap of the lists' fronts would reach after need - 1 pops is the first that can
  still have `need` occurrences, and every list in front of it jumps there by binary search,
* candidates are looked up in the long lists by binary search until they reach the required overlap or cannot any more.

All probes of a partition take these steps together, as arrays: the fronts of a probe's lists are a row, ordered in each step. A pair is
emitted in the partition of its first shared token. A partition beyond BLOCK records is split by one more shared token, again and again
while the overlap asked for allows it; what cannot be split so is compared in pairs of blocks, so that no task holds more than 2 BLOCK
records of one partition at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.spans import expanded
from assayloom.operators.ranking import ranked
from assayloom.operators.skew import salted_lookup, whole_groups, within_groups
from assayloom.shared import stored

BLOCK = 4_000
#: Shared tokens by which a partition is split at most; beyond, blocks do.
DEEPEST = 8
#: Occurrences that the merge must find; the rest of the required overlap is looked up in the longest lists.
IN_SHORT_LISTS = 4
#: Numbers of different tokens that are broadcast (with their frequency, to be numbered); more are numbered and looked up by shuffles.
VOCABULARY = 2_000_000
FAR = np.iinfo(np.int64).max


def required(n, t: Fraction):
    """ceil(t * n)"""
    return -(-n * t.numerator // t.denominator)


def merge_skip(lists: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.ndarray, low: np.ndarray, need: np.ndarray) -> tuple:
    """(probe, value, count) of the values that are at least low[probe] and in at least need[probe] of its lists.

    lists: all lists one after the other, ascending as a whole: a list's elements are base + value. begin, end, base: one row per probe, one
    column per list; a list that a probe does not have begins at its end.
    """
    probe = np.arange(len(low))
    padded = np.append(lists, FAR)
    at = np.maximum(begin, np.searchsorted(lists, base + low[:, None]))
    fronts = np.where(at < end, padded[np.minimum(at, len(lists))] - base, FAR)
    found = []
    while len(probe):
        ordered = np.sort(fronts, axis=1)
        reached = ordered[np.arange(len(probe)), need - 1]
        alive = reached < FAR
        if np.count_nonzero(alive) < 0.8 * len(probe):
            probe, fronts, at, end, base, need, ordered, reached = (x[alive] for x in (probe, fronts, at, end, base, need, ordered, reached))
            alive = np.ones(len(probe), bool)
        elif not alive.any():
            break
        hit = (ordered[:, 0] == reached) & alive
        if hit.any():
            found.append((probe[hit], reached[hit], (fronts[hit] == reached[hit, None]).sum(axis=1)))
        ahead = np.where(alive, reached + hit, -1)
        flat = np.flatnonzero(fronts < ahead[:, None])
        row = flat // fronts.shape[1]
        wanted, stop = base.ravel()[flat] + ahead[row], end.ravel()[flat]
        to = at.ravel()[flat] + 1
        value = padded[to]
        beyond = np.flatnonzero((value < wanted) & (to < stop))  # mostly the next one is reached
        to[beyond] = np.searchsorted(lists, wanted[beyond])
        at.ravel()[flat] = to
        fronts.ravel()[flat] = np.where(to < stop, padded[np.minimum(to, len(lists))] - base.ravel()[flat], FAR)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(map(np.concatenate, zip(*found)))


def _part(name: str) -> tuple[int, int, bool, bool]:
    """(last token, number of tokens, no more overlap is asked, two blocks) of a partition."""
    key, kind, blocks = name.split("|")
    low, high = blocks.split("-")
    tokens = key.split(",")
    return int(tokens[-1]), len(tokens), kind == "s", low != high


def _places(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): for each i, n[i] places from first[i] on."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def similar_rows(frame: pd.DataFrame, t: Fraction) -> pd.DataFrame:
    """Pairs of whole partitions. frame: part, class, side, block, tokens, in the order of part and number of tokens."""
    part, tokens = frame["part"].to_numpy(), frame["tokens"].to_list()
    starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    group = np.zeros(len(part), np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    last, shared, closed, apart = (np.array(x)[group] for x in zip(*map(_part, part[starts])))
    n = np.array([len(x) for x in tokens])
    rows, owner = np.arange(len(n)), np.repeat(np.arange(len(n)), n)
    flat = np.concatenate(tokens).astype(np.int64)
    if flat.max() >= 1 << 20:
        kept = np.unique(np.concatenate((flat, last)))  # numbers within the frame, in the same order
        flat, last = np.searchsorted(kept, flat), np.searchsorted(kept, last)
    width = int(flat.max()) + 1
    later = flat > last[owner]
    place = n - np.bincount(owner[later], minlength=len(n))  # of the partition's token, from 1
    need = required(n, t) - shared
    probes = np.where(closed, need == 0, need >= 0)
    indexed = place <= n + shared - required(2 * n, t / (1 + t))
    bound = int(n.max()) + 1
    low = np.searchsorted(group * bound + n, group * bound + required(n, t))  # the smallest that can be similar

    # Inverted lists of the indexed records, one after the other; each probe's part of a list ends where it would stand itself.
    listed = (group[owner[later]] * width + flat[later]) * len(n)
    order = np.argsort(listed + owner[later])
    el_owner, el_list = owner[later][order], listed[order]
    inside = indexed[el_owner]
    lists = (el_list + el_owner)[inside]
    end = np.cumsum(inside) - inside
    new = np.concatenate(([True], el_list[1:] != el_list[:-1])) if len(el_list) else np.zeros(0, bool)
    begin = end[np.flatnonzero(new)][np.cumsum(new) - 1] if len(el_list) else end
    has = (end > begin) & probes[el_owner]
    k = np.bincount(el_owner[has], minlength=len(n))
    active = probes & (k >= need)
    has = np.flatnonzero(has & active[el_owner])
    length = end[has] - begin[has]
    has = has[np.argsort(el_owner[has] * (int(length.max(initial=0)) + 1) + length)]  # each probe's lists from the shortest to the longest
    k = np.where(active, k, 0)
    first = np.cumsum(k) - k
    short = np.where(need > 0, k - need + np.minimum(need, IN_SHORT_LISTS), 0)

    merging = np.flatnonzero(active & (need > 0))
    which, at = _places(first[merging], short[merging])
    column = at - first[merging][which]
    shape = (len(merging), int(short[merging].max(initial=0)))
    b, e, base = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    b[which, column], e[which, column], base[which, column] = begin[has[at]], end[has[at]], el_list[has[at]]
    i, j, count = merge_skip(lists, b, e, base, low[merging], np.minimum(need, IN_SHORT_LISTS)[merging])
    i = merging[i]
    enough = np.flatnonzero(active & (need == 0))  # what is shared already is enough: all before it are candidates
    which, at = _places(low[enough], np.maximum(enough - low[enough], 0))
    which, at = which[indexed[at]], at[indexed[at]]
    i, j, count = np.concatenate((i, enough[which])), np.concatenate((j, at)), np.concatenate((count, np.zeros(len(at), np.int64)))

    overlap = required(n[i] + n[j], t / (1 + t)) - shared[i]  # of the later tokens
    left, looked, done = (k - short)[i], 0, []
    while len(i):
        can = count + left >= overlap
        ends = can & (left == 0)
        done.append((i[ends], j[ends], count[ends]))
        on = can & (left > 0)
        i, j, count, overlap, left = i[on], j[on], count[on], overlap[on], left[on]
        if not len(i):
            break
        wanted = el_list[has[(first + short)[i] + looked]] + j
        at = np.minimum(np.searchsorted(lists, wanted), len(lists) - 1)
        count = count + (lists[at] == wanted)
        left, looked = left - 1, looked + 1
    if not done:
        return pd.DataFrame(columns=["class_a", "class_b", "overlap", "either"], dtype=np.int64)
    i, j, count = map(np.concatenate, zip(*done))

    # The partition's tokens must be all that a pair shares up to there; else the pair belongs to another one.
    early, start = owner * width + flat, np.cumsum(n) - n
    which, at = _places(start[i], place[i])
    wanted = j[which] * width + flat[at]
    both = np.bincount(which[early[np.minimum(np.searchsorted(early, wanted), len(early) - 1)] == wanted], minlength=len(i))
    side, block = frame["side"].to_numpy(), frame["block"].to_numpy()
    ok = (both == shared[i]) & (((side[i] & 1) & (side[j] >> 1)) | ((side[i] >> 1) & (side[j] & 1))).astype(bool) & ~(apart[i] & (block[i] == block[j]))
    i, j, count = i[ok], j[ok], count[ok] + shared[i[ok]]
    own = frame["class"].to_numpy()
    return pd.DataFrame({"class_a": np.minimum(own[i], own[j]), "class_b": np.maximum(own[i], own[j]), "overlap": count, "either": n[i] + n[j] - count})


def _merge(t: Fraction):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["part"]):
            yield similar_rows(frame, t)

    return run


def _numbered(classes: DataFrame) -> DataFrame:
    """(class, side, tokens): the tokens as ascending numbers, the rarest token first."""
    exploded = classes.select("class", F.explode("tokens").alias("token"))
    frequent = stored(exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n_rows")), "tokens")
    n = frequent.count()
    kind = "smallint" if n < 1 << 15 else "int" if n < 1 << 31 else "bigint"
    if n > VOCABULARY:
        numbers = ranked(frequent, {"n_rows": False, "token": False}, "number").select("token", "n_rows", F.col("number").cast(kind).alias("number"))
        own = salted_lookup(exploded, numbers, "token", "class").groupBy("class").agg(F.sort_array(F.collect_list("number")).alias("tokens"))  # of one set
        return own.join(classes.select("class", "side"), "class").select("class", "side", "tokens")
    order = frequent.toPandas().sort_values(["n_rows", "token"])["token"]  # at most VOCABULARY rows
    shared = classes.sparkSession.sparkContext.broadcast(order.to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = pd.Index(shared.value)
        for batch in batches:
            sizes = np.array([len(x) for x in batch["tokens"]])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            numbers = index.get_indexer(np.concatenate(batch["tokens"].to_list()))
            numbers = numbers[np.lexsort((numbers, owner))]
            yield batch.assign(tokens=np.split(numbers, np.cumsum(sizes)[:-1]))

    return classes.select("class", "side", "tokens").mapInPandas(run, f"class long, side int, tokens array<{kind}>")


def _required(t: Fraction, shared: str | int = 0) -> Column:
    return F.expr(f"(size(tokens) * {t.numerator}L + {t.denominator - 1}L) div {t.denominator}L")


def _longer(placed: DataFrame, t: Fraction) -> DataFrame:
    """Records of partitions that are split by one more shared token. Records of which no more overlap may be asked stay as well."""
    most = (F.size("tokens") - _required(t) + F.col("shared") + 1).cast("int")
    more = F.explode(F.filter(F.slice("tokens", F.lit(1), F.least(most, F.size("tokens"))), lambda x: x > F.col("last")))
    deeper = placed.withColumn("last", more).withColumn("key", F.concat_ws(",", "key", "last")).withColumn("shared", F.col("shared") + 1)
    return deeper.unionByName(placed.where(_required(t) <= F.col("shared")).withColumn("closed", F.lit(True)))


def _placed(ordered: DataFrame, t: Fraction, depth: int) -> DataFrame:
    """(class, side, block, tokens, part): each record once for each partition of the inverted lists that it is in."""
    prefix = F.slice("tokens", F.lit(1), (F.size("tokens") - _required(t) + 1).cast("int"))
    level = ordered.withColumn("last", F.explode(prefix)).withColumn("key", F.col("last").cast("string"))
    level = level.withColumn("shared", F.lit(1)).withColumn("closed", F.lit(False))
    small, whole = [], []
    for d in range(1, DEEPEST + 1):
        if d < depth:
            level = _longer(level.where(~F.col("closed")), t).unionByName(level.where("closed"))
            continue
        counts = level.where(~F.col("closed")).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > BLOCK)
        counts = stored(counts.select("key"), "large")
        n = counts.count()
        if not n:
            break
        marks = counts.withColumn("large", F.lit(True))
        marked = level.join(F.broadcast(marks) if n <= VOCABULARY else marks, "key", "left").withColumn("large", F.coalesce("large", F.lit(False)) & ~F.col("closed"))
        small.append(marked.where(~F.col("large") & ~F.col("closed")).drop("large"))
        whole.append(marked.where("closed").drop("large"))
        level = marked.where("large").drop("large")
        if d == DEEPEST:
            break
        level = stored(_longer(level, t), "longer")
    whole += [level] if small or depth > 1 else []
    small += [] if small or depth > 1 else [level]
    blocks = [level.withColumn("blocks", F.lit(1)) for level in small]
    if whole:  # what cannot be split any more
        rest = reduce(DataFrame.unionByName, whole)
        counts = rest.groupBy("key", "closed").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
        blocks.append(rest.join(counts, ["key", "closed"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))
    placed = reduce(DataFrame.unionByName, blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws("-", F.least("_b", "block"), F.greatest("_b", "block"))
    return placed.select("class", "side", "block", "tokens", F.concat_ws("|", "key", F.when(F.col("closed"), "s").otherwise("-"), pair).alias("part"))


def similar_classes(sets: DataFrame, threshold: float, other: DataFrame | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pairs, members). sets, other: (rec_id, tokens), an array of distinct values of one type without nulls.

    members: (class, rec_id, side, n_rows), one row per record with a token; class is the least rec_id of the n_rows records of that set.
    pairs: class_a < class_b, overlap, either, for all pairs of different sets with overlap / either >= threshold (exactly, the limit
    included); with `other`, of a set of the first table and one of the second. Null and empty sets are in neither. Repeated records share a
    class. depth: shared tokens by which the lists are partitioned at once. The threshold is taken as a fraction of a million at most.
    """
    t = Fraction(threshold).limit_denominator(10**6)
    if not 0 < t <= 1 or abs(t - Fraction(threshold)) > 1e-12:
        raise ValueError("the threshold must be above 0 and at most 1, and a fraction of a million at most")
    rows = sets.select("rec_id", "tokens", F.lit(3 if other is None else 1).alias("side"))
    if other is not None:
        rows = rows.unionByName(other.select("rec_id", "tokens", F.lit(2).alias("side")))
    rows = stored(rows.where(F.size("tokens") > 0).withColumn("tokens", F.sort_array("tokens")), "rows")  # read twice
    classes = rows.groupBy("tokens").agg(F.min("rec_id").alias("class"), F.bit_or("side").alias("side"), F.count(F.lit(1)).alias("n_rows"))
    if other is not None:  # ids of two tables can be equal: classes are numbered anew
        classes = classes.withColumn("class", F.monotonically_increasing_id())
    classes = stored(classes, "sets")
    members = salted_lookup(rows, classes.drop("side"), "tokens", "rec_id").select("class", "rec_id", "side", "n_rows")
    ordered = stored(_numbered(classes), "ordered")
    tasks = _placed(ordered, t, depth).repartition("part").sortWithinPartitions("part", F.size("tokens"), "class")
    return tasks.mapInPandas(_merge(t), "class_a long, class_b long, overlap long, either long"), members


def similar_pairs(sets: DataFrame, threshold: float, depth: int = 1) -> DataFrame:
    """(rec_id_a, rec_id_b, similarity), rec_id_a < rec_id_b: all pairs of records of one table, those of equal sets included. Records of one
    set are expanded last, spread by their number."""
    pairs, members = similar_classes(sets, threshold, None, depth)
    copies = stored(members.where("n_rows > 1").select(F.col("class").alias("first"), F.col("rec_id").alias("doc_id"), "n_rows"), "copies")
    counts = copies.groupBy("first").agg(F.max("n_rows").alias("n_rows"))
    across = pairs.withColumn("similarity", F.col("overlap") / F.col("either"))
    for x in ("class_a", "class_b"):
        across = expanded(across, copies, counts, x)
    across = across.select(F.least("class_a", "class_b").alias("rec_id_a"), F.greatest("class_a", "class_b").alias("rec_id_b"), "similarity")
    same = within_groups(copies, "first", "doc_id", "n_rows").select(F.col("item_a").alias("rec_id_a"), F.col("item_b").alias("rec_id_b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(same)


def pairs_between(sets: DataFrame, other: DataFrame, threshold: float, depth: int = 1) -> DataFrame:
    """(rec_id_a, rec_id_b, similarity): all similar pairs of a record of the first table and one of the second."""
    pairs, members = similar_classes(sets, threshold, other, depth)
    members = stored(members, "members")
    pairs = stored(pairs, "pairs").withColumn("similarity", F.col("overlap") / F.col("either")).select("class_a", "class_b", "similarity")
    turned = pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "similarity")
    out = pairs.unionByName(turned).unionByName(members.select(F.col("class").alias("class_a"), F.col("class").alias("class_b")).distinct().withColumn("similarity", F.lit(1.0)))
    for side, x in ((1, "class_a"), (2, "class_b")):
        own = members.where(F.col("side") == side).select(F.col("class").alias("first"), F.col("rec_id").alias("doc_id"), "n_rows")
        counts = own.groupBy("first").agg(F.max("n_rows").alias("n_rows"))
        out = expanded(out, own, counts, x, lone=False)
    return out.select(F.col("class_a").alias("rec_id_a"), F.col("class_b").alias("rec_id_b"), "similarity")
