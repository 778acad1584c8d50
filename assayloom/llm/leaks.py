"""Problem 8: passages of held-out items inside a corpus, by size-partitioned MinHash containment with an exact check.

Items are short, documents long and of very unequal size, so a document's MinHash says little about the items in it. Each text is therefore
taken as its windows of `passage` words, as sets of word shingles. The sets are partitioned by their size, the number of different shingles
(fewer where words repeat). A passage that is contained in a document equals one of its windows, so it is contained in a set of its own size
and of no other: within a size partition the bound on containment is a Jaccard similarity of 1, for which one band of one row of MinHash is
enough and never misses. A set's partition and MinHash make one key. Neighbouring windows mostly share their MinHash, so a text has few
distinct keys. Texts shorter than a window hold no passage; longer ones are never cut off. Windows whose key is also one of an item's are
candidates, and their words, hence all their shingles, are compared with the item's passage itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.characters import BASE, SECOND, Rolling, chunks, code_points, mixed, word_signs
from assayloom.operators.skew import salted_lookup
from assayloom.shared import stored

#: Items whose keys are more than this are matched by a join instead of a broadcast (8 bytes each).
BROADCAST_KEYS = 4_000_000
#: Passages of items whose words take more characters than this are joined by a shuffle instead of a broadcast.
BROADCAST_CHARS = 64_000_000


def set_sizes(shingles: np.ndarray, width: int) -> np.ndarray:
    """The number of different values among the `width` ones from each position on."""
    n = len(shingles) - width + 1
    since = np.full(len(shingles), width, np.int64)  # how far back the same value stands, if it is within reach
    for d in range(width - 1, 0, -1):
        since[d:][shingles[d:] == shingles[:-d]] = d
    if (since == width).all():
        return np.full(n, width, np.int64)
    return sum((since[j : j + n] > j).astype(np.int64) for j in range(width))


def _windows(texts: list[str], shingle: int, passage: int):
    """For slices of texts: (first text of the slice, text of each word, word starts, word ends, lower-case string, key of the window that
    starts at each word, whether that window lies in one text). The key is of the window's size partition and MinHash."""
    for a, b in chunks(texts):
        lower = [t.lower() for t in texts[a:b]]
        joined = "\0".join(lower)
        codes = code_points(joined)
        inside = word_signs()[codes]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
        starts, ends = edge[::2], edge[1::2]
        n = len(starts) - passage + 1
        if n <= 0:
            continue
        whose = np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), starts, "right")
        words = Rolling(codes).stretches(starts, ends)
        sets = np.zeros(len(words) - shingle + 1, np.uint64)
        for i in range(shingle):
            sets = sets * BASE + words[i : i + len(sets)]
        sets = mixed(sets)
        least = sets[:n].copy()
        for i in range(1, passage - shingle + 1):
            np.minimum(least, sets[i : i + n], out=least)
        keys = least + set_sizes(sets, passage - shingle + 1).astype(np.uint64) * SECOND
        yield a, whose, starts, ends, joined, keys, whose[:n] == whose[passage - 1 :]


def _passages(id_name: str, text: str, shingle: int, passage: int, only: np.ndarray | None):
    """mapInPandas: (id, words) of every window; with `only` (sorted keys) of those windows whose key is in it, with a column `keys` of those
    whose key is in the text's own array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = only.value if only is not None else None
        for batch in batches:
            ids = batch[id_name].to_numpy()
            own = batch["keys"].tolist() if "keys" in batch else None
            for a, whose, starts, ends, joined, keys, whole in _windows(batch[text].tolist(), shingle, passage):
                if own is not None:
                    edges = np.searchsorted(whose[: len(keys)], np.arange(whose[0], whose[-1] + 2))
                    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:]), int(whose[0])):
                        whole[low:high] &= np.isin(keys[low:high], np.asarray(own[a + k], np.int64).view(np.uint64))
                elif wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                    whole = whole & (wanted[at] == keys)
                at = np.flatnonzero(whole)
                if len(at):
                    word = lambda j: joined[starts[j] : ends[j]]
                    words = [" ".join(map(word, range(i, i + passage))) for i in at.tolist()]
                    yield pd.DataFrame({id_name: ids[a + whose[at]], "key": keys[at].view(np.int64), "words": words}).drop_duplicates()

    return run


def _sketches(shingle: int, passage: int):
    """mapInPandas: (doc_id, key), the different keys of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for a, whose, _, _, _, keys, whole in _windows(batch["text"].tolist(), shingle, passage):
                at = np.flatnonzero(whole)
                yield pd.DataFrame({"doc_id": ids[a + whose[at]], "key": keys[at].view(np.int64)}).drop_duplicates()

    return run


def leaks(documents: DataFrame, doc_id: str, items: DataFrame, item_id: str, text: str = "text", shingle: int = 5, passage: int = 13) -> DataFrame:
    """(doc_id, item_id, n_passages): each document that contains at least `passage` consecutive words of an item, and how many of the
    item's distinct passages of that length it contains.

    Words are maximal runs of letters and digits, in lower case. Null texts and texts of fewer words than a passage are in no result.
    Repeated documents and items count each. Other columns are not read. An opening shared by items gives a row for each of them.
    """
    if passage < shingle:
        raise ValueError("a passage must hold a shingle")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    schema = "{} long, key long, words string"
    of_items = stored(tests.mapInPandas(_passages("item_id", "text", shingle, passage, None), schema.format("item_id")), "passages")
    size = of_items.agg(F.coalesce(F.sum(F.length("words") + 32), F.lit(0)).alias("n")).collect()[0].n
    keys = of_items.select("key").distinct()
    some = keys.limit(BROADCAST_KEYS + 1).toPandas()["key"].to_numpy()
    if len(some) == 0:
        return docs.where(F.lit(False)).select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).cast("long").alias("n_passages"))
    if len(some) <= BROADCAST_KEYS:
        shared = documents.sparkSession.sparkContext.broadcast(np.sort(some.view(np.uint64)))
        candidates = docs.mapInPandas(_passages("doc_id", "text", shingle, passage, shared), schema.format("doc_id"))
    else:  # only keys travel; the words are taken of the texts that share one
        sketches = stored(docs.mapInPandas(_sketches(shingle, passage), "doc_id long, key long"), "sketches")
        counted = sketches.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).join(keys, "key")
        own = salted_lookup(sketches, counted, "key", "doc_id").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # of one text
        candidates = docs.join(own, "doc_id").mapInPandas(_passages("doc_id", "text", shingle, passage, None), schema.format("doc_id"))
    if size <= BROADCAST_CHARS:  # a passage in very many documents is then no hot key
        exact = candidates.select("doc_id", "words").join(F.broadcast(of_items.select("item_id", "words")), "words")
    else:
        candidates = stored(candidates.select("doc_id", "words"), "candidates")
        holders = of_items.groupBy("words").agg(F.collect_set("item_id").alias("items"))
        counted = candidates.groupBy("words").agg(F.count(F.lit(1)).alias("n_rows")).join(holders, "words")
        exact = salted_lookup(candidates, counted, "words", "doc_id").select("doc_id", "words", F.explode("items").alias("item_id"))
    return exact.groupBy("doc_id", "item_id").agg(F.count_distinct("words").alias("n_passages"))
