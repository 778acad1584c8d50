"""Problem 7: filling containers of fixed capacity by best-two-fit.

Texts are measured in tokens of a public tokenizer, in one pass. What exceeds the capacity is cut into full containers of its own and a
rest. Items are hashed into blocks of bounded size, which are packed apart from each other: each container is filled greedily, largest
fitting item first, and then its smallest item is replaced by the two unpacked items that fit into the gap so widened more tightly. Where
a block ends up with containers that are far from full, their items are packed again, together with those of the other blocks.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.shared import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that the byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items in a block on average. A block is one task's work; its waste is part of one container.
BLOCK_ITEMS = 10_000
#: Containers filled less than this are packed again over all blocks.
FULL_ENOUGH = 0.98
MOST_SIZES = 1_000


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; a null text has none. The vocabulary file is the driver's; Spark sends it to the executors."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = Path(tokenizer).name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, n_tokens long")


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of places in sizes. Every size is between 1 and capacity."""
    places = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        places[sizes[i]].append(i)
    live = sorted(places)  # sizes that still have an item

    def take(size: int) -> int:
        own = places[size]
        if len(own) == 1:
            del live[bisect_right(live, size) - 1]
        return own.pop()

    def put_back(size: int, place: int) -> None:
        if not places[size]:
            live.insert(bisect_right(live, size), size)
        places[size].append(place)

    out = []
    while live:
        packed, gap = [], capacity
        while gap and (k := bisect_right(live, gap)):
            size = live[k - 1]
            packed.append((size, take(size)))
            gap -= size
        if gap and live:
            least, place = packed[-1]  # sizes were taken in descending order
            room = gap + least
            small = np.array(live[: bisect_right(live, room - live[0])], np.int64) if live[0] < room else np.zeros(0, np.int64)
            if len(small):
                second = np.searchsorted(small, room - small, "right") - 1
                same = second == np.arange(len(small))
                for k in np.flatnonzero(same).tolist():  # at most one size pairs with itself
                    if len(places[int(small[k])]) < 2:
                        second[k] -= 1
                total = np.where(second >= 0, small + small[second], 0)
                best = int(total.argmax())
                if total[best] > least:
                    packed.pop()
                    for size in (int(small[best]), int(small[second[best]])):
                        packed.append((size, take(size)))
                    put_back(least, place)
        out.append([place for _, place in packed])
    return out


def _pack(items: DataFrame, prefix: str) -> DataFrame:
    """items: size_id, capacity, doc_id, piece, first_token, n_tokens; adds container_id and filled. Blocks are hashes of doc_id."""
    counts = {r.size_id: r.n for r in items.groupBy("size_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_SIZES rows
    if not counts:
        return items.withColumn("container_id", F.lit(None).cast("string")).withColumn("filled", F.lit(0).cast("long"))
    blocks = F.coalesce(*[F.when(F.col("size_id") == k, F.lit(ceil(n / BLOCK_ITEMS))) for k, n in counts.items()], F.lit(1))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), blocks).cast("long"))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n_tokens", "doc_id", "piece"], ignore_index=True)
        sizes, block = own["n_tokens"].tolist(), own["block"].iat[0]
        names, filled = np.empty(len(own), object), np.zeros(len(own), np.int64)
        for k, places in enumerate(best_two_fit(sizes, int(own["capacity"].iat[0]))):
            names[places] = f"{prefix}{block}.{k}"
            filled[places] = sum(sizes[i] for i in places)
        return own.assign(container_id=names, filled=filled).drop(columns="block")

    schema = "size_id long, capacity long, doc_id long, piece long, first_token long, n_tokens long, container_id string, filled long"
    return items.groupBy("size_id", "block").applyInPandas(pack, schema)


def fill_containers(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(size_id, capacity, container_id, doc_id, piece, first_token, n_tokens, filled): each text of counts (doc_id, n_tokens) once for each
    capacity of sizes (size_id, n_tokens); texts longer than the capacity alone in pieces.

    Texts without tokens (null, empty) take no room: they have a null container_id, and filled 0. Repeated rows are packed each. Null and
    non-positive capacities are left out. sizes holds at most MOST_SIZES rows.
    """
    known = sizes.where("n_tokens > 0").select("size_id", "n_tokens").limit(MOST_SIZES + 1).collect()
    if len(known) > MOST_SIZES:
        raise ValueError(f"at most {MOST_SIZES} capacities")
    kinds = F.array(*[F.struct(F.lit(r.size_id).cast("long").alias("size_id"), F.lit(r.n_tokens).cast("long").alias("capacity")) for r in known])
    if not known:
        kinds = F.array().cast("array<struct<size_id: bigint, capacity: bigint>>")
    texts = counts.select("doc_id", "n_tokens", F.explode(kinds).alias("k")).select("doc_id", F.col("n_tokens").alias("all"), "k.*")
    none = texts.where("all = 0").select(
        "size_id", "capacity", F.lit(None).cast("string").alias("container_id"), "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("piece", "first_token", "n_tokens", "filled")]
    )
    full = texts.where("all >= capacity").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("all div capacity - 1"))))
    full = full.select(
        "size_id", "capacity", F.concat_ws(".", F.lit("d"), "doc_id", "piece", F.monotonically_increasing_id()).alias("container_id"), "doc_id", "piece",
        (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"), F.col("capacity").alias("filled"),
    )
    rest = texts.withColumn("n_tokens", F.col("all") % F.col("capacity")).where("n_tokens > 0")
    rest = rest.withColumn("piece", F.expr("all div capacity")).withColumn("first_token", F.col("piece") * F.col("capacity"))
    first = stored(_pack(rest.select("size_id", "capacity", "doc_id", "piece", "first_token", "n_tokens"), "b"), "packed")
    tight = F.col("filled") >= FULL_ENOUGH * F.col("capacity")
    again = _pack(first.where(~tight).drop("container_id", "filled"), "r")
    columns = full.columns
    return full.unionByName(first.where(tight).select(columns)).unionByName(again.select(columns)).unionByName(none)
