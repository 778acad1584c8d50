"""Problem 9: long exact spans shared between records, by suffix trees over prefix partitions.

A tree over every suffix of a corpus is hundreds of times its size, so the suffixes are thinned first without losing any span. With
`span` the least length, `prefix` = 2/3 of it and a window of span - prefix + 1 positions, a suffix is kept where the hash of its first
24 characters is the least in some window. Both copies of a shared span hold the same kept position within its first window, from which
at least `prefix` characters are shared to the right.

1. Kept suffixes are partitioned by a hash of their prefix; two prefixes that meet in one partition are told apart by their characters.
   Copies of a whole text, by a 128-bit digest of it, are one suffix. Prefixes that occur in one text only hold no shared span and go.
2. The texts are read again, and the suffixes that are left take along the characters before and after the prefix as far as a span can
   reach: `span - prefix` on either side.
3. A group that fits a task becomes a subtree: its suffixes sorted, with the lengths of common prefixes of neighbours, which are the
   depths of the internal nodes. Two leaves share the depth of their lowest common node to the right, and what precedes them to the left;
   if both reach `span`, it is a maximal repeat.
4. A group that does not fit, of a frequent notice shorter than the span say, is split by longer prefixes: the `span` characters from
   each start at which they cover the kept prefix, by a 128-bit digest of them. Suffixes in one such partition share a span, all others
   share none there. Neighbouring partitions mostly have the same holders; each set of holders is paired once.

Digests are BLAKE2b and SHA-256, for which no two texts with the same one are known; the rolling hashes modulo 2 ** 64, for which such
texts can be built, only choose positions and partitions and never decide that two texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.characters import Rolling, chunks, code_points
from assayloom.operators.skew import salted_lookup, salts, whole_groups, within_groups
from assayloom.shared import stored

SEED_CHARS = 24
#: Suffixes in a subtree at most; larger groups are split by longer prefixes.
SUBTREE = 128
#: Positions that are ranked at once; a longer text is ranked in pieces that overlap by more than a window.
PIECE = 1 << 23


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of the w values from each position on, where all w exist."""
    n = len(x) - w + 1
    blocks = np.concatenate((x, np.full((-len(x)) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def kept_positions(rolling: Rolling, window: int) -> np.ndarray:
    """Positions that hold the least seed of some window of neighbours. Of equal seeds the last one in the window counts."""
    seeds = rolling.windows(SEED_CHARS)
    place = np.uint64(0xFFFFFF)
    kept = [np.zeros(0, np.int64)]
    for at in range(0, max(len(seeds) - window + 1, 0), PIECE):
        own = seeds[at : at + PIECE + window]
        rank = (own & ~place) | (place - np.arange(len(own), dtype=np.uint64))  # no two are equal
        least = _least(rank, window)
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        kept.append((place - (least & place)).astype(np.int64) + at)
    return np.unique(np.concatenate(kept))


def digests(texts: list[str]) -> np.ndarray:
    """A 128-bit digest of each text, as two numbers."""
    raw = b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts)
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def covering(at: np.ndarray, reach: int, last: int) -> np.ndarray:
    """The positions from 0 to last that lie at most `reach` before one of `at`."""
    edges = np.zeros(last + 2, np.int32)
    np.add.at(edges, np.minimum(np.maximum(at - reach, 0), last + 1), 1)
    np.add.at(edges, np.minimum(at + 1, last + 1), -1)
    return np.flatnonzero(np.cumsum(edges)[:-1] > 0)


def _suffixes(span: int, prefix: int):
    """mapInPandas: key (hash of the prefix), doc_id, pos and a digest of the whole text, for each kept suffix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
            for a, b in chunks(texts):
                rolling = Rolling(code_points("\0".join(texts[a:b])))
                size = np.array([len(t) for t in texts[a:b]])
                end = np.cumsum(size + 1) - 1
                at = kept_positions(rolling, span - prefix + 1)
                whose = np.minimum(np.searchsorted(end, at, "right"), len(end) - 1)
                inside = (at >= (end - size)[whose]) & (at + prefix <= end[whose])  # a kept position can be a boundary
                at, whose = at[inside], whose[inside]
                whole, rest = digests(texts[a:b])[whose].T
                yield pd.DataFrame(
                    {"key": rolling.stretches(at, at + prefix).view(np.int64), "doc_id": ids[a + whose], "pos": at - (end - size)[whose], "whole": whole, "rest": rest}
                )

    return run


def _contexts(span: int, prefix: int):
    """mapInPandas over (doc_id, text, suffixes): the surroundings of each suffix of a small group; the windows of the large ones, whose key
    and second are the two numbers of a digest."""
    reach = span - prefix

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, keys, second, docs, starts = [], [], [], [], []
            for doc, text, suffixes in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["suffixes"].tolist()):
                large = []
                for s in suffixes:
                    pos = s["pos"]
                    if s["large"]:
                        large.append(pos)
                    else:
                        rows.append((s["key"], doc, pos, text[pos : pos + prefix], text[max(0, pos - reach) : pos], text[pos + prefix : pos + span]))
                if large:
                    covered = covering(np.array(large), reach, len(text) - span)
                    key, other = digests([text[i : i + span] for i in covered.tolist()]).T
                    keys.append(key)
                    second.append(other)
                    docs.append(np.full(len(covered), doc))
                    starts.append(covered)
            if rows:
                frame = pd.DataFrame(rows, columns=["key", "doc_id", "pos", "prefix", "before", "after"])
                yield frame.assign(second=0, large=False)[COLUMNS]
            if keys:
                frame = pd.DataFrame({"key": np.concatenate(keys), "doc_id": np.concatenate(docs), "pos": np.concatenate(starts), "second": np.concatenate(second)})
                yield frame.assign(prefix=None, before=None, after=None, large=True)[COLUMNS]

    return run


COLUMNS = ["large", "key", "second", "doc_id", "pos", "prefix", "before", "after"]
CONTEXTS = "large boolean, key long, second long, doc_id long, pos long, prefix string, before string, after string"
SPANS = "doc_a long, start_a long, doc_b long, start_b long, length long"


def _letters(texts: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of the first letters are the same, row by row."""
    other = a != b
    return np.minimum(np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1]), most)


def _subtrees(span: int, prefix: int):
    """mapInPandas over contexts with equal keys as neighbours: the maximal repeats of at least `span` characters in two texts."""
    reach = span - prefix

    def repeats(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        frame = frame.sort_values(["key", "prefix", "after"], ignore_index=True)  # the leaves of each subtree, in order
        doc, pos, key = (frame[c].to_numpy() for c in ("doc_id", "pos", "key"))
        tree = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (frame["prefix"].to_numpy()[1:] != frame["prefix"].to_numpy()[:-1]))))
        after, before = frame["after"].tolist(), [t[::-1] for t in frame["before"]]
        n_after, n_before = (np.array([len(t) for t in x]) for x in (after, before))
        after, before = _letters(after, reach), _letters(before, reach)
        depth = _common(after[1:], after[:-1], np.minimum(n_after[1:], n_after[:-1]))  # of the node above two neighbours
        lowest, i = depth.copy(), np.arange(len(frame) - 1)
        for apart in range(1, SUBTREE):
            i = i[i + apart < len(frame)]
            i = i[tree[i] == tree[i + apart]]
            if not len(i):
                break
            if apart > 1:
                lowest[i] = np.minimum(lowest[i], depth[i + apart - 1])
            for k in range(0, len(i), 50_000):
                a = i[k : k + 50_000]
                a = a[doc[a] != doc[a + apart]]
                b = a + apart
                left = _common(before[a], before[b], np.minimum(n_before[a], n_before[b]))
                deep = left + lowest[a] >= reach
                a, b, left = a[deep], b[deep], left[deep]
                a, b = np.where(doc[a] < doc[b], a, b), np.where(doc[a] < doc[b], b, a)
                right = lowest[np.minimum(a, b)]
                yield pd.DataFrame({"doc_a": doc[a], "start_a": pos[a] - left, "doc_b": doc[b], "start_b": pos[b] - left, "length": left + prefix + right}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["key"]):
            yield from repeats(frame)

    return run


def _contexts_of(texts: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(repeats, windows) of texts (doc_id, text), of equal ones only that of the smallest doc_id. repeats: doc_a < doc_b, start_a, start_b,
    length (clipped to what is within reach of one kept suffix; those of a longer repeat overlap). windows: key, second, doc_id, pos of
    each window of `span` characters from the split groups; equal ones share the key and second."""
    if span < SEED_CHARS:
        raise ValueError(f"a span has {SEED_CHARS} characters at least")
    prefix = max(2 * span // 3, SEED_CHARS)
    long_enough = texts.where(F.length("text") >= span)
    suffixes = long_enough.mapInPandas(_suffixes(span, prefix), "key long, doc_id long, pos long, whole long, rest long")
    suffixes = stored(suffixes.groupBy("key", "pos", "whole", "rest").agg(F.min("doc_id").alias("doc_id")).drop("whole", "rest"), "suffixes")
    groups = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    groups = groups.where(F.col("least") < F.col("most")).select("key", "n_rows")
    member = F.struct("key", "pos", (F.col("n_rows") > SUBTREE).alias("large"))
    by_text = salted_lookup(suffixes, groups, "key", "doc_id").groupBy("doc_id").agg(F.collect_list(member).alias("suffixes"))  # of one text
    contexts = stored(long_enough.join(by_text, "doc_id").mapInPandas(_contexts(span, prefix), CONTEXTS), "contexts")
    small = contexts.where(~F.col("large")).select("key", "doc_id", "pos", "prefix", "before", "after")
    repeats = small.repartition("key").sortWithinPartitions("key").mapInPandas(_subtrees(span, prefix), SPANS)
    return repeats, contexts.where("large").select("key", "second", "doc_id", "pos")


def _copies(texts: DataFrame, span: int) -> DataFrame:
    """(first, doc_id, n_rows) of every text that has copies and is long enough, the first of them included."""
    rows = texts.where(F.length("text") >= span).select("doc_id", F.unhex(F.sha2("text", 256)).alias("same"))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    return salted_lookup(rows, first, "same", "doc_id").select("first", "doc_id", "n_rows")


def _split_pairs(windows: DataFrame) -> DataFrame:
    """(doc_a, doc_b): texts that hold the same window. Of windows with the same holders, one is left, so each set of holders is paired once."""
    holders = windows.select(F.concat_ws(",", "key", "second").alias("window"), "doc_id").distinct()
    hashed = [F.xxhash64(F.lit(k), "doc_id").cast("decimal(38,0)") for k in (1, 2)]
    sets = holders.groupBy("window").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(h).alias(f"set_{i}") for i, h in enumerate(hashed)]).where("n_rows > 1")
    one = sets.groupBy("n_rows", "set_0", "set_1").agg(F.min("window").alias("window")).select("window", "n_rows")
    members = salted_lookup(holders, stored(one, "holders"), "window", "doc_id")  # a hot notice has as many rows as documents
    return within_groups(members, "window", "doc_id", "n_rows").select(F.col("item_a").alias("doc_a"), F.col("item_b").alias("doc_b")).distinct()


def linked_texts(texts: DataFrame, span: int) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: different texts with a common run, each by the smallest doc_id of its copies."""
    repeats, windows = _contexts_of(texts, span)
    return repeats.select("doc_a", "doc_b").unionByName(_split_pairs(windows)).distinct()


def pairs_sharing(df: DataFrame, doc_id: str, text: str = "text", span: int = 300) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents with a common run of at least `span` characters, compared exactly.

    Null, empty and shorter texts are in no pair. Copies of one text are pairs with each other and share the partners of their text.
    Other columns of df are not read. Texts of any length are compared whole. Copies are expanded last, spread by their numbers.
    """
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    copies = stored(_copies(texts, span), "copies")
    pairs = linked_texts(texts, span)
    counts = copies.groupBy("first").agg(F.max("n_rows").alias("n_rows"))
    for x in "ab":
        pairs = expanded(pairs, copies, counts, f"doc_{x}")
    pairs = pairs.select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"))
    same = within_groups(copies, "first", "doc_id", "n_rows").select(F.col("item_a").alias("doc_id_a"), F.col("item_b").alias("doc_id_b"))
    return pairs.unionByName(same)


def expanded(pairs: DataFrame, copies: DataFrame, counts: DataFrame, side: str, lone: bool = True) -> DataFrame:
    """pairs with each row once for every copy (first, doc_id, n_rows) of what is in column `side`; counts: (first, n_rows). With `lone`, what
    has no copies stays, else it goes. Each copy takes the rows in a task that a hash of the copy names, so that what has very many copies
    fills as many tasks as it needs."""
    share = salts("n_rows")
    own = copies.select(F.col("first").alias(side), F.col("doc_id").alias("_copy"), F.pmod(F.xxhash64("doc_id"), share).cast("int").alias("_salt"))
    spread = pairs.join(counts.withColumnRenamed("first", side), side, "left" if lone else "inner")
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(share, F.lit(1)) - 1)))
    out = spread.join(own, [side, "_salt"], "left").where(F.col("_copy").isNotNull() | F.col("n_rows").isNull())
    return out.withColumn(side, F.coalesce("_copy", side)).drop("_copy", "_salt", "n_rows")


def links(df: DataFrame, doc_id: str, text: str = "text", span: int = 300) -> DataFrame:
    """One row per document that shares a run with another: doc_id, class_id (the smallest doc_id of its text's copies), n_copies (of its text)
    and n_links (other texts that share a run with it). Texts as in pairs_sharing; no copies are expanded into pairs."""
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    copies = stored(_copies(texts, span), "copies")
    pairs = stored(linked_texts(texts, span), "links")
    ends = pairs.select(F.col("doc_a").alias("class_id")).unionByName(pairs.select(F.col("doc_b").alias("class_id")))
    linked = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    copied = copies.groupBy("first").agg(F.max("n_rows").alias("n_copies"))
    classes = linked.join(copied.withColumnRenamed("first", "class_id"), "class_id", "full").select(
        "class_id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    members = copies.select("doc_id", F.col("first").alias("class_id"))
    lone = classes.where("n_copies = 1").select(F.col("class_id").alias("doc_id"), "class_id", "n_copies", "n_links")
    many = salted_lookup(members, classes.where("n_copies > 1"), "class_id", "doc_id", "n_copies")
    return lone.unionByName(many.select(lone.columns))


def shared_parts(df: DataFrame, doc_id: str, text: str = "text", span: int = 300) -> DataFrame:
    """One row per document that shares something: doc_id, n_chars, n_spans, shared_chars, share. Texts as in pairs_sharing.

    Spans of a document are merged where they overlap; a text that has copies is shared as a whole.
    """
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    copies = stored(_copies(texts, span), "copies")
    repeats, windows = _contexts_of(texts, span)
    repeats = stored(repeats, "repeats")
    parts = [repeats.select(F.col(f"doc_{x}").alias("doc_id"), F.col(f"start_{x}").alias("start"), "length") for x in "ab"]
    windows = windows.withColumn("window", F.concat_ws(",", "key", "second"))
    held = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    held = held.where(F.col("least") < F.col("most")).select("window", "n_rows")
    split = salted_lookup(windows, held, "window", "doc_id").select("doc_id", F.col("pos").alias("start"), F.lit(span).cast("long").alias("length"))
    own = parts[0].unionByName(parts[1]).unionByName(split).groupBy("doc_id", "start")  # at most one row per position of a text
    own = own.agg((F.col("start") + F.max("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    merged = own.withColumn("reached", F.coalesce(before, F.lit(-1).cast("long")))
    sums = merged.groupBy("doc_id").agg(
        F.count_if(F.col("start") > F.col("reached")).alias("n_spans"), F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).alias("shared")
    )
    sizes = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"))
    out = sizes.join(sums, "doc_id", "left").join(copies.select("doc_id", F.lit(True).alias("copied")), "doc_id", "left")
    out = out.where(F.col("copied") | F.col("shared").isNotNull())
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("shared"))
    return out.select(
        "doc_id", "n_chars", F.when(F.col("copied"), F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), shared.alias("shared_chars"),
        F.round(shared / F.col("n_chars"), 6).alias("share"),
    )
