"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

A bin never holds two documents of one duplicate cluster, nor (with ``distinct_sources``) two of one source. Bins stand in
order of what is left in them and carry a bitmap of sources and one of clusters. A piece looks up the first bin that it
fits into and goes on to the successors until it finds one without a conflict, which is the tightest compatible bin; if
there is none it opens a new one. Pieces come in order of decreasing length.

A document longer than a bin is cut into pieces: full ones, which have bins to themselves, and a rest. Pieces are dealt
by a hash into groups of a few thousand, and each group packs on its own, so tasks are even and need bounded memory; a
hot source or cluster is spread over all groups. Only ids, lengths and hashes are shuffled, never texts.

Defined cases: texts that are null or have no words get one row with n_words 0 and no bin; a null source is a source;
documents of equal text are one cluster unless a cluster column is given; repeated rows are packed one by one (equal
ids fall into one group, which streams in blocks); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlattice.llm.util import n_words, stored

GROUP = 4096
_LOOK = 128


def _bits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value the word and the bit in a bitmap of the values that occur more than once, and the bitmap's words.
    A value that occurs once can't conflict and has no bit."""
    _, back, n = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    at = np.where(n[back] > 1, number[back], -1)
    word = np.where(at >= 0, at >> 6, 0)
    bit = np.where(at >= 0, np.left_shift(np.uint64(1), (np.maximum(at, 0) & 63).astype(np.uint64)), np.uint64(0))
    return word, bit, max(1, -(-int((n > 1).sum()) // 64))


def best_fit(lengths: np.ndarray, conflicts: list[np.ndarray], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of every piece, in the order given, and what is left of each bin."""
    n = len(lengths)
    maps = [_bits(c) for c in conflicts]
    left = np.zeros(n, np.int64)  # of the bins in order
    names = np.zeros(n, np.int64)
    held = [np.zeros((n, width), np.uint64) for _, _, width in maps]
    bins, offsets, rest, made = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i in range(n):
        size = int(lengths[i])
        at, found = int(np.searchsorted(left[:made], size)), -1
        while at < made and found < 0:
            end = min(made, at + _LOOK)
            ok = np.ones(end - at, bool)
            for (word, bit, _), bitmap in zip(maps, held, strict=True):
                if bit[i]:
                    ok &= (bitmap[at:end, word[i]] & bit[i]) == 0
            hit = int(np.argmax(ok))
            if ok[hit]:
                found = at + hit
            at = end
        if found < 0:
            found, name, free = made, made, capacity
            rows = [np.zeros(b.shape[1], np.uint64) for b in held]
            made += 1
        else:
            name, free = int(names[found]), int(left[found])
            rows = [b[found].copy() for b in held]
        for (word, bit, _), row in zip(maps, rows, strict=True):
            row[word[i]] |= bit[i]
        bins[i], offsets[i] = name, capacity - free
        free -= size
        # Move the bin down to its place by what is left now.
        to = int(np.searchsorted(left[:found], free))
        for array, value in ((left, free), (names, name), *zip(held, rows, strict=True)):
            array[to + 1 : found + 1] = array[to:found].copy()
            array[to] = value
        rest[name] = free
    return bins, offsets, rest[:made]


def pieces(docs: DataFrame, capacity: int, *, key: str, text: str, source: str, cluster: Column | None) -> DataFrame:
    """(key, piece, n_words, __src, __cl) of all documents; one row with n_words 0 for those without words."""
    base = docs.select(
        F.col(key),
        n_words(F.col(text)).alias("__n"),
        F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit("")), F.col(source).isNull()).alias("__src"),
        (cluster if cluster is not None else F.xxhash64(text)).alias("__cl"),
    )
    last = F.greatest(F.expr(f"(__n - 1) div {capacity}L"), F.lit(0))
    df = base.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return df.withColumns({"piece": F.col("piece").cast("int"), "n_words": F.least(F.lit(capacity).cast("long"), F.col("__n") - F.col("piece") * F.lit(capacity).cast("long"))}).drop("__n")


def pack(docs: DataFrame, *, capacity: int = 2048, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, distinct_sources: bool = True, seed: int = 3) -> DataFrame:
    """key, piece, n_words, bin_id, bin_offset and bin_free of every piece of every document."""
    # Stored, so that words are counted once; documents may have many pieces, and groups are of pieces.
    cut = stored(pieces(docs, capacity, key=key, text=text, source=source, cluster=cluster), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    kind = docs.schema[key].dataType.simpleString()
    dealt = cut.withColumn("__g", F.pmod(F.xxhash64(F.lit(seed), F.col(key), "piece"), F.lit(groups)).cast("int"))
    order = ["__g", F.col("n_words").desc(), F.xxhash64(F.lit(seed), F.col(key), "piece"), F.col(key), "__cl"]
    parts = min(groups, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def packed(block: pd.DataFrame, group: int, number: int) -> pd.DataFrame:
        some = block["n_words"].to_numpy() > 0
        full = block[some]
        conflicts = [full["__cl"].to_numpy()] + ([full["__src"].to_numpy()] if distinct_sources else [])
        bins, offsets, rest = best_fit(full["n_words"].to_numpy(), conflicts, capacity)
        out = block[[key, "piece", "n_words"]].copy()
        for name, values in (("bin_id", (group << 40) | (number << 13) | bins), ("bin_offset", offsets), ("bin_free", rest[bins])):
            column = pd.array([pd.NA] * len(block), dtype="Int64")
            column[some] = values
            out[name] = column
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, number = None, None, 0
        for batch in batches:
            for group, part in batch.groupby("__g", sort=True):
                if group != at:
                    if held is not None and len(held):
                        yield packed(held, at, number)
                    held, at, number = part, int(group), 0
                else:
                    held = pd.concat([held, part], ignore_index=True)
                while len(held) >= 2 * GROUP:
                    yield packed(held[: 2 * GROUP], at, number)
                    held, number = held[2 * GROUP :], number + 1
        if held is not None and len(held):
            yield packed(held, at, number)

    schema = f"`{key}` {kind}, piece int, n_words long, bin_id long, bin_offset long, bin_free long"
    return dealt.repartition(parts, "__g").sortWithinPartitions(*order).mapInPandas(run, schema)
