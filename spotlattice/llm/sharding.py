"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded order within their source; the rank as a fraction of the source's rows places them in one
global order, which is cut into shards whose row counts differ by one at most. Any stretch of that order holds the
sources in the proportions of the whole, so every shard matches the mixture. Its law is ``rows``.

Defined cases: a null source is a source of its own, after all others; null text counts as no bytes; repeated rows get
places of their own; with fewer rows than shards some shards stay empty; an empty table gives an empty result. Columns
of the input other than those named are kept only if asked for. Equal texts are not kept together: a group may be
larger than a shard, and the law is on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlattice.llm.order import group_key, n_buckets, prefix_sums
from spotlattice.llm.util import sized_broadcast, stored


def interleave(docs: DataFrame, *, shards: int, seed: int = 11, source: str = "source", key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep``, size, text_crc32, shard and slot of every row of docs; the text itself is never shuffled."""
    octets = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(
        *dict.fromkeys([key, *keep]),
        group_key(F.col(source)).alias("__src"),
        (F.octet_length(octets) + F.lit(16)).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")).alias("__h"),
    )
    df = stored(slim, "slim")  # so that texts are read once
    counts = stored(df.groupBy("__src").agg(F.count("*").alias("__n")), "sources")
    rows, n_sources = df.count(), counts.count()
    n = n_buckets(rows)
    spread = F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32))
    df = prefix_sums(df, "__src", spread, ["__h", key, "text_crc32"], {"__rank": F.lit(1).cast("long")})
    df = df.join(sized_broadcast(counts, n_sources), "__src").withColumn("__f", (F.lit(2) * F.col("__rank") + F.lit(1)).cast("double") / (F.lit(2) * F.col("__n")))
    df = prefix_sums(df, None, F.floor(F.col("__f") * F.lit(n)), ["__f", "__src", "__h", key, "text_crc32"], {"__pos": F.lit(1).cast("long")})
    shard = F.expr(f"(__pos * {shards}L) div {max(1, rows)}L")
    first = F.expr(f"((shard * {max(1, rows)}L) + {shards - 1}L) div {shards}L")
    df = df.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__pos") - first)
    return df.select(*dict.fromkeys([key, *keep]), "size", "text_crc32", "shard", "slot")
