"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: each source, in order of its name, has a weight; all of the mix is shared by weight, but no target exceeds
``repeats`` times the source's size, and what is over is shared again among the others (water filling, in closed form).

Each source's documents stand in a seeded permutation. The mix takes the stretch [0, target) of that permutation
repeated, so a document is taken whole in every full pass and the last pass stops at the target. The stretch is cut
into blocks of equal words. A splitting tree deals the exact number of blocks of each source to the output shards: at
each node all its blocks are drawn without replacement, so that the left half's counts are multivariate
hypergeometric. Then each shard draws as many blocks as its quota from the source's permuted blocks, all disjoint, and
orders its rows by a seeded hash.

Everything is DataFrame operations. What meets in one task is a row for each source or each block, and there are
``shards * blocks_per_shard`` blocks plus one for each source, whatever the size of the data.

What a document gives to the mix is the sum of its takings' words whose blocks the tree has dealt to a shard.

Defined cases: a null source is one source, last; null or empty text has size 0 and is never taken in words; repeated
rows are separate documents; an empty table gives an empty mix. All columns are kept; those added start with ``mix_``, and
an input column of such a name is replaced (``mixed_documents`` keeps it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.llm.order import group_key, n_buckets, prefix_sums
from spotlattice.llm.util import n_words, sized_broadcast, stored

WEIGHTS = (5, 2, 1)


def _draw(seed: int, what: str) -> Column:
    """The order in which blocks are drawn."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{what}"), "mix_source", F.col("mix_block").cast("string")).cast("binary"))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """mix_source, mix_source_size -> with mix_target; the rows are one for each source."""
    by_name, everything = W.orderBy("mix_source"), W.partitionBy()
    df = sizes.withColumn("__i", F.row_number().over(by_name))
    df = df.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("__i") - 1, F.lit(len(weights))) + 1).cast("long"))
    df = df.withColumn("__cap", F.lit(repeats).cast("long") * F.col("mix_source_size")).withColumn("__fill", F.col("__cap").cast("double") / F.col("__w"))
    before = W.orderBy("__fill", "mix_source").rowsBetween(W.unboundedPreceding, -1)
    total, all_w = F.sum("mix_source_size").over(everything), F.sum("__w").over(everything)
    df = df.withColumns({"__all": total, "__all_w": all_w, "__cb": F.coalesce(F.sum("__cap").over(before), F.lit(0)), "__wb": F.coalesce(F.sum("__w").over(before), F.lit(0))})
    capped = F.col("__fill") * (F.col("__all_w") - F.col("__wb")) <= (F.col("__all") - F.col("__cb")).cast("double")
    df = df.withColumn("__capped", capped)
    rest = F.col("__all") - F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0)).over(everything)
    rest_w = F.col("__all_w") - F.sum(F.when(F.col("__capped"), F.col("__w")).otherwise(0)).over(everything)
    df = df.withColumns({"__rest": rest, "__rest_w": rest_w})
    share = F.col("__rest").cast("double") * F.col("__w") / F.when(F.col("__rest_w") > 0, F.col("__rest_w"))
    return df.select("mix_source", "mix_source_size", F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(share).alias("mix_target"))


def split_quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """mix_source, mix_block -> mix_source, mix_shard, quota, by recursive halving of the shards.

    At each node of the tree the tokens of all sources are drawn without replacement: those of the first ranks go left,
    as many as the left shards' part of them, rounded down.
    """
    tokens = blocks.withColumns({"__lo": F.lit(0), "__hi": F.lit(shards)})
    for level in range(max(0, (shards - 1).bit_length())):
        node = W.partitionBy("__lo", "__hi")
        drawn = F.row_number().over(node.orderBy(_draw(seed, str(level)), "mix_source", "mix_block"))
        tokens = tokens.withColumns({"__r": drawn, "__n": F.count("*").over(node), "__mid": F.expr("(__lo + __hi) div 2")})
        left = F.expr("__r <= (__n * (__mid - __lo)) div (__hi - __lo)")
        leaf = F.col("__hi") - F.col("__lo") <= 1
        tokens = tokens.withColumns({"__lo": F.when(leaf | left, F.col("__lo")).otherwise(F.col("__mid")), "__hi": F.when(leaf | ~left, F.col("__hi")).otherwise(F.col("__mid"))}).drop("__r", "__n", "__mid")
    return tokens.groupBy("mix_source", F.col("__lo").cast("int").alias("mix_shard")).agg(F.count("*").alias("quota"))


def deal_blocks(blocks: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """mix_source, mix_block, mix_shard: each shard gets its quota of the source's permuted blocks, all disjoint."""
    ranked = blocks.withColumn("__r", F.row_number().over(W.partitionBy("mix_source").orderBy(_draw(seed, "deal"), "mix_block")))
    slots = quotas.select("mix_source", "mix_shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("__j"))
    slots = slots.select("mix_source", "mix_shard", F.row_number().over(W.partitionBy("mix_source").orderBy("mix_shard", "__j")).alias("__r"))
    return ranked.join(slots, ["mix_source", "__r"]).drop("__r")


def mix(docs: DataFrame, *, source: str = "source", key: str = "doc_id", text: str = "text", size: str | None = None, shards: int = 16, blocks_per_shard: int = 32, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, seed: int = 7, whole: bool = False) -> DataFrame:
    """One row for every taking of a document, and one with mix_words 0 for a document that is not taken.

    Added: mix_source, mix_size, mix_source_size, mix_target, mix_rank (unique within a source), mix_words (of this
    taking), mix_block, mix_shard (null if not taken) and mix_slot, a hash that orders the rows of a shard. With
    ``whole`` the last document of a source is taken whole or not at all, whichever is nearer to the target; otherwise
    only its first mix_words words belong to the mix. ``size`` names a column with the number of words, if there is one;
    docs is then read several times and should be a stored table.
    """
    md = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    df = docs.withColumns({"mix_source": group_key(F.col(source)), "mix_size": F.col(size).cast("long") if size else n_words(F.col(text)), "__h": md, "__x": F.xxhash64(F.col(text))})
    slim = df.select("mix_source", "mix_size", "__h")
    slim = slim if size else stored(slim, "sizes")  # so that words are counted once for all totals
    rows = slim.count()
    sizes = slim.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
    plan = stored(targets(sizes, weights=weights, repeats=repeats).withColumn("__goal", F.floor(F.col("mix_target") + F.lit(0.5)).cast("long")), "targets")
    n_sources = plan.count()
    n = n_buckets(rows, most=1 << 15)
    bucket = F.floor(F.conv(F.substring("__h", 1, 6), 16, 10).cast("long") * n / F.lit(1 << 24))
    df = prefix_sums(df, "mix_source", bucket, ["__h", key, "__x"], {"__start": F.col("mix_size"), "mix_rank": F.lit(1).cast("long")}, slim)
    width = F.greatest(F.lit(1), F.ceil(F.sum("mix_source_size").over(W.partitionBy()) / F.lit(shards * blocks_per_shard))).cast("long")
    plan = plan.withColumn("__bw", width)
    # A whole document may be taken a little beyond the target, so there is a block more than the target needs.
    blocks = plan.where("__goal > 0").select("mix_source", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("__goal div __bw"))).alias("mix_block"))
    dealt = deal_blocks(blocks, split_quotas(blocks, shards, seed), seed)
    df = df.join(sized_broadcast(plan, n_sources), "mix_source")
    of = F.greatest(F.col("mix_source_size"), F.lit(1))
    df = df.withColumns({"__full": F.expr("__goal div greatest(mix_source_size, 1L)"), "__rem": F.col("__goal") % of})
    part = F.when(2 * F.col("__start") + F.col("mix_size") <= 2 * F.col("__rem"), F.col("mix_size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("__rem") - F.col("__start")))
    df = df.withColumn("__part", part.cast("long"))
    takes = F.expr(
        "filter(transform(sequence(0L, __full), p -> struct(p as pass, if(p < __full, mix_size, __part) as words,"
        " least((p * mix_source_size + __start) div __bw, __goal div __bw) as block)), t -> t.words > 0)"
    )
    df = df.withColumn("__take", F.explode_outer(takes))
    df = df.withColumns({"mix_words": F.coalesce(F.col("__take.words"), F.lit(0)).cast("long"), "mix_block": F.col("__take.block"), "mix_slot": F.xxhash64(F.lit(seed), F.lit("slot"), F.col(key), F.col("__take.pass"))})
    # The blocks are bounded by the parameters and the number of sources.
    df = df.join(sized_broadcast(dealt, shards * blocks_per_shard + 2 * n_sources), ["mix_source", "mix_block"], "left")
    return df.drop("__h", "__x", "__start", "__goal", "__full", "__rem", "__part", "__bw", "__take")


def taken_words(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document of a mix: key, size, source_size, target, taken (words in the shards' blocks) and
    by_shard, what each shard has of it as "shard:words,...", in order; empty if the document is not taken."""
    each = mixed.groupBy("mix_source", "mix_rank", key, "mix_shard").agg(F.first("mix_size").alias("size"), F.first("mix_source_size").alias("source_size"), F.first("mix_target").alias("target"), F.sum("mix_words").alias("w"))
    has = F.col("mix_shard").isNotNull()
    lines = F.array_sort(F.collect_list(F.when(has, F.struct("mix_shard", "w"))))  # a shard each at most
    out = each.groupBy("mix_source", "mix_rank", key).agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.when(has, F.col("w")).otherwise(0)).alias("taken"), lines.alias("l"))
    return out.select(key, "size", "source_size", "target", "taken", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["mix_shard"].cast("string"), x["w"].cast("string"))), ",").alias("by_shard"))


def mixed_documents(docs: DataFrame, *, rows_each: int = 20_000, shards: int = 16, **options) -> DataFrame:
    """The columns of docs: the documents of the mix, a row for each taking, laid out by shard and shuffled within it."""
    names = {c: f"__own_{c}" for c in docs.columns if c.startswith("mix_")}
    out = mix(docs.withColumnsRenamed(names), whole=True, shards=shards, **options).where("mix_words > 0")
    each = max(8, -(-docs.count() // (shards * rows_each)))
    out = out.repartition("mix_shard", F.pmod("mix_slot", F.lit(each))).sortWithinPartitions("mix_shard", "mix_slot")
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
