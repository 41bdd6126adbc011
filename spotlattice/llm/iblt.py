"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document is the set of 64-bit digests of its paragraphs (its non-empty lines). Its fingerprint has three tables of
``CELLS / 3`` cells; every digest goes to one cell of each table, and a cell holds a count, the digests XORed, and their
check values XORed. Cells of two versions subtract; where one digest is left, the check value tells, and taking it out
of its other cells frees more (peeling), until no cell holds anything: the digests taken out are the paragraphs in which
the versions differ. If cells are left over, the pair is tried again with a sketch four times as large, which is four
sketches, each of a quarter of the digests; only the quarters that fail again grow further.

All of it is Spark functions: the sketches and the peeling are higher-order functions over the arrays of one row, so a
document never leaves its row, and there is one shuffle of the texts, to bring each document to its successor.

Defined cases: null text is the empty text; texts without paragraphs have an empty sketch, and two of them are alike (1);
paragraphs that repeat within a document count once; equal texts have equal fingerprints; documents with equal ids follow
each other in the order of a hash of their texts, null ids come first; a single document is its own successor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.llm.order import prefix_sums, steps
from spotlattice.llm.util import stored

CELLS = 18
#: Digests that one peeling takes out at most; more count as a failure.
MOST = 12
_TABLES = 3


def paragraphs(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.length(p) > 0)
    return F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p)))


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(13)).bitwiseAND(F.lit(0xFFFFFFFF))


def _places(k: Column) -> list[Column]:
    """The cell of a digest in each table."""
    each = CELLS // _TABLES
    return [(F.pmod(F.xxhash64(k, F.lit(t)), F.lit(each)) + t * each).cast("int") for t in range(_TABLES)]


def sketch(digests: Column) -> Column:
    """array of struct(n, k, h), one for each cell."""
    placed = F.transform(digests, lambda k: F.struct(k.alias("k"), _check(k).alias("h"), *[p.alias(f"p{t}") for t, p in enumerate(_places(k))]))
    cell_of = lambda xs, j: F.filter(xs, lambda x: (x["p0"] == j) | (x["p1"] == j) | (x["p2"] == j))
    xor = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[f]))
    # placed is an expression of its own for every cell unless it is bound to a variable first
    bound = F.transform(F.array(placed), lambda xs: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda j: cell_of(xs, j)))
    held = F.element_at(bound, 1)
    return F.transform(held, lambda xs: F.struct(F.size(xs).cast("long").alias("n"), xor(xs, "k").alias("k"), xor(xs, "h").alias("h")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column) -> Column:
    """struct(cells, found): found has (digest, sign) of what was taken out; decoded if the cells are all empty."""
    entry = "array<struct<k:bigint,n:bigint>>"
    start = F.struct(cells.alias("cells"), F.array().cast(entry).alias("found"))

    def step(state: Column, _: Column) -> Column:
        pure = F.get(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"]))), F.lit(0))
        bound = F.transform(F.array(pure), lambda p: F.when(p.isNotNull(), F.struct(p.alias("c"), *[x.alias(f"p{t}") for t, x in enumerate(_places(p["k"]))])))

        def without(q: Column) -> Column:
            c = q["c"]
            left = F.transform(
                state["cells"],
                lambda x, j: F.when(
                    (q["p0"] == j) | (q["p1"] == j) | (q["p2"] == j),
                    F.struct((x["n"] - c["n"]).alias("n"), x["k"].bitwiseXOR(c["k"]).alias("k"), x["h"].bitwiseXOR(c["h"]).alias("h")),
                ).otherwise(x),
            )
            return F.when(q.isNull(), state).otherwise(F.struct(left.alias("cells"), F.concat(state["found"], F.array(F.struct(c["k"].alias("k"), c["n"].alias("n")))).alias("found")))

        return F.element_at(F.transform(bound, without), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step)


def decoded(state: Column) -> Column:
    return F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))


def fingerprint(cells: Column) -> Column:
    """The sketch as text: base64 of 2 bytes of count, 8 of digests and 4 of checks for each cell."""
    hexed = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"].bitwiseAND(F.lit(0xFFFF))), 4, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 8, "0")))
    return F.translate(F.base64(F.unhex(F.array_join(hexed, ""))), "\r\n", "")


def differences(pairs: DataFrame, *, rounds: int = 30) -> DataFrame:
    """pairs(pair, a, b) of digest arrays -> (pair, found): the (digest, sign) in which they differ, by peeling.

    ``pair`` must be unique. Each round takes what has failed, as four parts each; it ends when nothing has.
    """
    # Few bytes, much work: as many tasks as rows ask for, not as bytes do.
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // 20_000))
    left = pairs.select("pair", "a", "b").repartition(tasks, "pair")
    done: list[DataFrame] = []
    for level in range(rounds):
        close = F.abs(F.size("a") - F.size("b")) <= MOST
        state = left.withColumn("__s", F.when(close, peel(subtract(sketch(F.col("a")), sketch(F.col("b"))))))
        tried = stored(state.withColumn("__ok", F.coalesce(decoded(F.col("__s")), F.lit(False))).select("pair", F.when(F.col("__ok"), F.col("__s.found")).alias("found"), F.when(~F.col("__ok"), F.col("a")).alias("a"), F.when(~F.col("__ok"), F.col("b")).alias("b"), "__ok"), "peeled")
        done.append(tried.where("__ok").select("pair", "found"))
        failed = tried.where("not __ok")
        if failed.isEmpty():
            break
        part = lambda xs, i, level=level: F.filter(xs, lambda k: F.shiftrightunsigned(F.xxhash64(k, F.lit(99)), 2 * level).bitwiseAND(F.lit(3)) == i)
        left = failed.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("pair", part(F.col("a"), F.col("__i")).alias("a"), part(F.col("b"), F.col("__i")).alias("b"))
    else:
        raise RuntimeError("peeling did not end")
    return reduce(DataFrame.unionByName, done).groupBy("pair").agg(F.flatten(F.collect_list("found")).alias("found"))


def with_successor(docs: DataFrame, *, key: str = "doc_id", text: str = "text", out: str = "next_text") -> DataFrame:
    """docs with the text of the row that follows by key (after the last, the first); one shuffle of the texts.

    Rows are dealt into narrow ranges of the key, of which heavy ones are cut again. A window in each finds the successor;
    the last row of a range takes the first of the next range that has rows. Ranges are numbered without one task seeing
    them all. Rows that share a key stay in one range.
    """
    every = steps(stored(docs.select(key), "keys"), key, each=500)
    df = every.of(docs).withColumn("__x", F.xxhash64(text))
    order = [F.col(key).asc_nulls_first(), F.col("__x")]
    w = W.partitionBy("__b").orderBy(*order)
    heads = df.select("__b", F.col(key), "__x", F.struct(F.col(text).alias("t")).alias("__head")).withColumn("__r", F.row_number().over(w)).where("__r = 1").select("__b", "__head")
    ranges = stored(every.of(docs.select(key)).groupBy("__b").agg(F.lit(1).alias("one")), "ranges")
    total = max(1, ranges.count())
    numbered = stored(prefix_sums(ranges.withColumn("__at", F.col("__b")), None, every.bucket(), ["__at"], {"__i": F.lit(1).cast("long")}).select(F.col("__at").alias("__b"), "__i"), "numbered")
    follow = numbered.select("__b", F.pmod(F.col("__i") + 1, F.lit(total)).alias("__i")).join(numbered.select("__i", F.col("__b").alias("__n")), "__i").select("__b", "__n")
    heads = follow.join(heads.withColumnRenamed("__b", "__n"), "__n").select("__b", "__head")
    led = df.withColumn("__lead", F.lead(F.struct(F.col(text).alias("t"))).over(w))
    return led.join(heads, "__b", "left").withColumn(out, F.coalesce(F.col("__lead"), F.col("__head"))["t"]).drop("__b", "__x", "__lead", "__head")


def edit(text: Column, successor: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the successor's first as many."""
    t, s = F.coalesce(text, F.lit("")), F.coalesce(successor, F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    return F.concat(F.substring(t, F.lit(1), F.length(t) - half), F.substring(s, F.lit(1), half))


def likeness(size_a: Column, size_b: Column, differing: Column) -> Column:
    """The Jaccard similarity of two sets from their sizes and the number of elements in one of them only."""
    total = size_a + size_b
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differing) / (total + differing).cast("double"))


def compare_with_edited(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, both fingerprints, and the likeness to the edited text and to the next document."""
    both = with_successor(docs.select(key, text), key=key, text=text).withColumn("__e", edit(F.col(text), F.col("next_text")))
    base = stored(
        both.select(
            F.col(key),
            F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"),
            F.sha2(F.col("__e"), 256).alias("edited_sha256"),
            paragraphs(F.col(text)).alias("own"),
            paragraphs(F.col("__e")).alias("edited"),
            paragraphs(F.col("next_text")).alias("after"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "paragraphs",
    )
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("edited").alias("b")), F.struct(F.lit(1).alias("side"), F.col("after").alias("b"))))
    pairs = base.select("row", F.col("own").alias("a"), sides.alias("s")).select(F.struct("row", "s.side").alias("pair"), "a", "s.b")
    found = differences(pairs).select(F.col("pair.row").alias("row"), F.col("pair.side").alias("side"), F.size("found").alias("d"))
    count = lambda side: F.max(F.when(F.col("side") == side, F.col("d"))).alias(f"d{side}")
    df = base.join(found.groupBy("row").agg(count(0), count(1)), "row")
    return df.select(
        key,
        "n_chars",
        "edited_sha256",
        fingerprint(sketch(F.col("own"))).alias("fingerprint"),
        fingerprint(sketch(F.col("edited"))).alias("edited_fingerprint"),
        likeness(F.size("own"), F.size("edited"), F.col("d0")).alias("near_edited"),
        likeness(F.size("own"), F.size("after"), F.col("d1")).alias("near_next"),
    )
