"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links make.

Texts become sets of hashed word shingles; equal sets are one class, and classes are what is joined. Two sets link when
``den * |A & B| >= num * |A | B|``, which is an overlap of T = ceil(num * (|A| + |B|) / (num + den)) at least.

Dealing out, for links of sets that differ little. The sizes fall into bands. Linked sets of a band differ in at most d
elements, so if elements are dealt into K = d + 1 + E parts by a hash, at least E + 1 parts hold the same elements in both,
and with few empty parts one of these is not empty: a key of (band, part, its elements) that both sets have. Sets with more
than E empty parts have keys for empty parts too, so no link is lost. A set with e empty parts shares more than s = K - d -
e - 1 of its other keys with every partner.

Dealing out, for other links, where parts would be of few elements and shared by chance. All elements have one order, the
rare ones first. A set of n elements shares m = ceil(num * n / den) at least with each partner, and its first n - m + 1 + s
elements are its keys, with a reserve s that depends on m only and grows no faster than m. Of the elements that two linked
sets share, the first 1 + s are keys of both, for the larger s of the two. Passages that very many texts share come last in
the order, so their elements are keys only of texts that consist of little else. How often elements occur is counted while
the texts are signed, and only for the order: where rare ones are not told apart nothing is lost, as any order gives the
same links.

Cells. Keys of only one class lead nowhere; the others have their smallest class as pivot, and all classes that have the
same pivot form a cell. Linked classes always meet in a cell.

Frequent keys. A set shares more than s of its keys with every partner. So it may give up the s of its keys that come last in
an order that is the same for all sets: of the keys that two linked sets share, both keep the one that comes first. This
order is by the number of classes, so that what goes are the keys of passages that very many texts share, and their cells
with them. And a set that shares no more than s keys with all others together has no partner at all, and is in no cell.

Search. A cell is cut into chunks of bounded size, each with the pivot. In a chunk an inverted index of its sets is
searched for sets: the lists are divided by length, the short ones are merged for the sets that occur T - L times at
least, these are looked up in the L long lists by binary search (if they are many, the long lists are merged as well), and
those that reach T are linked. The pivot is searched
first, then every set outside the largest component so far, which is enough to find all components. A chunk returns its
components, not its pairs. Cells of several chunks whose members are still in several components get a second search, of
all members outside the cell's largest component against every chunk, in blocks. So a group of near copies costs its
size, not its square.

Names. A class is known by a 64-bit hash of its set; sets that share one but differ in a second hash are found by an
aggregate over all classes and known by the second, so that only equal 128 bits are taken for equal sets. Keys of 56 bits
that coincide by chance only put classes into a cell.

Defined cases: null, empty and blank texts have no shingles and link with nothing; texts with fewer words than a shingle
are one shingle; rows with the same id count as one document; rows with a null id get no component (null); an empty
table gives an empty result. Ids are whole numbers (or strings of digits; other strings count as null). Shingles are
hashes of 64 bits: two that coincide by chance count as one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spotlattice.llm.components import components
from spotlattice.llm.shingles import mix, set_id, shingle_sets
from spotlattice.llm.util import release_memory, sized_broadcast, stored

_U = np.uint64
#: Sets and elements in a chunk of a cell, at most (a single larger set is a chunk of its own).
CHUNK_SETS, CHUNK_ELEMENTS = 512, 500_000
#: Keys of fewer entries are never given up; their cells are small.
FREQUENT = 32
#: Parts of so many elements are seldom shared by chance; where they would have fewer, keys are single elements.
LARGE_PARTS = 6
#: Slots of the table of frequent elements, and how many of them are looked for: in all, in a task, and in each piece of so
#: many elements of a task.
SLOTS, OFTEN, OFTEN_IN_TASK, PIECE = 1 << 22, 1 << 17, 1 << 14, 1 << 20
_RATIO = 1.5


@lru_cache(maxsize=16)
def bands(num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, parts, empty parts allowed) of each band, for sizes up to 2**40."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = math.floor(lo * _RATIO)
        d = (den - num) * 2 * hi // (den + num)
        least, empty = max(1, lo * num // den), 0
        for _ in range(3 if d else 0):
            parts = d + 1 + empty
            expected = parts * math.exp(-least / parts)
            empty = min(d + 1, math.ceil(expected + 5 * math.sqrt(expected)))
        out.append((lo, hi, d + 1 + empty, empty))
        lo = hi + 1
    return out


def keys_of(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one set by parts, and for each a code: how many keys of its band may be given up, times 4, plus the band
    modulo 4.

    Two linked sets of different elements share a key, also after each has given up its last ones.
    """
    n, out, codes = len(s), [np.zeros(0, _U)], [np.zeros(0, np.uint16)]
    with np.errstate(over="ignore"):
        for k, (lo, hi, parts, empty) in enumerate(bands(num, den)):
            if hi < n or lo > n * den // num:
                continue
            if parts == 1:
                continue  # sets of this band link only if they are equal
            salt = mix(np.array([k + 1], _U) * _U(0xC2B2AE3D27D4EB4F))
            part = mix(s ^ salt) % _U(parts)
            order = np.argsort(part, kind="stable")
            at = part[order]
            first = _runs(at)
            sums = np.add.reduceat(mix(s[order] + salt), first)
            found = mix(sums + mix(at[first] + salt * _U(3)))
            gone = parts - len(first)
            spare = empty - gone  # K - d - e - 1
            if gone > empty:
                missing = np.setdiff1d(np.arange(parts, dtype=_U), at[first])
                found, spare = np.concatenate([found, mix(mix(missing + salt * _U(5)) + _U(1))]), 0
            out.append(found)
            codes.append(np.full(len(found), min(spare, 16383) * 4 + k % 4, np.uint16))
    return np.concatenate(out).view(np.int64), np.concatenate(codes)


def first_keys(s: np.ndarray, num: int, den: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one set by the order of elements, and codes, as ``keys_of`` has them but without bands.

    ``rank`` has a number from 0 to 255 for each slot of the elements' hashes: keys are elements of low ranks.
    """
    n = len(s)
    if n * den // num == n:  # the set links only with its equals
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    m = -(-num * n // den)
    spare = max(0, min(m - 1, 1 + m // 6, 16383))
    keep = n - m + 1 + spare
    with np.errstate(over="ignore"):
        order = mix(s + _U(0xC2B2AE3D27D4EB4F)) >> _U(8) | rank[s & _U(len(rank) - 1)].astype(_U) << _U(56)
        found = mix(s[np.argpartition(order, keep - 1)[:keep]] if keep < n else s)
    return found.view(np.int64), np.full(len(found), spare * 4, np.uint16)


class Index:
    """An inverted index of sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets])
        elements = np.concatenate(sets)
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(elements, kind="stable")
        ordered = elements[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.elements, self.owner = ordered[first], owner[order]
        self.first = np.append(first, len(ordered))
        self.length = np.diff(self.first)
        self.flat = np.repeat(np.arange(len(first)), self.length) * self.n + self.owner  # sorted: by list, then owner

    def search(self, s: np.ndarray, num: int, den: int, skip: Callable[[int], bool], own: bool) -> Iterator[int]:
        """The indexed sets that link with s, but for those that ``skip`` tells. With ``own`` s is one of them itself, and
        lists in which there is nothing but s are left out."""
        a = len(s)
        least = max(1, -(-num * (a - (-a * num // den)) // (num + den)))  # T for the smallest set that can link
        lists = self._lists(s)
        lists = lists[self.length[lists] > int(own)]
        if len(lists) < least:
            return
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        longest = int(self.length[lists[-1]])
        n_long = min(least - 1, len(lists), int(least / (0.01 * math.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        probe = np.sort(long) * self.n
        occurs = self._occurs(short)
        found = np.flatnonzero((occurs >= least - n_long) & (self.sizes * den >= a * num) & (self.sizes * num <= a * den))
        found = [c for c in found.tolist() if not skip(c)]
        if len(found) * len(long) * 4 > self.length[long].sum():  # many to look up: the long lists are merged, too
            occurs, probe = occurs + self._occurs(long), probe[:0]
        for c in found:
            if skip(c):
                continue
            seen = int(occurs[c])
            if len(probe):
                key = probe + c
                to = np.searchsorted(self.flat, key)
                seen += int((self.flat[np.minimum(to, len(self.flat) - 1)] == key).sum())
            if seen * (num + den) >= num * (a + int(self.sizes[c])):
                yield c

    def _occurs(self, lists: np.ndarray) -> np.ndarray:
        """How many of some lists each set is in."""
        many = self.length[lists]
        at = np.arange(int(many.sum())) + np.repeat(self.first[lists] - np.cumsum(many) + many, many)
        return np.bincount(self.owner[at], minlength=self.n)

    def _lists(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.elements, s), len(self.elements) - 1)
        return at[self.elements[at] == s]


class Forest:
    def __init__(self, n: int):
        self.up, self.size, self.parts, self.top = list(range(n)), [1] * n, n, 0

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        if a != b:
            self.up[b] = a
            self.size[a] += self.size[b]
            self.parts -= 1
            top = self.find(self.top)
            self.top = a if self.size[a] > self.size[top] else top

    def in_top(self, x: int) -> bool:
        """Whether x is in the largest component."""
        return self.find(x) == self.find(self.top)


def chunk_edges(ids: list[int], sets: list[np.ndarray], asks: list[bool], num: int, den: int, pivot: int | None = None) -> list[tuple[int, int]]:
    """(id, smaller id) edges that span the components of one chunk.

    Without ``asks`` the pivot is searched among the others, then each set that is not in the largest component: of two
    linked sets in different components at the end one has been searched, so there are none. Else those that ask are
    searched among those that don't.
    """
    order = sorted(range(len(ids)), key=lambda i: (asks[i], ids[i] != pivot, ids[i]))
    ids, sets, asks = [ids[i] for i in order], [sets[i] for i in order], [asks[i] for i in order]
    forest, indexed = Forest(len(ids)), asks.count(False)
    if not indexed:
        return []
    index = Index(sets[:indexed])

    def search(q: int) -> None:
        for c in index.search(sets[q], num, den, lambda c: forest.find(c) == forest.find(q), q < indexed):
            forest.join(c, q)

    if indexed < len(ids):
        for q in range(indexed, len(ids)):
            search(q)
    else:
        search(0)
        todo = list(range(1, len(ids)))
        while todo and forest.parts > 1:
            later = []
            for q in todo:
                if forest.in_top(q):
                    later.append(q)
                else:
                    search(q)
            todo = [q for q in later if not forest.in_top(q)]
    roots: dict[int, int] = {}
    for i, x in enumerate(ids):
        r = forest.find(i)
        roots[r] = min(roots.get(r, x), x)
    return [(x, roots[forest.find(i)]) for i, x in enumerate(ids) if roots[forest.find(i)] != x]


def _search(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows(pivot, chunk, block, asks, cls, elements) -> edges(u, v), a chunk in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, asks = None, [], [], []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if len(ids) > 1:
                out.extend(chunk_edges(ids, sets, asks, num, den, at[0]))

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["u", "v"])
            out.clear()
            return got

        for b in batches:
            pivot, chunk, block, ask, cls = (b.column(i).to_pylist() for i in range(5))
            lists = b.column(5)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(_U)
            for i in range(b.num_rows):
                if (pivot[i], chunk[i], block[i]) != at:
                    flush()
                    at, ids, sets, asks = (pivot[i], chunk[i], block[i]), [], [], []
                ids.append(cls[i])
                asks.append(ask[i])
                sets.append(values[ends[i] : ends[i + 1]].copy())
            if out:
                yield batch()
        flush()
        yield batch()
        release_memory()

    key = ["pivot", "chunk", "block"]
    dealt = rows.select(*key, "asks", "cls", "elements").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "u long, v long")


def namer(clashing: frozenset[int] = frozenset(), bits: int = 64) -> Callable[[np.ndarray], int]:
    """A function that names sets: by ``bits`` of their hash, or by their second hash where others have the same name."""
    return lambda s: c if (c := set_id(s) >> (64 - bits)) not in clashing else set_id(s, second=True)


def _signed(text: str, width: int, bits: int = 64) -> Column:
    """struct(n, cls, chk) of a text; cls and chk, the second hash, are null where there are no shingles."""
    name = namer(bits=bits)

    @F.pandas_udf("n long, cls long, chk long")
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(s), name(s), set_id(s, second=True)) if len(s) else (0, None, None) for s in shingle_sets(texts, width)]
        # Not by way of a float column, which would round the classes of a batch with an empty text.
        whole = lambda i: pd.array([r[i] for r in rows], dtype="Int64")
        return pd.DataFrame({"n": [r[0] for r in rows], "cls": whole(1), "chk": whole(2)}, index=texts.index)

    return sign(text)


def _counted(docs: DataFrame, width: int, bits: int, often: bool) -> DataFrame:
    """(id, text) -> (id, n, cls, chk) of every row, with often false, and (null, count, element, null), with often true,
    for the most frequent elements of each task if they are asked for: at least so many rows of it have them."""
    name = namer(bits=bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        elements, counts = np.zeros(0, _U), np.zeros(0, np.int64)

        def count() -> None:
            nonlocal elements, counts
            piece, c = np.unique(np.concatenate(held), return_counts=True)
            piece, c = np.concatenate([elements, piece[c > 1]]), np.concatenate([counts, c[c > 1]])
            elements, at = np.unique(piece, return_inverse=True)
            counts = np.bincount(at, c, len(elements)).astype(np.int64)
            if len(elements) > 8 * OFTEN_IN_TASK:
                top = np.argsort(-counts, kind="stable")[: 4 * OFTEN_IN_TASK]
                elements, counts = elements[top], counts[top]
            held.clear()

        for b in batches:
            rows = []
            for s in shingle_sets(b["text"], width):
                rows.append((len(s), name(s), set_id(s, second=True)) if len(s) else (0, None, None))
                if often:
                    held.append(s)
                    size += len(s)
                if size >= PIECE:
                    count()
                    size = 0
            # Not by way of a float column, which would round the classes of a batch with an empty text.
            whole = lambda i, rows=rows: pd.array([r[i] for r in rows], dtype="Int64")
            yield pd.DataFrame({"id": b["id"].array, "n": whole(0), "cls": whole(1), "chk": whole(2), "often": False})
        if held:
            count()
        top = np.argsort(-counts, kind="stable")[:OFTEN_IN_TASK]
        top = top[counts[top] > 2]
        none = pd.array([None] * len(top), dtype="Int64")
        yield pd.DataFrame({"id": pd.array([None] * len(top), dtype=object), "n": counts[top], "cls": elements[top].view(np.int64), "chk": none, "often": True})
        release_memory()

    # Ids by way of text: a column of whole numbers with nulls would come as floats.
    slim = docs.select(F.col("id").cast("string").alias("id"), "text")
    made = slim.mapInPandas(run, "id string, n long, cls long, chk long, often boolean")
    return made.withColumn("id", F.col("id").cast("long"))


def _ranks(often: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """For each slot of the hashes a number that grows with the count of its most frequent element; 0 for all others."""
    rank = np.zeros(slots, np.uint8)
    top = often.groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(OFTEN).collect()
    at = np.array([r["cls"] for r in top], np.int64).view(_U) & _U(slots - 1)
    np.maximum.at(rank, at.astype(np.int64), np.array([min(255, int(8 * math.log2(r["n"]))) for r in top], np.uint8))
    return rank


def _classes(docs: DataFrame, width: int, bits: int, most: int = 100_000, ranked: bool = False) -> tuple[DataFrame, DataFrame, frozenset[int], np.ndarray | None]:
    """(id, text) -> signatures (id, n, cls), classes (cls, id, n) of rows with an id, the names that clashed, and the ranks
    of elements if they are asked for."""
    both = stored(_counted(docs, width, bits, ranked), "signatures")
    raw = both.where("not often").select("id", "n", "cls", "chk")
    by = raw.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
    by = stored(by, "classes")
    # Of 10**10 classes about three pairs share 64 bits.
    clashing = frozenset(r["cls"] for r in by.where("lo <> hi").select("cls").limit(most + 1).collect())
    if len(clashing) > most:
        raise RuntimeError("the names of sets have too few bits")
    if clashing:
        raw = raw.withColumn("cls", F.when(F.col("cls").isin(*clashing), F.col("chk")).otherwise(F.col("cls")))
        by = stored(raw.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.max("n").alias("n")), "classes")
    return raw.select("id", "n", "cls"), by.where("id is not null").select("cls", "id", "n"), clashing, _ranks(both.where("often")) if ranked else None


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _least(keys: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first entry of each key is and where the others are, by key and then class (the first of ``others``);
    an entry that repeats both is left out."""
    cls = others[0]
    order = np.lexsort((cls, keys))
    k, c = keys[order], cls[order]
    order = order[np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])] if len(k) else order
    first = np.zeros(len(order), bool)
    first[_runs(keys[order])] = True
    return order[first], order[~first]


_PACK = "bucket int, late int, low binary, cls binary, code binary, n binary"
_SHARED = "pivot long, cls long, code int, c long, key long, n long"


def _shared_keys(docs: DataFrame, width: int, num: int, den: int, n_buckets: int, name: Callable[[np.ndarray], int], rank: np.ndarray | None = None, flush: int = 1 << 18) -> DataFrame:
    """(id, text) -> for keys of several classes (pivot, cls, code, c), pivots among them, with the key's smallest class as
    pivot and the number c of such keys, at least; of keys with FREQUENT entries or more, (cls, code, 1, key, n) instead,
    with the number n of entries.

    Keys are sorted and packed, some hundred thousand at a time. Of each key a pack has its smallest class first and apart from
    the others, so that what must be held together of a key in its bucket is one class a pack; the others stream past.
    A key of very many classes thus needs no memory for them.
    """

    ranks = docs.sparkSession.sparkContext.broadcast(None if rank is None else rank.tobytes())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = None if ranks.value is None else np.frombuffer(ranks.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows_of(late: int, keys: np.ndarray, cls: np.ndarray, code: np.ndarray, n: np.ndarray) -> list[tuple]:
            if not len(keys):
                return []
            bucket = ((keys >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)
            first = _runs(bucket)
            low = (keys & _U(0xFFFFFFFF)).astype(np.uint32)
            return [(int(bucket[i]), late, low[i:j].tobytes(), cls[i:j].tobytes(), code[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(first, np.append(first[1:], len(keys)), strict=True)]

        def flushed() -> pd.DataFrame:
            keys, cls, code = (np.concatenate(x) for x in zip(*held, strict=True))
            keys = keys.view(_U)
            first, rest = _least(keys, cls)
            at = np.searchsorted(keys[first], keys[rest])
            n = (1 + np.bincount(at, minlength=len(first))).astype(np.uint32)
            out = rows_of(0, keys[first], cls[first], code[first], n) + rows_of(1, keys[rest], cls[rest], code[rest], np.zeros(0, np.uint32))
            return pd.DataFrame(out, columns=["bucket", "late", "low", "cls", "code", "n"])

        for batch in batches:
            for s in shingle_sets(batch["text"], width):
                keys, code = (keys_of(s, num, den) if rank is None else first_keys(s, num, den, rank)) if len(s) else ((), ())
                if len(keys):
                    held.append((keys, np.full(len(keys), name(s), np.int64), code))
                    size += len(keys)
                if size >= flush:
                    yield flushed()
                    held.clear()
                    size = 0
        if size:
            yield flushed()
        held.clear()
        release_memory()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, early, known = None, [], None

        def entries(low: np.ndarray, cls: np.ndarray, code: np.ndarray, first: bool = False) -> pd.DataFrame:
            """The rows of some entries; those that come first with their key are rows by themselves only if it is frequent."""
            one, least, total, own = known
            i = np.searchsorted(one, low)
            often = total[i] >= FREQUENT
            few = np.zeros(0, np.int64) if first else np.flatnonzero(~often & (least[i] != cls))
            pivot = least[i][few]
            both = np.concatenate([np.stack([pivot, cls[few], code[few].astype(np.int64)], 1), np.stack([pivot, pivot, own[i][few].astype(np.int64)], 1)])
            rows, c = np.unique(both, axis=0, return_counts=True)
            many = np.flatnonzero(often)
            key = (np.int64(at) << 32) | low[many].astype(np.int64)
            zero, none = np.zeros(len(rows), np.int64), np.zeros(len(many), np.int64)
            halves = {"pivot": (rows[:, 0], none), "cls": (rows[:, 1], cls[many]), "code": (rows[:, 2], code[many].astype(np.int64)), "c": (c, none + 1), "key": (zero, key), "n": (zero, total[i][many])}
            return pd.DataFrame({name: np.concatenate(h) for name, h in halves.items()})

        def met() -> tuple[tuple, list[pd.DataFrame]]:
            nonlocal known
            low, cls, code, n = (np.concatenate(x) for x in zip(*early, strict=True))
            order = np.argsort(low, kind="stable")
            total = np.add.reduceat(n[order].astype(np.int64), _runs(low[order]))
            first, rest = _least(low, cls)
            known = (low[first], cls[first], total, code[first])
            return known, [entries(low[first], cls[first], code[first], True), entries(low[rest], cls[rest], code[rest])]

        for batch in batches:
            for bucket, late, *fields in zip(*(batch[c] for c in ("bucket", "late", "low", "cls", "code", "n")), strict=True):
                low, cls, code, n = (np.frombuffer(f, t) for f, t in zip(fields, (np.uint32, np.int64, np.uint16, np.uint32), strict=True))
                if bucket != at:
                    if early and known is None:
                        yield from met()[1]
                    at, early, known = bucket, [], None
                if late:
                    if known is None:
                        yield from met()[1]
                    yield entries(low, cls, code)
                else:
                    early.append((low, cls, code, n))
        if early and known is None:
            yield from met()[1]
        early, known = [], None
        release_memory()

    packed = docs.select("text").mapInPandas(pack, _PACK)
    parts = max(1, min(n_buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket", "late").mapInPandas(meet, _SHARED)


def _members(shared: DataFrame, salt_each: int = 4096) -> DataFrame:
    """The distinct (pivot, cls) of all cells of two classes at least, when classes without enough shared keys are left
    out and every other class has given up its most frequent ones."""
    spare, frequent = F.shiftright("code", 2), F.col("n") > 0
    own = shared.groupBy("cls", "code").agg(F.sum("c").alias("c"), F.collect_set(F.when(~frequent, F.col("pivot"))).alias("ps"), F.collect_set(F.when(frequent, F.struct("n", "key"))).alias("ks"))
    own = stored(own.where(F.col("c") > spare), "owned")
    kept = own.withColumn("k", F.explode(F.slice(F.sort_array("ks", asc=False), spare + 1, F.greatest(F.size("ks"), F.lit(1))))).select("cls", "k.n", "k.key")
    # A key may have a large part of all classes: its rows meet their pivot in as many tasks as they need.
    salts = F.greatest(F.ceil(F.col("n") / F.lit(salt_each)), F.lit(1)).cast("int")
    pivots = kept.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("n").alias("n"), F.count("*").alias("c")).where("c > 1")
    pivots = pivots.select("key", "pivot", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    often = kept.withColumn("salt", F.pmod(F.xxhash64("cls"), salts).cast("int")).join(pivots, ["key", "salt"]).select("pivot", "cls")
    every = stored(own.select(F.explode("ps").alias("pivot"), "cls").unionByName(often).distinct(), "pairs")
    alone = every.groupBy("pivot").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).where("c = 1").select("pivot", "cls")
    return every.join(alone, ["pivot", "cls"], "left_anti")  # by both, as a pivot may have very many


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int, name: Callable[[np.ndarray], int], bits: int = 1 << 25) -> DataFrame:
    """(id, cls, elements) of the texts of at least each wanted (id, cls); texts are not shuffled.

    A bitmap of the wanted ids, of a fixed size, goes to every task: where it is full it only prunes less. What comes is to
    be joined by id and class, so that a set with very many copies does not send them all to one task.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    maps = wanted.select((slot + 1).alias("b"))  # the bitmap functions count from 1
    maps = maps.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    table = np.zeros(bits // 8 + 4096, np.uint8)
    for k, m in maps.collect():
        table[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, seen = np.frombuffer(shared.value, np.uint8), set()
        for b in batches:
            slots = b["slot"].to_numpy()
            # bit positions count from the lowest bit of a byte
            b = b[(have[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)]
            for lo in range(0, len(b), 256):
                part, out = b[lo : lo + 256], []
                for i, s in zip(part["id"], shingle_sets(part["text"], width), strict=True):
                    if len(s) and (row := (i, name(s))) not in seen:  # of rows that repeat both, one a task
                        seen.add(row)
                        out.append((*row, s.view(np.int64)))
                yield pd.DataFrame(out, columns=["id", "cls", "elements"])
        release_memory()

    made = docs.select("id", slot.alias("slot"), "text").mapInPandas(run, "id long, cls long, elements array<long>")
    return made.dropDuplicates(["id", "cls"])


def _chunks(c: str, e: str) -> Column:
    return F.greatest(F.ceil(F.col(c) / F.lit(CHUNK_SETS)), F.ceil(F.col(e) / F.lit(CHUNK_ELEMENTS))).cast("int")


def _same_id(known: DataFrame) -> DataFrame:
    """Edges between the classes of each id that has several."""
    several = stored(known.groupBy("id").agg(F.min("cls").alias("v"), F.max("cls").alias("most")).where("v <> most").select("id", "v"), "several")
    return known.join(several, "id").where("cls <> v").select(F.col("cls").alias("u"), "v").distinct()


def link_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 4, den: int = 5, bits: int = 64) -> DataFrame:
    """key, n_shingles and component_id (the smallest id that links reach) of every row of docs.

    Rows with one id are one document, so they have one component, also if their texts are not alike. ``bits`` is the
    length of the names of sets before clashes are resolved.
    """
    return _grouped(docs, key, text, width, num, den, True, bits).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, key: str, text: str, width: int, num: int, den: int, by_id: bool, bits: int = 64) -> DataFrame:
    """id, n, cls, root (the component's own name) and component_id of every row; ids join classes only with ``by_id``."""
    slim = docs.select(F.expr(f"try_cast(`{key}` as long)").alias("id"), F.col(text).alias("text"))
    texts = slim.where("id is not null")
    # Parts of linked sets have (num + den) / 2 / (den - num) elements or so.
    signed, classes, clashing, rank = _classes(slim, width, bits, ranked=num + den < LARGE_PARTS * 2 * (den - num))
    name = namer(clashing, bits)
    known = signed.where("cls is not null and id is not null")
    # Some hundred thousand keys a bucket: a word has 0.2 to 0.6 of them.
    words = (signed.agg(F.sum("n")).first()[0] or 0) + 1
    n_buckets = int(min(1 << 24, max(16, words * (3 if rank is None else 2) * (den - num) / den / 2.5e5)))
    members = _members(stored(_shared_keys(texts, width, num, den, n_buckets, name, rank), "shared-keys"))
    members = stored(members.join(classes, "cls"), "members")
    # Cells of several chunks are few, so their sizes travel to the members and not the members to the sizes.
    large = stored(members.groupBy("pivot").agg(F.count("*").alias("c"), F.sum("n").alias("e")).select("pivot", _chunks("c", "e").alias("m")).where("m > 1"), "large")
    n_large = large.count()
    cells = members.join(sized_broadcast(large, n_large), "pivot", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    own = F.pmod(F.xxhash64("pivot", "cls"), F.col("m")).cast("int")
    placed = cells.withColumn("chunk", F.explode(F.when(F.col("cls") == F.col("pivot"), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array(own))))
    placed = placed.withColumns({"block": F.lit(0), "asks": F.lit(False)})
    edges = stored(_search(placed.join(_sets_of(texts, members, width, name), ["id", "cls"]), num, den), "links")
    if by_id:
        edges = edges.unionByName(_same_id(known))
    roots = components(edges)
    if n_large:
        blocks = stored(_unsettled(cells.where("m > 1"), placed, roots), "blocks")
        if not blocks.isEmpty():
            edges = edges.unionByName(stored(_search(blocks.join(_sets_of(texts, blocks, width, name), ["id", "cls"]), num, den), "links"))
            roots = components(edges)
    # The smallest document id of each component, by way of the classes.
    rooted = classes.join(roots.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    found = rooted.join(least, "root").select("cls", "root", "component_id")
    out = signed.join(found, "cls", "left")
    if by_id:
        # Rows without shingles follow the other rows of their id.
        blank = signed.where("cls is null and id is not null").select("id").distinct()
        other = stored(known.join(blank, "id").groupBy("id").agg(F.min("cls").alias("cls")).join(found, "cls").select("id", F.col("component_id").alias("__other")), "blank")
        if not other.isEmpty():
            out = out.join(other, "id", "left").withColumn("component_id", F.coalesce("component_id", "__other"))
    return out.select("id", "n", "cls", "root", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", small: int = 500_000, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs of which one of each group of texts stays: that with the smallest id.

    Rows with a null id stay. Texts of one id that no links join are judged apart, so none is lost with another; of several
    texts of a group with one id, the one with the smallest hash stays.
    """
    found = stored(_grouped(docs, key, text, width, num, den, False), "groups").where("id is not null")
    stays = F.col("id") == F.col("component_id")
    again = found.groupBy(F.col("id").alias("__key")).agg(F.count("*").alias("c"), F.max(~stays).alias("goes"), F.max(stays).alias("stays")).where("c > 1 or goes")
    again = stored(again, "leaving")
    # Broadcast only after a look at the size; a shuffle join beyond it.
    side = F.broadcast(again) if again.count() <= small else again
    kept = docs.join(side, F.col(key) == F.col("__key"), "left_anti")
    several = again.where("c > 1 and stays")
    if several.isEmpty():
        return kept
    rows = docs.join(several.select("__key"), F.col(key) == F.col("__key")).drop("__key").withColumn("__cls", _signed(text, width)["cls"])
    groups = found.where(stays).select(F.col("id").alias("__key"), F.col("cls").alias("__of"), F.col("root").alias("__root")).distinct()
    rows = rows.join(groups, (F.col(key) == F.col("__key")) & F.col("__cls").eqNullSafe(F.col("__of")))
    first = rows.withColumn("__r", F.row_number().over(W.partitionBy(key, "__root").orderBy(F.xxhash64(text), text))).where("__r = 1")
    return kept.unionByName(first.select(*docs.columns))


def _unsettled(cut: DataFrame, placed: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks for the members outside the largest component of their cell, against every chunk of it."""
    now = cut.join(roots.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    most = now.groupBy("pivot", "root").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    outside = now.join(most, "pivot").where("root <> top.root")
    load = outside.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / F.lit(CHUNK_SETS)), F.ceil(F.sum("n") / F.lit(CHUNK_ELEMENTS))).cast("int").alias("blocks"))
    asking = outside.join(load, "pivot").select("pivot", "id", "cls", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("chunk"), F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("asks"))
    asked = placed.where("m > 1").join(load, "pivot").select("pivot", "id", "cls", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"))
    return asking.unionByName(asked)
